"""Process only what is new since the last run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_path

BATCH_COLUMN = "batch_id"


def run_incremental(
    spark: SparkSession,
    input_dir: str,
    schema: T.StructType | str,
    transform: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    format: str = "parquet",
    max_files_per_batch: int | None = None,
    **options: str,
) -> int:
    """Read the files that arrived since the last run, transform them, and add the result to `output`.

    Returns the number of batches processed. Progress is kept in `checkpoint`. The output is Parquet
    partitioned by batch. A batch that is repeated after a failure first deletes what it wrote before, also if
    it now has no rows, so every file counts exactly once. `transform` sees one batch at a time.
    """
    reader = spark.readStream.format(format).schema(schema).options(**options)
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    done = []

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch).withColumn(BATCH_COLUMN, F.lit(batch_id).cast("long"))
        delete_path(spark, f"{output.rstrip('/')}/{BATCH_COLUMN}={batch_id}")
        rows.write.mode("append").partitionBy(BATCH_COLUMN).parquet(output)
        done.append(batch_id)

    stream = reader.load(input_dir).writeStream.foreachBatch(add)
    query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def incremental_result(spark: SparkSession, output: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Everything the runs have written so far; before the first output an empty frame of `schema`, if that is given."""
    try:
        return spark.read.parquet(output).drop(BATCH_COLUMN)
    except AnalysisException as missing:
        if schema is None or missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
