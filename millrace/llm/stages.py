"""Steps of a longer job: results stored in the shared folder, with what they were made from let go."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back; then let Spark drop the shuffle files behind it.

    A stored step outlives lost executors. Spark deletes the shuffle files of a finished step once the driver's garbage
    collector has seen that nothing refers to it; asking for that here keeps the disk need of a long job that of its
    largest step instead of that of all steps. Hand the frame over without keeping a name for it.
    """
    spark = df.sparkSession
    path, schema = scratch_path(spark, label), df.schema
    df.write.option("compression", "zstd").mode("error").parquet(path)
    del df
    gc.collect()
    jvm = getattr(spark, "_jvm", None)  # a Connect session has none
    if jvm is not None:
        jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path  # for millrace.session.discard
    return out


def partitions(spark: SparkSession) -> int:
    """The number of partitions that a shuffle is asked for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(df: DataFrame, n: int, *by: Column, rows: int | None = None) -> DataFrame:
    """At most n rows, with the smallest hashes of `by`; about n rows reach the driver however many tasks there are.

    Rows are counted first, if their number is not given, so that a share of the hash range gives some n rows and a half (and 50, so that few are never none); only those are sorted.
    """
    order = F.xxhash64(*by)
    share = min(1.0, (1.5 * n + 50) / max(df.count() if rows is None else rows, 1))
    some = df.withColumn("o", order).filter(F.pmod("o", F.lit(1 << 30)) <= int(share * (1 << 30)))
    return some.orderBy(*[F.col(c).asc() for c in ("o", *df.columns)]).limit(n)
