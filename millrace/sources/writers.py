"""File writers and kept results."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

# User-facing write modes and Spark's names; create leaves an existing target alone.
MODES = {
    "overwrite": "overwrite",
    "append": "append",
    "create": "ignore",
    "fail": "error",
}

# Parquet compression codecs users may ask for. Brotli needs a codec Spark does not ship.
COMPRESSIONS = ("snappy", "gzip", "lz4", "zstd", "none")


def _writer(df: DataFrame, mode: str) -> DataFrameWriter:
    if mode not in MODES:
        raise ValueError(f"Unknown write mode {mode!r}; one of {', '.join(MODES)}")
    return df.write.mode(MODES[mode])


def write_csv(df: DataFrame, path: str, delimiter: str = ",", mode: str = "overwrite", encoding: str = "utf-8") -> None:
    """Delimited text with a header line and every value in quotes."""
    writer = _writer(df, mode).option("sep", delimiter).option("header", "true").option("encoding", encoding)
    writer.option("quoteAll", "true").option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "overwrite") -> None:
    if compression.lower() == "brotli":
        raise ValueError("Spark ships no brotli codec; use zstd or gzip")
    if compression.lower() not in COMPRESSIONS:
        raise ValueError(f"Unknown compression {compression!r}; one of {', '.join(COMPRESSIONS)}")
    _writer(df, mode).option("compression", compression.lower()).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; null fields are written, so that every column can be read back."""
    _writer(df, mode).option("ignoreNullFields", "false").json(path)


def materialise(df: DataFrame, path: str | None = None, refresh: bool = False) -> DataFrame:
    """Keep a result so that later steps do not compute it again.

    Without a path it is persisted in executor memory and disk (call `unpersist` when done). With a
    path it is written there once and read back; a path names one result, so the caller picks a new
    one when settings change, or asks for a refresh.
    """
    if path is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    df.write.mode("overwrite" if refresh else "ignore").parquet(path)
    kept = df.sparkSession.read.parquet(path)
    if [(f.name, f.dataType.simpleString()) for f in kept.schema] != [(f.name, f.dataType.simpleString()) for f in df.schema]:
        raise ValueError(f"{path} holds another result ({kept.schema.simpleString()}); give another path or refresh it")
    return kept
