"""The shared scratch folder and what is stored there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH_SUBDIR = "millrace"

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor can reach.

    Where the setting is absent a local session gets a temporary folder. On a cluster such a
    folder would be visible to one machine only, so there the setting is demanded.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share")
    return _local_dirs.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="millrace-"))


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{SCRATCH_SUBDIR}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    This cuts lineage and fixes values that depend on how the plan ran (partition ids, sampled
    range bounds), and unlike executor-local storage it outlives a lost executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("error").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what `written` stored for this frame; nothing may read it any more."""
    path = getattr(df, "_scratch", None)
    if path is not None:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reaches; nothing happens if it is not there."""
    jvm = getattr(spark, "_jvm", None)  # a Connect session has none; its folder is cleaned from outside
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
