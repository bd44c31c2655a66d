"""Cutting lineage: tables written to the folder that all executors share, read again, and deleted when nobody needs them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where that is unset and everything runs in one process (tests), a new local one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        in_use = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = in_use.get() if in_use.isDefined() else None
    if not set_dir:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it again; survives the loss of any executor."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    WRITTEN.add(path)
    return out


#: Tables of this process that are still there.
WRITTEN: set[str] = set()


def forget(df: DataFrame) -> None:
    """Delete what `written` wrote for df; nothing may read it any more."""
    _delete(df.sparkSession, df.written_to)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this process wrote on its way; for callers that have stored what they wanted."""
    for path in list(WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    WRITTEN.discard(path)
