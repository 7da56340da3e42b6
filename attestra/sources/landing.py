"""Folders that jobs share, and tables landed there as files for streams to pick up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the session names none, a temporary one on a single machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attestra-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def uri(path: str) -> str:
    """A path as file systems outside Spark take it, with its scheme."""
    if "://" in path:
        return path
    return "file://" + path.removeprefix("file:")


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read back: computed once, however often they are used."""
    path = f"{shared_dir(rows.sparkSession)}/kept/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def land(rows: DataFrame, files: int = 4, order: str = "ts") -> str:
    """Write ``rows`` as ``files`` Parquet files, ranged by ``order``, to a new folder; its path."""
    path = f"{shared_dir(rows.sparkSession)}/landed/{uuid.uuid4().hex}"
    rows.repartitionByRange(files, order).write.parquet(path)
    return path
