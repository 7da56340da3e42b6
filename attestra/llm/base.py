"""Session helpers shared by the operators: scratch tables and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled by one numpy call; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 19
#: Bytes that a task gathers before it writes them to a scratch table; bounds an executor's heap.
ROW_GROUP_BYTES = 32 << 20


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors, from ``spark.checkpoint.dir``.

    Only where the session names none, and all runs on one machine (as in
    tests), is a temporary folder chosen and set as the checkpoint folder; on a
    cluster, executors would write to disks of their own, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="attestra-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/attestra/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(docs: DataFrame, text_bytes_each: int = 16 << 20) -> int:
    """How many parts what is gathered from these texts is dealt to: their number follows the texts' bytes, whatever the session's is."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    return max(shuffle_partitions(docs.sparkSession), -(-total // text_bytes_each))


def with_identity(docs: DataFrame) -> DataFrame:
    """Add ``_d`` (doc_id; nulls sort last) and ``_t`` (hash of the text).

    Together they identify a document however often the input is scanned.
    Rows that agree in doc_id and text are one document.
    """
    seed = F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.lit(0))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_d"),
        F.xxhash64(seed, F.coalesce(F.col("text"), F.lit(""))).alias("_t"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, min(to, batch.num_rows) - at)
            at = to
