"""Writers: replaced partitions, JSON reports, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, *keys: str) -> None:
    """Delete-then-insert by key: partitions that ``rows`` has are replaced, the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def json_report(metrics: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One JSON document a row for each document, with the metrics (one row) in each."""
    by = verdicts.groupBy("document").agg(F.array_sort(F.collect_list(F.struct(*[c for c in verdicts.columns if c != "document"]))).alias("verdicts"))
    head = metrics.select(F.struct("*").alias("metrics"))
    return by.crossJoin(F.broadcast(head)).select("document", F.to_json(F.struct("document", "metrics", "verdicts")).alias("report"))
