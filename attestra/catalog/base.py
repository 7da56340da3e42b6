"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.literal import Literal as Literal

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name, with the SQL that says the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def take(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with where each row stands in it, ``row``, for sums that depend on the order of what they add."""
    return table(spark, sf_dir, name).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("row"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt over all cores if their files give fewer splits than there are cores; of larger tables, as read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns wanted of the documents, for work that takes long a row."""
    return spread(table(spark, sf_dir, "documents").select(*columns), "doc_id")
