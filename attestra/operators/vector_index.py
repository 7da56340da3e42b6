"""Neighbours within a tenant from an index of cells, exact without reading all of them.

A tenant's vectors are dealt to cells, each around one of them; the index is
Parquet partitioned by tenant and cell, and the cells' centres and radii (the
largest angle to a member) are a table of their own.  By the triangle
inequality no member of a cell is nearer to a query than the angle to the
centre less the radius.  The nearest cell is read first; its k-th distance is a
bound, and of the other cells only those are read that may hold something
within it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.vectors import cosine_distance
from attestra.operators import retrieval

#: Cells of a tenant at most; about the root of its vectors otherwise.
CELLS = 256
#: Distances are rounded to six digits, so bounds are kept this far apart.
ROUNDING = 1e-6


def checked_dimension(vector: Column, n: int) -> Column:
    """``vector``, failing where it hasn't ``n`` components; null stays null."""
    wrong = F.raise_error(F.concat(F.lit(f"a vector of {n} components is needed, not of "), F.size(vector).cast("string")))
    return F.when(vector.isNull() | (F.size(vector) == n), vector).otherwise(wrong.cast("array<double>"))


def _angle(distance: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance)))


@dataclass(frozen=True)
class Index:
    """``vectors``: tenant, cell, id, vector, in folders by tenant and cell; ``cells``: tenant, cell, centre, radius, n."""

    spark: SparkSession
    path: str

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")


def build(rows: DataFrame, path: str, dimension: int, cells: int = CELLS) -> Index:
    """An index of rows (tenant, id, vector); null vectors are in none, others must have ``dimension`` components.

    Centres are the tenant's vectors whose ids' hashes fall below a share that
    gives about the root of their number, ``cells`` at most, and the one with
    the least hash, so that there is one.
    """
    rows = rows.filter("vector is not null").select("tenant", F.col("id").cast("long").alias("id"), checked_dimension(F.col("vector").cast("array<double>"), dimension).alias("vector"))
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sizes = rows.groupBy("tenant").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    share = F.least(F.sqrt("n"), F.lit(float(cells))) / F.col("n") * (1 << 30)
    chosen = rows.join(sizes, "tenant").filter((order < share) | (order == F.col("first"))).select("tenant", F.col("id").alias("cell"), F.col("vector").alias("centre"))
    near = retrieval.nearest(rows.withColumnRenamed("id", "query_id"), chosen.select("tenant", (-F.col("cell") - 1).alias("id"), F.col("centre").alias("vector")), 1, on=["tenant"])
    placed = near.select(F.col("query_id").alias("id"), (-F.col("id") - 1).alias("cell"), "distance")
    spark = rows.sparkSession
    rows.join(placed, "id").hint("rebalance", "tenant", "cell").write.partitionBy("tenant", "cell").parquet(f"{path}/vectors")
    kept = spark.read.parquet(f"{path}/vectors").withColumn("tenant", F.col("tenant").cast(rows.schema["tenant"].dataType))
    radii = kept.groupBy("tenant", "cell").agg(F.max(_angle(F.col("distance") + ROUNDING)).alias("radius"), F.count("*").alias("n"))
    chosen.join(radii, ["tenant", "cell"]).write.parquet(f"{path}/cells")
    return Index(spark, path)


def search(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """query_id, rank, id, distance of the k nearest of each query (query_id, tenant, vector) in its tenant; and query_id, cells, read: how many cells there are and were read.

    A query isn't its own neighbour; ties go to the smaller id.
    """
    kind = queries.schema["tenant"].dataType
    vectors = index.vectors.withColumn("tenant", F.col("tenant").cast(kind)).select("id", "vector", "tenant", F.col("cell").cast("long").alias("cell"))
    asked = queries.filter("vector is not null").select("query_id", "tenant", F.col("vector").cast("array<double>").alias("vector"))
    met = asked.join(index.cells.withColumn("tenant", F.col("tenant").cast(kind)), "tenant").withColumn("angle", _angle(cosine_distance(F.col("vector"), F.col("centre"))))
    nearest_cell = met.groupBy("query_id").agg(F.min(F.struct("angle", "cell")).alias("m")).select("query_id", F.col("m.cell").alias("first"))
    met = met.join(nearest_cell, "query_id").withColumn("low", 1 - F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius"))))
    look = lambda pairs: retrieval.nearest(pairs.select("query_id", "vector", "tenant", "cell"), vectors, k, on=["tenant", "cell"])
    one = look(met.filter("cell = first"))
    bound = one.filter(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
    open_ = met.join(bound, "query_id", "left").filter((F.col("cell") != F.col("first")) & (F.col("bound").isNull() | (F.col("low") <= F.col("bound") + 2 * ROUNDING)))
    found = retrieval.ranked(one.unionByName(look(open_)), k)
    read = open_.groupBy("query_id").agg(F.count("*").alias("more"))
    told = met.groupBy("query_id").agg(F.count("*").alias("cells")).join(read, "query_id", "left").select("query_id", "cells", (1 + F.coalesce("more", F.lit(0))).alias("read"))
    return found, told
