"""Tenants kept apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TenantScope:
    """Reads and writes for one tenant; there is none without a tenant."""

    tenant: str | int

    def __post_init__(self) -> None:
        if self.tenant is None or str(self.tenant).strip() == "":
            raise ValueError("a tenant is needed")

    def read(self, rows: DataFrame, column: str = "tenant_id") -> DataFrame:
        """The tenant's rows: a filter that Spark pushes to the scan, before any join or search."""
        return rows.filter(F.col(column) == F.lit(self.tenant))

    def foreign(self, rows: DataFrame, column: str = "tenant_id") -> DataFrame:
        """Rows of others; those without a tenant are nobody's."""
        return rows.filter(F.col(column).isNotNull() & (F.col(column) != F.lit(self.tenant)))

    def checked(self, rows: DataFrame, column: str = "tenant_id") -> DataFrame:
        """``rows``, failing where one belongs to another tenant; for reads and writes alike."""
        own: Column = F.col(column).isNull() | (F.col(column) == F.lit(self.tenant))
        return rows.withColumn(column, F.when(own, F.col(column)).otherwise(F.raise_error(F.lit("row of another tenant")).cast(dict(rows.dtypes)[column])))

    def append(self, rows: DataFrame, path: str, column: str = "tenant_id") -> None:
        """Rows added to a table's folder; one without a tenant gets this one, one of another tenant fails the write."""
        owned = rows.withColumn(column, F.coalesce(F.col(column), F.lit(self.tenant).cast(dict(rows.dtypes)[column])))
        self.checked(owned, column).write.mode("append").parquet(path)

    def erase(self, tables: dict[str, DataFrame], now: Column, column: str = "tenant_id") -> dict[str, DataFrame]:
        """Every table without the tenant's rows, and "journal": what was deleted, table by table."""
        out = {n: t.filter(F.col(column).isNull() | (F.col(column) != F.lit(self.tenant))) for n, t in tables.items()}
        parts = [self.read(t, column).agg(F.count("*").alias("deleted")).select(F.lit(n).alias("table_name"), "deleted", now.alias("at")) for n, t in tables.items()]
        journal = parts[0]
        for part in parts[1:]:
            journal = journal.unionByName(part)
        return out | {"journal": journal}
