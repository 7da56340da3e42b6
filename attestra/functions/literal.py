"""Small literal tables that Spark and SQL both read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


@dataclass(frozen=True)
class Literal:
    """A literal table: columns as "name TYPE, .." in SQL types, values as Python literals (dates and times as text)."""

    columns: str
    rows: tuple

    def _columns(self) -> list[tuple[str, str]]:
        return [tuple(c.split()) for c in self.columns.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        plain = [(n, t if t not in ("DATE", "TIMESTAMP") else "VARCHAR") for n, t in self._columns()]
        out = spark.createDataFrame(list(self.rows), ", ".join(f"{n} {_SPARK[t]}" for n, t in plain))
        return out.selectExpr(*[f"CAST({n} AS {_SPARK[t]}) AS {n}" for n, t in self._columns()])

    def sql(self) -> str:
        def value(v) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return str(v).upper()
            return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

        names = [n for n, _ in self._columns()]
        casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in self._columns())
        body = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in self.rows)
        return f"(SELECT {casts} FROM (VALUES {body}) AS t({', '.join(names)}))"
