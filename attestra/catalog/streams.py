"""Streaming queries; each has a batch twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.catalog.base import Catalog, table
from attestra.sources.landing import land
from attestra.streaming import keyed, limits

C = Catalog()


def _events(spark: SparkSession, sf: str, files: int, closed: bool = False) -> DataFrame:
    events = table(spark, sf, "events")
    path = land(events)
    if closed:  # lands after the others, so that no batch is late for it
        last = events.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"))
        nobody = {"user_id": F.lit(-1).cast("long"), "event_id": F.lit(-1).cast("long"), "event_type": F.lit("end"), "value": F.lit(0.0), "props": F.lit("")}
        last.withColumns(nobody).select(*events.columns).write.mode("append").parquet(path)
    return limits.event_stream(spark, path, events.schema, files)


@C.add("rate_window_stream", "SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY ALL")
def rate_window_stream(spark: SparkSession, sf: str) -> DataFrame:
    found = limits.drain(limits.rate_windows(_events(spark, sf, 1), limit=2), "complete")
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@C.add(
    "lockout_stream",
    """WITH e AS (SELECT user_id, ts, event_id, event_type IN ('error', 'click') AS failed FROM events), i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e),
r AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM i)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS locked_at FROM r WHERE failed AND run % 5 = 0""",
)
def lockout_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Four files, one a batch; they may come in any order, and a last event of nobody, long after, lets the watermark pass them all."""
    rows = _events(spark, sf, 1, closed=True).select("user_id", "ts", "event_id", F.col("event_type").isin("error", "click").alias("failed"))
    found = limits.drain(limits.lockouts(rows, late="90 days"))
    return found.select("user_id", F.date_format("locked_at", "yyyy-MM-dd HH:mm:ss").alias("locked_at"))


@C.add(
    "token_families_stream",
    """WITH a AS (SELECT user_id AS family, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS replay FROM events)
SELECT family, event_id, replay, max(CASE WHEN replay THEN 1 ELSE 0 END) OVER (PARTITION BY family ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS revoked FROM a""",
)
def token_families_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Users stand for families, event types for their tokens."""
    rows = _events(spark, sf, 1, closed=True).select(F.col("user_id").alias("family"), "ts", "event_id", F.col("event_type").alias("what"))
    return limits.drain(keyed.token_families(rows, late="90 days")).filter("family >= 0")


_DEADLINE_DAYS = 12


@C.add(
    "audit_budget_stream",
    f"""WITH e AS (SELECT user_id AS audit_id, event_id, ts, event_type IN ('error', 'click') AS failed FROM events), i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER w AS g, ts - min(ts) OVER (PARTITION BY audit_id) <= INTERVAL {_DEADLINE_DAYS} DAY AS in_time FROM e WINDOW w AS (PARTITION BY audit_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY audit_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM i),
o AS (SELECT *, coalesce(bool_or(in_time AND run >= 3) OVER (PARTITION BY audit_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS opened FROM r)
SELECT audit_id, event_id, in_time AND NOT opened AS asked, CASE WHEN opened THEN 'breaker open' WHEN NOT in_time THEN 'deadline' END AS reason FROM o""",
)
def audit_budget_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Users stand for audits, errors and clicks for questions that fail."""
    what = F.when(F.col("event_type").isin("error", "click"), "failed").otherwise("answered")
    rows = _events(spark, sf, 1, closed=True).select(F.col("user_id").alias("audit_id"), "ts", "event_id", what.alias("what"))
    return limits.drain(keyed.audit_budget(rows, late="90 days", deadline_ms=_DEADLINE_DAYS * 86_400_000)).filter("audit_id >= 0")
