"""The scheduler as a stream of ticks whose effects happen once.

A micro-batch is one tick (of several times in it the last counts).  Before it
changes anything the tick pins the versions that it starts from; both steps,
the watch over regulations and the schedules that are due, are computed from
those, and every table takes their rows by key in a commit that carries the
tick's token.  So a batch that fails between two commits and comes again
computes the same rows, and commits only what is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestra.operators import lifecycle
from attestra.sources.snapshots import Table

#: The tables of the scheduler and the keys of their rows; ``pins`` has the versions that ticks started from.
KEYS = {
    "frameworks": ["code"], "versions": ["code", "version_label"], "audits": ["audit_id"], "documents": ["audit_id", "storage_key"],
    "schedules": ["schedule_id"], "notifications": ["notification_id"], "pins": ["token", "name"],
}
NOTIFICATIONS = "notification_id string, org_id long, kind string, about string"
PINS = "token string, name string, version long"


def open_tables(spark, path: str, buckets: int = 16) -> dict[str, Table]:
    """The scheduler's tables under one folder; notifications and pins are made empty where they are missing."""
    tables = {name: Table(spark, f"{path}/{name}", keys, buckets) for name, keys in KEYS.items()}
    for name, schema in (("notifications", NOTIFICATIONS), ("pins", PINS)):
        if tables[name].version() is None:
            tables[name].replace(spark.createDataFrame([], schema), token="made")
    return tables


def _pinned(tables: dict[str, Table], token: str) -> dict[str, DataFrame]:
    """The tables as they were when the tick of this token first began."""
    known = {r["name"]: r["version"] for r in tables["pins"].read().filter(F.col("token") == token).collect()}  # a row a table
    if not known:
        known = {name: t.version() for name, t in tables.items() if name != "pins"}
        tables["pins"].upsert(tables["pins"].spark.createDataFrame([(token, *kv) for kv in known.items()], PINS), token=token)
    return {name: tables[name].read(version) for name, version in known.items()}


def tick(tables: dict[str, Table], fetched: DataFrame, now: str, token: str, between: Callable[[str], None] = lambda step: None) -> None:
    """One tick at a time (as text); ``between`` is called before each commit, with its name."""
    was, at = _pinned(tables, token), F.lit(now).cast("timestamp_ntz")

    def commit(name: str, step: str, rows: DataFrame) -> None:
        between(f"{step} {name}")
        tables[name].upsert(rows, token=f"{token} {step}")

    def told(rows: DataFrame, about: str) -> DataFrame:
        key = F.sha2(F.concat_ws("\x00", F.lit(token), F.col("org_id").cast("string"), "kind", F.col(about).cast("string")), 256)
        return rows.select(key.alias("notification_id"), F.col("org_id").cast("long").alias("org_id"), "kind", F.col(about).cast("string").alias("about"))

    def changed(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*was[name].columns).exceptAll(was[name])

    seen = lifecycle.watch(was["frameworks"], fetched, was["versions"], was["audits"], at)
    commit("versions", "watch", changed("versions", seen["versions"]))
    commit("notifications", "watch", told(seen["watch_notifications"], "framework"))
    commit("frameworks", "watch", changed("frameworks", seen["frameworks"]))
    run = lifecycle.rerun(was["schedules"], was["audits"], was["documents"], at)
    framework = run["audits"].join(was["audits"].select(F.col("audit_id").alias("source_audit_id"), "framework"), "source_audit_id")
    commit("audits", "schedules", framework.select("audit_id", "org_id", "framework"))
    commit("documents", "schedules", run["documents"])
    commit("notifications", "schedules", told(run["notifications"], "schedule_id"))
    commit("schedules", "schedules", changed("schedules", run["schedules"]))


def start(ticks: DataFrame, tables: dict[str, Table], fetched: Callable[[], DataFrame], checkpoint: str, between: Callable[[str], None] = lambda step: None) -> StreamingQuery:
    """Run the scheduler for a stream of times (``at``); the checkpoint is the lock that keeps a second scheduler from the same ticks."""

    def turn(batch: DataFrame, number: int) -> None:
        last = batch.agg(F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss").alias("at")).first().at
        if last is not None:
            tick(tables, fetched(), last, f"tick-{number}", between)

    return ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(turn).trigger(availableNow=True).start()
