"""Schedules, retention, locks and breakers; the time is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import dates as D
from attestra.operators import ingestion


def due(schedules: DataFrame, now: Column) -> DataFrame:
    return schedules.filter(F.col("is_active") & (F.col("next_run_at") <= now))


def stale(watched: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Never checked, or not within the last hours."""
    return watched.filter(F.col("checked_at").isNull() | (F.col("checked_at") < now - F.make_dt_interval(F.lit(0), F.lit(hours))))


def advance(schedules: DataFrame, now: Column) -> DataFrame:
    """Due schedules with their source gone are switched off, the other due ones move on from now."""
    is_due = F.col("is_active") & (F.col("next_run_at") <= now)
    gone = F.col("source_audit_id").isNull()
    return schedules.withColumns({"next_run_at": F.when(is_due & ~gone, D.next_run(now, F.col("cadence"))).otherwise(F.col("next_run_at")), "is_active": F.col("is_active") & ~(is_due & gone)})


def rerun(schedules: DataFrame, audits: DataFrame, documents: DataFrame, now: Column) -> dict[str, DataFrame]:
    """One run of what is due: cloned audits with their documents, schedules as they are afterwards, notifications.

    schedules: schedule_id, org_id, source_audit_id, title, cadence, next_run_at,
    is_active.  A schedule whose source is gone is switched off and says so; the
    others get an audit of their own (its key is the schedule's and the time's,
    so that running again gives the same), whose documents are rows that refer
    to the same contents, and move on.
    """
    ready = due(schedules, now).join(audits.select(F.col("audit_id").alias("source_audit_id"), F.lit(True).alias("_there")), "source_audit_id", "left")
    run = ready.filter("_there")
    stamp = F.date_format(now, "yyyy-MM-dd")
    clone_id = F.concat_ws("@", F.col("schedule_id").cast("string"), stamp)
    clones = run.select(clone_id.alias("audit_id"), "schedule_id", "org_id", F.concat_ws(" — ", "title", stamp).alias("title"), "source_audit_id")
    copies = documents.join(clones.select(F.col("audit_id").alias("clone_id"), "source_audit_id"), documents["audit_id"] == F.col("source_audit_id"))
    copies = copies.select(F.col("clone_id").alias("audit_id"), *[c for c in documents.columns if c != "audit_id"])
    done = ready.select("schedule_id", F.col("_there").isNull().alias("_gone"))
    after = schedules.join(done, "schedule_id", "left").withColumns(
        {
            "next_run_at": F.when(F.col("_gone"), F.col("next_run_at")).when(F.col("_gone").isNotNull(), D.next_run(now, F.col("cadence"))).otherwise(F.col("next_run_at")),
            "is_active": F.col("is_active") & ~F.coalesce("_gone", F.lit(False)),
            "source_audit_id": F.when(~F.coalesce("_gone", F.lit(False)), F.col("source_audit_id")),
        }
    )
    kind = F.when(F.col("_there").isNull(), "audit_schedule.disabled").otherwise("audit_schedule.completed")
    return {"audits": clones, "documents": copies, "schedules": after.drop("_gone"), "notifications": ready.select("org_id", "schedule_id", kind.alias("kind"))}


def tick(frameworks: DataFrame, fetched: DataFrame, versions: DataFrame, audits: DataFrame, schedules: DataFrame, documents: DataFrame, now: Column) -> dict[str, DataFrame]:
    """One turn of the scheduler: first the watch over regulations, then the schedules that are due.

    An exception of one part is that part's: both are separate results, written
    by themselves.
    """
    return watch(frameworks, fetched, versions, audits, now) | rerun(schedules, audits, documents, now)


def watch(frameworks: DataFrame, fetched: DataFrame, versions: DataFrame, audits: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Frameworks and versions after a look at what was fetched, and who is told.

    frameworks: code, is_active, checked_at.  Those that are stale are compared
    with what was fetched (a fetch that failed has a null digest: it counts as
    checked, and stops nothing else); every organisation that has audited a
    changed one is told.
    """
    checked = stale(frameworks.filter("is_active"), now).select("code")
    found = ingestion.status(versions, fetched.join(checked, "code", "left_semi").filter("digest is not null"))
    told = audits.join(found.filter("status = 'updated'").select(F.col("code").alias("framework")), "framework").select("org_id", "framework").distinct().withColumn("kind", F.lit("framework.updated"))
    seen = frameworks.join(checked.withColumn("_due", F.lit(True)), "code", "left").withColumn("checked_at", F.when(F.col("_due"), now).otherwise(F.col("checked_at"))).drop("_due")
    return {"frameworks": seen, "versions": ingestion.next_versions(versions, found), "watch_notifications": told}


def purge(passages: DataFrame, now: Column, record: str = "document") -> DataFrame:
    """Contents whose time is over become null; the rows stay."""
    over = D.is_due(F.col("created_at"), F.lit(record), now)
    return passages.withColumns({"content": F.when(~over, F.col("content")), "purged": over})


def consecutive_failures(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``events`` with run: failures in a row up to and with each; 0 after a success."""
    so_far = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = events.withColumn("_island", F.sum((~F.col("failed")).cast("int")).over(so_far))
    within = Window.partitionBy(by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("run", F.sum(F.col("failed").cast("int")).over(within)).drop("_island")


def breaker(events: DataFrame, by: str, order: list[str], threshold: int = 3) -> DataFrame:
    """open: ``threshold`` failures in a row have happened by then; it never closes again."""
    so_far = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return consecutive_failures(events, by, order).withColumn("open", F.max("run").over(so_far) >= threshold)


def lockouts(events: DataFrame, by: str, order: list[str], failures: int = 5) -> DataFrame:
    """The failures that lock an account: every fifth in a row, since a lock starts the count again."""
    rows = consecutive_failures(events, by, order)
    return rows.filter(F.col("failed") & (F.col("run") % failures == 0))


def replayed(tokens: DataFrame) -> DataFrame:
    """Token uses with revoked: a use of a token that was used before revokes its family from then on.

    tokens: family, token, at.
    """
    again = F.row_number().over(Window.partitionBy("family", "token").orderBy("at")) > 1
    so_far = Window.partitionBy("family").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("replay", again).withColumn("revoked", F.max(F.col("replay").cast("int")).over(so_far) == 1)


def rate_windows(events: DataFrame, by: str, time: str, window: str, limit: int) -> DataFrame:
    """Requests by key and tumbling window, and whether they exceed the limit."""
    counted = events.groupBy(by, F.window(time, window).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("limited"))
