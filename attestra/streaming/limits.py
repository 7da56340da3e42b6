"""Rate limits and lockouts on event streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from attestra.sources.landing import shared_dir


def event_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Event files as they land; times become instants, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def rate_windows(events: DataFrame, by: str = "user_id", window: str = "1 hour", limit: int = 200, late: str = "10 minutes") -> DataFrame:
    """Requests by key and tumbling window; windows close, and their state goes, once the watermark is past them."""
    counted = events.withWatermark("ts", late).groupBy(by, F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("limited"))


_EVENT = np.dtype([("known", "u1"), ("user", "<i8"), ("ts", "<i8"), ("id", "<i8"), ("failed", "u1")])
_COUNT = np.dtype([("known", "u1"), ("user", "<i8"), ("n", "<i8")])


def count_failures(events: np.ndarray, counts: np.ndarray, failures: int) -> tuple[np.ndarray, np.ndarray]:
    """Of events (_EVENT) in any order: those that lock an account, and what each account's count (_COUNT) is after them; ``counts``: before them."""
    events = events[np.lexsort((events["failed"], events["id"], events["ts"], events["user"], events["known"]))]
    at = np.arange(len(events))
    first = np.ones(len(events), bool)
    first[1:] = (events["user"][1:] != events["user"][:-1]) | (events["known"][1:] != events["known"][:-1])
    failed, account = events["failed"] == 1, np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    # what the accounts here come with
    both = np.concatenate([counts, np.zeros(len(begin), _COUNT)])
    both["known"][len(counts) :], both["user"][len(counts) :] = events["known"][begin], events["user"][begin]
    accounts, which = np.unique(both[["known", "user"]], return_inverse=True)
    n = np.zeros(len(accounts), np.int64)
    n[which[: len(counts)]] = counts["n"]
    which = which[len(counts) :]
    # failures since the last success, or since the account's first event and what it came with
    since = np.maximum.accumulate(np.where(~failed, at, np.where(first, at - 1, -1)))
    run = at - since + np.where(since < begin[account], n[which][account], 0)
    n[which] = np.where(failed, run % failures, 0)[np.append(begin[1:], len(events)) - 1]
    after = np.zeros(len(accounts), _COUNT)
    after["known"], after["user"], after["n"] = accounts["known"], accounts["user"], n
    return events[failed & (run % failures == 0)], after[n > 0]


def lockouts(events: DataFrame, failures: int = 5, minutes: int = 15, late: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """user_id, locked_at, locked_until: every ``failures`` failures in a row lock an account.

    events: user_id, ts, event_id, failed.  A success and a lock start the count
    again.  Events wait until the watermark, ``late`` behind the newest, is past
    them, and then count in the order of ts and event_id, whatever batches they
    came in; what comes later than that is dropped.  State is the counts and the
    waiting events of all accounts of a bucket, as bytes: a batch costs one call
    a bucket, however many accounts there are.  ``buckets`` is part of the
    state's layout and stays for a checkpoint's life.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else (b"", b"")
        counts, parts, mark = np.frombuffer(kept[0], _COUNT), [np.frombuffer(kept[1], _EVENT)], state.getCurrentWatermarkMs()
        for batch in batches:
            part = np.zeros(len(batch), _EVENT)
            part["ts"] = batch["ts"].astype("datetime64[us]").astype("int64")
            for name, column in (("known", "known"), ("user", "user_id"), ("id", "event_id"), ("failed", "failed")):
                part[name] = batch[column]
            parts.append(part[part["ts"] // 1000 >= mark])
        waiting = np.concatenate(parts)
        passed = waiting["ts"] // 1000 < mark
        ready, waiting = waiting[passed], waiting[~passed]
        locked = ready[:0]
        if len(ready):
            locked, counts = count_failures(ready, counts, failures)
        if len(waiting) or len(counts):
            state.update((counts.tobytes(), waiting.tobytes()))
            if len(waiting):
                state.setTimeoutTimestamp(int(max(waiting["ts"].min() // 1000, mark)) + 1)
        elif state.exists:
            state.remove()
        if len(locked):
            times = pd.to_datetime(pd.Series(locked["ts"]), unit="us")
            users = pd.Series(locked["user"]).astype("Int64").mask(pd.Series(locked["known"] == 0))
            yield pd.DataFrame({"user_id": users, "locked_at": times, "locked_until": times + pd.Timedelta(minutes=minutes)})

    schema = "user_id long, locked_at timestamp, locked_until timestamp"
    user = F.col("user_id").cast("long")
    timed = events.withWatermark("ts", late).select(
        F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int").alias("bucket"), user.isNotNull().alias("known"), F.coalesce(user, F.lit(0)).alias("user_id"), "ts",
        F.coalesce(F.col("event_id").cast("long"), F.lit(2**63 - 1)).alias("event_id"), F.coalesce("failed", F.lit(False)).alias("failed"),
    )
    return timed.groupBy("bucket").applyInPandasWithState(step, schema, "counts binary, waiting binary", "append", "EventTimeTimeout")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream gives for what has landed, as a table in the shared folder; for tests and backfills.

    The sink is Parquet with a checkpoint; a stream in complete mode overwrites
    its table batch by batch.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/rows").start()
    else:
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
