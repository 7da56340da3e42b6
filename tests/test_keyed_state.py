"""Keyed state with timers, against the same rules on a sorted list."""

import datetime as dt
import random

import pandas as pd
import pytest
from attestra.streaming import keyed, limits

BEGIN = dt.datetime(2024, 1, 1)
SCHEMA = "key long, ts timestamp, event_id long, what string"


def landed(spark, path, batches):
    """One file a batch, in order; the last one lets the watermark pass all others."""
    end = [(-1, BEGIN + dt.timedelta(days=400), -1, "end")]
    for rows in [*batches, end]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.fixture
def events():
    r = random.Random(4)
    rows = [(r.randrange(6), BEGIN + dt.timedelta(seconds=r.randrange(3000)), i, r.choice("abcdefghij")) for i in range(160)]
    r.shuffle(rows)
    return rows


def test_token_families_revoke_on_reuse(spark, tmp_path, events):
    stream = landed(spark, tmp_path, [events[i : i + 40] for i in range(0, 160, 40)])
    found = {(r.key, r.event_id, r.replay, r.revoked) for r in limits.drain(keyed.token_families(stream, "key", "1 day")).collect() if r.key >= 0}
    expected, used, revoked = set(), {}, set()
    for key, _, event_id, token in sorted(events, key=lambda e: (e[1], e[2])):
        replay = token in used.setdefault(key, set())
        used[key].add(token)
        revoked |= {key} if replay else set()
        expected.add((key, event_id, replay, key in revoked))
    assert found == expected and any(e[2] for e in expected) and not all(e[3] for e in expected)


def test_families_are_forgotten(spark, tmp_path):
    at = lambda days: BEGIN + dt.timedelta(days=days)
    rows = [[(1, at(0), 1, "a")], [(2, at(1), 2, "x")], [(2, at(40), 3, "y")], [(2, at(41), 4, "z")], [(1, at(42), 5, "a")]]
    found = {r.event_id: (r.replay, r.revoked) for r in limits.drain(keyed.token_families(landed(spark, tmp_path, rows), "key", "1 hour")).collect()}
    assert found[5] == (False, False)  # thirty days after its last use nothing of family 1 is left


def test_an_audit_has_a_budget(spark, tmp_path):
    at = lambda seconds: BEGIN + dt.timedelta(seconds=seconds)
    rows = [(1, at(0), 1, "failed"), (1, at(1), 2, "failed"), (1, at(2), 3, "failed"), (1, at(3), 4, "answered"), (2, at(0), 5, "failed"), (2, at(100), 6, "answered"), (2, at(240), 7, "failed"), (2, at(241), 8, "answered")]
    found = {r.event_id: (r.asked, r.reason) for r in limits.drain(keyed.audit_budget(landed(spark, tmp_path, [rows[::2], rows[1::2]]), "key", "1 day")).collect()}
    assert [found[i] for i in range(1, 9)] == [(True, None)] * 3 + [(False, "breaker open")] + [(True, None)] * 3 + [(False, "deadline")]


class OneState:
    """A key's state, as it is handed to a processor; counts what is asked of it."""

    def __init__(self):
        self.get, self.exists, self.mark, self.calls = None, False, 0, []

    def getCurrentWatermarkMs(self):
        return self.mark

    def update(self, value):
        self.get, self.exists = value, True
        self.calls.append("update")

    def setTimeoutTimestamp(self, at):
        assert at > self.mark
        self.calls.append("timer")

    def remove(self):
        self.get, self.exists = None, False
        self.calls.append("remove")


def test_a_batch_costs_one_call_however_many_events():
    processor, state = keyed.TokenFamilies("key", forget_ms=10_000_000), OneState()
    rows = pd.DataFrame({"ts": pd.to_datetime(range(1000, 6000), unit="s"), "event_id": range(5000), "what": [str(i % 4999) for i in range(5000)]})
    assert list(processor((7,), iter([rows.sample(frac=1.0, random_state=1)]), state)) == []
    state.mark = 6_500_000
    (found,) = processor((7,), iter([]), state)
    assert found["event_id"].tolist() == list(range(5000)) and found["replay"].sum() == 1 and state.calls == ["update", "timer"] * 2
    state.mark = 5_999_000 + 10_000_000
    assert list(processor((7,), iter([]), state)) == [] and state.calls[4:] == ["remove"]


def test_lockouts_keep_one_state_a_bucket(spark, tmp_path):
    r = random.Random(7)
    rows = [(r.choice([None, *range(40)]), BEGIN + dt.timedelta(seconds=r.randrange(2000)), i, r.random() < 0.8) for i in range(1500)]
    schema = "user_id long, ts timestamp, event_id long, failed boolean"
    for part in (rows[::2], rows[1::2], [(-1, BEGIN + dt.timedelta(days=400), -1, True)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landed"))
    query = limits.lockouts(stream, late="1 day", buckets=8).writeStream.format("memory").queryName("locked").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 8
    expected, count = [], {}
    for user, ts, _, failed in sorted(rows, key=lambda e: (e[1], e[2])):
        count[user] = count.get(user, 0) + 1 if failed else 0
        if count[user] == 5:
            count[user] = 0
            expected.append((user, ts))
    found = [(x.user_id, x.locked_at) for x in spark.table("locked").collect()]
    assert sorted(found, key=str) == sorted(expected, key=str) and any(u is None for u, _ in found)
