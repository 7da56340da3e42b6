"""The scheduler's stream: a tick that dies between two commits and comes again leaves what one that lives does."""

import datetime as dt

import pytest
from attestra.streaming import ticks

NOW = dt.datetime(2024, 1, 20)


def filled(spark, path):
    tables = ticks.open_tables(spark, path, buckets=2)
    old = NOW - dt.timedelta(days=3)
    tables["frameworks"].replace(spark.createDataFrame([("a", True, None), ("b", True, NOW), ("c", True, old), ("d", False, None)], "code string, is_active boolean, checked_at timestamp_ntz"))
    tables["versions"].replace(spark.createDataFrame([(c, "1", "old", True) for c in "abcd"], "code string, version_label string, digest string, is_current boolean"))
    tables["audits"].replace(spark.createDataFrame([("1", 10, "a"), ("2", 20, "a"), ("3", 20, "c")], "audit_id string, org_id long, framework string"))
    tables["documents"].replace(spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "z")], "audit_id string, storage_key string"))
    rows = [(1, 10, "1", "Review", "weekly", old, True), (2, 20, "gone", "Review", "monthly", old, True), (3, 20, "2", "Review", "weekly", NOW + dt.timedelta(days=1), True)]
    tables["schedules"].replace(spark.createDataFrame(rows, "schedule_id long, org_id long, source_audit_id string, title string, cadence string, next_run_at timestamp_ntz, is_active boolean"))
    return tables


def state(tables):
    return {name: sorted(tuple(r) for r in t.read().collect()) for name, t in tables.items() if name not in ("pins", "frameworks")} | {"checked": sorted(r.code for r in tables["frameworks"].read().filter("checked_at = timestamp_ntz '2024-01-20 00:00:00'").collect())}


def fetched(spark):
    return lambda: spark.createDataFrame([("a", "1", "new", dt.date(2024, 1, 20)), ("b", "1", "new", dt.date(2024, 1, 20)), ("c", "1", None, dt.date(2024, 1, 20))], "code string, version_label string, digest string, fetched date")


def run(spark, path, tables, between=lambda step: None):
    stream = spark.readStream.schema("at timestamp").option("maxFilesPerTrigger", 1).json(f"{path}/landed")
    query = ticks.start(stream, tables, fetched(spark), f"{path}/checkpoint", between)
    query.awaitTermination()


def land(path, *times):
    (path / "landed").mkdir(exist_ok=True)
    for t in times:
        (path / "landed" / f"{t[:10]}.json").write_text(f'{{"at": "{t}"}}\n')


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    land(path, "2024-01-20 00:00:00")
    tables = filled(spark, str(path / "tables"))
    run(spark, path, tables)
    return state(tables)


def test_a_tick(whole):
    assert ("a", "1 (2024-01-20)", "new", True) in whole["versions"] and ("a", "1", "old", False) in whole["versions"] and len(whole["versions"]) == 5
    assert whole["checked"] == ["a", "b", "c"]
    assert sorted(r[1:] for r in whole["notifications"]) == [(10, "audit_schedule.completed", "1"), (10, "framework.updated", "a"), (20, "audit_schedule.disabled", "2"), (20, "framework.updated", "a")]
    assert [a for a in whole["audits"] if "@" in a[0]] == [("1@2024-01-20", 10, "a")] and [d for d in whole["documents"] if "@" in d[0]] == [("1@2024-01-20", "x"), ("1@2024-01-20", "y")]
    assert [(s[0], s[5], s[6]) for s in whole["schedules"]] == [(1, NOW + dt.timedelta(days=7), True), (2, NOW - dt.timedelta(days=3), False), (3, NOW + dt.timedelta(days=1), True)]


@pytest.mark.parametrize("dies", ["watch notifications", "schedules audits", "schedules schedules"])
def test_a_tick_that_dies_and_comes_again(spark, tmp_path, whole, dies):
    land(tmp_path, "2024-01-20 00:00:00")
    tables = filled(spark, str(tmp_path / "tables"))

    def between(step):
        if step == dies:
            raise RuntimeError("dies")

    with pytest.raises(Exception, match="dies"):
        run(spark, tmp_path, tables, between)
    assert state(tables) != whole
    run(spark, tmp_path, tables)  # the same batch again
    assert state(tables) == whole
    before = {name: t.version() for name, t in tables.items()}
    ticks.tick(tables, fetched(spark)(), "2024-01-20 00:00:00", "tick-0")  # and once more, by hand
    assert {name: t.version() for name, t in tables.items()} == before
