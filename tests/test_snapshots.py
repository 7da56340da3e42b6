"""Tables of committed snapshots: whole versions, conflicts, replays, expiry."""

import os

import pytest
from attestra.sources.snapshots import Conflict, Table
from pyspark.sql import functions as F


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t"), ["id"], buckets=4)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_and_readers(spark, table):
    assert table.version() is None
    with pytest.raises(ValueError, match="no version"):
        table.read()
    first = spark.createDataFrame([(i, "a") for i in range(20)], "id long, v string")
    assert table.replace(first) == 0
    reader = table.read()  # opened before the change
    assert table.upsert(spark.createDataFrame([(3, "b"), (99, "c")], "id long, v string")) == 1
    assert rows(reader) == rows(first) == rows(table.read(0))
    assert {r.v for r in table.read().filter("id in (3, 99)").collect()} == {"b", "c"} and table.read().count() == 21
    assert table.delete(spark.createDataFrame([(3,), (4,), (1000,)], "id long")) == 2
    assert sorted(r.id for r in table.read().collect()) == [i for i in range(20) if i not in (3, 4)] + [99]
    assert table.change(lambda old: old.withColumn("v", F.upper("v"))) == 3 and table.read().filter("v = 'A'").count() == 18


def test_only_touched_buckets_are_written(spark, table, tmp_path):
    table.replace(spark.range(1000).select("id", F.lit("a").alias("v")))
    table.upsert(spark.createDataFrame([(7, "b")], "id long, v string"))
    folders = sorted((p for p in (tmp_path / "t" / "data").iterdir()), key=os.path.getmtime)
    assert [len([b for b in f.iterdir() if "=" in b.name]) for f in folders] == [4, 1]


def test_a_change_is_computed_once(spark, table, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    table.upsert(spark.range(100).select(counted("id").alias("id"), F.lit("a").alias("v")))
    table.upsert(spark.range(50, 150).select(counted("id").alias("id"), F.lit("b").alias("v")))
    assert seen.value == 200 and table.read().count() == 150 and table.read().filter("v = 'b'").count() == 100
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2  # nothing is left of what was staged


def test_a_replayed_change_does_nothing(spark, table):
    table.replace(spark.createDataFrame([(1, 0)], "id long, v int"), token="start")
    more = spark.createDataFrame([(2, 0)], "id long, v int")
    assert [table.upsert(more, token="batch-1") for _ in range(3)] == [1, 1, 1] and table.version() == 1
    assert table.replace(more, token="start") == 1 and table.read().count() == 2


def test_of_two_writers_one_wins(spark, table):
    table.replace(spark.createDataFrame([(1, 0)], "id long, v int"))
    other = Table(spark, table.path, ["id"], buckets=4)

    def meanwhile(old):
        other.upsert(spark.createDataFrame([(5, 5)], "id long, v int"))
        return old.withColumn("v", F.lit(9))

    with pytest.raises(Conflict):
        table.change(meanwhile)
    assert rows(table.read()) == [(1, 0), (5, 5)]


def test_a_write_that_dies_leaves_the_version(spark, table):
    table.replace(spark.createDataFrame([(1, 0)], "id long, v int"))
    with pytest.raises(Exception, match="dies"):
        table.change(lambda old: old.withColumn("v", F.raise_error(F.lit("dies")).cast("int")))
    assert rows(table.read()) == [(1, 0)] and table.version() == 0


def test_expired_versions_and_empty_tables(spark, table):
    table.replace(spark.createDataFrame([(i, i) for i in range(8)], "id long, v int"))
    for i in range(3):
        table.upsert(spark.createDataFrame([(100, i)], "id long, v int"))
    assert table.expire(keep=1) == 2 and table.version() == 3 and table.read().count() == 9
    assert table.expire(keep=1) == 0
    table.delete(table.read())
    assert rows(table.read()) == [] and table.read().columns == ["id", "v"]
    table.upsert(spark.createDataFrame([(None, 1)], "id long, v int"))
    assert rows(table.read()) == [(None, 1)]
