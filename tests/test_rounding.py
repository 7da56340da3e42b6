"""Scores that lie between two roundings, against the SQL in the order of the rows."""

import datetime as dt
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest
from attestra import catalog

from tests.compare import assert_same

AT = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LINES = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
PENALTIES = [((25.0, 0.01), 0.5), ((40.0, 0.06), 0.3), ((40.0, 0.03), 0.85), ((25.0, 0.06), 0.5 * 0.3), ((32.0, 0.01), 0.2), ((10.0, 0.01), 0.0)]


def between(x):
    """Whether the number and its tenfold round to different tenths."""
    return math.floor(x * 10 + 0.5) / 10 != float(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_UP))


def added(values):
    total = 0.0
    for v in values:
        total += v
    return total


@pytest.fixture
def halves(spark, tmp_path):
    r = random.Random(5)
    events, lines = [], []
    for user in range(5):
        values = [1.0]
        while not between(added(values) / len(values)):
            values = [r.randrange(20000) / 100 for _ in range(4)]
        events += [(4 * i, AT, user, "view", v, "") for i, v in enumerate(values)] + [(4 * i + 1, AT, user, "view", v / 3, "") for i, v in enumerate(values)]
    for audit in range(5):
        picked = PENALTIES[:1]
        while not between(100.0 * (1 - added(p for _, p in picked) / len(picked))):
            picked = r.choices(PENALTIES, k=100)
        lines += [(i, audit, 2, *line, "A", "O") for i, (line, _) in enumerate(picked)]
    con = duckdb.connect()
    for name, rows, schema in (("events", events, EVENTS), ("lineitem", lines, LINES)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        (file,) = (tmp_path / name).glob("*.parquet")
        file.rename(tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    return str(tmp_path), con


@pytest.mark.parametrize("name", ["penalty_score", "reproducibility", "score_gaps"])
def test_halves_round_as_in_sql(spark, halves, name):
    path, con = halves
    assert_same(catalog.QUERIES[name](spark, path), con, catalog.SQL[name])


def test_a_ratio_rounds_as_in_sql(spark, tmp_path):
    lines = [(i, k, 1 if i < k else 2, 10.0, 0.01, "N", "O") for k in (57, 69, 113, 139, 163) for i in range(800)]
    spark.createDataFrame(lines, LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert_same(catalog.QUERIES["penalty_score"](spark, str(tmp_path)), con, catalog.SQL["penalty_score"])
