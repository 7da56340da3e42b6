"""The index of cells against all pairs."""

import numpy as np
import pytest
from attestra.operators import vector_index
from pyspark.sql import functions as F

SCHEMA = "tenant string, id long, vector array<double>"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    middles = r.normal(size=(6, 8))
    out = [(f"t{i % 3}", i, (middles[i % 6] + 0.15 * r.normal(size=8)).tolist()) for i in range(300)]
    out += [("t0", 300 + i, out[0][2]) for i in range(5)]  # ties
    return [*out, ("t0", 400, None), ("alone", 401, [1.0] * 8), ("t1", 402, [0.0] * 8)]


def nearest(rows, tenant, query_id, vector, k):
    own = [(i, np.array(v)) for t, i, v in rows if t == tenant and i != query_id and v is not None and any(v)]
    q = np.array(vector)
    told = sorted((round(float(1 - v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 6) + 0.0, i) for i, v in own)
    return [(i, d) for d, i in told[:k]]


def test_rows_are_those_of_all_pairs(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = vector_index.build(df, str(tmp_path / "index"), 8)
    queries = df.filter("id % 10 = 0 or id > 299").withColumnRenamed("id", "query_id")
    found, told = vector_index.search(index, queries, 4)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.distance))
    for t, i, v in rows:
        if (i % 10 == 0 or i > 299) and v is not None and any(v):
            expected = nearest(rows, t, i, v, 4)
            assert [x for x, _ in got.get(i, [])] == [x for x, _ in expected], i
            assert np.allclose([d for _, d in got.get(i, [])], [d for _, d in expected], atol=2e-6)
    read = told.filter("query_id < 300").agg(F.sum("read").alias("r"), F.sum("cells").alias("c")).first()
    assert read.r < 0.8 * read.c  # far cells aren't read
    assert {p.name for p in (tmp_path / "index" / "vectors").iterdir() if "=" in p.name} == {"tenant=alone", "tenant=t0", "tenant=t1", "tenant=t2"}
    plan = index.vectors.filter("tenant = 't1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant" in plan


def test_other_dimensions_fail(spark, tmp_path):
    wrong = spark.createDataFrame([("t", 1, [1.0, 2.0])], SCHEMA)
    with pytest.raises(Exception, match="a vector of 8 components is needed, not of 2"):
        vector_index.build(wrong, str(tmp_path / "index"), 8)


def test_empty_index(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    index = vector_index.build(df, str(tmp_path / "index"), 8)
    found, _ = vector_index.search(index, df.limit(0).withColumnRenamed("id", "query_id"), 4)
    assert found.count() == 0
