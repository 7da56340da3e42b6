"""Lexical ranking from the index against scoring every passage."""

import re

from attestra.functions import text as T
from attestra.operators import retrieval, term_index
from pyspark.sql import functions as F


def test_same_rows_as_scoring_everything(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    passages = docs.select("doc_id", F.posexplode(F.array(F.substring("text", 1, 400), F.substring("text", 401, 400), F.lit(""))).alias("position", "t")).select("doc_id", "position", T.normalize(F.col("t")).alias("body"))
    asked = spark.createDataFrame([("r1", "that with from hand hand", 2), ("r2", "nirgends zzzzz", 1), ("r3", "tion eaux", 3), ("r4", "a of", 2)], "requirement string, query string, n int")
    index = term_index.build(passages, str(tmp_path / "index"))
    found, scored = term_index.search(index, asked, F.col("n"))
    expected = retrieval.lexical_topk(passages, asked, F.col("n"))
    key = ["doc_id", "requirement", "rank", "position", "score"]
    assert sorted(map(tuple, found.select(*key).collect())) == sorted(map(tuple, expected.select(*key).collect()))
    n = {r.requirement: r.scored for r in scored.collect()}
    assert 0 < n["r3"] < passages.count() / 2 and "r2" not in n and "r4" not in n
    assert term_index.search(index, asked.limit(0), F.col("n"))[0].count() == 0


def test_postings_are_pruned_by_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "beta gamma"), (2, 0, ""), (3, 0, None)], "doc_id long, position int, body string")
    index = term_index.build(rows, str(tmp_path / "index"))
    grams = {r.gram: r.n for r in index.postings.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    assert grams == {"alp": 1, "lph": 1, "pha": 1, "bet": 2, "eta": 2, "gam": 1, "amm": 1, "mma": 1}
    assert "PartitionFilters: [isnotnull(bucket" in index.postings.filter("bucket = 3")._jdf.queryExecution().executedPlan().toString()


def test_postings_are_packed_and_nothing_is_dealt_by_term_or_requirement(spark, tmp_path):
    bodies = [(i % 40, i // 40, f"shared words number{i} \U00020000\U00020001中文字 end") for i in range(400)] + [(41, 0, "x\U00020000\U00020001中 shared"), (None, 0, "words"), (42, 0, ""), (42, 1, "a b")]
    rows = spark.createDataFrame(bodies, "doc_id long, position int, body string").repartition(2)
    asked = spark.createDataFrame([("r1", "shared words words", 3), ("r2", "\U00020000\U00020001中文字", 2), ("r3", "number399", 1)], "requirement string, query string, n int")
    index = term_index.build(rows, str(tmp_path / "index"))
    one = index.packed.filter("gram = 'sha'")
    assert one.count() <= 4 and one.selectExpr("sum(size(ordinals))").first()[0] == 401  # not a row for each passage
    assert index.postings.filter("gram = '\U00020000\U00020001中'").count() == 401
    found, scored = term_index.search(index, asked, F.col("n"))
    key = ["doc_id", "requirement", "rank", "position", "score"]
    expected = retrieval.lexical_topk(rows, asked, F.col("n"))
    told = lambda df: sorted((tuple(r) for r in df.select(*key).collect()), key=repr)
    assert told(found) == told(expected)
    assert {r.requirement: r.scored for r in scored.collect()} == {"r1": 402, "r2": 400, "r3": 1}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortMergeJoin \[(requirement|term)#", plan)


def test_grams_of_a_block_in_several_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    bodies = pa.array(["abcab cabc", "", "ab", "é中文é中文", "abc" * 5])
    told = lambda: [(p, g, o) for b in term_index._stretches(7, np.arange(3, 8), bodies) for p, g, o in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    expected = {(b[i : i + 3], 3 + n) for n, b in enumerate(bodies.to_pylist()) for i in range(len(b) - 2) if " " not in b[i : i + 3]}
    whole = told()
    assert {(g, o) for _, g, os in whole for o in os} == expected and {p for p, _, _ in whole} == {7 << 12 | 3}
    monkeypatch.setattr(term_index, "CHARACTERS", 12)
    parts = told()
    assert sorted((g, o) for _, g, os in parts for o in os) == sorted(expected) and len({p for p, _, _ in parts}) > 1
