"""Passages ranked for a whole catalogue in one go over a document's bodies, against ranking query by query."""

import random

from attestra.functions import text as T
from attestra.operators import catalogue, retrieval
from pyspark.sql import functions as F


def test_same_lists_as_query_by_query(spark):
    r = random.Random(3)
    words = ["abab", "ababab", "data", "register", "officer", "l'officer", "xx", "datadata", "été1"]
    bodies = [[" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(r.randint(0, 9))] for _ in range(40)] + [["x" * 200, "data" * 50], None]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, bodies array<string>")
    asked = spark.createDataFrame([(1, ["abab", "data", "data"], 3), (2, ["nowhere"], 2), (3, [], 4), (4, ["offic", "register", "ata"], 5)], "n int, words array<string>, k int")
    found = retrieval.ranked_bodies(docs, "bodies", asked, {"best": ("words", F.col("k")), "two": ("words", F.lit(2))})
    one = catalogue.paired(docs, asked)
    expected = one.withColumns({"best": retrieval.best_of(F.col("words"), F.col("bodies"), F.col("k")), "two": retrieval.best_of(F.col("words"), F.col("bodies"), F.lit(2))})
    key = ["doc_id", "n", "best", "two"]
    assert sorted(map(repr, found.select(*key).collect())) == sorted(map(repr, expected.select(*key).collect())) and found.count() == 4 * len(bodies)
    assert retrieval.ranked_bodies(docs, "bodies", asked.limit(0), {"best": ("words", F.col("k"))}).count() == 0


def test_a_document_keeps_the_scores_of_all_requirements(spark):
    r = random.Random(4)
    bodies = [[" ".join(r.choices(["data", "register", "xx", "officer"], k=r.randint(0, 40))) for _ in range(r.randint(1, 9))] for _ in range(30)] + [["xx"]]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, bodies array<string>")
    asked = spark.createDataFrame([("a", "data register data", 3), ("b", "officer", 2), ("c", "nowhere", 1)], "requirement string, query string, criticality int")
    found = {(d.doc_id, x.requirement, x.criticality): x.scores for d in retrieval.scored_bodies(docs, "bodies", asked, 3).collect() for x in d.found}
    expected = {}
    for x in retrieval.lexical_best(docs, asked, F.lit(3)).orderBy("rank").collect():
        expected.setdefault((x.doc_id, x.requirement, x.criticality), []).append(x.score)
    assert found == expected and len(found) == 3 * len(bodies)


def test_a_few_terms_count_as_many_do(monkeypatch):
    r = random.Random(5)
    words = ["abab", "ababab", "dataset", "datadata", "xx", "été1"]
    queries = [["abab", "data", "data"], ["tada", "été1"], []]
    few = retrieval.term_hits(queries)
    monkeypatch.setattr(retrieval, "FEW_TERMS", 0)
    many = retrieval.term_hits(queries)
    texts = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(200)]
    assert [few(t) for t in texts] == [many(t) for t in texts] and few.__name__ != many.__name__


def test_a_word_is_looked_at_once():
    of_body = retrieval.term_hits([["abab", "data"], ["data", "data"]])
    assert of_body("ababab data datadata") == {0: 4, 1: 6} and of_body("") == {}
    assert of_body("data " * 3) == {0: 3, 1: 6}


def test_scores_are_rounded_as_spark_does(spark):
    cases = [(1, 3296), (3, 3296), (7, 133), (2, 800)]  # 800 / 4096 = 0.1953125 is a half
    found = spark.createDataFrame(cases, "n int, size int").select(F.round(F.col("n") / (1 + F.col("size") / 800), 6).alias("s")).collect()
    assert [r.s for r in found] == [retrieval._damped(*c) for c in cases]
    assert spark.range(1).select(T.occurrences(F.lit("ababab"), F.lit("abab"))).first()[0] == 1
