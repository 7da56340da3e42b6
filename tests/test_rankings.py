"""Retrievers ranked within a document's row, against every passage paired with every query."""

from attestra.functions import vectors as V
from attestra.operators import catalogue
from attestra.plans import validation
from pyspark.sql import Window
from pyspark.sql import functions as F


def test_nearest_texts_are_those_of_the_cosine(spark):
    words = ["data", "register", "officer", "backup", "the", "of"]
    texts = [[" ".join(words[(i * j + s) % 6] for s in range(j + 1)) for j in range(i % 7)] for i in range(30)] + [["", "data"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, texts array<string>")
    asked = spark.createDataFrame([("a", "the register of data"), ("b", ""), ("c", "backup")], "requirement string, query string").withColumn("q", V.hashing_embedder()("query"))
    near = catalogue.paired(docs.select("doc_id", F.posexplode("texts").alias("position", "t")).select("doc_id", "position", V.hashing_embedder()("t").alias("c")), asked)
    order = Window.partitionBy("doc_id", "requirement").orderBy("distance", "position")
    ranked = near.withColumn("distance", F.round(V.cosine_distance(F.col("q"), F.col("c")), 6)).filter("distance is not null").withColumn("rank", F.row_number().over(order)).filter("rank <= 3")
    expected = {(r.doc_id, r.requirement, r["rank"], r.position) for r in ranked.collect()}
    queries = {r.requirement: r.q for r in asked.collect()}
    rows = docs.select("doc_id", V.nearest_texts([queries[x] for x in "abc"], 3, many=2)("texts").alias("n")).collect()
    assert {(r.doc_id, x, i + 1, p) for r in rows for x, own in zip("abc", r.n, strict=True) for i, p in enumerate(own)} == expected and len(expected) > 100


def test_rankings_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "the register of data " * 100), (2, ""), (3, None), (4, "backup " * 150)], "doc_id long, text string")
    grid = spark.createDataFrame([("r1", "register data"), ("r2", "backup")], "requirement string, query string")
    found = validation.rankings(docs, grid, 2)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {(r.retriever, r.doc_id, r.requirement): [tuple(x) for x in r.best] for r in found.collect()}
    assert len(rows) == 12 and rows["lexical", 1, "r1"] == [(2, True), (0, True)] and rows["lexical", 1, "r2"] == [(0, False), (1, False)] and rows["fused", 4, "r2"] == [(0, True), (1, True)]
