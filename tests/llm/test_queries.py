"""Registered queries: SQL twins, and tables that are empty, full of nulls, or have clashing columns."""

import pytest
from attestra.llm import chat, decontaminate, jaccard, langid, lmscore, mixing, pii, queries, substring, suffixes, topk
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import assert_same, connection


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connection(sf_dir), queries.SQL[name])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "src1", 0), (None, "no id at all but some words here", "en", None, 31), (None, None, None, None, None),
    (3, "same same same", "fr", "src0", 14), (3, "same same same", "fr", "src0", 14), (3, "other text of id three", "fr", "src0", 22), (4, "word " * 60000, "en", "src0", 300000), (5, "\n\t ", "de", "src2", 3), (6, "12345 67890", None, "src3", 11),
]
CLASHING = ("_d", "_t", "_r", "_row", "node", "kept", "score", "rejected", "lang_pred", "n_words", "copies", "spans", "email", "comp", "key", "contaminated")


@pytest.fixture(params=["odd", "empty", "clashing", "one"])
def docs(request, spark):
    rows = {"odd": ODD, "clashing": ODD, "empty": [], "one": ODD[6:7]}[request.param]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("own") for c in CLASHING}) if request.param == "clashing" else df


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "some words here"), (2, None)], "item_id long, text string")


OPERATORS = {
    "substring": lambda d, i: substring.deduplicate(d),
    "suffixes": lambda d, i: suffixes.deduplicate(d),
    "lm": lambda d, i: lmscore.score(d),
    "pii": lambda d, i: pii.digest(pii.find(d)),
    "redact": lambda d, i: pii.redact(d),
    "contamination": lambda d, i: decontaminate.contamination(d, i),
    "jaccard": lambda d, i: jaccard.join(d, 3, 90),
    "mix": lambda d, i: mixing.mix(d, F.col("source"), 0.5),
    "language": lambda d, i: langid.identify(d, langid.dictionaries(d, langid.is_training(5))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_every_row(docs, items, name):
    assert len(OPERATORS[name](docs, items).collect()) == docs.count()


def test_empty_benchmark(spark, docs, items):
    found = decontaminate.contamination(docs, items.limit(0))
    assert found.count() == docs.count() and found.filter("contaminated or n_hit > 0").count() == 0


def test_empty_conversations_and_vectors(spark):
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (1, None, None, None), (1, None, None, None), (1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert {r.n_turns for r in chat.render(odd.withColumn("part", F.lit(1))).collect()} == {3}  # the turn without an id is a snapshot of the other


def test_repeated_rows_of_bytes(spark):
    text = "abcdefghij" * 3 + "".join(map(str, range(100)))
    df = spark.createDataFrame([(7, text), (7, text), (None, text)], "doc_id long, text string").coalesce(1)
    assert sorted(r.n_removed for r in suffixes.deduplicate(df).collect()) == [0, len(text), len(text)]


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_tables(spark, sf_dir, docs, at):
    stage = corpus_pipeline.STAGES[at][1]
    found = stage(spark, docs, sf_dir)
    assert found.columns[: len(docs.columns)] == docs.columns or "copies" in docs.columns
    rows = found.collect()
    assert len(rows) <= docs.count()
    if at not in (0, 1, 4):
        assert len(rows) == docs.count()


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == [*docs.columns, "copies"]
    kept = found.select("doc_id").distinct().count()
    assert 0 < kept <= docs.count() and kept == found.count()


def test_mix_meets_its_budget(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for rows in (4096, 8):  # one bucket, and many
        mixing.BUCKET_ROWS, before = rows, mixing.BUCKET_ROWS
        try:
            found = mixing.mix(docs, mixing.domain_of_source(F.col("source")), 0.6, 2, mixing.WEIGHTS)
            total, taken = found.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("copies"))).first()
        finally:
            mixing.BUCKET_ROWS = before
        assert found.filter("copies > 2").count() == 0 and 0.3 * total < taken <= 0.6 * total
