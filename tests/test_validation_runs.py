"""Passes of a validation run: evaluated anew each time, resumed without asking again."""

from collections.abc import Iterator

import pyarrow as pa
import pytest
from attestra.catalog import work
from attestra.operators import retrieval
from attestra.plans import validation
from attestra.sources import readers
from attestra.sources.snapshots import Table
from pyspark.sql import functions as F


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")


class Evaluator:
    """Two articles a request; the second's verdict changes in pass 2 of document 3.  Remembers what it was asked."""

    def __init__(self, dies_at=None):
        self.asked, self.dies_at = [], dies_at

    def __call__(self, rows):
        keys = sorted(tuple(r) for r in rows.select("doc_id", "run").collect())
        if self.dies_at is not None and len(self.asked) >= self.dies_at:
            raise RuntimeError("dies")
        self.asked += keys
        other = F.when((F.col("doc_id") == 3) & (F.col("run") == 2), "breach").otherwise("compliant")
        made = F.array(F.struct(F.lit("Article 5").alias("article_ref"), F.lit("compliant").alias("verdict")), F.struct(F.lit("6").alias("article_ref"), other.alias("verdict")))
        return rows.select("doc_id", "run", F.inline(made))


def test_every_pass_is_evaluated(docs):
    ask = Evaluator()
    found = validation.run(docs, 2, ask, "doc_id").collect()
    assert sorted(ask.asked) == [(d, r) for d in range(6) for r in (1, 2)] and len(found) == 24 and {r.article for r in found} == {"5", "6"}
    assert [(r.doc_id, r.run) for r in found if r.verdict == "breach"] == [(3, 2)]


def test_a_killed_run_resumes(spark, docs, tmp_path):
    table, first = Table(spark, str(tmp_path / "runs"), ["doc_id", "run", "article"], buckets=2), Evaluator(dies_at=4)
    with pytest.raises(RuntimeError, match="dies"):
        validation.resume(table, docs, 2, first, "doc_id", batches=3)
    second = Evaluator()
    found = validation.resume(table, docs, 2, second, "doc_id", batches=3)
    assert set(first.asked).isdisjoint(second.asked) and sorted(first.asked + second.asked) == [(d, r) for d in range(6) for r in (1, 2)]
    assert found.count() == 24
    third = Evaluator()
    assert validation.resume(table, docs, 3, third, "doc_id").count() == 36 and sorted(third.asked) == [(d, 3) for d in range(6)]
    assert validation.resume(table, docs.limit(0), 3, third, "doc_id").count() == 36 and len(third.asked) == 6


def test_a_pass_is_part_of_the_question(spark):
    prompts = spark.createDataFrame([("s", "u", 1), ("s", "u", 2)], "system string, user string, run int")
    told = readers.evaluate(validation.pass_prompts(prompts).select("system", "user"), lambda system, user: system)
    assert sorted(r.answer for r in told.collect()) == ["s\n(pass 1)", "s\n(pass 2)"]


def test_a_text_is_ranked_once_for_all_passes(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "that with from hand " * 50 * (i % 3) + "x") for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, ranker = spark.sparkContext.accumulator(0), retrieval._ranker

    def counted(*how):
        def rank(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return ranker(*how)((seen.add(len(b)), b)[1] for b in batches)

        return rank

    monkeypatch.setattr(retrieval, "_ranker", counted)
    rows = work._evaluated(spark, str(tmp_path)).collect()
    assert len(rows) == 20 * 3 * 3 and seen.value == 20
