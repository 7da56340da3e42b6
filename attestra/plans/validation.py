"""Validation: every document audited several times, and what the audits say compared with what is known."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.vectors import hashing_embedder, nearest_texts
from attestra.operators import chunking, metrics, retrieval, scoring
from attestra.operators.catalogue import held
from attestra.sources.landing import kept
from attestra.sources.snapshots import Table

SIGNIFICANT = 0.02  # fixed value: a smaller gain than two points says nothing


Evaluate = Callable[[DataFrame], DataFrame]


def requests(documents: DataFrame, passes: int, by: str, done: DataFrame | None = None) -> DataFrame:
    """Every document in every pass (``run``, from 1) that ``done`` (by, run, ..) has nothing of."""
    wanted = documents.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    return wanted if done is None else wanted.join(done.select(by, "run").distinct(), [by, "run"], "left_anti")


def run(documents: DataFrame, passes: int, evaluate: Evaluate, by: str, done: DataFrame | None = None) -> DataFrame:
    """Findings of every pass, each evaluated anew, keyed by the article's number: the word "Article" is left out.

    ``evaluate`` takes requests (the documents' columns and run) and gives by,
    run, article_ref and what it found; the pass is part of what it is asked, so
    a client's cache of one pass answers no other one (:func:`pass_prompts`).
    """
    found = _findings(requests(documents, passes, by, done), evaluate)
    return found if done is None else done.unionByName(found)


def _findings(asked: DataFrame, evaluate: Evaluate) -> DataFrame:
    return evaluate(asked).withColumn("article", F.trim(F.replace("article_ref", F.lit("Article"), F.lit("")))).drop("article_ref")


def resume(table: Table, documents: DataFrame, passes: int, evaluate: Evaluate, by: str, batches: int = 1) -> DataFrame:
    """The same, kept in a table by (by, run, article): what an earlier run has committed isn't asked again.

    Documents are committed in ``batches``, by a hash; a run that dies loses the
    batch under way.
    """
    for batch in range(batches):
        part = documents.filter(F.pmod(F.xxhash64(by), F.lit(batches)) == batch)
        done = table.read() if table.version() is not None else None
        missing = requests(part, passes, by, done)
        if not missing.isEmpty():
            table.upsert(_findings(missing, evaluate))
    return table.read()


def pass_prompts(prompts: DataFrame) -> DataFrame:
    """Prompts (system, user, run) whose system text names the pass, so that equal questions of two passes are two."""
    return prompts.withColumn("system", F.concat("system", F.lit("\n(pass "), F.col("run").cast("string"), F.lit(")")))


def scores(rows: DataFrame, by: str) -> DataFrame:
    """by, run, score of the verdicts (criticality, credit) of each pass."""
    keyed = rows.withColumn("_k", F.struct(by, "run"))
    return scoring.weighted(keyed, "_k").select(f"_k.{by}", "_k.run", "score")


def in_range(found: DataFrame, by: str, low: Column, high: Column) -> DataFrame:
    """by, mean_score, in_range: null scores don't count, and a document without any is out of range."""
    mean = found.groupBy(by).agg(F.avg("score").alias("mean"))
    return mean.select(by, F.round("mean", 4).alias("mean_score"), F.coalesce(F.col("mean").between(low, high), F.lit(False)).alias("in_range"))


def totals(passages: DataFrame, by: str, text: str, section: str, articles: Column) -> DataFrame:
    """by, passages, sections, articles_evaluated, tokens."""
    size = F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")
    return passages.groupBy(by).agg(F.count("*").alias("passages"), F.count_distinct(section).alias("sections"), F.max(articles).cast("long").alias("articles_evaluated"), F.sum(size).alias("tokens"))


def rankings(docs: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """retriever, doc_id, requirement, best: the k best passages (position, hit) by words ("lexical"), by vectors ("semantic"), and by both ("fused"); hit: whether a passage holds the query's words.

    A document stays in its row: nothing is shuffled, and all queries of the
    grid (a catalogue) are asked in one go.
    """
    wide = max(2 * k, 10)  # retrieval.widened
    asked, rows = held(grid.select("requirement", retrieval.terms(F.col("query")).alias("words"), hashing_embedder()(F.lower("query")).alias("q")))
    if rows is None:
        raise ValueError("too many requirements for a catalogue that every document is asked about")
    vectors, place = [np.array(r.q, np.float32) for r in rows], F.create_map(*[F.lit(x) for i, r in enumerate(rows) for x in (r.requirement, i)])
    pieces = docs.filter(F.length("text") > 0).select("doc_id", chunking.hard_split(F.col("text")).alias("pieces"))
    texts = pieces.select("doc_id", F.transform("pieces", T.normalize).alias("bodies"), nearest_texts(vectors, wide)(F.transform("pieces", F.lower)).alias("_near"))
    found = retrieval.ranked_bodies(texts, "bodies", asked.drop("q"), {"_scored": ("words", F.lit((1 << 31) - 1))})
    found = found.select("doc_id", "requirement", F.slice("_scored.position", 1, wide).alias("lexical"), F.get("_near", F.element_at(place, F.col("requirement"))).alias("semantic"), F.transform(F.filter("_scored", lambda x: x["score"] >= 1), lambda x: x["position"]).alias("hits"))
    share = lambda places, x: F.when(F.array_contains(places, x), 1.0 / (retrieval.RRF + F.array_position(places, x))).otherwise(0.0)
    every = F.array_distinct(F.concat("lexical", "semantic"))
    fused = F.array_sort(F.transform(every, lambda x: F.struct((-F.round(share(F.col("lexical"), x) + share(F.col("semantic"), x), 6)).alias("less"), x.alias("position"))))["position"]
    lists = F.array(*[F.struct(F.lit(name).alias("retriever"), F.slice(places, 1, k).alias("places")) for name, places in (("lexical", F.col("lexical")), ("semantic", F.col("semantic")), ("fused", fused))])
    each = found.select("doc_id", "requirement", "hits", F.inline(lists)).filter(F.size("places") > 0)
    return each.select("retriever", "doc_id", "requirement", F.transform("places", lambda x: F.struct(x.alias("position"), F.array_contains("hits", x).alias("hit"))).alias("best"))


def compared_retrievers(docs: DataFrame, grid: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """retriever, accuracy, precision, recall, f1, excluded, gain over the lexical one, significant: the same corpus audited with each.

    An article is compliant if all k passages hold its words; ``excluded`` is
    how many articles an audit left out of scope.  truth: doc_id, expected.
    """
    proven = rankings(docs, grid, k).withColumn("proven", F.size(F.filter("best", lambda x: x["hit"])))
    verdict = F.when(F.col("proven") == k, "compliant").otherwise("breach")
    rows = kept(truth.join(proven.select("retriever", "doc_id", verdict.alias("obtained")), "doc_id").withColumn("never_exclude", F.lit(False)))
    out = None
    for name in ("lexical", "semantic", "fused"):
        counts = metrics.counters(rows.filter(F.col("retriever") == name))
        excluded = counts.select((F.col("wrongful_exclusions") + F.col("excluded_breaches")).alias("excluded"))
        rates = metrics.rates(counts, 1.0).crossJoin(excluded).withColumn("retriever", F.lit(name))
        out = rates if out is None else out.unionByName(rates)
    base = out.filter("retriever = 'lexical'").select(F.col("accuracy").alias("_base"))
    gain = F.round(F.col("accuracy") - F.col("_base"), 4)
    return out.crossJoin(F.broadcast(base)).select("retriever", "accuracy", "precision", "recall", "f1", "excluded", gain.alias("gain"), (F.abs(gain) >= SIGNIFICANT).alias("significant"))
