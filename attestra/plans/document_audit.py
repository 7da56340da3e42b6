"""The whole path from documents to scores as one plan, without a model: lexical evidence, credits, weighted score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import chunking, retrieval, scoring
from attestra.operators import verdicts as credits

PASSAGES = 3


def documents(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, bodies: the normalised slices of every document that has text."""
    return docs.filter(F.length("text") > 0).select(by, F.transform(chunking.hard_split(F.col("text")), T.normalize).alias("bodies"))


def bodies(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", F.col("chunk_index").alias("position"), T.normalize(F.col("chunk")).alias("body"))


def verdicts_of(best: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, requirement, criticality, verdict, credit from ranked passages (score)."""
    return judged(best.groupBy(by, "requirement").agg(F.first("criticality").alias("criticality"), F.count_if(F.col("score") >= 1).alias("proven")))


def judged(proven: DataFrame) -> DataFrame:
    """``proven`` (how many of the best passages hold a requirement's words) with verdict and credit."""
    verdict = F.when(F.col("proven") == PASSAGES, "compliant").otherwise("breach")
    return proven.withColumn("verdict", verdict).withColumn("credit", credits.credit(F.col("verdict"), F.col("proven"), F.lit(PASSAGES)))


def verdicts(docs: DataFrame, grid: DataFrame) -> DataFrame:
    """A requirement is met if its three best passages all score 1 or more."""
    return verdicts_of(retrieval.lexical_best(documents(docs), grid, F.lit(PASSAGES)))


def audit(docs: DataFrame, grid: DataFrame) -> DataFrame:
    """doc_id, score, n_scored, level."""
    return scoring.weighted(verdicts(docs, grid), "doc_id")
