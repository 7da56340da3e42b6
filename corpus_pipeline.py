"""From raw documents to a training mix: five operators, one after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import decontaminate, jaccard, langid, mixing, pii
from attestra.llm.base import written


def _row(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and the whole row, whatever other columns are called."""
    return docs.select("doc_id", "text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart clearly; a missing language is filled in."""
    # text once: rows wait for the Python workers in memory
    rest = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))
    found = langid.identify(rest, langid.dictionaries(docs, langid.is_training(5))).filter(~F.col("rejected"))
    known = F.coalesce(F.col("_row.lang"), F.col("lang_pred"))
    return found.select(*[(known if c == "lang" else F.col("text") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    return jaccard.keep_one(docs, n=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to count as contaminated."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(_row(docs), benchmark).filter(~F.col("contaminated")).select("_row.*")


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target mix takes, and how many copies of each."""
    return mixing.select(docs, mixing.domain_of_source(F.col("source")), mixing.SHARE, mixing.MAX_EPOCHS, mixing.WEIGHTS, mixing.SEED)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", without_pii),
    ("mixing sources to target weights", mixed),
]

#: Compression sizes can't be had in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
