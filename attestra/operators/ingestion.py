"""Regulations: parsing lines into articles, and versions that change over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.literal import Literal
from attestra.operators import verdicts

# How a regulation's pages mark an article and a chapter, and where they are.
HEADER = r"(?i)^\s*Article\s+(premier|\d+(?:\s*(?:bis|ter|quater))?)\s*$"
CHAPTER = r"(?i)^\s*(CHAPITRE|TITRE)\s+([IVXLC]+|\d+)\s*$"
URL = "https://eur-lex.europa.eu/legal-content/FR/TXT/HTML/?uri=CELEX:%s"
# The regulations that are watched.
REGISTRY = Literal(
    "code VARCHAR, name VARCHAR, pillar VARCHAR, celex VARCHAR, authority VARCHAR, version_label VARCHAR, effective_date DATE",
    (
        ("rgpd", "Reglement general sur la protection des donnees (UE) 2016/679", "privacy", "32016R0679", "Parlement europeen et Conseil", "2016/679", "2018-05-25"),
        ("nis2", "Directive (UE) 2022/2555 dite NIS 2", "cybersecurity", "32022L2555", "Parlement europeen et Conseil", "2022/2555", "2024-10-18"),
        ("csrd", "Directive (UE) 2022/2464 sur la publication d'informations en matiere de durabilite", "sustainability", "32022L2464", "Parlement europeen et Conseil", "2022/2464", "2024-01-05"),
        ("ai_act", "Reglement (UE) 2024/1689 etablissant des regles harmonisees concernant l'intelligence artificielle", "ai_governance", "32024R1689", "Parlement europeen et Conseil", "2024/1689", "2024-08-01"),
        ("dora", "Reglement (UE) 2022/2554 sur la resilience operationnelle numerique du secteur financier", "operational_resilience", "32022R2554", "Parlement europeen et Conseil", "2022/2554", "2025-01-17"),
    ),
)


def registry(spark: SparkSession) -> DataFrame:
    """code, name, pillar, celex, authority, url, version_label, effective_date of the regulations that are watched."""
    return REGISTRY.df(spark).withColumn("url", F.format_string(URL, "celex"))


def registered(pages: DataFrame, code: Column) -> DataFrame:
    """Landed pages (any columns) by the source that ``code`` names: the registry's entry, or null where it has none, and how many pages there are."""
    landed = pages.groupBy(code.alias("code")).agg(F.count("*").alias("n_pages"))
    return landed.join(registry(pages.sparkSession), "code", "left")


def articles(lines: DataFrame) -> DataFrame:
    """source, ordering, reference, title, body, chapter of the articles in numbered lines.

    A header opens an article, the line after it is its title, what follows its
    body.  A reference that comes again is a quotation: the first one stays,
    and the rest are numbered anew.
    """
    w = Window.partitionBy("source").orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    head, chap = F.col("line").rlike(HEADER), F.col("line").rlike(CHAPTER)
    rows = lines.withColumns({"head": head, "chap": chap})
    rows = rows.withColumns(
        {
            "art": F.sum(F.col("head").cast("int")).over(so_far),
            "chapter": F.last(F.when(F.col("chap"), F.concat_ws(" ", F.initcap(F.regexp_extract("line", CHAPTER, 1)), F.regexp_extract("line", CHAPTER, 2))), True).over(so_far),
            "next": F.when(~F.lead("head").over(w), F.lead("line").over(w)),
        }
    ).filter("art > 0")
    number = F.regexp_extract("line", HEADER, 1)
    reference = F.concat(F.lit("Article "), F.when(F.lower(number) == "premier", "1").otherwise(number))
    heads = rows.filter("head").select("source", "art", reference.alias("reference"), "next", "chapter")
    text = rows.filter("not head and not chap").join(heads.select("source", "art", F.coalesce("next", "reference").alias("skip")), ["source", "art"]).filter("line <> skip")
    bodies = text.groupBy("source", "art").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    found = heads.join(bodies, ["source", "art"], "left")
    first = Window.partitionBy("source", "reference").orderBy("art")
    found = found.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    title = F.coalesce("next", "reference")
    return found.select(
        "source",
        F.row_number().over(Window.partitionBy("source").orderBy("art")).alias("ordering"),
        "reference",
        F.left(title, F.lit(400)).alias("title"),
        F.coalesce(F.nullif(F.trim("body"), F.lit("")), title).alias("body"),
        "chapter",
    )


def status(versions: DataFrame, fetched: DataFrame) -> DataFrame:
    """``fetched`` with status: created, updated or unchanged, by the digest of the current version."""
    current = versions.filter("is_current").select("code", F.col("digest").alias("known"))
    found = F.when(F.col("known").isNull(), "created").when(F.col("known") == F.col("digest"), "unchanged").otherwise("updated")
    return fetched.join(current, "code", "left").withColumn("status", found).drop("known")


def next_versions(versions: DataFrame, fetched: DataFrame) -> DataFrame:
    """All versions after an ingestion: a changed regulation's current one is closed, a new one opened.

    A label that is taken already gets the date of the fetch, then .2, .3, ...
    Ingesting the same text again changes nothing.
    """
    changed = fetched.filter("status <> 'unchanged'")
    taken = versions.groupBy("code").agg(F.collect_set("version_label").alias("taken"))
    dated = F.concat(F.col("version_label"), F.lit(" ("), F.col("fetched").cast("string"), F.lit(")"))
    taken_or_none = F.coalesce("taken", F.array().cast("array<string>"))
    numbered = F.transform(F.sequence(F.lit(2), F.size(taken_or_none) + 2), lambda i: F.concat(dated, F.lit("."), i.cast("string")))
    choices = F.concat(F.array("version_label", dated), numbered)
    label = F.get(F.filter(choices, lambda x: ~F.array_contains(taken_or_none, x)), 0)
    opened = changed.join(taken, "code", "left").select("code", label.alias("version_label"), "digest", F.lit(True).alias("is_current"))
    closing = opened.select("code", F.lit(True).alias("closing"))
    kept = versions.join(closing, "code", "left").select("code", "version_label", "digest", (F.col("is_current") & F.col("closing").isNull()).alias("is_current"))
    return kept.unionByName(opened)


def preview(found: DataFrame) -> DataFrame:
    """By source: articles, length and digest of their text, the first five references."""
    ordered = F.array_sort(F.collect_list(F.struct("ordering", "reference", "body")))
    out = found.groupBy("source").agg(F.count("*").alias("n_articles"), F.sum(F.length("body")).alias("text_length"), ordered.alias("o"))
    digest = F.sha2(F.array_join(F.transform("o", lambda x: x["body"]), "\n"), 256)
    return out.select("source", "n_articles", "text_length", digest.alias("digest"), F.slice(F.transform("o", lambda x: x["reference"]), 1, 5).alias("first_references"))


def ingest_all(found: DataFrame, versions: DataFrame, framework: Column, codes: list[str] | None = None) -> DataFrame:
    """code, n_articles, auditable, digest, status of every source whose articles are in ``found``, or of those named.

    All sources are one plan: nothing is looped over.
    """
    rows = found if codes is None else found.filter(F.col("source").isin(*codes))
    who = verdicts.audience(framework, F.col("reference"), T.article_number(F.col("reference")), F.col("body"))
    auditable = rows.groupBy("source").agg(F.count_if(who == "entity").alias("auditable"))
    fetched = preview(rows).join(auditable, "source").withColumnRenamed("source", "code")
    return status(versions, fetched).select("code", "n_articles", "auditable", "digest", "status")


def upsert_frameworks(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """By code: new rows come in, known ones get the fetched name, url and license and keep the rest."""
    joined = known.alias("k").join(fetched.alias("f"), "code", "full")
    fresh = ("name", "url", "license")
    return joined.select("code", *[F.coalesce(f"f.{c}", f"k.{c}").alias(c) if c in fresh else F.coalesce(f"k.{c}", f"f.{c}").alias(c) for c in known.columns if c != "code"])
