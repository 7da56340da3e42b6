"""Scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import rules as R
from attestra.functions import text as T
from attestra.operators.metrics import rounded, totalled


def weighted(verdicts: DataFrame, by: str) -> DataFrame:
    """score (0 to 100, one decimal), n_scored, level: credits weighted by criticality over compliant and breach rows."""
    counted = F.col("verdict").isin("compliant", "breach")
    total = F.sum(F.when(counted, F.col("criticality")))
    points = F.sum(F.when(counted, F.col("criticality") * F.col("credit")))
    out = verdicts.groupBy(by).agg(F.coalesce(F.round(100.0 * points / total, 1), F.lit(0.0)).alias("score"), F.count_if(counted).alias("n_scored"))
    return out.withColumn("level", R.level(F.col("score")))


def losses(verdicts: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n articles that cost most points, with loss over 0."""
    lost = F.round(F.col("criticality") * (1 - F.col("credit")), 2)
    rows = verdicts.filter(F.col("verdict").isin("compliant", "breach")).withColumn("lost", lost).filter("lost > 0")
    order = Window.partitionBy(by).orderBy(F.desc("lost"), "article")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(by, "rank", "article", "lost")


def penalties(verdicts: DataFrame, by: str, order: str) -> DataFrame:
    """score by penalties (withheld if over 30 % of the evaluated rows fell back), fallback_ratio, degraded, not_applicable.

    verdicts: outcome, severity, source, evaluated (submitted to the model), and the ``order`` in which penalties are added.
    """
    weight = R.lookup(R.coerce_severity(F.col("severity")), R.SEVERITY_WEIGHT)
    outcome = F.coalesce("outcome", F.lit("undetermined"))
    penalty = F.when(outcome.isin("not_applicable", "yes"), 0.0).when(outcome == "partial", weight * R.PARTIAL_FACTOR).when(outcome == "undetermined", R.UNDETERMINED_PENALTY).otherwise(weight)
    n = F.count_if(outcome != "not_applicable")
    raw = F.when(n == 0, 100.0).otherwise(F.greatest(F.lit(0.0), rounded(100.0 * (1 - F.max_by("_total", order) / n), 1)))
    ratio = F.coalesce(F.avg(F.when(F.col("evaluated"), (~F.col("source").eqNullSafe(F.lit("llm"))).cast("double"))), F.lit(0.0))
    rows = totalled(verdicts, [by], penalty, order, "_total")
    out = rows.groupBy(by).agg(raw.alias("raw"), rounded(ratio, 4).alias("fallback_ratio"), F.count_if(outcome == "not_applicable").alias("not_applicable"))
    out = out.withColumn("degraded", F.col("fallback_ratio") > R.DEGRADED_THRESHOLD)
    return out.withColumn("score", F.when(~F.col("degraded"), F.col("raw"))).drop("raw")


def severity_counts(findings: DataFrame, by: str) -> DataFrame:
    """Findings by severity, zeros included; what isn't applicable is counted apart."""
    real = F.col("status") != "not_applicable"
    counts = [F.count_if(real & (F.col("severity") == s)).alias(s) for s in R.SEVERITIES]
    return findings.groupBy(by).agg(F.count_if(real).alias("findings"), F.count_if(~real).alias("not_applicable"), *counts)


# Headings of a report's groups, in order.
GROUPS = (("non_conformity", "Non-conformities"), ("improvement", "Improvements"), ("not_applicable", "Out of scope"))
EVIDENCE_CHARS = 400


def html_report(findings: DataFrame, by: str, version: Column | None = None) -> DataFrame:
    """by, version, html, sha256: one page for each ``by``.

    Findings stand in three groups under headings with their numbers, ordered
    by severity, then reference and title; severities of what counts are summed
    up first.  Everything is escaped; evidence is cut to 400 characters, which
    is what the page shows.  A page is a row, so its size is that of its findings.
    """
    kind = R.lookup(F.col("kind"), {k: i for i, (k, _) in enumerate(GROUPS)})
    safe = lambda c: T.html_escape(F.coalesce(c, F.lit("")))
    wrap = lambda tag, c: F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat(F.lit(f"<{tag}>"), T.html_escape(c), F.lit(f"</{tag}>")))
    # fields travel and are sorted; pages are written where they arrive
    evidence = F.left("evidence", F.lit(EVIDENCE_CHARS)).alias("evidence")
    key = F.struct(kind.alias("kind"), R.severity_rank(F.col("severity")).alias("rank"), "reference", "title", "severity", "description", evidence, "recommendation", "model_used")
    card = lambda x: F.concat(F.lit('<article class="'), x["severity"], F.lit('"><span>'), safe(x["reference"]), F.lit("</span>"), wrap("h3", x["title"]), wrap("p", x["description"]), wrap("blockquote", x["evidence"]), wrap("aside", x["recommendation"]), wrap("small", x["model_used"]), F.lit("</article>"))
    counts = [F.count_if((F.col("status") != "not_applicable") & (F.col("severity") == s)).alias(f"_{s}") for s in R.SEVERITIES]
    rows = findings.groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("rows"), *counts)
    pills = F.concat(*[F.when(F.col(f"_{s}") > 0, F.concat(F.lit(f'<b class="{s}">{s} '), F.col(f"_{s}").cast("string"), F.lit("</b>"))).otherwise("") for s in R.SEVERITIES])

    def group(i: int, heading: str) -> Column:
        own = F.filter("rows", lambda x: x["kind"] == i)
        body = F.when(F.size(own) == 0, "<p>Nothing to report.</p>").otherwise(F.array_join(F.transform(own, card), ""))
        return F.concat(F.lit(f"<h2>{heading} ("), F.size(own).cast("string"), F.lit(")</h2>"), body)

    number = F.lit(1) if version is None else version
    page = F.concat(F.lit("<html><body><header>"), F.col(by).cast("string"), F.lit(" v"), number.cast("string"), F.lit("</header><section>"), pills, F.lit("</section>"), *[group(i, h) for i, (_, h) in enumerate(GROUPS)], F.lit("</body></html>"))
    return rows.select(by, number.cast("int").alias("version"), page.alias("html")).withColumn("sha256", F.sha2("html", 256))


def synopsis(verdicts: DataFrame, by: str) -> DataFrame:
    kinds = ("compliant", "breach", "out_of_scope", "undetermined")
    return verdicts.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col("verdict") == k).alias(k) for k in kinds])
