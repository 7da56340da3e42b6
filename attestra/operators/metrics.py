"""Obtained verdicts measured against annotated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compared(expected: DataFrame, obtained: DataFrame, keys: list[str]) -> DataFrame:
    """Every annotation with what was obtained; null where nothing was."""
    return expected.join(obtained, keys, "left")


def judged(expected: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """The same where only findings are written down: what has none was found compliant.

    An expectation "tolerated" is taken as compliant, flagged, correct whatever
    was found, and for :func:`counted` no part of the counts.
    """
    rows = compared(expected, findings, keys).withColumn("obtained", F.coalesce("obtained", F.lit("compliant")))
    rows = rows.withColumn("tolerated", F.coalesce(F.col("expected") == "tolerated", F.lit(False)))
    rows = rows.withColumn("expected", F.when(F.col("tolerated"), "compliant").otherwise(F.col("expected")))
    return rows.withColumn("correct", F.col("tolerated") | (F.col("expected") == F.col("obtained")))


def counted(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("tolerated"))


def counters(rows: DataFrame) -> DataFrame:
    """One row of counts over (expected, obtained, never_exclude).

    A missing verdict counts in the total and as faulty, but not as a false negative.
    """
    e, o = F.col("expected"), F.col("obtained")
    there = o.isNotNull()
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(e == o).alias("correct"),
        F.count_if((e == "breach") & (o == "breach")).alias("tp"),
        F.count_if((e != "breach") & (o == "breach")).alias("fp"),
        F.count_if((e == "breach") & there & (o != "breach")).alias("fn"),
        F.count_if((e == "out_of_scope") & there).alias("scope_expected"),
        F.count_if((e == "out_of_scope") & (o == "out_of_scope")).alias("scope_correct"),
        F.count_if(F.col("never_exclude") & (o == "out_of_scope")).alias("wrongful_exclusions"),
        F.count_if((e == "breach") & (o == "out_of_scope")).alias("excluded_breaches"),
        F.count_if(o == "undetermined").alias("undetermined"),
        F.count_if(~there).alias("missing"),
    )


def rates(counts: DataFrame, empty: float) -> DataFrame:
    """precision, recall, f1, accuracy; ``empty`` is precision and recall without a denominator (1 in one engine, 0 in the other)."""
    share = lambda a, b, none: F.when(b > 0, a / b).otherwise(none)
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp"), empty), share(F.col("tp"), F.col("tp") + F.col("fn"), empty)
    out = counts.withColumns({"_p": p, "_r": r})
    f1 = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(0.0)
    accuracy = share(F.col("correct"), F.col("total"), 0.0)
    return out.select(*[F.round(c, 4).alias(n) for n, c in (("precision", F.col("_p")), ("recall", F.col("_r")), ("f1", f1), ("accuracy", accuracy))])


def wilson(hits: Column, total: Column, z: float = 1.96) -> Column:
    """low, high of the score interval, within 0 and 1; (0, 0) without trials."""
    p, d = hits / total, 1 + z * z / total
    middle, half = (p + z * z / (2 * total)) / d, z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / d
    low, high = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return F.struct(F.when(total > 0, F.round(low, 6)).otherwise(0.0).alias("low"), F.when(total > 0, F.round(high, 6)).otherwise(0.0).alias("high"))


def confusion_matrix(rows: DataFrame, values: list[str]) -> DataFrame:
    return rows.groupBy("expected").pivot("obtained", values).count().na.fill(0)


def most_common(rows: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """The n most frequent combinations, ties by name."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(n)


def score_gap(score: Column, low: Column, high: Column) -> Column:
    """0 within the range, else the distance to it; 100 without a score."""
    return F.when(score.isNull(), 100.0).when(score.between(low, high), 0.0).otherwise(F.least(F.abs(score - low), F.abs(score - high)))


def rounded(c: Column, digits: int) -> Column:
    """Half away from zero as SQL engines do, on the scaled number: 12.249999999999998 is 122.5 tenths, thus 12.3; ``F.round`` goes by its decimal digits."""
    return F.round(c * 10.0**digits) / 10.0**digits


def totalled(rows: DataFrame, by: list[str], value: Column, order: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` so far, the group's rows added in their order.

    Sums of doubles end in digits that the order of adding decides, and a score
    that is just between two roundings goes by them.  The last row's sum
    (``max_by`` of ``order``) is the same however the table is split.
    """
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(value).over(so_far))


def reproducibility(scores: DataFrame, verdicts: DataFrame, by: str) -> DataFrame:
    """By document over runs: population deviation and range of scores, unstable articles, stability."""
    spread = scores.groupBy(by).agg(F.count("*").alias("runs"), F.round(F.stddev_pop("score"), 3).alias("deviation"), F.round(F.max("score") - F.min("score"), 3).alias("range"))
    each = verdicts.groupBy(by, "article").agg((F.count_distinct("verdict") > 1).alias("unstable"))
    share = each.groupBy(by).agg(F.count_if("unstable").alias("unstable"), F.round(1 - F.count_if("unstable") / F.count("*"), 4).alias("stability"))
    return spread.join(share, by)


def first_run_stability(verdicts: DataFrame, by: str) -> DataFrame:
    """Share of the first run's articles whose verdict never changes."""
    first = verdicts.filter("run = 1").select(by, "article").distinct()
    same = verdicts.join(first, [by, "article"], "left_semi").groupBy(by, "article").agg((F.count_distinct("verdict") == 1).alias("same"))
    return same.groupBy(by).agg(F.round(F.avg(F.col("same").cast("double")), 4).alias("stability"))


def unstable_share(verdicts: DataFrame, by: str) -> DataFrame:
    """One row: the share of (by, article) whose verdict isn't the same in all runs; 0 without any."""
    each = verdicts.groupBy(by, "article").agg((F.count_distinct("verdict") > 1).alias("unstable"))
    return each.agg(F.coalesce(F.round(F.count_if("unstable") / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0)).alias("unstable_share"))


# Name, bound and direction of the release gates.
GATES = (("recall", 0.90, True), ("precision", 0.95, True), ("accuracy", 0.90, True), ("wrongful_exclusions", 0.0, False), ("out_of_range", 1.0, False), ("unstable_share", 0.0, False), ("undetermined_share", 0.05, False))


def gates(measured: DataFrame) -> DataFrame:
    """One row a gate (gate, value, bound, passed) and whether all passed; ``measured`` is one row."""
    each = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).cast("double").alias("value"), F.lit(b).alias("bound"), F.lit(up).alias("at_least")) for n, b, up in GATES])
    rows = measured.select(F.inline(each))
    rows = rows.withColumn("passed", F.when(F.col("at_least"), F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound")))
    return rows.withColumn("all_passed", F.bool_and("passed").over(Window.partitionBy()))
