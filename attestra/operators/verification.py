"""Quotations checked against their source."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import quotations as near
from attestra.operators.quotations import SIMILAR

# Shortest normalised quotation for evidence, and for exclusions and exemptions.
SHORTEST, SHORTEST_EXCLUSION = 25, 15


def _placed(quotes: Column, normal: Column, shortest: int) -> Column:
    """Of each quotation what it is normalised (n), why it is rejected unseen (reason), and its place in the normalised document (at)."""
    plain = F.transform(quotes, lambda q: F.struct(q.alias("q"), T.normalize(q).alias("n")))
    marked = F.transform(plain, lambda x: F.struct(x["n"].alias("n"), F.when(F.coalesce(F.trim(x["q"]), F.lit("")) == "", "empty").when(F.length(x["n"]) < shortest, "too short").alias("reason")))
    place = lambda d: lambda x: F.struct(x["n"].alias("n"), x["reason"].alias("reason"), F.when(x["reason"].isNull(), F.instr(d, x["n"]) - 1).alias("at"))
    # through a one-element array: what lambdas refer to is computed once
    return F.get(F.transform(F.array(F.struct(normal.alias("d"), marked.alias("m"))), lambda r: F.transform(r["m"], place(r["d"]))), 0)


def _exact(x: Column) -> Column:
    found = F.coalesce(x["at"] >= 0, F.lit(False))
    reason = F.coalesce(x["reason"], F.when(found, "exact").otherwise("not found"))
    return F.struct(found.alias("valid"), reason.alias("reason"), F.when(found, 1.0).otherwise(0.0).alias("similarity"), F.when(found, x["at"]).otherwise(-1).cast("int").alias("position"))


def _near(x: Column, c: Column) -> Column:
    """The exact check of a quotation, or the fuzzy one where it isn't found and there is one."""
    similar = c["similarity"] >= SIMILAR
    fuzzy = F.struct(similar.alias("valid"), F.when(similar, "approximate").otherwise("not found").alias("reason"), c["similarity"].alias("similarity"), F.when(similar, c["position"]).otherwise(-1).cast("int").alias("position"))
    return F.when(c.isNull(), _exact(x)).otherwise(fuzzy)


def verify(quote: Column, document: Column, shortest: int = SHORTEST) -> Column:
    """valid, reason, similarity, position (in the normalised document, from 0) of one quotation, the exact tier."""
    return F.get(verify_each(F.array(quote), document, shortest), 0)


def verify_each(quotes: Column, document: Column, shortest: int = SHORTEST) -> Column:
    """The same for an array of quotations; the document is normalised once for all of them."""
    return verify_in(quotes, T.normalize(document), shortest)


def verify_in(quotes: Column, normal: Column, shortest: int = SHORTEST) -> Column:
    """The same in a document that is normalised already."""
    return F.transform(_placed(quotes, normal, shortest), _exact)


def checked(rows: DataFrame, quotes: Column, document: Column, shortest: int = SHORTEST, tolerance: str | None = None, name: str = "checks") -> DataFrame:
    """``rows`` with the checks of an array of quotations, as the column ``name``.

    Tiers, strictest first: blank and short quotations are rejected, exact ones
    (after normalising) accepted.  With ``tolerance`` one that isn't found is
    accepted as "approximate" if a stretch of the document is similar enough:
    by edits, wherever it is ("edits", see :mod:`quotations`; the similarity of
    what is farther away is 0), or by fixed windows ("parity").
    """
    if tolerance is None:
        return rows.withColumn(name, verify_each(quotes, document, shortest))
    # a Python function takes no lambdas' results directly: they are a column first
    rows = rows.withColumn("_normal", T.normalize(document)).withColumn("_placed", _placed(quotes, F.col("_normal"), shortest))
    rows = rows.withColumn("_asked", F.transform("_placed", lambda x: F.when(x["at"] < 0, x["n"])))
    found = rows.withColumn("_found", (near.closest() if tolerance == "edits" else _parity())(F.col("_asked"), F.col("_normal")))
    return found.withColumn(name, F.zip_with("_placed", "_found", _near)).drop("_normal", "_placed", "_asked", "_found")


def quotations(many: Column, single: Column) -> Column:
    """One clean list from the two ways in which a model may quote: the single one first, if it is new; blanks out."""
    listed = F.coalesce(many, F.array().cast("array<string>"))
    joined = F.when(single.isNull() | F.array_contains(listed, single), listed).otherwise(F.concat(F.array(single), listed))
    return F.filter(joined, lambda x: x.isNotNull() & (F.trim(x) != ""))


def evidence(elements: DataFrame, tolerance: str | None = None) -> DataFrame:
    """element rows (blocking, claimed, quotes, document) with verified, similarity, reason, retained, rejected.

    An element that is claimed without a quotation is rejected; with several,
    all must verify, and the lowest similarity counts.
    """
    asked = F.when(F.col("claimed"), F.col("quotes"))
    rows = checked(elements, asked, F.col("document"), SHORTEST, tolerance)
    some = F.size("quotes") > 0
    verified = F.col("claimed") & some & F.forall("checks", lambda c: c["valid"])
    wrong = F.get(F.filter("checks", lambda c: ~c["valid"]), 0)["reason"]
    rows = rows.withColumns(
        {
            "verified": F.coalesce(verified, F.lit(False)),
            "similarity": F.when(F.col("claimed") & some, F.array_min(F.transform("checks", lambda c: c["similarity"]))).otherwise(0.0),
            "reason": F.when(F.col("claimed") & ~some, "no quotation").when(F.col("claimed"), wrong),
            "quotation": F.when(some, F.array_join("quotes", " […] ")),
        }
    )
    retained = F.col("claimed") & F.col("verified")
    return rows.withColumns({"retained": F.coalesce(retained, F.lit(False)), "rejected": F.coalesce(F.col("claimed") & ~retained, F.lit(False))}).drop("checks")


def latest_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Of answers with the same key the last one counts."""
    return answers.groupBy(*keys).agg(*[F.max_by(c, "position").alias(c) for c in answers.columns if c not in (*keys, "position")])


def best_sentences(rows: DataFrame, by: str) -> DataFrame:
    """by, n, sentence: of each document the first sentence (40 characters or more) that shares most words over five letters with the title; two at least.

    rows: by, title, document.  Sentences become rows of their own, so each is
    normalised once, and the best one is an aggregate with partial results.
    """
    asked = rows.select(by, F.array_distinct(F.filter(F.split(T.normalize(F.col("title")), " "), lambda w: F.length(w) > 5)).alias("words"), "document")
    cut = asked.filter(F.size("words") >= 2).select(by, "words", F.posexplode(F.split("document", r"(?<=[.!?])\s+|\n")).alias("i", "s"))
    plain = cut.withColumn("s", F.trim("s")).filter(F.length("s") >= 40).withColumn("own", F.split(T.normalize(F.col("s")), " "))
    scored = plain.select(by, "i", "s", F.size(F.array_intersect("words", "own")).alias("n"))
    # an extra step between: the count isn't taken anew for each use below
    best = scored.groupBy(by).agg(F.max(F.struct("n", (-F.col("i")).alias("first"), "s")).alias("b"))
    return best.filter("b.n >= 2").select(by, "b.n", F.col("b.s").alias("sentence"))


def _windows(q: str, d: str) -> Iterator[tuple[int, int]]:
    """Start and end of the stretches of d that the fixed windows look at (fixed values): around 40 places of pieces of 12 characters at most, or some 400 steps along d if there are none, with margins of 20 characters or a fifth on both sides."""
    n = len(q)
    margin = max(20, n // 5)
    places: dict[int, None] = {}
    seen = 0
    for i in range(0, max(1, n - 12), max(12, n // 8)):
        at = -1
        while seen < 40 and (at := d.find(q[i : i + 12], at + 1)) >= 0:
            places[max(0, at - i)] = None
            seen += 1
    for at in sorted(places) or range(0, max(1, len(d) - n + 1), max(1, (len(d) - n) // 400)):
        low = max(0, at - margin)
        yield low, min(len(d), low + n + 2 * margin)


def closest_window(q: str | None, d: str | None) -> tuple[float, int] | None:
    """(similarity, start) of the fixed window of d that is most similar to q, the first of equals; None without a quotation."""
    if q is None or d is None:
        return None
    if not q or not d:
        return 0.0, -1
    best = (0.0, -1)
    for low, high in _windows(q, d):
        own = difflib.SequenceMatcher(None, q, d[low:high])
        if own.real_quick_ratio() <= best[0] or own.quick_ratio() <= best[0]:
            continue
        if (found := own.ratio()) > best[0]:
            best = found, low
        if found >= 0.99:
            break
    return best


def _parity():
    """A column function like :func:`quotations.closest`, with the fixed windows."""

    @F.pandas_udf("array<struct<similarity:double,position:int>>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for quotes, documents in batches:
            rows = [None if many is None else [closest_window(q, d) for q in many] for many, d in zip(quotes, documents, strict=True)]
            yield pd.Series([None if r is None else [None if x is None else {"similarity": x[0], "position": x[1]} for x in r] for r in rows])

    return found.asNondeterministic()  # so that the optimiser neither repeats it nor moves it into a filter
