"""Audit of how far the sources of a language differ in their words.

Equal texts of a language are collapsed first: each is tokenised once, and its
words count as often as each source holds it.  A language keeps the words that
at least ``LEAST`` of its documents have.  Every source, and the language as a
whole, gives each kept word a smoothed probability in billionths, and

    f = floor((p - q) ** 2 / q)

compares two of them; all arithmetic is on whole numbers.

Most words are missing from most sources, and all of those have one probability
p0 in a source.  With T the words that a source has, and V words kept,

    sum f(p, q) = V f(p0, q0)
                + sum over T_p of f(p, q0) - f(p0, q0)
                + sum over T_q of f(p0, q) - f(p0, q0)
                + sum over both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The second and third sums need only how many words a source has how often; the
last goes over the sources that share a word, added up inside a task.

Rows: null texts, languages and sources are ''; a repeated row counts again.
A source without any word is compared too; a language that keeps no word has
value 0 for every pair, and no terms.  Terms and items are ordered by their
UTF-8 bytes.  Texts are equal if 128 bits of their hashes are.

Scale: copies travel as hashes and counts.  A text that stands alone is tokenised
where it is read; of repeated ones a map task sends one copy.  Which are repeated
is broadcast as hashes if they are few enough by count (``BROADCAST_BYTES``);
beyond that all texts are shuffled, once.  A row of the term table holds one
word's counts, one number a source.  Pair sums leave a task as one row a pair and
million comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.base import written

#: Documents of a language that have to hold a word.
LEAST = 3
#: Ranks of the words of a source that are listed.
TERMS = 200
ONE = 1_000_000_000
WORD = r"([^\x00-\x40\x5B-\x60\x7B-\x7F]+)"
#: Most bytes of the hashes of repeated texts that are broadcast, and bytes that one takes there.
BROADCAST_BYTES, KEY_BYTES = 64 << 20, 64
#: Comparisons of two sources that a task makes before it sends sums.
COMPARISONS = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _f(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _p(count: Column, total: Column, kept: Column) -> Column:
    """Smoothed probability in billionths; counts beyond nine billion need more digits than a long has."""
    wide = _div((count + 1).cast("decimal(19,0)") * F.lit(ONE).cast("decimal(19,0)"), (total + kept).cast("decimal(19,0)"))
    return 1 + F.when(count < 9_000_000_000, _div((count + 1) * ONE, total + kept)).otherwise(wide)


def terms_of(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Every (lang, source) of ``docs``; and every kept word of a lang with its number of documents, its count, and the count of each source that has it."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    key = ["lang", "_h", "_i"]
    rows = docs.select(*plain).withColumns({"_h": F.xxhash64("text"), "_i": F.xxhash64(F.lit(11), "text")})
    copies = written(rows.groupBy(*key, "source").agg(F.count("*").alias("n")), "copies")
    held = copies.groupBy(*key).agg(F.collect_list(F.struct("source", "n")).alias("held"), F.sum("n").alias("n"))  # a row a source at most
    texts = rows.filter(F.col("text") != "")
    repeated, alone = written(held.filter(F.col("n") > 1), "repeated"), None
    if repeated.count() * KEY_BYTES <= BROADCAST_BYTES:
        marks = F.broadcast(repeated.select(*key))
        alone = texts.join(marks, key, "left_anti").select("lang", F.array(F.struct("source", F.lit(1).cast("long").alias("n"))).alias("held"), F.lit(1).cast("long").alias("n"), "text")
        texts, held = texts.join(marks, key, "left_semi"), repeated
    texts = texts.groupBy(*key).agg(F.first("text").alias("text")).join(held, key).select("lang", "held", "n", "text")
    texts = texts if alone is None else alone.unionByName(texts)
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(WORD), 1)
    # each word as often as it stands there, for every source; and once, for the text
    both = texts.select("lang", "held", "n", words.alias("w")).select("lang", "held", "n", F.posexplode(F.array("w", F.array_distinct("w"))).alias("once", "w"))
    whole = F.array(F.struct(F.col("held")[0]["source"].alias("source"), F.col("n").alias("n")))
    each = both.select("lang", "once", "w", F.explode(F.when(F.col("once") == 0, F.col("held")).otherwise(whole)).alias("h"))
    each = each.select("lang", "h.source", "once", "h.n", F.explode("w").alias("term"))
    count, documents = (F.sum(F.when(F.col("once") == i, F.col("n")).otherwise(0)).alias(name) for i, name in enumerate(("count", "documents")))
    cells = each.groupBy("lang", "term", "source").agg(count, documents)
    terms = cells.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("count").alias("count"), F.collect_list(F.struct("source", "count")).alias("held"))
    return copies.select("lang", "source").distinct(), written(terms.filter(F.col("documents") >= least), "terms")


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the fourth part of the value, for each two sources that share words of the batch."""
    for batch in batches:
        held = batch.column(1)
        sizes = np.asarray(held.value_lengths())
        flat = held.flatten()
        source, p, p0 = (flat.field(i) for i in range(3))
        langs, of_lang = np.unique(np.asarray(batch.column(0).to_pylist(), object), return_inverse=True)
        coded = source.dictionary_encode()
        both = np.repeat(of_lang, sizes) * len(coded.dictionary) + coded.indices.to_numpy()
        groups, code = np.unique(both, return_inverse=True)
        p, p0 = p.to_numpy(), p0.to_numpy()
        begin = np.cumsum(sizes) - sizes
        for size in np.unique(sizes[sizes > 1]).tolist():
            terms = begin[sizes == size]
            many, rows = max(1, COMPARISONS // size**2), max(1, COMPARISONS // size)
            for t in range(0, len(terms), many):
                at = terms[t : t + many, None] + np.arange(size)
                for r in range(0, size, rows):
                    yield _sums(at[:, r : r + rows], at, p, p0, code, groups, langs, coded.dictionary)


def _sums(mine, other, p, p0, code, groups, langs, sources) -> pa.RecordBatch:
    """Value of each ``mine`` with each ``other`` place of its row, added up by the pair of their groups."""
    i, j = (np.broadcast_to(x, (*mine.shape, other.shape[1])).reshape(-1) for x in (mine[:, :, None], other[:, None, :]))
    i, j = i[i != j], j[i != j]

    def f(a, b):
        return (a - b) ** 2 // b

    value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
    pairs, inverse = np.unique(code[i] * len(groups) + code[j], return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, inverse, value)
    one, two = groups[pairs // len(groups)], groups[pairs % len(groups)]
    columns = [pa.array(langs[one // len(sources)], pa.string()), sources.take(pa.array(one % len(sources))), sources.take(pa.array(two % len(sources))), pa.array(total)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])


def audit(docs: DataFrame, least: int = LEAST, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: every other source of the lang (``pair``), and the source's words that stand out most (``term``)."""
    everyone, kept = terms_of(docs, least)
    held = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.count").alias("total"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("count").alias("lang_total"))
    groups = everyone.join(held, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0)
    p0 = F.when(F.col("kept") > 0, _p(F.lit(0), F.col("total"), F.col("kept")))
    groups = written(groups.withColumn("p0", p0), "groups")

    cells = kept.select("lang", "term", F.col("count").alias("lang_count"), F.explode("held").alias("h")).select("lang", "term", "lang_count", "h.source", "h.count").join(groups, ["lang", "source"])
    cells = cells.withColumns({"p": _p(F.col("count"), F.col("total"), F.col("kept")), "q": _p(F.col("lang_count"), F.col("lang_total"), F.col("kept"))})
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = cells.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    found = found.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= terms)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    none = groups.select("lang", "source", "kept", "p0").join(other, "lang").filter(F.col("source") != F.col("item"))
    none = none.select("lang", "source", "item", F.coalesce(F.col("kept") * _f(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    often = cells.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("n")).join(other, "lang").filter(F.col("source") != F.col("item"))
    p, p0, q0, n = (F.col(c) for c in ("p", "p0", "q0", "n"))
    here = F.struct("source", "item", (n * (_f(p, q0) - _f(p0, q0))).alias("value"))
    there = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (n * (_f(q0, p) - _f(q0, p0))).alias("value"))
    one = often.select("lang", F.explode(F.array(here, there)).alias("v")).select("lang", "v.*")
    shared = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held")).filter(F.size("held") > 1).select("lang", "held")
    both = shared.mapInArrow(_pair_sums, "lang string, source string, item string, value long")
    pairs = none.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_rank))
    return pairs.unionByName(found)
