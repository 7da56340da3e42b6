"""Periodic runs of words: online diagonal matching, one lag at a time for every word.

A run is a stretch of words with smallest period q, at least max(6, 4 q) words
long, that no neighbouring word extends.  Seen as a matrix of a text against
itself, it is a stretch of the diagonal with lag q.  Every word looks for its
latest earlier occurrence; if that lies at the lag of the word before it, the
match length of that lag grows by one, otherwise the old diagonal ends, is
emitted if it was long enough, and a new one begins.

That one occurrence is enough, and the work stays n log n where a word fills
the whole text, if a word is taken with the words after it: at width K, a power
of two, for the lags q with K / 2 < q <= K.  A run is more than q + K words
long, and inside it a window of q words or more recurs at multiples of q only,
so the latest earlier occurrence is exactly one period back at every place, and
the diagonal is unbroken from the run's second period to its last window.
Conversely an unbroken diagonal of such windows has no smaller period, since
that would be a later occurrence.  Windows of width 2 K are named by the pair
of names of their halves; only those whose halves both recur are looked at
again, so a text without repeated phrases is done after two or three widths.

Rows: a null or empty text has no words and no runs.  Rows that are repeated
are judged on their own, each as it is.  Columns of ``docs`` stay, unless they
are called as one that is added.  Words are equal if 64-bit hashes are.

Scale: one pass over the texts without a shuffle; a task holds half a megabyte
of text, or one text that is longer, at some 100 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import hashing
from attestra.llm.base import chunks, text_bytes

#: Least words of a run, and least periods in it.
LEAST_WORDS, LEAST_PERIODS = 6, 4

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _diagonals(at: np.ndarray, names: np.ndarray, width: int) -> Runs:
    """Start, length and period of the diagonals of sufficient length at lags in (width / 2, width].

    ``at`` are places in ascending order, ``names`` the windows that begin
    there; equal windows have equal names.
    """
    order = np.argsort(names, kind="stable")
    lag = np.zeros(len(at), np.int64)  # 0: no earlier occurrence
    same = names[order[1:]] == names[order[:-1]]
    lag[order[1:][same]] = (at[order[1:]] - at[order[:-1]])[same]
    goes_on = (lag[1:] == lag[:-1]) & (at[1:] == at[:-1] + 1)
    first = np.flatnonzero(np.append(True, ~goes_on)) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(at)))
    period = lag[first]
    length = count + width - 1 + period
    enough = (2 * period > width) & (period <= width) & (length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period))
    return (at[first] - period)[enough], length[enough], period[enough]


def runs_of(words: np.ndarray, rows: np.ndarray) -> Runs:
    """Start, length and period of all runs in ``words``, hashes cut into texts by the offsets ``rows``; sorted by start, then period.

    No run crosses from one text into the next.
    """
    of = np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows))
    names = np.unique(hashing.mix(words ^ hashing.mix(of + np.uint64(1))), return_inverse=True)[1]
    at, width, found = np.arange(len(words)), 1, []
    while len(at):
        found.append(_diagonals(at, names, width))
        recurs = np.bincount(names)[names] > 1
        name_at = np.full(len(words) + width, -1, np.int64)
        name_at[at[recurs]] = names[recurs]
        # the second half of a window lies ``width`` words on; where that text is over, names of another text, or none, stand there
        wide = at[recurs]
        wide = wide[name_at[wide + width] >= 0]
        wide = wide[of[wide] == of[wide + width]]
        pairs = name_at[wide] * np.int64(len(words) + 1) + name_at[wide + width]
        at, names, width = wide, np.unique(pairs, return_inverse=True)[1], 2 * width
    start, length, period = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for part in chunks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
            yield _found(part.column(0))


def _found(texts: pa.Array) -> pa.Array:
    data, offsets = text_bytes(texts)
    starts, ends, rows = hashing.words(data, offsets, hashing.WHITESPACE)
    start, length, period = runs_of(hashing.word_hashes(data, starts, ends), rows)
    edge = np.zeros(len(starts) + 1, np.int64)  # +1 where words that repeat begin, -1 where they end
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    cuts = np.searchsorted(start, rows)
    of = np.searchsorted(rows, start, "right") - 1
    fields = [pa.array(x) for x in (start - rows[of], length, period)]
    runs = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    raw, texts_kept = data.tobytes(), []
    for i in range(len(texts)):
        mine = np.arange(rows[i], rows[i + 1])[kept[rows[i] : rows[i + 1]]]
        texts_kept.append(b" ".join([raw[a:b] for a, b in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)]))
    return pa.StructArray.from_arrays([pa.array(np.diff(rows)), runs, pa.array(texts_kept, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; by start, then period) and collapsed.

    ``collapsed`` is the text's words, joined by one space, without those that
    a run holds after its first period.
    """
    made = {"n_words": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}
    kept = docs.drop(*made, "_runs")
    udf = F.arrow_udf(_judge, f"struct<{','.join(f'{n}:{t}' for n, t in made.items())}>")
    return kept.withColumn("_runs", udf("text")).select(*[F.col(f"`{c}`") for c in kept.columns], *[F.col(f"_runs.{n}").alias(n) for n in made])


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with the text of every tenth document (by crc32 of its id) turned periodic from some word on; other texts, and those without an id, unchanged."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    cut = docs.withColumn("_w", words).withColumn("_n", F.size("_w").cast("long")).withColumn("_g", F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10"))
    cut = cut.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int")).withColumn("_p", F.expr("int(1 + (_n - _a) div (3 + _g % 8))"))
    again = F.expr("slice(flatten(array_repeat(slice(_w, _a + 1, _p), int((_n - _a + _p - 1) div _p))), 1, int(_n - _a))")
    text = F.when(F.col("_n") > 0, F.array_join(F.concat(F.expr("slice(_w, 1, _a)"), again), " ")).otherwise(F.col("text"))
    return cut.withColumn("text", text).drop("_w", "_n", "_g", "_a", "_p")


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest (ties: smallest start, then period), and hashes of all runs and of what is kept."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("_best.length * 1000 div -_best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
