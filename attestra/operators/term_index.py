"""Lexical ranking from an index of grams, so that passages without a term are never scored.

The index is a table of postings: every stretch of three characters without a
space, and the passages that have it, written once in folders by a hash of the
gram, sorted within files.  A passage can have a term only if it has all of the
term's grams; those that do are read and counted exactly.

Passages are numbered within blocks as they are written, and a posting is a row
for a gram and some of a block's passages, so that neither the rows that are
sorted nor what is shuffled grow with the characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import retrieval
from attestra.operators.catalogue import paired

GRAM = 3
BUCKETS = 64
#: Passages in a block, and characters that one numpy call reads.
BLOCK, CHARACTERS = 4096, 4 << 20


def grams(text: Column) -> Column:
    """The distinct stretches of GRAM characters without a space."""
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM)))), lambda g: ~F.contains(g, F.lit(" ")))


def _bucket(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _stretches(block: int, ordinals: np.ndarray, bodies: pa.Array) -> Iterator[pa.RecordBatch]:
    """A row for each gram of some passages of a block: their first ordinal names them, for all grams of a passage are told together."""
    ends = np.cumsum(pc.utf8_length(bodies).to_numpy(zero_copy_only=False))
    chars, letter = np.unique(np.frombuffer("".join(bodies.to_pylist()).encode("utf-32-le"), "<u4"), return_inverse=True)
    if len(bodies) > 1 and (ends[-1] > CHARACTERS or len(chars) ** GRAM * len(bodies) >= 1 << 63):
        half = len(bodies) // 2
        yield from _stretches(block, ordinals[:half], bodies.slice(0, half))
        yield from _stretches(block, ordinals[half:], bodies.slice(half))
        return
    n = max(0, len(letter) - GRAM + 1)
    whose = np.repeat(np.arange(len(bodies)), np.diff(ends, prepend=0))
    word = chars[letter] != ord(" ")
    ok, code = whose[:n] == whose[len(whose) - n :], np.zeros(n, np.int64)
    for i in range(GRAM):
        ok &= word[i : i + n]
        code = code * len(chars) + letter[i : i + n]
    pairs = np.sort(code[ok] * len(bodies) + whose[:n][ok])
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    code, passage = np.divmod(pairs, len(bodies))
    begins = np.flatnonzero(np.diff(code, prepend=-1))
    letters = code[begins][:, None] // len(chars) ** np.arange(GRAM)[::-1] % max(1, len(chars))
    told = chars[letters].astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(pairs)), pa.int32()), pa.array(ordinals[passage].astype(np.int16)))
    part = pa.array(np.full(len(begins), block << 12 | int(ordinals[0])))
    whole = pa.RecordBatch.from_arrays([part, pa.array([told[i : i + GRAM] for i in range(0, len(told), GRAM)], pa.string()), lists], ["part", "gram", "ordinals"])
    for at in range(0, len(whole), BLOCK):
        yield whole.slice(at, BLOCK)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column("body")))
        blocks = batch.column("block").to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(blocks))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield from _stretches(int(blocks[a]), batch.column("ordinal").to_numpy()[a:z], batch.column("body").slice(a, z - a))


@dataclass(frozen=True)
class TermIndex:
    """``postings``: gram, by, position; ``passages``: by, position, body, and their block and ordinal in it."""

    spark: SparkSession
    path: str
    by: str

    @property
    def packed(self) -> DataFrame:
        """bucket, gram, ordinals of some passages of a block; part: which block's, and which these are."""
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def postings(self) -> DataFrame:
        rows = self.packed.select("bucket", "gram", _block("part").alias("block"), F.explode("ordinals").alias("ordinal"))
        return rows.join(self.passages, ["block", "ordinal"]).select("gram", self.by, "position", "bucket")

    @property
    def passages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/passages")


def _block(part: str) -> Column:
    return F.shiftright(part, 12)


def build(passages: DataFrame, path: str, by: str = "doc_id") -> TermIndex:
    """An index of passages (by, position, body: normalised)."""
    number = passages.select(by, "position", "body").withColumn("_n", F.monotonically_increasing_id())
    number.select(by, "position", "body", F.shiftright("_n", 12).alias("block"), (F.col("_n") % BLOCK).cast("smallint").alias("ordinal")).write.parquet(f"{path}/passages")
    index = TermIndex(passages.sparkSession, path, by)
    rows = index.passages.select("block", "ordinal", "body").mapInArrow(_postings, "part long, gram string, ordinals array<smallint>").withColumn("bucket", _bucket("gram"))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    return index


def search(index: TermIndex, requirements: DataFrame, k: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`retrieval.lexical_topk`; and requirement, scored: how many passages were.

    requirements: a catalogue of a few dozen rows (requirement, query, ..), sent to where the passages are.
    Where no passage of a ``by`` scores, its first k are taken.
    """
    by = index.by
    words = requirements.select("requirement", F.explode(retrieval.terms(F.col("query"))).alias("term")).groupBy("requirement", "term").agg(F.count("*").alias("times"))
    wanted = words.select("term").distinct().select("term", F.explode(grams(F.col("term"))).alias("gram"), F.size(grams(F.col("term"))).alias("n")).withColumn("bucket", _bucket("gram"))
    lists = index.packed.join(F.broadcast(wanted), ["bucket", "gram"]).groupBy("part", "term").agg(F.collect_list("ordinals").alias("lists"), F.first("n").alias("n")).filter(F.size("lists") == F.col("n"))
    common = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", 0), F.array_intersect)
    candidates = lists.select(_block("part").alias("block"), "term", F.explode(common).alias("ordinal")).groupBy("block", "ordinal").agg(F.collect_list("term").alias("terms")).join(index.passages, ["block", "ordinal"])
    hits = F.transform("terms", lambda t: F.struct(t.alias("term"), T.occurrences(F.col("body"), t).alias("hits")))
    counted = candidates.select("block", "ordinal", by, "position", F.length("body").alias("size"), F.explode(hits).alias("_h")).select("*", "_h.*").filter("hits > 0")
    score = F.round(F.sum(F.col("hits") * F.col("times")) / (1 + F.first("size") / 800), 6)
    # one exchange for the sum and the ranks
    spread = counted.join(F.broadcast(words), "term").repartition(by, "requirement")
    scored = spread.groupBy("requirement", by, "position", "block", "ordinal").agg(score.alias("score")).filter("score > 0")
    order = Window.partitionBy(by, "requirement")
    asked = requirements.withColumn("_k", k)
    best = scored.withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), "position"))).join(F.broadcast(asked), "requirement").filter(F.col("rank") <= F.col("_k")).drop("block", "ordinal")
    # the pairs that nothing scores for
    heads = index.passages.select(by, "position").withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("position")))
    held = best.filter("rank = 1").select(F.col(by).alias("_by"), F.col("requirement").alias("_requirement"))
    first = paired(heads, asked).filter(F.col("rank") <= F.col("_k")).join(held, F.col(by).eqNullSafe(F.col("_by")) & (F.col("requirement") == F.col("_requirement")), "left_anti").withColumn("score", F.lit(0.0))
    found = best.unionByName(first.select(*best.columns)).drop("_k")
    told = candidates.select("block", "ordinal", F.explode("terms").alias("term")).join(F.broadcast(words), "term")
    return found, told.groupBy("requirement").agg(F.count_distinct("block", "ordinal").alias("scored"))
