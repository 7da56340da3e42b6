"""Benchmark decontamination as a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (the whole item
where it is shorter).  Containing a window means containing each of its words,
so one word of it is a sufficient prefix: its rarest, by counts over all
documents.  Document words that are such a prefix word give candidates; they
are cut by length and position (the window has to lie within the document),
then by the hash of the item-sized window, and what is left is compared word
by word.

Scale: documents are never shuffled.  The benchmark is met in blocks of at most
``BLOCK_BYTES`` of text; each block is broadcast, whatever the number of
blocks, and each is one more pass over the documents, which carry their hits
along.  No group of documents is gathered anywhere, so a passage that a third
of them share costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import hashing as H
from attestra.llm.base import chunks, text_bytes

WINDOW = 13
BLOCK_BYTES = 8 << 20
_CANDIDATES = 1 << 21


@dataclass
class Block:
    """Distinct words of some items, and their windows ordered by prefix word."""

    vocabulary: np.ndarray  # sorted word hashes
    filter: np.ndarray  # of the hashes' low 20 bits
    key: np.ndarray  # window's prefix word, as its place in ``vocabulary``; sorted
    offset: np.ndarray  # of that word within the window
    length: np.ndarray
    hash: np.ndarray
    text: list[bytes]
    items: list[list[str]]
    begin: np.ndarray  # first window of each word of ``vocabulary``


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    held, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").filter("text is not null").toLocalIterator():
        if held and size + len(row.text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((row.i, row.text))
        size += len(row.text)
    yield held


def _tokens(data: np.ndarray, offsets: np.ndarray):
    data = H.LOWER[data]
    starts, ends, rows = H.words(data, offsets, H.PUNCTUATION)
    return data, starts, ends, rows, H.word_hashes(data, starts, ends)


def _find(vocabulary: np.ndarray, low: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the hashes that are in the vocabulary, and where in it."""
    at = np.flatnonzero(low[(hashes & H.U(0xFFFFF)).astype(np.int64)])
    if not len(vocabulary) or not len(at):
        return at[:0], at[:0]
    place = np.minimum(np.searchsorted(vocabulary, hashes[at]), len(vocabulary) - 1)
    same = vocabulary[place] == hashes[at]
    return at[same], place[same]


def _block(items: list[tuple[str, str]], window: int, counted) -> Block:
    """counted: vocabulary, filter -> how often each word occurs in the documents."""
    windows: dict[bytes, tuple[list[str], list[bytes], np.ndarray]] = {}
    every = []
    for item, text in items:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        data, starts, ends, _, hashes = _tokens(raw, np.array([0, len(raw)]))
        own = data.tobytes()
        words = [own[s:e] for s, e in zip(starts, ends, strict=True)]
        every.append(hashes)
        n = min(window, len(words))
        for s in range(len(words) - n + 1 if n else 0):
            there = windows.setdefault(b" ".join(words[s : s + n]), ([], words[s : s + n], hashes[s : s + n]))
            if item not in there[0]:
                there[0].append(item)
    vocabulary = np.unique(np.concatenate(every)) if every else np.zeros(0, H.U)
    low = np.zeros(1 << 20, bool)
    low[(vocabulary & H.U(0xFFFFF)).astype(np.int64)] = True
    counts = counted(vocabulary, low)
    rows = []
    for text, (ids, _, hashes) in windows.items():
        place = np.searchsorted(vocabulary, hashes)
        first = int(np.lexsort((place, counts[place]))[0])
        sums = H.prefix(hashes)
        whole = H.slices(sums, np.array([0]), np.array([len(hashes)]))[0]
        rows.append((int(place[first]), first, len(hashes), whole, text, ids))
    rows.sort(key=lambda r: (r[0], r[1]))
    key = np.array([r[0] for r in rows], np.int64)
    return Block(vocabulary, low, key, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], H.U), [r[4] for r in rows], [r[5] for r in rows], np.searchsorted(key, np.arange(len(vocabulary) + 1)))


def _count_words(vocabulary: np.ndarray, low: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for part in chunks(batches):
            total += np.bincount(_find(vocabulary, low, _tokens(*text_bytes(part.column(0)))[-1])[1], minlength=len(vocabulary))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["word", "n"])

    return count


def _match(block: Block, part_text: pa.Array) -> tuple[list[list[tuple[int, int]]], list[set[str]], np.ndarray]:
    """Per row: spans of hit words, items, and the number of words."""
    data, starts, ends, rows, hashes = _tokens(*text_bytes(part_text))
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(rows) - 1)]
    items: list[set[str]] = [set() for _ in range(len(rows) - 1)]
    at, word = _find(block.vocabulary, block.filter, hashes)
    fan = block.begin[word + 1] - block.begin[word]
    at, word, fan = at[fan > 0], word[fan > 0], fan[fan > 0]
    if len(at):
        sums, own = H.prefix(hashes), None
        row_of = np.searchsorted(rows, at, "right") - 1
        cuts = np.searchsorted(np.cumsum(fan), np.arange(_CANDIDATES, int(fan.sum()) + _CANDIDATES, _CANDIDATES))
        a = 0
        for b in (min(int(c) + 1, len(at)) for c in cuts):
            f = fan[a:b]
            w = np.repeat(block.begin[word[a:b]] - np.cumsum(f) + f, f) + np.arange(int(f.sum()))
            s, r = np.repeat(at[a:b], f) - block.offset[w], np.repeat(row_of[a:b], f)
            fits = (s >= rows[r]) & (s + block.length[w] <= rows[r + 1])
            w, s, r = w[fits], s[fits], r[fits]
            same = H.slices(sums, s, s + block.length[w]) == block.hash[w]
            for i, x, row in zip(w[same].tolist(), s[same].tolist(), r[same].tolist(), strict=True):
                own = data.tobytes() if own is None else own
                n = int(block.length[i])
                if b" ".join(own[starts[j] : ends[j]] for j in range(x, x + n)) == block.text[i]:
                    spans[row].append((x - int(rows[row]), x - int(rows[row]) + n))
                    items[row].update(block.items[i])
            a = b
            if a >= len(at):
                break
    return spans, items, np.diff(rows)


def _merge(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(map(tuple, spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _scan(block, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            spans, items, n_words = _match(block.value, part.column(part.schema.get_field_index("text")))
            had = part.column(part.schema.get_field_index("_spans")).to_pylist()
            had_items = part.column(part.schema.get_field_index("_items")).to_pylist()
            spans = [_merge([(x["s"], x["e"]) for x in old] + new) for old, new in zip(had, spans, strict=True)]
            items = [sorted(new.union(old)) for old, new in zip(had_items, items, strict=True)]
            columns = {n: part.column(part.schema.get_field_index(n)) for n in names}
            columns["_spans"] = pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
            columns["_items"] = pa.array(items, pa.list_(pa.string()))
            columns["_words"] = pa.array(n_words, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans, item_ids and contaminated.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
    contaminated: at least one word is hit, and ``share`` times the hit words
    are at least all words.  Null and empty texts have no words; items with
    null or no words have no windows; an item without an id counts as "null"
    and rows with one id are one item.  Repeated documents are judged each.
    Other columns of ``docs`` pass through, but for those named as the result's.
    """
    spark = docs.sparkSession
    made = ["n_words", "n_hit", "hit_spans", "item_ids", "contaminated"]
    out = docs.drop(*made, "_spans", "_items", "_words")
    names = out.columns
    out = out.withColumns({"_spans": F.lit(None).cast("array<struct<s:int,e:int>>"), "_items": F.lit(None).cast("array<string>"), "_words": F.lit(0).cast("long")})
    out = out.withColumns({"_spans": F.coalesce("_spans", F.array().cast("array<struct<s:int,e:int>>")), "_items": F.coalesce("_items", F.array().cast("array<string>"))})
    texts = docs.select("text")

    def counted(vocabulary: np.ndarray, low: np.ndarray) -> np.ndarray:
        total = np.zeros(len(vocabulary), np.int64)
        if len(vocabulary):
            found = texts.mapInArrow(_count_words(vocabulary, low), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
            for row in found.collect():  # no more rows than the block has words
                total[row.word] = row.n
        return total

    for items in _item_blocks(benchmark):
        block = spark.sparkContext.broadcast(_block(items, window, counted))
        out = out.mapInArrow(_scan(block, names), out.schema)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return out.select(
        *[F.col(f"`{n}`") for n in names],
        F.col("_words").alias("n_words"),
        hit.alias("n_hit"),
        F.col("_spans").alias("hit_spans"),
        F.col("_items").alias("item_ids"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    """Per document the counts, and the hash of its sorted item ids."""
    ids = F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")
