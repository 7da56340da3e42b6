"""Quotations that stand in a document with a few characters inserted, left out or changed.

A quotation of m characters is there if some stretch of the document, wherever
it starts and however long it is, is at most k = m (1 - SIMILAR) edits away;
its similarity is 1 - edits / m for the closest stretch.

An edit spoils at most g of a quotation's m - g + 1 grams (stretches of g
characters), so at least m - g + 1 - g k of them are whole, and lie on
diagonals (place in the document less place in the quotation) that differ by k
at most.  Places where enough grams meet are verified by an edit distance that
handles a whole column of its table as the bits of one number.

Two forms: :func:`closest` for quotations that name their document, within the
row that holds both, and :func:`join` for quotations looked for in all
documents, as an equi-join of grams.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.sources.landing import kept

SIMILAR = 0.90  # fixed value: the fuzzy threshold
#: Gram lengths, the longest first; a quotation takes the first that leaves it enough whole grams. Every length of quotation has one.
GRAMS = (8, 6, 5, 4, 3, 2, 1)
#: Grams up to this length are looked for by quotations that they are the whole of, so the first place in a document tells all.
WHOLE = 4
#: Bits of the filter that tells which grams of a document any quotation has: 2 MB a gram length, whatever the number of quotations.
FILTER_BITS = 24
_STEP = np.uint64(0x9E3779B97F4A7C15)


def most_edits(length: int) -> int:
    return int(length * (1 - SIMILAR) + 1e-9)


def least_grams(length: int, gram: int) -> int:
    """How many grams of a quotation are whole in any stretch that is close enough."""
    return length - gram + 1 - gram * most_edits(length)


def gram_of(length: int) -> int:
    """The gram length that a quotation of this length is looked for with; 0 if it is empty."""
    return next((g for g in GRAMS if least_grams(length, g) > 0), 0)


def gram_hashes(text: str, gram: int) -> np.ndarray:
    """A 64-bit hash of every stretch of ``gram`` characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < gram:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(points) - gram + 1, np.uint64)
    for i in range(gram):
        out = (out ^ points[i : i + len(out)]) * _STEP
        out ^= out >> np.uint64(29)
    return out


def bands(diagonals: np.ndarray, width: int, least: int) -> np.ndarray:
    """The bands of diagonals that ``least`` or more of the given ones fall into; a band is twice ``width`` wide and overlaps its neighbours by half, so what lies within ``width`` is in one as a whole."""
    low = diagonals // width
    found, n = np.unique(np.concatenate([low, low - 1]), return_counts=True)
    return found[n >= least]


def closest_end(quote: str, text: str, most: int) -> tuple[int, int] | None:
    """Edits and end of the stretch of ``text`` that is closest to ``quote``, the first of equals; None beyond ``most`` edits.

    The differences of neighbouring cells of a column are bits: ``up`` where
    the next cell is one more, ``down`` where it is one less.
    """
    m = len(quote)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    where = _places(quote)
    up, down, edits, best = mask, 0, m, None
    for j, same in enumerate(map(where.get, text, repeat(0)), 1):
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | mask & ~(diagonal | up), up & diagonal
        if right & top:
            edits += 1
        elif left & top:
            edits -= 1
            if edits <= most and (best is None or edits < best[0]):
                best = edits, j
                if not edits:
                    break
        right = right << 1  # a stretch may start anywhere, so the first row is 0
        up, down = mask & (left << 1 | ~(diagonal | right)), right & diagonal & mask
    return best


def _places(quote: str) -> dict[str, int]:
    """Of each letter, where it stands, as bits."""
    where: dict[str, int] = dict.fromkeys(quote, 0)
    bit = 1
    for c in quote:
        where[c] |= bit
        bit <<= 1
    return where


def closest_stretch(quote: str, text: str, low: int = 0) -> tuple[int, int, int] | None:
    """Edits, start and end of the closest stretch of ``text`` (which begins at ``low``); of equally close ones the first to end, and of those the shortest."""
    most = most_edits(len(quote))
    found = closest_end(quote, text, most)
    if found is None:
        return None
    edits, end = found
    # the shortest of all stretches that end there and are as close, from one pass backwards
    least = max(0, len(quote) - edits)
    size = next(n for n, d in enumerate(distances(quote[::-1], text[max(0, end - len(quote) - edits) : end][::-1])) if n >= least and d == edits)
    return edits, low + end - size, low + end


def distances(a: str, b: str) -> Iterator[int]:
    """Edit distance of ``a`` and the first 0, 1, 2 .. characters of ``b``."""
    m = len(a)
    yield m
    if not m:
        yield from range(1, len(b) + 1)
        return
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, edits = mask, 0, m
    for same in map(_places(a).get, b, repeat(0)):
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | mask & ~(diagonal | up), up & diagonal
        if right & top:
            edits += 1
        elif left & top:
            edits -= 1
        yield edits
        right = right << 1 | 1  # the whole of b counts
        up, down = mask & (left << 1 | ~(diagonal | right)), right & diagonal & mask


def distance(a: str, b: str) -> int:
    """Edit distance of two whole strings."""
    return deque(distances(a, b), 1)[0]


class Document:
    """A normalised text and the hashes of its grams, taken once for all quotations that are looked for in it."""

    def __init__(self, text: str):
        self.text, self._sorted = text, {}

    def grams(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes, and the places where they stand."""
        if gram not in self._sorted:
            hashes = gram_hashes(self.text, gram)
            order = np.argsort(hashes, kind="stable")
            self._sorted[gram] = hashes[order], order
        return self._sorted[gram]

    def find(self, quote: str) -> tuple[float, int]:
        """Similarity and start of the closest stretch; (0, -1) if none is close enough."""
        gram = gram_of(len(quote))
        if not quote or not self.text:
            return 0.0, -1
        if gram <= WHOLE:
            at = self.text.find(quote)
            return float(at >= 0), at
        hashes, places = self.grams(gram)
        own = gram_hashes(quote, gram)
        first, last = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        diagonals = places[at] - np.repeat(np.arange(len(own)), n)
        if len(diagonals) < least_grams(len(quote), gram):
            return 0.0, -1
        k = most_edits(len(quote))
        found = bands(diagonals, 2 * k + 1, least_grams(len(quote), gram))
        if not len(found):
            return 0.0, -1
        low = diagonals // (2 * k + 1)
        among = lambda x: found[np.minimum(np.searchsorted(found, x), len(found) - 1)] == x
        diagonals = np.array(sorted(set(diagonals[among(low) | among(low - 1)].tolist())))
        return self._within(quote, diagonals - k, diagonals + len(quote) + 2 * k)

    def verify(self, quote: str, found: np.ndarray) -> tuple[float, int]:
        """The closest stretch within bands of diagonals."""
        m, k = len(quote), most_edits(len(quote))
        return self._within(quote, found * (2 * k + 1) - k, (found + 2) * (2 * k + 1) + m + k)

    def _within(self, quote: str, lows: np.ndarray, highs: np.ndarray) -> tuple[float, int]:
        """The closest stretch within ascending intervals."""
        best = None
        for low, high in _merged(lows, highs):
            window = closest_stretch(quote, self.text[max(0, low) : max(0, high)], max(0, low))
            if window is not None and (best is None or window[0] < best[0]):
                best = window
        return _told(quote, best)


def _told(quote: str, stretch: tuple[int, int, int] | None) -> tuple[float, int]:
    return (1 - stretch[0] / len(quote), stretch[1]) if stretch else (0.0, -1)


def _merged(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ascending intervals, those that overlap as one."""
    begin = None
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        if begin is not None and a <= end:  # noqa: F821
            end = max(end, b)  # noqa: F821
            continue
        if begin is not None:
            yield begin, end
        begin, end = a, b
    if begin is not None:
        yield begin, end


def closest():
    """A column function of (array of normalised quotations, normalised document): similarity and position of each, null for a null quotation."""

    @F.pandas_udf("array<struct<similarity:double,position:int>>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for quotes, documents in batches:
            out = []
            for many, text in zip(quotes, documents, strict=True):
                document = Document(text or "")
                out.append(None if many is None else [None if q is None else dict(zip(("similarity", "position"), document.find(q), strict=True)) for q in many])
            yield pd.Series(out)

    return found.asNondeterministic()  # so that the optimiser neither repeats it nor moves it into a filter


def _filters(grams: DataFrame) -> dict[int, np.ndarray]:
    """For each gram length that a quotation has, which of 2 ** FILTER_BITS values the grams' hashes begin with, as a mask; as many numbers at most reach the driver."""
    top = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    found = grams.select("gram", top.cast("int").alias("top")).distinct().toArrow()
    lengths, tops, out = found.column("gram").to_numpy(), found.column("top").to_numpy(), {}
    for gram in np.unique(lengths).tolist():
        mask = np.zeros(1 << FILTER_BITS, bool)
        mask[tops[lengths == gram]] = True
        out[gram] = np.packbits(mask)
    return out


def _quote_grams(quotes: DataFrame, key: str) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, quote in enumerate(batch.column(1).to_pylist()):
                gram = gram_of(len(quote or ""))
                if gram:
                    hashes = gram_hashes(quote, gram)
                    n = len(hashes)
                    columns = [batch.column(0).slice(i, 1).take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, gram, np.int32)), pa.array(hashes.view(np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, len(quote), np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "gram", "hash", "at", "length"])

    return quotes.select(key, "quote").mapInArrow(cut, f"`{key}` {quotes.schema[key].dataType.simpleString()}, gram int, hash long, at int, length int")


def cut_grams(batches: Iterator[pa.RecordBatch], masks: dict[int, np.ndarray], characters: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Of batches (key, text): the key, gram, hash and place of the grams that the masks let through; texts of about so many characters are cut at once."""
    for batch in batches:
        by, texts = batch.schema.names[0], [x or "" for x in batch.column(1).to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        share = (np.cumsum(sizes) - 1) // characters
        for low, high in zip(first := np.flatnonzero(np.diff(share, prepend=-2)), np.append(first[1:], len(texts)), strict=True):
            text, size = "".join(texts[low:high]), sizes[low:high]
            begin = np.cumsum(size) - size
            for gram, mask in masks.items():
                hashes = gram_hashes(text, gram)
                at = np.flatnonzero(mask[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                row = np.searchsorted(begin, at, "right") - 1  # of equal beginnings the last: the others are empty
                within = at + gram <= begin[row] + size[row]
                at, row = at[within], row[within]
                if gram <= WHOLE and len(at):
                    _, first_of = np.unique(np.rec.fromarrays([row, hashes[at]]), return_index=True)
                    first_of.sort()
                    at, row = at[first_of], row[first_of]
                if len(at):
                    columns = [batch.column(0).take(pa.array(low + row)), pa.array(np.full(len(at), gram, np.int32)), pa.array(hashes[at].view(np.int64)), pa.array((at - begin[row]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=[by, "gram", "hash", "place"])


def _document_grams(documents: DataFrame, by: str, sent) -> DataFrame:
    """by, gram, hash, place of the grams of a text that some quotation may have."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut_grams(batches, {gram: np.unpackbits(mask).astype(bool) for gram, mask in sent.value.items()})

    return documents.select(by, "text").mapInArrow(cut, f"`{by}` {documents.schema[by].dataType.simpleString()}, gram int, hash long, place int")


def join(quotes: DataFrame, documents: DataFrame, key: str = "quote_id", by: str = "doc_id", normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, by, similarity, position: every document in which a quotation stands nearly enough.

    quotes: key, quote; documents: by, text; both normalised, keys unique; texts
    that ``normal`` is given for are normalised with it where they are looked at.
    Empty quotations stand nowhere.
    Grams of documents travel only if a quotation has them, their numbers are
    added up where they meet, and of the documents only those with a place to
    verify are read again.
    """
    asked = _quote_grams(quotes, key)
    sent = documents.sparkSession.sparkContext.broadcast(_filters(asked))  # 2 MB a gram length
    normal = normal or (lambda text: text)
    hits = _document_grams(documents.select(by, normal(F.col("text")).alias("text")), by, sent).join(asked, ["gram", "hash"])
    k = F.floor(F.col("length") * F.lit(1 - SIMILAR) + 1e-9)
    width = 2 * k + 1
    low = F.floor((F.col("place") - F.col("at")) / width)
    least = F.col("length") - F.col("gram") + 1 - F.col("gram") * k
    counted = hits.select(key, by, least.alias("least"), F.explode(F.array(low, low - 1)).alias("band")).groupBy(key, by, "band", "least").agg(F.count("*").alias("n"))
    enough = counted.filter(F.col("n") >= F.col("least")).groupBy(key, by).agg(F.array_sort(F.collect_list("band")).alias("bands"))
    # its written size tells Spark whether to broadcast it, so that texts needn't be shuffled
    rows = kept(enough).join(quotes.select(key, "quote"), key).join(documents.select(by, "text"), by).withColumn("text", normal(F.col("text")))

    @F.pandas_udf("struct<similarity:double,position:int>")
    def verify(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for quote, text, found in batches:
            out = [Document(t).verify(q, np.array(b)) for q, t, b in zip(quote, text, found, strict=True)]
            yield pd.DataFrame(out, columns=["similarity", "position"])

    checked = rows.select(key, by, verify.asNondeterministic()(F.col("quote"), F.col("text"), F.col("bands")).alias("v"))
    return checked.select(key, by, "v.similarity", "v.position").filter("position >= 0")


def similarity(quote: Column, document: Column) -> Column:
    """The similarity of one normalised quotation to the closest stretch of a normalised document; 0 if none is close enough."""
    return F.get(closest()(F.array(quote), document), 0)["similarity"]
