"""Substring deduplication on words: passages that occur more than once go, all of them.

Level-wise doubling: windows of 9 words, sampled by content, are looked for
first; only what repeats at one length is extended to twice that length, until
the window's width is reached or no candidates survive.  See
:mod:`attestra.llm.repeats` for the levels and how they scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from attestra.llm import repeats

WIDTH, FIRST = 35, 9


def doubling(width: int, first: int = FIRST) -> list[int]:
    out = [min(first, width)]
    while out[-1] < width:
        out.append(width if 2 * out[-1] > width - 2 else 2 * out[-1])
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for doc_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()  # exactly at ASCII white space
            cut = repeats.union(spans, len(words))
            kept, at = [], 0
            for start, end in cut.tolist():
                kept += words[at:start]
                at = end
            kept += words[at:]
            text = b" ".join(kept)
            made.append((doc_id, len(words), len(words) - len(kept), text.decode("utf-8", "surrogatepass"), [{"s": s, "e": e} for s, e in cut.tolist()]))
        spans = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), spans]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in made], t) for j, t in enumerate(types)], ["doc_id", "n_words", "n_removed", "kept", "removed_spans"])


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by a space) and removed_spans (word positions).

    Every word that a window of ``width`` words covers goes if the window's
    words also start anywhere else, same document included.  Windows are judged
    on the input.  Words are what ASCII white space separates, unchanged.  Null
    and empty texts have no words; documents shorter than a window lose none;
    repeated rows are documents each, and so repeat each other.
    """
    home = repeats.homed(docs)
    hits = repeats.find(home, repeats.word_units, width, doubling(width), first_stays=False)
    rows = home.join(hits, "_r", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string, removed_spans array<struct<s:int,e:int>>")
