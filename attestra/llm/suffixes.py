"""Deduplication of repeated byte strings: all but the first occurrence go.

Content-sampled level-wise hashing stands in place of a suffix array: no suffix
is sorted and there are no ranks; windows are equal if their hashed runs are.
:mod:`attestra.llm.repeats` has the levels and how they scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from attestra.llm import repeats

WIDTH = 100
LEVELS = (32, 64, 88)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for doc_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            cut = repeats.union(spans, len(data))
            kept, at = [], 0
            for start, end in cut.tolist():
                kept.append(data[at:start])
                at = end
            kept.append(data[at:])
            made.append((doc_id, len(data), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), b"".join(kept), [{"s": s, "e": e} for s, e in cut.tolist()]))
        spans = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), spans]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in made], t) for j, t in enumerate(types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed_spans"])


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and removed_spans (byte offsets).

    Every byte that a string of ``width`` bytes covers goes if the string also
    starts earlier: in a document of smaller doc_id (null ids come last, equal
    ones in the order of rows), or earlier in the same document.  Strings are
    judged on the input and don't cross documents.  Null texts are empty;
    shorter texts lose nothing; repeated rows are documents each, so the second
    of two goes.
    """
    home = repeats.homed(docs)
    levels = [x for x in LEVELS if x < width] + [width]
    hits = repeats.find(home, repeats.byte_units, width, levels, first_stays=True)
    rows = home.join(hits, "_r", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed_spans array<struct<s:int,e:int>>")
