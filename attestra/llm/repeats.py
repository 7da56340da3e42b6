"""Windows of a fixed width that occur more than once in a corpus, found level by level.

Units are words or bytes.  Whether a window of W units occurs elsewhere is
decided on samples that are taken by content: of the shorter windows (length L)
inside it, the first with the smallest hash stands for it.  Equal W-windows have
equal L-windows at the same place, so nothing is lost, and one sampled L-window
("anchor") stands for a run of W-windows.  A level goes like this:

* every undecided run sends its anchor's hash (the key) and the hash of all
  units that the run spans (the context) to the key's bucket;
* a key that occurs once ends its run: none of its windows repeats;
* runs with equal contexts repeat each other window for window, so all but the
  first are decided; the first goes on to the next level, with longer anchors,
  only if the key has other contexts, whose windows may equal some of its own.

At the last level L is W, key and context are the window itself, and everything
is decided.

Scale: texts are shuffled once, into a table bucketed by row, with which the
lists of every level are joined in place.  Keys travel packed, some 17 bytes a
run.  What repeats within a map task is decided there and sent once a task, so
a passage, or a copy, that a third of all rows hold is no larger for a bucket
than there are tasks.  Buckets are dealt by hash and sorted one at a time;
their number follows the bytes of the texts, so that none grows with them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import hashing as H
from attestra.llm.base import chunks, parts_for, scratch_dir, text_bytes, written

#: Runs that a map task holds before it sends them on.
FLUSH = 1 << 19
#: Text bytes that numpy handles at once: a byte takes some fifteen 64-bit numbers.
CHUNK = 1 << 19
HIT, OPEN = 1, 2
_RUN = np.dtype([("doc", "<u4"), ("lo", "<u4"), ("span", "<u2")])


def homed(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row, with a row number ``_r``, in a table bucketed by it."""
    spark = docs.sparkSession
    n = parts_for(docs)
    name = f"attestra_{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("_r"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    writer = rows.repartition(n, "_r").write.option("compression", "zstd").option("path", f"{scratch_dir(spark)}/attestra/{name}")
    writer.bucketBy(n, "_r").saveAsTable(name)
    return spark.table(name)


def word_units(column: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    starts, ends, rows = H.words(data, offsets, H.WHITESPACE)
    return rows, tuple(H.prefix(H.word_hashes(data, starts, ends, lane), lane) for lane in (0, 1))


def byte_units(column: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    return offsets, tuple(H.byte_prefix(data, lane) for lane in (0, 1))


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _columns(runs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Column by column, documents as differences: small bytes for the compressor."""
    return np.diff(runs["doc"], prepend=0).astype("<u4"), runs["lo"], runs["span"]


def _unpack(blob: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out = np.empty(n, _RUN)
    out["doc"] = np.cumsum(np.frombuffer(raw, "<u4", n), dtype="<u4")
    out["lo"], out["span"] = np.frombuffer(raw, "<u4", n, 4 * n), np.frombuffer(raw, "<u2", n, 8 * n)
    return out


def _runs(units, length: int, width: int, part: pa.RecordBatch, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, context and place (document within the part, first start, starts after it) of every undecided run."""
    rows, sums = units(part.column(part.schema.get_field_index("text")))
    n = int(rows[-1])
    undecided = H.window_starts(rows, width)
    if not first:
        blobs = part.column(part.schema.get_field_index("open")).to_pylist()
        pairs = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 2).astype(np.int64)
        start = np.repeat(rows[:-1], [len(x) // 8 for x in blobs]) + pairs[:, 0]
        mark = np.bincount(start, minlength=n + 1) - np.bincount(start + pairs[:, 1] + 1, minlength=n + 1)
        undecided &= np.cumsum(mark[:n]) > 0
    if not undecided.any():
        return np.zeros(0, H.U), np.zeros(0, H.U), np.zeros(0, _RUN)
    reach = width - length
    fits = np.flatnonzero(H.window_starts(rows, length))
    values = np.full(n, 2**64 - 1, H.U)
    values[fits] = H.slices(sums[0], fits, fits + length)
    least = H.sliding(values, reach + 1) if reach else values
    starts = np.flatnonzero(undecided)
    # a run ends where the smallest value changes, or where its first place drops out (there may be an equal one further on)
    new = np.ones(len(starts), bool)
    before = starts[:-1]
    new[1:] = (starts[1:] != before + 1) | (least[starts[1:]] != least[before]) | (values[before] == least[before])
    at = np.flatnonzero(new)
    lo, hi = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    place = np.empty(len(lo), _RUN)
    doc = np.searchsorted(rows, lo, "right") - 1
    place["doc"], place["lo"], place["span"] = doc, lo - rows[doc], hi - lo
    return least[lo], H.slices(sums[1], lo, hi + width, 1), place


def _emit(units, length: int, width: int, buckets: int, first: bool, both: bool):
    """Rows: bucket, home (a name for what was sent together), kind, n, blob."""

    def flush(keys, contexts, places, ids, orders) -> Iterator[tuple]:
        key, context, place = np.concatenate(keys), np.concatenate(contexts), np.concatenate(places)
        ids, orders = np.concatenate(ids), np.concatenate(orders)
        home = int(ids[0])
        # documents by id, then row: what comes first of equal ones is the first of all in this task
        rank = np.empty(len(ids), np.int64)
        by = np.lexsort((ids, orders))
        rank[by] = np.arange(len(ids))
        ids, orders = ids[by], orders[by]
        place["doc"] = rank[place["doc"]]
        order = np.lexsort((place["lo"], place["doc"], context, key))
        k, c = key[order], context[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        repeated = ~new
        if both:
            repeated[:-1] |= ~new[1:]
        sent = order[new]
        local = np.sort(place[order[repeated]], order=["doc", "lo"])
        yield home % buckets, home, 0, len(ids), _pack(ids)
        if len(local):
            yield home % buckets, home, 1, len(local), _pack(*_columns(local))
        bucket = (key[sent] >> H.U(40)) % H.U(buckets)
        sent = sent[np.lexsort((place["lo"][sent], place["doc"][sent], bucket))]
        bucket = ((key[sent] >> H.U(40)) % H.U(buckets)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.unique(bucket).tolist():
            s = sent[cuts[b] : cuts[b + 1]]
            docs, local_doc = np.unique(place["doc"][s], return_inverse=True)
            own = place[s].copy()
            own["doc"] = local_doc
            head = np.array([len(docs)], "<i8")
            short = key[s].view(np.uint8).reshape(-1, 8)[:, 2:]  # 48 bits
            yield b, home, 2, len(s), _pack(head, docs.astype("<i8"), ids[docs], orders[docs], short, context[s], *_columns(own))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, docs = ([], [], [], [], []), 0, 0
        names = ["bucket", "home", "kind", "n", "blob"]

        def out() -> Iterator[pa.RecordBatch]:
            for row in flush(*held):
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.int32()), pa.array([row[3]], pa.int32()), pa.array([row[4]], pa.binary())], names)
            for x in held:
                x.clear()

        for part in chunks(batches, limit=CHUNK):
            key, context, place = _runs(units, length, width, part, first)
            if not len(key):
                continue
            used, place["doc"] = np.unique(place["doc"], return_inverse=True)
            place["doc"] += docs
            number = part.column(part.schema.get_field_index("_r")).to_numpy(zero_copy_only=False)[used]
            doc_id = part.column(part.schema.get_field_index("doc_id")).fill_null(2**63 - 1).to_numpy(zero_copy_only=False)[used]
            for x, y in zip(held, (key, context, place, number, doc_id), strict=True):
                x.append(y)
            count, docs = count + len(key), docs + len(used)
            if count >= FLUSH:
                yield from out()
                count = docs = 0
        if count:
            yield from out()

    return emit


def _judge(both: bool, last: bool):
    """Of one bucket: which runs are decided as repeated, and which stay open."""
    names = ["home", "kind", "n", "blob"]

    def judge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [(r["home"], r["kind"], r["n"], r["blob"]) for r in rows if r["kind"] < 2]
        rows = [r for r in rows if r["kind"] == 2]
        key, context, doc_id, number, lo, source, places = [], [], [], [], [], [], []
        for i, r in enumerate(rows):
            n, raw = r["n"], zstandard.ZstdDecompressor().decompress(r["blob"])
            m = int(np.frombuffer(raw, "<i8", 1)[0])
            docs, ids, orders = (np.frombuffer(raw, "<i8", m, 8 + 8 * m * j) for j in range(3))
            at = 8 + 24 * m
            wide = np.zeros((n, 8), np.uint8)
            wide[:, 2:] = np.frombuffer(raw, np.uint8, 6 * n, at).reshape(n, 6)
            key.append(wide.view(H.U).reshape(n))
            context.append(np.frombuffer(raw, H.U, n, at + 6 * n))
            at += 14 * n
            place = np.empty(n, _RUN)
            local = np.cumsum(np.frombuffer(raw, "<u4", n, at), dtype=np.int64)
            place["doc"], place["lo"], place["span"] = docs[local], np.frombuffer(raw, "<u4", n, at + 4 * n), np.frombuffer(raw, "<u2", n, at + 8 * n)
            places.append(place)
            doc_id.append(orders[local])
            number.append(ids[local])
            lo.append(place["lo"].astype(np.int64))
            source.append(np.full(n, i, np.int32))
        if rows:
            key, context, doc_id, number, lo, source, places = map(np.concatenate, (key, context, doc_id, number, lo, source, places))
            order = np.lexsort((lo, number, doc_id, context, key))
            k, c = key[order], context[order]
            new_key = np.ones(len(k), bool)
            new_key[1:] = k[1:] != k[:-1]
            new = new_key.copy()
            new[1:] |= c[1:] != c[:-1]
            repeated = ~new
            if both:
                repeated[:-1] |= ~new[1:]
            group = np.cumsum(new_key) - 1
            contexts = np.bincount(group, new)
            status = repeated * np.uint8(HIT)
            if not last:
                status = status | (new & (contexts[group] > 1)) * np.uint8(OPEN)
            for flag, kind in ((HIT, 1), (OPEN, 2)):
                picked = order[(status & flag) > 0]
                picked = picked[np.lexsort((lo[picked], places["doc"][picked], source[picked]))]
                cuts = np.searchsorted(source[picked], np.arange(len(rows) + 1))
                for i, r in enumerate(rows):
                    if cuts[i] < cuts[i + 1]:
                        out.append((r["home"], kind, int(cuts[i + 1] - cuts[i]), _pack(*_columns(places[picked[cuts[i] : cuts[i + 1]]]))))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.Table.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)

    return judge


def _merge(width: int):
    """Of one home: per row number, the spans of units that hits cover, and the runs that stay open."""

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["kind"] == 0)
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(head["blob"]), "<i8", head["n"])
        found = []
        for kind in (1, 2):
            runs = [_unpack(r["blob"], r["n"]) for r in rows if r["kind"] == kind]
            runs = np.sort(np.concatenate(runs), order=["doc", "lo"]) if runs else np.zeros(0, _RUN)
            if kind == 1:
                runs = covered(runs["doc"].astype(np.int64), runs["lo"].astype(np.int64), runs["lo"].astype(np.int64) + runs["span"] + width)
            else:
                runs = runs["doc"].astype(np.int64), runs["lo"].astype(np.int64), runs["span"].astype(np.int64)
            cuts = np.searchsorted(runs[0], np.arange(len(ids) + 1))
            pairs = np.stack(runs[1:], 1).astype("<u4")
            found.append([pairs[a:b].tobytes() if a < b else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
        keep = [i for i in range(len(ids)) if found[0][i] or found[1][i]]
        return pa.table({"_r": pa.array(ids[keep], pa.int64()), "hits": pa.array([found[0][i] for i in keep], pa.binary()), "open": pa.array([found[1][i] for i in keep], pa.binary())})

    return merge


def covered(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans, which are sorted by document and start; touching spans become one."""
    if not len(doc):
        return doc, start, end
    big = np.int64(1) << 40  # past any position: documents don't meet
    top = np.maximum.accumulate(doc * big + end)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * big + start[1:] > top[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return doc[new], start[new], top[last] - doc[new] * big


def find(home: DataFrame, units: Callable, width: int, levels: Sequence[int], first_stays: bool) -> DataFrame:
    """_r and spans (binary: pairs of little-endian 32-bit starts and ends) of the units that repeated windows cover.

    ``levels`` are growing anchor lengths, the last one ``width``.
    ``first_stays``: the first occurrence (by doc_id, nulls last, then row, then
    place) of a window isn't covered by it; else all occurrences are.
    """
    buckets = parts_for(home)
    undecided, lists = None, []
    for length in levels:
        first, last = undecided is None, length == width
        rows = home if first else home.join(undecided, "_r")
        sent = rows.mapInArrow(_emit(units, length, width, buckets, first, not first_stays), "bucket int, home long, kind int, n int, blob binary")
        judged = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_judge(not first_stays, last), "home long, kind int, n int, blob binary")
        level = written(judged.repartition(buckets, "home").groupBy("home").applyInArrow(_merge(width), "_r long, hits binary, open binary"), f"level{length}")
        lists.append(level.filter("hits is not null").select("_r", "hits"))
        undecided = level.filter("open is not null").select("_r", "open")
        if last or undecided.isEmpty():
            break
    hits = lists[0]
    for more in lists[1:]:
        hits = hits.unionByName(more)
    return hits.groupBy("_r").agg(F.collect_list("hits").alias("spans"))


def union(spans: list[bytes] | None, limit: int) -> np.ndarray:
    """The rows' spans as one sorted array of starts and ends that neither overlap nor touch."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    pairs = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in spans]).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    _, start, end = covered(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
    return np.stack([start, np.minimum(end, limit)], 1)
