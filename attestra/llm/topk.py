"""Exact top-k search by columnar branch and bound.

Vectors are packed into blocks that lie dimension by dimension ("vertical"
layout).  For a block of queries and a block of candidates, inner products
grow by one group of dimensions at a time; after each group a candidate goes
when its partial score plus the bound on what the remaining dimensions can
add (Cauchy-Schwarz on the remaining mass) is below the query's k-th best
score, and the survivors are compacted.

Scale: queries are a stated set, met with all rows block against block; a
pair of blocks is one record, its working set bounded by the block sizes, and
the k best of each query and task are all that is shuffled on.  Blocks hold the
smallest whole numbers that fit.  Candidate blocks are dealt over as many parts
as ``BLOCKS_A_PART`` of them ask for, and the queries' blocks copied once for
each part: a part's first block finds the floors that prune its others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.base import written

BLOCK = 1024
QUERY_BLOCK = 256
DIMENSIONS = 16
BLOCKS_A_PART = 8
_WHOLE = tuple(np.dtype(t) for t in ("<i2", "<i4", "<i8"))


def _pack(size: int, names: list[str]):
    """dim, bytes a number, ids and vectors (dimension by dimension) of up to ``size`` rows of one length."""

    def block(dim: int, ids: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        low, high = int(table.min(initial=0)), int(table.max(initial=0))
        kind = next(t for t in _WHOLE if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        values = [dim, kind.itemsize, ids.astype("<i8").tobytes(), np.ascontiguousarray(table.T.astype(kind)).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids, lens = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
            flat, starts = batch.column(1).flatten().to_numpy(), np.cumsum(lens) - lens
            for dim in np.unique(lens).tolist():
                at = np.flatnonzero(lens == dim)
                own, table = ids[at], flat[starts[at][:, None] + np.arange(dim)]
                if dim in held:
                    own, table = np.concatenate([held[dim][0], own]), np.concatenate([held[dim][1], table])
                whole = len(own) // size * size
                for low in range(0, whole, size):
                    yield block(dim, own[low : low + size], table[low : low + size])
                held[dim] = own[whole:], table[whole:]
        for dim, (own, table) in held.items():
            if len(own):
                yield block(dim, own, table)

    return pack


def _search(k: int):
    def one(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, best: dict) -> None:
        """q, c: dimension x row.  best: query -> (scores, ids) so far, k at most."""
        dim = len(q)
        exact = np.int64
        if dim and float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * dim < 2**52:
            exact = np.float64  # products and sums stay whole numbers there
        q, c = q.astype(exact), c.astype(exact)
        cuts = [*range(0, dim, DIMENSIONS), dim] if dim else [0, 0]
        mass_q = [np.sqrt((q[a:].astype(np.float64) ** 2).sum(0)) for a in cuts[1:]]
        mass_c = [np.sqrt((c[a:].astype(np.float64) ** 2).sum(0)) for a in cuts[1:]]
        first = q[: cuts[1]].T @ c[: cuts[1]]
        for j, query in enumerate(q_ids.tolist()):
            alive, score = np.flatnonzero(ids != query), None
            score = first[j, alive]
            have = best.get(query)
            floor = have[0][-1] if have is not None and len(have[0]) == k else None
            for b in range(1, len(cuts)):
                if b > 1:
                    score = score + q[cuts[b - 1] : cuts[b], j] @ c[cuts[b - 1] : cuts[b], alive]
                if floor is not None and b < len(cuts) - 1:
                    bound = score + mass_q[b - 1][j] * mass_c[b - 1][alive] * (1 + 1e-9) + 1e-6
                    keep = bound >= floor
                    alive, score = alive[keep], score[keep]
            if floor is not None:
                keep = score >= floor
                alive, score = alive[keep], score[keep]
            s = np.concatenate([have[0], score]) if have is not None else score
            i = np.concatenate([have[1], ids[alive]]) if have is not None else ids[alive]
            top = np.lexsort((i, -s))
            s, i = s[top], i[top]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
            best[query] = (s[new][:k], i[new][:k])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            dims, q_bytes, c_bytes = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("dim", "q_bytes", "bytes"))
            q_ids, q_vectors, ids, vectors = (batch.column(batch.schema.get_field_index(n)) for n in ("q_ids", "q_vectors", "ids", "vectors"))
            for r in range(batch.num_rows):  # a pair of blocks each
                asked, own = np.frombuffer(q_ids[r].as_buffer(), "<i8"), np.frombuffer(ids[r].as_buffer(), "<i8")
                q = np.frombuffer(q_vectors[r].as_buffer(), f"<i{q_bytes[r]}").reshape(dims[r], len(asked))
                c = np.frombuffer(vectors[r].as_buffer(), f"<i{c_bytes[r]}").reshape(dims[r], len(own))
                one(asked, q, own, c, best)
                if len(best) > 64 * QUERY_BLOCK:
                    yield flush(best)
        if best:
            yield flush(best)

    def flush(best: dict) -> pa.RecordBatch:
        rows = [(q, int(i), int(s)) for q, (scores, ids) in best.items() for s, i in zip(scores, ids, strict=True)]
        best.clear()
        return pa.RecordBatch.from_pydict(
            {n: pa.array([r[j] for r in rows], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))}
        )

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest integer inner products of each query.

    ``vectors`` has ``vec_id`` and ``embedding``; a component x counts as
    floor(scale * x).  Ties go to the smaller vec_id.  Rows with a null id,
    a null vector, or a null or non-finite component take no part, nor does a
    row whose id is the query's own; vectors of other lengths than the query's
    aren't compared with it.  Repeated rows count once.  An empty table gives
    an empty result.
    """
    usable = (
        F.col("embedding").isNotNull()
        & F.col("vec_id").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    rows = vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("id"),
        F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    names, asking = ["dim", "bytes", "ids", "vectors"], ["dim", "q_bytes", "q_ids", "q_vectors"]
    packed = lambda n: ", ".join(f"{c} {t}" for c, t in zip(n, ("int", "int", "binary", "binary"), strict=True))
    blocks = written(rows.select("id", "v").mapInArrow(_pack(BLOCK, names), packed(names)), "blocks")
    asked = written(rows.filter("asks").select("id", "v").mapInArrow(_pack(QUERY_BLOCK, asking), packed(asking)), "queries")
    parts = blocks.groupBy("dim").agg(F.ceil(F.count("*") / BLOCKS_A_PART).cast("int").alias("parts"))
    dealt = blocks.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int")).drop("parts")
    copies = asked.join(parts, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # a pair of blocks is a record; small as blocks are, parts stay tasks of their own
    tasks = 2 * (parts.agg(F.sum("parts").alias("n")).first().n or 1)
    met = copies.repartition(tasks, "dim", "part").join(dealt.repartition(tasks, "dim", "part"), ["dim", "part"])
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
