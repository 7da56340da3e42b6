"""N-gram Jaccard join: documents whose sets of word shingles are similar.

Documents with equal sets are one node.  Nodes of similar size share a tile
(size bands, overlapping by what the threshold allows).  In a tile two linked
sets differ in at most k shingles, so if hash space is cut into more than k
parts, at least one part of both is the same: the hash of a part's shingles is
a key that linked nodes share.  There are spare parts, so they share several: a
node that has too few keys in common with any others is linked with nothing.
A part with next to no shingles, or hardly any but common ones (a licence, a
line that many documents repeat), says little; such keys are left out, but by
sets that have more of them than there are spares.

Nodes that share a key are compared with the key's leader, the one that meets
most others; a node with many leaders meets first the one that it shares most
keys with, then those that are still in other components.  Bitmaps of hashed
shingles, as wide as the sizes ask for, bound the overlap from above by their
bit counts, and what passes is intersected exactly as sorted arrays.  Links give components.  A key whose other members
are in different components still is open; what open keys connect is compared
across components in tiles of two blocks, again by bitmaps, then exactly.
Comparing only across components loses no component, and a group of any number
of edited copies of one original is done after the leaders.

Scale: keys are rows that Spark shuffles and sorts (and spills), in partitions
whose number follows the data; a key that a map task sees in two nodes is known
to matter there and looked up once.  Only texts of nodes that share a
key are shuffled.  Pairs that become rows are nodes times leaders; those of a
tile are bit counts within a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import hashing as H
from attestra.llm.base import chunks, shuffle_partitions, text_bytes, written
from attestra.llm.components import components

FLUSH = 1 << 19
#: Nodes, and bytes of their texts, in a block of a tile.
BLOCK_NODES, BLOCK_BYTES = 512, 16 << 20
LED = 256
#: Keys of a partition; and partitions at least, so that the keys of a set are packed alike in small tables and large ones.
KEYS_A_PARTITION, LEAST_PARTITIONS = 1 << 19, 128
#: A shingle in so many sets of one task's share is common; of these the most frequent are known everywhere.
OFTEN, COMMON = 3, 200_000
_LIMITS = [1]
while _LIMITS[-1] < 1 << 40:
    _LIMITS.append(max(_LIMITS[-1] + 1, _LIMITS[-1] * 5 // 4))
LIMITS = np.array(_LIMITS, np.int64)  # size bands: LIMITS[i] <= size < LIMITS[i + 1]


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of every row's distinct shingles, and the rows' offsets in them."""
    data, offsets = text_bytes(column)
    data = H.LOWER[data]
    starts, ends, rows = H.words(data, offsets, H.WHITESPACE)
    counts = np.diff(rows)
    sums = H.prefix(H.word_hashes(data, starts, ends))
    whole = np.flatnonzero((counts > 0) & (counts < n))
    first = np.concatenate([np.flatnonzero(H.window_starts(rows, n)), rows[whole]])
    last = np.concatenate([first[: len(first) - len(whole)] + n, rows[whole + 1]])
    doc, value = np.searchsorted(rows, first, "right") - 1, H.slices(sums, first, last)
    doc[len(first) - len(whole) :] = whole
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(rows)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for every set; 0 for empty ones."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(values) + 1, H.U)
        np.cumsum(H.mix(values ^ H.U(salt)), out=total[1:])
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def _nodes(n: int):
    """_r, doc_id, _d, _t, n_shingles, s1, s2 of every row; common: with some rows, the shingles that several sets since the last have."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def common() -> bytes:
            values, offsets, s1 = (np.concatenate([h[i] for h in held]) for i in range(3))
            _, first = np.unique(s1, return_index=True)  # equal sets count once
            take = np.zeros(len(s1), bool)
            take[first] = True
            shingles, sets = np.unique(values[np.repeat(take, offsets)], return_counts=True)
            often = sets >= OFTEN
            return np.concatenate([shingles[often], sets[often].astype(H.U)]).tobytes()

        for part in chunks(batches):
            values, offsets = shingle_sets(part.column(part.schema.get_field_index("text")), n)
            s1, s2 = _sums(values, offsets)
            held.append((values, np.diff(offsets), s1))
            count += len(values)
            found = [None] * len(s1)
            if count >= 2 * FLUSH:
                found[-1] = common()
                held.clear()
                count = 0
            keep = [part.column(part.schema.get_field_index(c)) for c in ("_r", "doc_id", "_d", "_t")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(offsets), pa.int64()), pa.array(s1), pa.array(s2), pa.array(found, pa.binary())], [*_ROW, "common"])
        if held:
            nothing = [pa.nulls(1, t) for t in (pa.int64(),) * 7]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([common()], pa.binary())], [*_ROW, "common"])

    return nodes


_ROW = ["_r", "doc_id", "_d", "_t", "n_shingles", "s1", "s2"]


def _each_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            both = np.frombuffer(blob, np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["shingle", "n"])


def part_keys(values: np.ndarray, offsets: np.ndarray, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all sets, the set of each, and how many keys a set must share to be linked with anything.

    In a tile, linked sets differ in k shingles at most, so of k + 1 + spare
    parts they have 1 + spare in common.  A part with next to no shingles but
    common ones is thin, in both if they have it in common.  Thin parts aren't
    sent, unless a set has more of those than spares; what isn't sent can't be
    asked for, nor what a partner may not have sent: a set that sends its thin
    parts may share but one key with a partner that has no more than spares.
    """
    telling = np.ones(len(values), bool)
    if len(common):
        telling = common[np.minimum(np.searchsorted(common, values), len(common) - 1)] != values
    sizes = np.diff(offsets)
    keys, owners = [], []
    need = np.full(len(sizes), 1 << 30, np.int64)
    band = np.searchsorted(LIMITS, sizes, "right") - 1
    for up in (0, 1):  # the set's own tile, and the next one if a larger partner may be there
        tile = band + up
        used = np.flatnonzero((sizes > 0) & ((up == 0) | (100 * sizes >= percent * LIMITS[np.minimum(tile, len(LIMITS) - 1)])))
        if not len(used):
            continue
        largest = LIMITS[tile[used] + 1] - 1
        k = 2 * largest * (100 - percent) // (100 + percent)
        spare = np.where(k > 0, 1 + k // 4, 0)
        parts = k + 1 + spare
        weak = np.where(largest >= 6 * parts, 2, 1)  # few parts of a set may be thin
        lens = sizes[used]
        at = np.repeat(offsets[used] - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
        own = np.repeat(np.arange(len(used)), lens)
        v = values[at]
        part = ((v >> H.U(32)) * parts[own].astype(H.U)) >> H.U(32)
        slot = np.append(0, np.cumsum(parts))
        cell = slot[own] + part.astype(np.int64)
        total = np.zeros(len(v) + 1, H.U)
        np.cumsum(H.mix(v ^ H.U(0xA0761D6478BD642F)), out=total[1:])
        cuts = np.searchsorted(cell, np.arange(slot[-1] + 1))
        told = np.append(0, np.cumsum(telling[at]))
        count = told[cuts[1:]] - told[cuts[:-1]]
        of = np.repeat(np.arange(len(used)), parts)
        place = np.arange(slot[-1]) - slot[of]
        key = H.mix((total[cuts[1:]] - total[cuts[:-1]]) ^ H.mix((tile[used][of] * (1 << 32) + place).astype(H.U)))
        thin = count < weak[of]
        held_back = np.bincount(of, thin, len(used)).astype(np.int64)
        send = ~thin | (held_back > spare)[of]
        need[used] = np.minimum(need[used], 1 + spare - np.minimum(held_back, spare))
        keys.append(key[send])
        owners.append(used[of[send]])
    if not keys:
        return np.zeros(0, H.U), np.zeros(0, np.int64), need
    return np.concatenate(keys), np.concatenate(owners), need


_KEYS = ["key", "s1", "need", "known"]


def _emit(n: int, percent: int, parts: int, common):
    """part, s1, need, known, keys: the keys of all sets, those of one set and part together.

    A key that several sets of one task's share have is known to be shared:
    all its rows say so and go anywhere, and one of them is sent once more for
    the look-up, in the key's part, so that what other tasks have finds it.  A
    key is looked up once a share, then, however many sets have it.

    Half a set's hash names it here: two sets that agree in it are taken for
    each other when keys are counted, and told apart again by the join that
    follows, which only adds candidates.
    """

    def rows(key: np.ndarray, owner: np.ndarray, part: np.ndarray, s1: np.ndarray, need: np.ndarray, known: bool) -> pa.RecordBatch:
        order = np.lexsort((key, part, owner))
        key, owner, part = key[order], owner[order], part[order]
        new = np.ones(len(key), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        keys = pa.ListArray.from_arrays(pa.array(np.append(at, len(key)).astype(np.int32)), pa.array(key.view(np.int64)))
        of = owner[at]
        return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(s1[of]), pa.array(need[of].astype(np.int32)), pa.array(np.full(len(at), known)), keys], ["part", "s1", "need", "known", "keys"])

    def flush(keys, owners, s1, needs) -> Iterator[pa.RecordBatch]:
        key, owner, s1, need = map(np.concatenate, (keys, owners, s1, needs))
        _, first, node = np.unique(s1, return_index=True, return_inverse=True)
        owner, s1, need = node[owner], s1[first], need[first]
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[new], owner[new]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        shared = ~first
        shared[:-1] |= ~first[1:]
        yield rows(key[first], owner[first], ((key[first] >> H.U(40)) % H.U(parts)).astype(np.int64), s1, need, False)
        if shared.any():
            anywhere = (s1.view(H.U)[owner[shared]] % H.U(parts)).astype(np.int64)
            yield rows(key[shared], owner[shared], anywhere, s1, need, True)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, base = ([], [], [], []), 0, 0
        for part in chunks(batches):
            values, offsets = shingle_sets(part.column(part.schema.get_field_index("text")), n)
            s1, _ = _sums(values, offsets)
            key, owner, need = part_keys(values, offsets, percent, common.value)
            for x, y in zip(held, (key, owner + base, s1, need), strict=True):
                x.append(y)
            count, base = count + len(key), base + len(s1)
            if count >= FLUSH:
                yield from flush(*held)
                for x in held:
                    x.clear()
                count = base = 0
        if count:
            yield from flush(*held)

    return emit


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by known, key and set: those whose key is known to be shared, or is by what the stream says.

    Only one row is held from batch to batch: the first of the last key while
    no other set has come with it.
    """
    held, key_before, open_before = None, None, False
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in _KEYS]
        known = columns[3].astype(bool)
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[known]) for c in columns[:3]], _KEYS[:3])
            columns = [c[~known] for c in columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        key, s1 = columns[:2]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        new = first.copy()
        new[1:] |= s1[1:] != s1[:-1]
        run = np.cumsum(first) - 1
        shared = np.bincount(run, new) > 1
        if open_before and key[0] == key_before:
            shared[0] = True
        keep = new & shared[run]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns[:3]], _KEYS[:3])
        key_before, open_before = key[-1], bool(shared[-1])
        at = np.flatnonzero(first)[-1]
        held = None if open_before else [c[at : at + 1] for c in columns]


def _bitmap(values: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, bool)
    bits[(values & H.U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(H.U)


def similar(a: np.ndarray, b: np.ndarray, percent: int, maps: dict[int, np.ndarray]) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|; sets as sorted arrays.  maps: bitmaps of ``a`` by width.

    Sizes bound the overlap, then bit counts: bits that differ are shingles
    that differ, so overlap <= (|a| + |b| - differing bits) / 2.
    """
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    width = max(64, 1 << int(4 * max(len(a), len(b)) - 1).bit_length())
    if width not in maps:
        maps[width] = _bitmap(a, width)
    most = (len(a) + len(b) - int(np.bitwise_count(maps[width] ^ _bitmap(b, width)).sum())) // 2
    if 100 * most < percent * (len(a) + len(b) - most):
        return False
    overlap = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * overlap >= percent * (len(a) + len(b) - overlap)


def _partitions(rows: DataFrame, percent: int) -> int:
    """How many partitions the keys of these rows are dealt to: by their number, estimated from the sets' sizes."""
    shingles = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first().n
    keys = shingles * 5 * (100 - percent) // (100 + percent)  # two tiles a set at most, parts and spares in each
    return max(shuffle_partitions(rows.sparkSession), LEAST_PARTITIONS, -(-keys // KEYS_A_PARTITION))


def _leaders(members: DataFrame) -> DataFrame:
    """key, leader: the node of each key that meets most others over all its keys; the original of a group of edited copies, say."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    score = members.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("score"))
    return members.join(score, "node").groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "node")).alias("best")).select("key", F.col("best.node").alias("leader"))


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The links (a, b) among pairs (leader, node).

    A leader's nodes are dealt to groups of about ``LED``; each group gets the
    leader's text once, ahead of the nodes' texts.
    """
    text = texts.select("node", "text")
    groups = pairs.groupBy("leader").agg(F.ceil(F.count("*") / LED).cast("int").alias("groups"))
    led = pairs.join(groups, "leader").withColumn("group", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"))
    led = led.join(text, "node").select("leader", "group", F.lit(False).alias("leads"), "node", "text")
    leads = groups.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("node", F.col("leader"))
    leads = leads.join(text, "node").select("leader", "group", F.lit(True).alias("leads"), "node", "text")
    dealt = led.unionByName(leads).repartition(shuffle_partitions(pairs.sparkSession), "leader", "group")
    ordered = dealt.sortWithinPartitions("leader", "group", F.desc("leads"))
    return ordered.select("leader", "leads", "node", "text").mapInArrow(_compare(n, percent), "a long, b long")


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    rows = pairs.join(comp.withColumnRenamed("comp", "c"), "node", "left").join(comp.select(F.col("node").alias("leader"), F.col("comp").alias("lead_c")), "leader", "left")
    return rows.filter(F.coalesce("c", "node") != F.coalesce("lead_c", "leader")).select("leader", "node")


def _bounded(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and bitmaps leave it open whether they are linked."""

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, lead_size = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("size", "lead_size"))
            marks = zip(batch.column(batch.schema.get_field_index("bits")).to_pylist(), batch.column(batch.schema.get_field_index("lead_bits")).to_pylist(), strict=True)
            differ = np.array([_differing(np.frombuffer(a, H.U), np.frombuffer(b, H.U)) for a, b in marks], np.int64)
            most = (size + lead_size - differ) // 2
            keep = 100 * most >= percent * (size + lead_size - most)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).filter(pa.array(keep)) for c in ("leader", "node")], ["leader", "node"])

    bits = texts.select("node", "size", "bits")
    rows = pairs.join(bits, "node").join(bits.toDF("leader", "lead_size", "lead_bits"), "leader")
    rows = rows.filter(100 * F.least("size", "lead_size") >= percent * F.greatest("size", "lead_size"))
    return rows.select("leader", "node", "size", "lead_size", "bits", "lead_bits").mapInArrow(open_pairs, "leader long, node long")


def _differing(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two bitmaps differ; the wider one is folded first."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _marked(n: int):
    """node, text, size, bits: every node's bitmap, two bits a shingle or more."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            text = part.column(part.schema.get_field_index("text"))
            values, offsets = shingle_sets(text, n)
            sizes = np.diff(offsets)
            bits = [_bitmap(values[a:b], max(64, 1 << int(2 * max(b - a, 1) - 1).bit_length())).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("node")), text, pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], ["node", "text", "size", "bits"])

    return marked


def _tiles(rest: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between different components among nodes that open keys connect; rest: key, node, comp, first.

    What open keys connect is one cluster.  A cluster is cut into blocks, and
    every pair of blocks is a tile, so a task holds two blocks however large
    the cluster is.
    """
    cluster = written(components(rest.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))), "clusters").withColumnRenamed("comp", "cluster")
    nodes = rest.select("node", "comp").distinct().join(cluster, "node").join(texts.select("node", "text"), "node")
    nodes = written(nodes.select("cluster", "node", "comp", "text", F.length("text").alias("size")), "nodes")
    blocks = nodes.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = nodes.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "text")

    def tile(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_numpy() for c in ("i", "j", "own", "node", "comp")}
        values, offsets = shingle_sets(table.column("text").combine_chunks(), n)
        found = _tile(values, offsets, column["own"], column["comp"], bool(column["i"][0] == column["j"][0]), percent)
        return pa.table({"a": pa.array(column["node"][[x for x, _ in found]], pa.int64()), "b": pa.array(column["node"][[y for _, y in found]], pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(tile, "a long, b long")


def _tile(values: np.ndarray, offsets: np.ndarray, own: np.ndarray, comp: np.ndarray, within: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join components, by size bands; two blocks are compared across, one within itself."""
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    _, comp = np.unique(comp, return_inverse=True)
    comp = comp.copy()
    out, at = [], 0
    while at < len(order):
        # rows of a band, and all that may be similar to one of them and is no smaller
        last = int(np.searchsorted(sizes[order], max(sizes[order[at]] * 5 // 4, 1), "right"))
        last = min(max(last, at + 1), at + 256)
        reach = int(np.searchsorted(sizes[order], 100 * sizes[order[last - 1]] // percent, "right"))
        band = order[at:reach]
        width = max(64, 1 << int(4 * max(int(sizes[band[-1]]), 1) - 1).bit_length())
        maps = np.stack([_bitmap(values[offsets[x] : offsets[x + 1]], width) for x in band])
        for r in range(last - at):
            x = band[r]
            y = band[r + 1 :]
            differ = np.bitwise_count(maps[r] ^ maps[r + 1 :]).sum(1, dtype=np.int64)
            most = (sizes[x] + sizes[y] - differ) // 2
            fits = (100 * most >= percent * (sizes[x] + sizes[y] - most)) & (comp[y] != comp[x])
            if not within:
                fits &= own[y] != own[x]
            for z in y[fits].tolist():
                if comp[z] == comp[x]:
                    continue  # linked by now
                overlap = len(np.intersect1d(values[offsets[x] : offsets[x + 1]], values[offsets[z] : offsets[z + 1]], assume_unique=True))
                if 100 * overlap >= percent * (int(sizes[x]) + int(sizes[z]) - overlap):
                    out.append((int(x), z))
                    comp[comp == comp[z]] = comp[x]
        at = last
    return out


def _compare(n: int, percent: int):
    """Rows come leader by leader, its own text first."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, maps = None, {}
        for part in chunks(batches):
            values, offsets = shingle_sets(part.column(part.schema.get_field_index("text")), n)
            leader, node, leads = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("leader", "node", "leads"))
            found = np.zeros(len(node), bool)
            for i in range(len(node)):
                own = values[offsets[i] : offsets[i + 1]]
                if leads[i]:
                    held, maps = own.copy(), {}
                else:
                    found[i] = similar(held, own, percent, maps)
            yield pa.RecordBatch.from_arrays([pa.array(leader[found], pa.int64()), pa.array(node[found], pa.int64())], ["a", "b"])

    return compare


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    ``_d`` and ``_t`` identify the row, ``comp`` its component (null for empty
    sets) where ids are missing or repeated.

    Words are what ASCII white space separates, A-Z lower-cased.  A set holds
    the distinct ``n``-word shingles, or the whole text where it has fewer
    words; null and blank texts have empty sets, which link with nothing.  Two
    rows link if their sets' overlap is at least ``percent`` % of their union.
    component_id is the smallest doc_id reachable, the row's own included; rows
    without an id don't give a component its name.  Repeated rows are rows
    each, with equal sets.
    """
    spark = docs.sparkSession
    identified = docs.select(
        F.monotonically_increasing_id().alias("_r"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_d"),
        F.xxhash64("text").alias("_t"),
        "text",
    )
    rows = written(identified.mapInArrow(_nodes(n), "_r long, doc_id long, _d long, _t long, n_shingles long, s1 long, s2 long, common binary"), "rows")
    often = rows.filter("common is not null").select("common").mapInArrow(_each_common, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = often.orderBy(F.desc("n"), "shingle").select("shingle").limit(COMMON).toArrow().column("shingle").to_numpy()  # 8 bytes each, not a Python row
    common = spark.sparkContext.broadcast(np.sort(often.astype(np.int64).view(H.U)))  # COMMON numbers at most; they only save work
    rows = rows.filter("_r is not null").drop("common")
    classes = rows.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("_r").alias("node"), F.min("doc_id").alias("first_id"), F.min(F.struct("_r", "_d", "_t")).alias("_at"))
    classes = written(classes.select("s1", "s2", "node", "first_id", F.col("_at._d").alias("_d"), F.col("_at._t").alias("_t")), "classes")
    parts = _partitions(rows, percent)
    sent = docs.select("text").mapInArrow(_emit(n, percent, parts, common), "part int, s1 long, need int, known boolean, keys array<long>")
    # what is known already is dealt evenly; the rest meets by key, one row a share, and is read as a sorted stream
    dealt = sent.repartition(parts, "part").select(F.explode("keys").alias("key"), "s1", "need", "known")
    shared = dealt.sortWithinPartitions("known", "key", "s1").mapInArrow(_judge, "key long, s1 long, need int").distinct()
    members = written(shared.join(classes.select("s1", "node"), "s1").select("key", "node", "need"), "shared")
    for _ in range(2):  # what shares too few keys is linked with nothing; keys that one node is left of go as well
        enough = members.groupBy("node").agg(F.count("*").alias("n"), F.min("need").alias("need")).filter("n >= need").select("node")
        left = members.join(enough, "node", "left_semi")
        keys = left.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        members = written(left.join(keys, "key", "left_semi"), "members")
    members = members.select("key", "node")
    wanted = members.select("node").distinct().join(classes.select("node", "_d", "_t"), "node")
    # rows that agree in _d and _t have equal texts, so any of them will do
    texts = written(identified.select("_d", "_t", "text").join(wanted, ["_d", "_t"]).select("node", "text").dropDuplicates(["node"]).mapInArrow(_marked(n), "node long, text string, size long, bits binary"), "texts")
    heads = written(_leaders(members), "leaders")
    met = members.join(heads, "key").filter("node <> leader")
    pairs = written(met.groupBy("leader", "node").agg(F.count("*").alias("shared")), "pairs")
    # each node first meets the leader that it shares most with; mostly that links it
    best = pairs.groupBy("node").agg(F.max(F.struct("shared", "leader")).alias("b")).select(F.least("node", "b.leader").alias("leader"), F.greatest("node", "b.leader").alias("node")).distinct()
    best = written(best, "best")
    links = written(_verified(_bounded(best, texts, percent), texts, n, percent), "links")
    comp = written(components(links), "components")
    # then, across components, all its other leaders, if the bitmaps let it
    across = pairs.select(F.least("leader", "node").alias("leader"), F.greatest("leader", "node").alias("node")).distinct().join(best, ["leader", "node"], "left_anti")
    across = _across(across, comp)
    bounded = written(_bounded(across, texts, percent), "bounded")
    links = links.unionByName(written(_verified(bounded, texts, n, percent), "links"))
    comp = written(components(links), "components")
    # a key is done with when its members but the leader, now compared with all of them, are in one component
    rest = met.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    ends = rest.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("node").alias("first")).filter("low <> high").select("key", "first")
    rest = written(rest.join(ends, "key"), "rest")
    if not rest.isEmpty():
        more = written(_tiles(rest, texts, n, percent), "links")
        comp = written(components(links.unionByName(more)), "components")
    named = classes.select("s1", "s2", "node", "first_id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = named.join(names, "comp").select("s1", "s2", "node", "comp", "component_id")
    out = rows.join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "_d", "_t", "_r", "comp", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one row of each component: of the smallest doc_id, then text hash.

    Rows with empty sets stay.  Rows that agree in doc_id and text are one row.
    """
    names = docs.columns
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    found = join(rows, n, percent)
    first = found.filter("comp is not null").groupBy("comp").agg(F.min(F.struct("_d", "_t")).alias("_k")).select("_k._d", "_k._t")
    kept = first.unionByName(found.filter("comp is null").select("_d", "_t").distinct())
    keyed = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_d"), F.xxhash64("text").alias("_t"), "_row")
    return keyed.join(kept, ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"]).select("_row.*")
