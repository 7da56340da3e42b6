"""Passages ranked per requirement: lexical, by vectors, fused."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from attestra.functions import text as T
from attestra.operators.catalogue import held, paired

RRF = 60  # fixed value of reciprocal rank fusion
#: Vectors in a block of queries and of candidates, and candidate blocks that one copy of the queries meets.
QUERY_BLOCK, BLOCK, BLOCKS_A_SALT = 256, 1024, 64


def terms(query: Column) -> Column:
    """The query's words over three letters, repeated ones repeated."""
    return F.filter(F.split(T.normalize(query), " "), lambda t: F.length(t) > 3)


def lexical_score(words: Column, body: Column) -> Column:
    """Occurrences of all words, damped by the length of the (normalised) body."""
    hits = F.aggregate(words, F.lit(0), lambda n, t: n + T.occurrences(body, t))
    return hits / (1 + F.length(body) / 800)


def widened(k: Column, n: Column | None = None) -> Column:
    """How many (of n, if that is known) a ranker gives to the fusion."""
    wide = F.greatest(2 * k, F.lit(10))
    return wide if n is None else F.least(n, wide)


def evidence_k(elements: Column, k: int = 5) -> Column:
    return F.greatest(F.lit(k), F.least(F.lit(12), 3 + elements))


def lexical_topk(passages: DataFrame, requirements: DataFrame, k: Column, by: str = "doc_id") -> DataFrame:
    """The k best passages of every ``by`` for each requirement; where none scores, its first k.

    passages: by, position, body (normalised text); requirements: a catalogue of
    a few dozen rows (requirement, query, ..), which goes to every passage.
    """
    asked = requirements.withColumn("words", terms(F.col("query")))
    scored = paired(passages, asked).withColumn("score", F.round(lexical_score(F.col("words"), F.col("body")), 6))
    order = Window.partitionBy(by, "requirement").orderBy(F.desc("score"), "position")
    best = F.max("score").over(Window.partitionBy(by, "requirement"))
    ranked = scored.withColumns({"rank": F.row_number().over(order), "best": best})
    return ranked.filter((F.col("rank") <= k) & ((F.col("score") > 0) | (F.col("best") <= 0))).drop("words", "body", "best")


def best_of(words: Column, bodies: Column, k: Column) -> Column:
    """(position, score) of the k best of a document's (normalised) bodies, best first; where none scores, the first k.

    All in one row: nothing is shuffled, and what leaves the row is k entries.
    """
    scored = F.transform(bodies, lambda b, i: F.struct((-F.round(lexical_score(words, b), 6)).alias("less"), i.alias("position")))
    first = F.slice(F.array_sort(scored), F.lit(1), F.greatest(k, F.lit(0)))
    told = F.transform(first, lambda x: F.struct(x["position"].alias("position"), (-x["less"]).alias("score")))
    # bound to a name, so that it is computed once
    kept = F.transform(F.array(told), lambda t: F.filter(t, lambda x: (x["score"] > 0) | (F.get(t, 0)["score"] <= 0)))
    return F.get(kept, 0)


#: Words whose terms a Python worker remembers, and how long they may be.
KNOWN_WORDS, KNOWN_LENGTH = 1 << 17, 64
#: So many terms are counted in a body one by one, which takes a microsecond each; a body's words take some 170.
FEW_TERMS = 64


@lru_cache(1 << 16)
def _damped(hits: int, length: int) -> float:
    """The score of :func:`lexical_score`, rounded as Spark's round does: halves of the shortest decimal go up."""
    return float(Decimal(repr(hits / (1 + length / 800))).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def term_hits(queries: list[list[str]]) -> Callable[[str], dict[int, int]]:
    """A function of a body: how often the terms of each query occur in it, queries without any left out.

    Terms hold no space, so an occurrence lies within a word of the body, and
    what a word holds is looked up once: by its stretches of the terms' lengths.
    A few terms are counted in the whole body.
    """
    asked: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for q, words in enumerate(queries):
        for term, times in Counter(words).items():
            asked[term].append((q, times))
    if len(asked) <= FEW_TERMS:
        few = list(asked.items())

        def counted(body: str) -> dict[int, int]:
            hits: dict[int, int] = {}
            for term, own in few:
                found = body.count(term)
                if found:
                    for q, times in own:
                        hits[q] = hits.get(q, 0) + times * found
            return hits

        return counted
    lengths = sorted({len(t) for t in asked})
    known: dict[str, tuple] = {}

    def of_word(word: str) -> tuple:
        n = len(word)
        terms = {word[i : i + size] for size in lengths if size <= n for i in range(n - size + 1)} & asked.keys()
        return tuple((q, times * word.count(t)) for t in terms for q, times in asked[t])

    def of_body(body: str) -> dict[int, int]:
        hits: dict[int, int] = {}
        for word in body.split(" "):
            found = known.get(word)
            if found is None:
                found = of_word(word)
                if len(word) <= KNOWN_LENGTH:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    known[word] = found
            for q, n in found:
                hits[q] = hits.get(q, 0) + n
        return hits

    return of_body


def _ranker(queries: list[list[str]], most: list[int]):
    def rank(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of_body = term_hits(queries)
        for batch in batches:
            positions, scores, lists, rows = [], [], [0], [0]
            for bodies in (x.as_py() for x in batch):  # one document at a time
                if bodies is not None:
                    found: list[list[tuple[float, int]]] = [[] for _ in queries]
                    for at, body in enumerate(bodies):
                        for q, n in of_body(body or "").items():
                            score = _damped(n, len(body))
                            if score > 0:
                                found[q].append((-score, at))
                    for own, k in zip(found, most, strict=True):
                        own.sort()
                        best = own[: max(k, 0)] if own else [(-0.0, at) for at in range(min(max(k, 0), len(bodies)))]
                        positions.extend(at for _, at in best)
                        scores.extend(0.0 - less for less, _ in best)
                        lists.append(len(positions))
                rows.append(len(lists) - 1)
            each = pa.StructArray.from_arrays([pa.array(positions, pa.int32()), pa.array(scores, pa.float64())], ["position", "score"])
            inner = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), each)
            yield pa.ListArray.from_arrays(pa.array(rows, pa.int32()), inner)

    return rank


def ranked_bodies(documents: DataFrame, bodies: str, asked: DataFrame, queries: dict[str, tuple[str, Column]]) -> DataFrame:
    """Every document with every row of ``asked`` (a catalogue), and for each name of ``queries`` ({name: (words, k)}) the result of :func:`best_of`.

    The catalogue's words are looked for in one go over a document's bodies, so
    that the work is that of reading them, however many words are asked for;
    only a catalogue that is too large to be sent is ranked pair by pair.
    """
    asked, rows = held(asked.withColumns({f"_k_{name}": k.cast("int") for name, (_, k) in queries.items()}))
    if rows is None:
        found = paired(documents, asked)
        return found.withColumns({name: best_of(F.col(words), F.col(bodies), F.col(f"_k_{name}")) for name, (words, _) in queries.items()}).drop(*[f"_k_{name}" for name in queries])
    words, most = [list(r[w] or ()) for w, _ in queries.values() for r in rows], [r[f"_k_{name}"] or 0 for name in queries for r in rows]
    rank = F.arrow_udf(_ranker(words, most), "array<array<struct<position:int,score:double>>>")
    numbered = asked.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], StructType([*asked.schema.fields, StructField("_n", IntegerType())]))
    found = paired(documents.withColumn("_ranked", rank.asNondeterministic()(F.col(bodies))), numbered)  # neither repeated nor moved
    return found.withColumns({name: F.get("_ranked", F.col("_n") + i * len(rows)) for i, name in enumerate(queries)}).drop("_ranked", "_n", *[f"_k_{name}" for name in queries])


def scored_bodies(documents: DataFrame, bodies: str, asked: DataFrame, k: int) -> DataFrame:
    """Every document in its row with ``found``: of each row of ``asked`` (a catalogue with a column ``query``) its other columns, and the scores of the k best bodies.

    What :func:`lexical_best` tells, with nothing left of the bodies and no row a passage.
    """
    asked, rows = held(asked.withColumn("_words", terms(F.col("query"))).drop("query"))
    if rows is None:
        raise ValueError("too many requirements for a catalogue that every document is asked about")
    rank = F.arrow_udf(_ranker([list(r["_words"] or ()) for r in rows], [k] * len(rows)), "array<array<struct<position:int,score:double>>>")
    named = [f for f in asked.schema.fields if f.name != "_words"]
    own = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in named], F.get("_ranked", F.lit(i))["score"].alias("scores")) for i, r in enumerate(rows)]
    ranked = documents.withColumn("_ranked", rank.asNondeterministic()(F.col(bodies)))  # neither repeated nor moved
    return ranked.withColumn("found", F.array(*own)).drop("_ranked", bodies)


def lexical_best(documents: DataFrame, requirements: DataFrame, k: Column, by: str = "doc_id") -> DataFrame:
    """The rows of :func:`lexical_topk` for documents (by, bodies: an array) that hold their passages themselves.

    requirements: a catalogue of a few dozen rows (requirement, query, ..).
    """
    asked = requirements.withColumn("words", terms(F.col("query")))
    rows = ranked_bodies(documents.select(by, "bodies"), "bodies", asked, {"_best": ("words", k)}).drop("words", "bodies")
    return rows.select("*", F.posexplode("_best").alias("_n", "_b")).select(*[c for c in rows.columns if c != "_best"], (F.col("_n") + 1).alias("rank"), "_b.position", "_b.score")


def _packed(rows: DataFrame, key: str, on: list[str], size: int, prefix: str) -> DataFrame:
    """Blocks of up to ``size`` vectors of one length and one value of ``on``: numbers, and unit vectors as a matrix, in bytes.

    Vectors that are null, hold null or no number, or have no length are in none.
    """
    schema = f"{prefix}dim int, " + "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in on) + f"{prefix}ids binary, {prefix}unit binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            lens = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is no number
            starts = np.cumsum(lens) - lens
            keys = [batch.column(2 + i).to_pylist() for i in range(len(on))]
            groups: dict[tuple, list[int]] = {}
            for i, n in enumerate(lens.tolist()):
                if n and ids[i].is_valid:
                    groups.setdefault((n, *(k[i] for k in keys)), []).append(i)
            for group, members in groups.items():
                at = np.array(members)
                matrix = flat[starts[at][:, None] + np.arange(group[0])]
                with np.errstate(invalid="ignore"):
                    length = np.sqrt((matrix * matrix).sum(1))
                usable = np.isfinite(length) & (length > 0)
                matrix, at = matrix[usable] / length[usable, None], at[usable]
                numbers = ids.take(pa.array(at)).to_numpy(zero_copy_only=False).astype("<i8")
                for low in range(0, len(at), size):
                    made = [group[0], *group[1:], numbers[low : low + size].tobytes(), np.ascontiguousarray(matrix[low : low + size]).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, [pa.int32(), *(batch.schema.field(2 + i).type for i in range(len(on))), pa.binary(), pa.binary()], strict=True)], names)

    names = [f"{prefix}dim", *on, f"{prefix}ids", f"{prefix}unit"]
    return rows.select(F.col(key).cast("long").alias(key), "vector", *on).mapInArrow(pack, schema)


def _best(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k nearest of each query in each pair of blocks."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q_ids, q_unit, c_ids, c_unit = (batch.column(batch.schema.get_field_index(c)) for c in ("q_ids", "q_unit", "c_ids", "c_unit"))
            for i in range(batch.num_rows):  # a pair of blocks a record
                q, c = np.frombuffer(q_ids[i].as_buffer(), "<i8"), np.frombuffer(c_ids[i].as_buffer(), "<i8")
                a, b = np.frombuffer(q_unit[i].as_buffer()).reshape(len(q), -1), np.frombuffer(c_unit[i].as_buffer()).reshape(len(c), -1)
                by_id = np.argsort(c, kind="stable")
                distance = np.round(1 - a @ b[by_id].T, 6)
                distance[q[:, None] == c[by_id][None, :]] = np.inf
                near = np.argsort(distance, axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(distance, near, 1)
                real = np.isfinite(found)
                rows = [np.repeat(q, real.sum(1)), c[by_id][near][real], found[real] + 0.0]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["query_id", "id", "distance"])

    return best


def nearest(queries: DataFrame, candidates: DataFrame, k: int, on: list[str] | None = None) -> DataFrame:
    """query_id, rank, id, distance: exact cosine neighbours, ties by id.

    ``on``: columns that must be equal (tenant, document); blocks of vectors
    that agree in them (and in length) meet.  Both sides travel as blocks of
    unit vectors, so a row of the join is a pair of blocks and one product of
    matrices; what leaves it are the k best of each query.  Candidate blocks
    are dealt over salts, so that a hot value of ``on`` is no single task, and
    the queries' blocks are copied once for every ``BLOCKS_A_SALT`` of those.
    """
    on = on or []
    asked, offered = _packed(queries, "query_id", on, QUERY_BLOCK, "q_"), _packed(candidates, "id", on, BLOCK, "c_")
    many = offered.groupBy(F.col("c_dim").alias("n_dim"), *on).agg(F.ceil(F.count("*") / BLOCKS_A_SALT).cast("int").alias("salts"))
    salted = offered.join(many.withColumnRenamed("n_dim", "c_dim"), ["c_dim", *on]).withColumn("salt", F.pmod(F.xxhash64("c_ids"), F.col("salts")).cast("int")).drop("salts")
    copies = asked.join(many.withColumnRenamed("n_dim", "q_dim"), ["q_dim", *on]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    pairs = copies.join(salted.withColumnRenamed("c_dim", "q_dim"), ["q_dim", *on, "salt"])
    found = pairs.select("q_ids", "q_unit", "c_ids", "c_unit").mapInArrow(_best(k), "query_id long, id long, distance double")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query among (query_id, id, distance), ties by id."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def fuse(rankings: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of (query_id, rank, id) lists: the k best sums of 1 / (60 + rank)."""
    every = rankings[0].select("query_id", "rank", "id")
    for more in rankings[1:]:
        every = every.unionByName(more.select("query_id", "rank", "id"))
    total = every.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (RRF + F.col("rank"))), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def with_fallback(ranked: DataFrame, fallback: DataFrame) -> DataFrame:
    """``ranked``, and the fallback's rows for queries that it has none for."""
    return ranked.unionByName(fallback.join(ranked.select("query_id").distinct(), "query_id", "left_anti"))


def context(first: DataFrame, more: DataFrame) -> DataFrame:
    """The passages of ``first``, then those of ``more`` that aren't among them."""
    keys = [*first.columns[:2]]
    fresh = more.join(first.select(*keys), keys, "left_anti")
    return first.withColumn("part", F.lit(1)).unionByName(fresh.withColumn("part", F.lit(2)))
