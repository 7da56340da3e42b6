"""Chat formatting with cumulative-snapshot collapse.

A service that logs a conversation after every turn leaves many snapshots,
each a prefix of the next.  Every turn gets a rolling hash of the turns up to
it (the exclusive or of hashes of position, role and text: 128 bits in two
lanes).  A conversation whose last rolling hash is that of an earlier turn of a
longer one is a snapshot; anti-joins leave the maximal conversations, one of
each group of equal ones, and those are rendered.

Scale: turns are hashed before they are shuffled, so texts move once, for
rendering.  Prefix hashes are made distinct before the join, so a first turn
that a third of all conversations share is one row.  A conversation is
rendered in parts of ``PART_TURNS`` turns: no row grows with its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 512


def rolling(turns: DataFrame) -> DataFrame:
    """conv_id, turn, _c (hash of role and text), position, n_turns, h1, h2: the hash of the turns up to each."""
    content = F.xxhash64(F.coalesce("role", F.lit("\x00")), F.coalesce("text", F.lit("\x00")))
    rows = turns.select("conv_id", "turn", content.alias("_c"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit("\x00")), F.coalesce("role", F.lit("\x00"))).alias("_e"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "_c", "_e")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("position", F.row_number().over(order))
    return rows.select(
        "conv_id", "turn", "_c", "_e", "position",
        F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"),
        F.bit_xor(F.xxhash64("position", "_c")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64("position", "_e")).over(so_far).alias("h2"),
    )


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that prefix no longer one; of equal ones, the smallest id."""
    ends = rolled.filter("position = n_turns").select("conv_id", "n_turns", "h1", "h2")
    inner = rolled.filter("position < n_turns").select(F.col("position").cast("long").alias("n_turns"), "h1", "h2").distinct()
    # equal conversations first: what is left has one row for each hash, so no key is hot in the join
    ends = ends.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    return ends.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_equal")


def render(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, n_turns, n_equal, part, n_parts, text: the maximal conversations in a chat template.

    Turns go by number; those with equal numbers (or none, which go first) in
    the fixed order of their hashes.  A null role is "unknown", a null text
    empty, and "<|" within a text is written "< |".  Rows without a conv_id are
    one conversation.  Repeated turns are turns.
    """
    rolled = rolling(turns)
    kept = maximal(rolled)
    role = F.coalesce("role", F.lit("unknown"))
    line = F.concat(F.lit("<|"), F.replace(role, F.lit("<|"), F.lit("< |")), F.lit("|>\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))
    content = F.xxhash64(F.coalesce("role", F.lit("\x00")), F.coalesce("text", F.lit("\x00")))
    other = F.xxhash64(F.lit(1), F.coalesce("text", F.lit("\x00")), F.coalesce("role", F.lit("\x00")))
    lines = turns.select("conv_id", F.struct("turn", content.alias("c"), other.alias("e")).alias("_key"), line.alias("line"))
    order = Window.partitionBy("_id").orderBy(F.asc_nulls_first("_key"))
    kept = kept.withColumnRenamed("conv_id", "_id")
    rows = lines.join(kept, F.col("conv_id").eqNullSafe(F.col("_id"))).withColumn("position", F.row_number().over(order))
    rows = rows.withColumn("part", ((F.col("position") - 1) / part_turns).cast("int"))
    parts = rows.groupBy("_id", "part").agg(F.first("n_turns").alias("n_turns"), F.first("n_equal").alias("n_equal"), F.array_sort(F.collect_list(F.struct("position", "line"))).alias("lines"))
    return parts.select(
        F.col("_id").alias("conv_id"), "n_turns", "n_equal", "part",
        F.ceil(F.col("n_turns") / part_turns).cast("int").alias("n_parts"),
        F.concat_ws("", F.transform("lines", lambda x: x["line"])).alias("text"),
    )
