"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree of domains, languages and sources.  A token budget
goes down the tree in proportion to weights; no node gets more than its
documents can give in ``max_epochs`` epochs, and what it can't take goes to its
siblings first.  As a node's limit is what its subtree can give, a shortage
leaves a subtree only when all siblings there are full.  A leaf's budget is
then met with whole epochs and a token prefix of one more, whose order is
seeded.

Scale: one aggregation gives the tree; budgets are windows over its nodes.
The prefix of a leaf is found in two steps, first by buckets of the epoch
order (about ``BUCKET_ROWS`` documents each, however large the leaf), then
within a bucket, so that no task gets a whole leaf.  Texts are read once and
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.base import written

BUCKET_ROWS = 4096
NONE = "(none)"
TREE = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(name: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit(1))


def fill(nodes: DataFrame, parent: list[str], node: str) -> DataFrame:
    """Add ``budget``: the share of ``given`` that goes to each of the parent's nodes.

    Nodes are looked at by limit over weight; those whose proportional share
    reaches the limit are full, the rest divide what is left.  Shares are whole
    tokens, rounded down; a node of no weight gets none.
    """
    siblings = Window.partitionBy(*parent)
    before = siblings.orderBy("_ratio", node).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    used = nodes.withColumn("_w", F.greatest(F.col("weight"), F.lit(0)).cast("double"))
    used = used.withColumn("_c", F.when(F.col("_w") > 0, F.col("limit").cast("double")).otherwise(zero))
    used = used.withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_c") / F.col("_w")).otherwise(zero))
    used = used.withColumns({"_all": F.sum("_w").over(siblings), "_sum_c": F.coalesce(F.sum("_c").over(before), zero), "_sum_w": F.coalesce(F.sum("_w").over(before), zero)})
    full = F.col("_c") * (F.col("_all") - F.col("_sum_w")) <= (F.col("given") - F.col("_sum_c")) * F.col("_w")
    used = used.withColumn("_full", full)
    used = used.withColumns({"_full_c": F.sum(F.when(F.col("_full"), F.col("_c")).otherwise(zero)).over(siblings), "_full_w": F.sum(F.when(F.col("_full"), F.col("_w")).otherwise(zero)).over(siblings)})
    share = F.floor((F.col("given") - F.col("_full_c")) * F.col("_w") / (F.col("_all") - F.col("_full_w")))
    used = used.withColumn("budget", F.when(F.col("_full"), F.col("_c")).otherwise(share).cast("long"))
    return used.drop("_w", "_c", "_ratio", "_all", "_sum_c", "_sum_w", "_full", "_full_c", "_full_w")


def budgets(leaves: DataFrame, share: float, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Leaves (tree columns, tokens) with ``budget``: tokens that each is to give."""
    leaves = leaves.withColumn("limit", F.col("tokens") * max_epochs)
    level = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * share).cast("long").alias("given"))
    parent: list[str] = []
    for at, node in enumerate(TREE):
        path = [*parent, node]
        nodes = leaves.groupBy(*path).agg(F.sum("limit").alias("limit")).withColumn("weight", _weight(F.col(node), weights.get(node, {})))
        # the root is one row; further down, a child meets its parent's row
        nodes = nodes.join(level, parent) if at else nodes.crossJoin(F.broadcast(level))
        level = fill(nodes, parent, node).select(*path, F.col("budget").alias("given"))
        parent = path
    return leaves.join(level, parent).withColumnRenamed("given", "budget").drop("limit")


def mix(docs: DataFrame, domain: Column, share: float, max_epochs: int = 2, weights: dict[str, dict[str, int]] | None = None, seed: int = 1) -> DataFrame:
    """doc_id, _t (hash of the text), domain, lang, source, n_tokens and copies, for every document.

    The budget is ``share`` of all tokens.  copies: how many epochs take the
    document; 0 leaves it out.  The partial epoch takes documents in seeded
    order (ties by doc_id, then length) as long as their tokens fit.  Null
    languages, sources and domains are nodes of their own named "(none)";
    documents without words have no copies.  Repeated rows are documents each.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select(
        "doc_id",
        F.xxhash64("text").alias("_t"),
        F.coalesce(domain.cast("string"), F.lit(NONE)).alias("domain"),
        F.coalesce("lang", F.lit(NONE)).alias("lang"),
        F.coalesce("source", F.lit(NONE)).alias("source"),
        token_count(F.col("text")).alias("n_tokens"),
        order.alias("_order"),
    )
    rows = written(rows, "rows")  # without texts; each text is read once
    leaves = rows.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = written(leaves, "leaves")
    plan = budgets(leaves, share, max_epochs, weights or {})
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    digits = F.ceil(F.log(F.greatest(F.col("docs") / BUCKET_ROWS, F.lit(1.0))) / F.log(F.lit(16.0))).cast("int")
    plan = plan.withColumn("_whole", whole).withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("tokens")).withColumn("_digits", digits)
    # its written size decides whether Spark broadcasts it
    plan = written(plan.select(*TREE, "_whole", "_rest", "_digits"), "plan")
    rows = rows.join(plan, [*TREE]).withColumn("_bucket", F.expr("left(_order, _digits)"))
    buckets = rows.groupBy(*TREE, "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    ahead = Window.partitionBy(*TREE).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*TREE, "_bucket").orderBy("_order", F.asc_nulls_first("doc_id"), "n_tokens", "_t").rowsBetween(Window.unboundedPreceding, 0)
    taken = rows.join(buckets, [*TREE, "_bucket"]).withColumn("_end", F.col("_before") + F.sum("n_tokens").over(within))
    copies = F.when(F.col("n_tokens") == 0, F.lit(0)).otherwise(F.col("_whole") + F.when(F.col("_end") <= F.col("_rest"), 1).otherwise(0)).cast("long")
    return taken.select("doc_id", "_t", *TREE, "n_tokens", copies.alias("copies"))


def select(docs: DataFrame, domain: Column, share: float, max_epochs: int = 2, weights: dict[str, dict[str, int]] | None = None, seed: int = 1) -> DataFrame:
    """``docs`` that the mix takes, with ``copies`` added (in place of a column of that name).

    Rows that agree in doc_id and text get the most copies that one of them has.
    """
    names = [c for c in docs.columns if c != "copies"]
    taken = mix(docs, domain, share, max_epochs, weights, seed).filter("copies > 0")
    taken = taken.groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_h")).agg(F.max("copies").alias("copies"))
    rows = docs.select(F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_x"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    return rows.join(taken, F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_x") == F.col("_h"))).select("_row.*", "copies")


#: What the registered query and the pipeline mix with.
SHARE, MAX_EPOCHS, SEED = 0.6, 2, 1
WEIGHTS = {"domain": {"web": 4, "books": 3, "forums": 2, "news": 1}, "lang": {"en": 6, "fr": 2, "de": 2, "es": 1}, "source": {"src0": 3}}


def domain_of_source(source: Column) -> Column:
    """The four domains of the test sources, by the number in their name."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int") % 4
    return F.when(number == 0, "web").when(number == 1, "books").when(number == 2, "forums").when(number == 3, "news")
