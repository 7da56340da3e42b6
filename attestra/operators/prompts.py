"""Prompts for a model client, put together from passages and the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators.catalogue import paired

SYSTEM = {
    "applicability": "You decide whether an article applies to an organisation. Answer with one JSON object: condition_met, applicable, quotation. Leave an article out only with a literal quotation from the document that rules its condition out.",
    "evidence": "You look for proof. For each element answer with one JSON object in a list: element, found, quotations. Quote the document literally; what isn't in it isn't found.",
    "exemption": "You decide whether an exemption holds. Answer with one JSON object in a list: reference, holds, quotation. Only exemptions that are listed count, and only with a literal quotation.",
}


def excerpts(passages: DataFrame, by: list[str]) -> DataFrame:
    """by, excerpts: "[id · section]", a line end and the text of each passage, in the order of ``position``, a blank line between."""
    piece = T.excerpt(F.col("passage_id"), F.col("section"), F.col("text"))
    rows = passages.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("position", piece.alias("piece")))).alias("p"))
    return rows.select(*by, F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n").alias("excerpts"))


def _listed(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "\n")


def user_prompt(kind: str, article: Column, condition: Column, elements: Column, exemptions: Column, excerpts_: Column) -> Column:
    """The question of a kind about an article; the document's excerpts stand between triple quotes."""
    head = F.concat(F.lit("Article "), article, F.lit("\n"))
    titled = lambda key, x, what: F.concat(F.lit("- "), key, F.coalesce(F.concat(F.lit(": "), x[what]), F.lit("")))
    if kind == "applicability":
        body = F.concat(F.lit("Condition: "), F.coalesce(condition, F.lit("none")))
    elif kind == "evidence":
        body = F.concat(F.lit("Elements:\n"), _listed(elements, lambda e: F.concat(titled(e["element"], e, "title"), F.when(e["blocking"], " (blocking)").otherwise(""), F.when(F.size(e["hints"]) > 0, F.concat(F.lit("; for instance "), F.array_join(e["hints"], ", "))).otherwise(""))))
    else:
        body = F.concat(F.lit("Exemptions:\n"), _listed(F.filter(exemptions, lambda e: e["ex_ante"]), lambda e: F.concat(titled(e["reference"], e, "title"), F.coalesce(F.concat(F.lit(" if "), e["condition"]), F.lit("")))))
    return F.concat(head, body, F.lit('\n\nDocument:\n\"\"\"'), excerpts_, F.lit('\"\"\"'))


def prompts(documents: DataFrame, grid: DataFrame, kinds: tuple[str, ...] = tuple(SYSTEM)) -> DataFrame:
    """doc_id, article, kind, system, user for every document (doc_id, excerpts) and article of the grid (a few rows).

    Exemptions are asked about only where the article has some that can be judged beforehand.
    """
    rows = paired(documents, grid)
    article = F.concat_ws(" - ", "article", "title")
    condition = F.concat_ws("\nNote: ", "condition", "note")
    made = [
        F.when(F.lit(True) if k != "exemption" else F.exists("exemptions", lambda e: e["ex_ante"]), F.struct(F.lit(k).alias("kind"), F.lit(SYSTEM[k]).alias("system"), user_prompt(k, article, F.nullif(condition, F.lit("")), F.col("elements"), F.col("exemptions"), F.col("excerpts")).alias("user")))
        for k in kinds
    ]
    return rows.select("doc_id", "article", F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))
