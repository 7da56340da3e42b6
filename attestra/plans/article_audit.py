"""The audit of every article of a grid over every document: two contexts, three questions, one verdict.

An article is asked about with passages that its title and hints find, and its
condition with those and the ones that title and condition find.  What the gate
leaves out of scope isn't asked for evidence, and only a breach with exemptions
that can be judged beforehand is asked for one.

Who answers is a function of (question, rows, wanted): it returns the rows with
the question's answer as a struct, null where it wasn't wanted.  :func:`offline`
needs no model; :func:`model` asks a client.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import chunking, grid, prompts, retrieval, scoring, verdicts
from attestra.operators import verification as Q
from attestra.sources import readers

PASSAGES = 5  # fixed value: passages of a question, evidence_k may ask for more
#: What each question is answered with.
GATE = "struct<failed:boolean,condition_met:boolean,applicable_said:boolean,quote:string>"
FOUND = "array<struct<element:string,claimed:boolean,quotes:array<string>>>"
EXEMPTION = "struct<reference:string,quote:string>"
SHAPES = {"applicability": GATE, "evidence": FOUND, "exemption": EXEMPTION}
Ask = Callable[[str, DataFrame, Column], DataFrame]


def sections(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, text, passages of documents cut into sections."""
    cut = chunking.section_passages(docs.select(F.col(by).alias("doc_id"), "text"))
    listed = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("passage_id", "section", "text"))).alias("passages"))
    return docs.select(by, "text").join(listed.withColumnRenamed("doc_id", by), by)


def slices(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, text, passages of documents cut into slices of one size; nothing is shuffled."""
    pieces = F.transform(chunking.hard_split(F.col("text")), lambda t, i: F.struct(F.concat(F.lit("p"), F.lpad((i + 1).cast("string"), 3, "0")).alias("passage_id"), F.lit("text").alias("section"), t.alias("text")))
    return docs.filter(F.length("text") > 0).select(by, "text", pieces.alias("passages"))


def _asked(known: DataFrame) -> DataFrame:
    """The grid with the words of both questions and the number of passages of the first."""
    hints = F.flatten(F.transform("elements", lambda e: F.coalesce(e["hints"], F.array().cast("array<string>"))))
    evidence = F.array_join(F.concat(F.array("title"), hints), " ")
    condition = F.concat_ws(" ", "title", "condition")
    return known.withColumns({"_evidence": retrieval.terms(evidence), "_condition": retrieval.terms(condition), "_k": retrieval.evidence_k(F.size("elements"), PASSAGES)})


def contexts(documents: DataFrame, known: DataFrame, by: str = "doc_id") -> DataFrame:
    """One row a document and article of the grid (a few dozen rows): the document, sentences of its passages, the article, consulted and context (places of passages).

    ``context`` is ``consulted`` and then what only the condition finds.
    """
    normal = documents.select(by, "text", T.normalize(F.col("text")).alias("normal"), "passages", F.transform("passages", lambda p: T.normalize(p["text"])).alias("bodies"), F.transform("passages", lambda p: _sentences(_shown(p))).alias("sentences"))
    rows = retrieval.ranked_bodies(normal, "bodies", _asked(known), {"consulted": ("_evidence", F.col("_k")), "_more": ("_condition", F.lit(PASSAGES))})
    rows = rows.withColumns({c: F.col(f"{c}.position") for c in ("consulted", "_more")})
    return rows.withColumn("context", F.concat("consulted", F.array_except("_more", "consulted"))).drop("_evidence", "_condition", "_k", "_more", "bodies")


def excerpts(places: Column, passages: Column) -> Column:
    """How passages are shown: each with its number and section, in the order of ``places``."""
    return F.array_join(F.transform(places, lambda i: _shown(F.get(passages, i))), "\n\n")


def _shown(passage: Column) -> Column:
    return T.excerpt(passage["passage_id"], passage["section"], passage["text"])


def _sentences(shown: Column) -> Column:
    """s and own (normalised words) of the sentences of 40 characters or more."""
    cut = F.filter(F.transform(F.split(shown, r"(?<=[.!?])\s+|\n"), lambda s: F.trim(s)), lambda s: F.length(s) >= 40)
    return F.transform(cut, lambda s: F.struct(s.alias("s"), F.split(T.normalize(s), " ").alias("own")))


def offline(question: str, rows: DataFrame, wanted: Column) -> DataFrame:
    """The client without a model: every article applies, no exemption holds, and an element's evidence is the first sentence that shares most long words with its title, two at least."""
    if question == "applicability":
        return rows.withColumn(question, F.when(wanted, F.from_json(F.lit('{"failed": false, "applicable_said": true}'), GATE)))
    if question == "exemption":
        return rows.withColumn(question, F.lit(None).cast(EXEMPTION))

    def best(title: Column, sentences: Column) -> Column:
        words = F.array_distinct(F.filter(F.split(T.normalize(title), " "), lambda w: F.length(w) > 5))

        def of(words: Column) -> Column:
            shared = F.transform(sentences, lambda x, i: F.struct(F.size(F.array_intersect(words, x["own"])).alias("n"), (-i).alias("first"), x["s"].alias("s")))
            top = F.array_max(F.filter(shared, lambda x: x["n"] >= 2))
            return F.when(F.size(words) >= 2, top["s"])

        return F.transform(F.array(words), of)[0]  # bound to a name, so that a title is cut once, not at every sentence

    def answer(e: Column, sentences: Column) -> Column:
        return F.transform(F.array(best(e["title"], sentences)), lambda s: F.struct(e["element"].alias("element"), s.isNotNull().alias("claimed"), F.filter(F.array(s), lambda x: x.isNotNull()).alias("quotes")))[0]

    sentences = rows.withColumn("_s", F.when(wanted, F.flatten(F.transform("consulted", lambda i: F.get("sentences", i)))))
    found = F.transform(F.array("_s"), lambda s: F.transform("elements", lambda e: answer(e, s)))[0]
    return sentences.withColumn(question, F.when(wanted, found).cast(FOUND)).drop("_s")


def model(client: Callable[[str, str], str], by: str = "doc_id", **how) -> Ask:
    """Questions put to ``client`` as prompts, equal ones once; ``how`` is that of :func:`readers.evaluate`.

    An answer that fails or can't be read leaves an article in scope, and its elements unclaimed.
    """

    def ask(question: str, rows: DataFrame, wanted: Column) -> DataFrame:
        shown = excerpts(F.col("context" if question == "applicability" else "consulted"), F.col("passages"))
        user = prompts.user_prompt(question, F.concat_ws(" - ", "article", "title"), F.nullif(F.concat_ws("\nNote: ", "condition", "note"), F.lit("")), F.col("elements"), F.col("exemptions"), shown)
        asked = rows.filter(wanted).select(by, "article", F.lit(prompts.SYSTEM[question]).alias("system"), user.alias("user"))
        answers = asked.withColumn("prompt_hash", readers.prompt_hash(how.get("model", ""), how.get("temperature", 0.0)))
        told = readers.evaluate(asked.select("system", "user"), client, **how).select("prompt_hash", "answer", "error")
        read = answers.select(by, "article", "prompt_hash").join(told, "prompt_hash").select(by, "article", _read(question).alias(question))
        return rows.join(read, [by, "article"], "left")

    return ask


def _read(question: str) -> Column:
    value = T.json_value(F.col("answer"))
    get = lambda path, kind: F.try_variant_get(value, path, kind)
    if question == "applicability":
        return F.struct(value.isNull().alias("failed"), get("$.condition_met", "boolean").alias("condition_met"), get("$.applicable", "boolean").alias("applicable_said"), get("$.quotation", "string").alias("quote"))
    if question == "exemption":
        return F.struct(get("$.reference", "string").alias("reference"), get("$.quotation", "string").alias("quote"))
    each = F.coalesce(F.from_json(value.cast("string"), "array<struct<element:string,found:boolean,quotation:string,quotations:array<string>>>"), F.array())
    return F.transform(each, lambda e: F.struct(e["element"].alias("element"), F.coalesce(e["found"], F.lit(False)).alias("claimed"), Q.quotations(e["quotations"], e["quotation"]).alias("quotes")))


def _proofs(rows: DataFrame) -> DataFrame:
    """proofs: of every element of the article whether it was claimed and verified, with what quotation, or why not."""
    none = F.array().cast("array<string>")

    def proof(e: Column, found: Column, normal: Column) -> Column:
        said = F.try_element_at(F.filter(found, lambda x: x["element"] == e["element"]), F.lit(-1))  # the last answer counts
        quotes, claimed = F.coalesce(said["quotes"], none), F.coalesce(said["claimed"], F.lit(False))
        return F.transform(
            F.array(F.struct(claimed.alias("claimed"), quotes.alias("quotes"), F.when(claimed, Q.verify_in(quotes, normal)).alias("checks"))),
            lambda x: F.struct(
                e["element"].alias("element"), e["blocking"].alias("blocking"), x["claimed"].alias("claimed"),
                (x["claimed"] & (F.size(x["quotes"]) > 0) & F.forall(F.coalesce(x["checks"], F.array()), lambda c: c["valid"])).alias("verified"),
                F.when(F.size(x["quotes"]) > 0, F.array_join(x["quotes"], " […] ")).alias("quotation"),
                F.when(x["claimed"] & (F.size(x["quotes"]) == 0), "no quotation").when(x["claimed"], F.get(F.filter(x["checks"], lambda c: ~c["valid"]), 0)["reason"]).alias("rejected"),
            ),
        )[0]

    made = F.transform(F.array(F.struct("evidence", "normal")), lambda r: F.transform("elements", lambda e: proof(e, r["evidence"], r["normal"])))
    return rows.withColumn("proofs", F.when(F.col("evidence").isNotNull(), F.get(made, 0)))


def audit(documents: DataFrame, known: DataFrame, ask: Ask = offline, by: str = "doc_id") -> DataFrame:
    """One row a document and article: verdict, credit, confidence, review, diagnostics, proofs, exemption, and the passages consulted.

    documents: by, text, passages (passage_id, section, text) of :func:`sections`
    or :func:`slices`; known: a grid with titles, conditions and hints.
    """
    rows = ask("applicability", contexts(documents, known, by), F.lit(True))
    a = F.col("applicability")
    proof = Q.verify_in(F.array(a["quote"]), F.col("normal"), Q.SHORTEST_EXCLUSION)
    said, why = verdicts.gate(F.coalesce(a["failed"], F.lit(True)), a["condition_met"], a["applicable_said"], F.col("needs_proof"), a["quote"], F.get(proof, 0)["valid"])
    rows = rows.withColumn("_gate", why).withColumn("applicable", said | F.col("_gate").isNotNull())
    rows = _proofs(ask("evidence", rows, F.col("applicable")))

    count = lambda test: F.size(F.filter("proofs", test)).cast("long")
    rows = rows.withColumns(
        {
            "blocking": F.size(grid.blocking(F.col("elements"))).cast("long"),
            "proven": F.coalesce(count(lambda p: p["blocking"] & p["verified"]), F.lit(0)),
            "_unverified": F.coalesce(count(lambda p: p["claimed"] & ~p["verified"]), F.lit(0)),
            "_minor": F.coalesce(count(lambda p: ~p["blocking"] & ~p["verified"]), F.lit(0)),
        }
    )
    rows = rows.withColumn("_proven", verdicts.all_proven(F.col("blocking"), F.col("proven")))
    breach = F.col("applicable") & ~F.col("_proven") & (F.size(grid.ex_ante(F.col("exemptions"))) > 0)
    rows = ask("exemption", rows, breach)
    x = F.when(breach & (F.coalesce(F.trim(F.col("exemption.reference")), F.lit("")) != ""), F.col("exemption"))
    listed = F.get(F.transform(F.array(x), lambda said: F.filter("exemptions", lambda e: e["ex_ante"] & (e["reference"] == said["reference"]))), 0)
    effect = F.get(listed, 0)["effect"]
    held = F.get(Q.verify_in(F.array(x["quote"]), F.col("normal"), Q.SHORTEST_EXCLUSION), 0)["valid"]
    rows = rows.withColumn("_unheld", F.when(x.isNotNull(), verdicts.exemption_diagnostic(effect, x["quote"], held)))
    rows = rows.withColumn("_effect", F.when(F.col("_unheld").isNull(), effect))

    rows = rows.withColumn("verdict", F.when(~F.col("applicable"), "out_of_scope").otherwise(verdicts.verdict(F.col("_proven"), F.col("_effect"))))
    rejected = F.transform(F.filter(F.coalesce("proofs", F.array()), lambda p: p["rejected"].isNotNull()), lambda p: F.concat_ws(": ", p["element"], p["rejected"]))
    # a failed answer keeps the article in scope without being a diagnostic
    first = F.when(~a["failed"], F.col("_gate"))
    rows = rows.withColumn("diagnostics", F.when(~F.col("applicable"), F.array().cast("array<string>")).otherwise(F.filter(F.concat(F.array(first), rejected, F.array("_unheld")), lambda d: d.isNotNull())))
    n = F.size("diagnostics")
    sure = verdicts.confidence(F.col("article"), F.col("verdict"), F.col("_unverified"), n, F.col("_minor"))
    rows = rows.withColumn("confidence", F.when(F.col("applicable"), sure).otherwise(0.85))
    return rows.select(
        by, "ordering", "article", "criticality", "applicable", "verdict", verdicts.credit(F.col("verdict"), F.col("proven"), F.col("blocking")).alias("credit"), "confidence",
        F.when(F.col("applicable"), verdicts.review(F.col("confidence"), n)).alias("review"), "diagnostics", "blocking", "proven", "proofs", F.when(F.col("_effect").isNotNull(), F.col("exemption.reference")).alias("exemption"),
        F.transform("consulted", lambda i: F.get("passages", i)["passage_id"]).alias("consulted"), F.transform("context", lambda i: F.get("passages", i)["passage_id"]).alias("context"),
        F.when(F.col("verdict") == "breach", F.transform(F.filter("proofs", lambda p: p["blocking"] & ~p["verified"]), lambda p: p["element"])).alias("to_document"),
    )


def scores(audited: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, score, n_scored, level of the weighted credits."""
    return scoring.weighted(audited, by)
