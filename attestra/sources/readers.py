"""Readers of what audits start from: texts, blobs, ground truth, annotations, reports, regulations."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_CHARS = 20_000  # fixed value: a regulation page that is shorter isn't the regulation


def texts(spark: SparkSession, folder: str, prefix: str | None = None) -> DataFrame:
    """name, text of the .txt files of a folder, whole; only names that start with ``prefix``, if given."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    rows = rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    return rows if prefix is None else rows.filter(F.startswith("name", F.lit(prefix)))


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    """name, size, content, sha256 of a folder's files."""
    rows = spark.read.format("binaryFile").load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("sha256"))


def extract_text(found: DataFrame) -> DataFrame:
    """name, text, problem: UTF-8 natively, PDF and DOCX where their libraries are installed."""

    def office(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                try:
                    out.append((name, _office_text(name, content), None))
                except Exception as e:  # a broken file is a row that says so
                    out.append((name, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["name", "text", "problem"])

    is_office = F.lower("name").rlike(r"\.(pdf|docx)$")
    plain = found.filter(~is_office).select("name", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(None).cast("string").alias("problem"))
    return plain.unionByName(found.filter(is_office).select("name", "content").mapInPandas(office, "name string, text string, problem string"))


def _office_text(name: str, content: bytes) -> str:
    import io

    if name.lower().endswith(".pdf"):
        from pypdf import PdfReader

        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
    from docx import Document

    return "\n".join(p.text for p in Document(io.BytesIO(content)).paragraphs)


_TRUTH = "cas array<struct<fichier:string,description:string,score_attendu:array<double>,verdicts_attendus:map<string,string>,jamais_exclure:array<string>>>"
VERDICTS = {"conforme": "compliant", "manquement": "breach", "hors_perimetre": "out_of_scope", "indetermine": "undetermined", "tolere": "tolerated"}


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """document, low, high, article, expected, never_exclude: one row for each annotated verdict."""
    cases = spark.read.schema(_TRUTH).json(path, multiLine=True).select(F.inline("cas"))
    rows = cases.select("fichier", "score_attendu", "jamais_exclure", F.explode("verdicts_attendus").alias("article", "verdict"))
    names = F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])
    return rows.select(
        F.col("fichier").alias("document"), F.get("score_attendu", 0).alias("low"), F.get("score_attendu", 1).alias("high"), "article",
        F.coalesce(F.try_element_at(names, "verdict"), "verdict").alias("expected"), F.array_contains("jamais_exclure", F.col("article")).alias("never_exclude"),
    )


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """document, low, high, article, expected, tolerated; keys that start with an underscore are notes."""
    shape = "map<string,struct<profil:string,score_attendu:array<int>,articles:map<string,struct<verdict:string,motif:string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("m")).select(F.explode("m").alias("document", "d"))
    rows = raw.filter(~F.startswith("document", F.lit("_"))).select("document", "d.score_attendu", F.explode("d.articles").alias("article", "a"))
    names = F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])
    return rows.select("document", F.get("score_attendu", 0).alias("low"), F.get("score_attendu", 1).alias("high"), "article", F.try_element_at(names, "a.verdict").alias("expected"), (F.col("a.verdict") == "tolere").alias("tolerated"))


def report_verdicts(spark: SparkSession, path: str, articles: Iterable[str] | None = None) -> DataFrame:
    """document, article, verdict of a written report."""
    shape = "documents array<struct<fichier:string,verdicts:array<struct<article:string,verdict:string,justification:string>>>>"
    rows = spark.read.schema(shape).json(path, multiLine=True).select(F.inline("documents")).select("fichier", F.inline("verdicts"))
    rows = rows.select(F.col("fichier").alias("document"), "article", "verdict", "justification")
    return rows if articles is None else rows.filter(F.col("article").isin(*articles))


def regulations(spark: SparkSession, folder: str) -> DataFrame:
    """name, html of landed regulation pages, without those too short to be one."""
    pages = spark.read.option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    return pages.filter(F.length("value") >= LEAST_CHARS).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("html"))


class TryLater(Exception):
    """What a client raises when it is asked too often; the next attempt waits three times as long."""


class Refused(Exception):
    """What a client raises when asking again is no use (a request that isn't accepted)."""


def prompt_hash(model: str = "", temperature: float = 0.0) -> Column:
    """What an answer is remembered by: a hash of model, temperature, system and user."""
    return F.sha2(F.concat_ws("\x00", F.lit(model), F.lit(str(temperature)), "system", "user"), 256)


def evaluate(
    prompts: DataFrame, client: Callable[[str, str], str], model: str = "", temperature: float = 0.0,
    attempts: int = 4, failures: int = 3, wait: float = 0.0, deadline: float | None = None, cache: DataFrame | None = None,
) -> DataFrame:
    """prompt_hash, answer, error, cached for every distinct prompt; ``client`` takes (system, user).

    The hash is of model, temperature, system and user.  Prompts that ``cache``
    (prompt_hash, answer) has aren't asked; equal ones are asked once.  Between
    attempts a task waits ``wait`` seconds, twice as long each time, three times
    after :class:`TryLater`; :class:`Refused` isn't tried again.  A task stops
    asking after ``failures`` failures in a row, or ``deadline`` seconds, and
    says so.  prompts: system, user.
    """

    def answer_of(system: str, user: str) -> tuple[str | None, str | None]:
        pause, error = wait, None
        for attempt in range(attempts):
            try:
                return client(system, user), None
            except Refused as e:
                return None, f"{type(e).__name__}: {e}"[:200]
            except Exception as e:
                error = f"{type(e).__name__}: {e}"[:200]
                if attempt + 1 < attempts:
                    time.sleep(pause)
                pause *= 3 if isinstance(e, TryLater) else 2
        return None, error

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        broken, began = 0, time.monotonic()
        for batch in batches:
            out = []
            for key, system, user in zip(batch["prompt_hash"], batch["system"], batch["user"], strict=True):
                if broken >= failures:
                    answer, error = None, "not asked: breaker open"
                elif deadline is not None and time.monotonic() - began > deadline:
                    answer, error = None, "not asked: deadline"
                else:
                    answer, error = answer_of(system, user)
                    broken = 0 if error is None else broken + 1
                out.append((key, answer, error))
            yield pd.DataFrame(out, columns=["prompt_hash", "answer", "error"])

    keyed = prompts.select(prompt_hash(model, temperature).alias("prompt_hash"), "system", "user").dropDuplicates(["prompt_hash"])
    if cache is None:
        return keyed.mapInPandas(ask, "prompt_hash string, answer string, error string").withColumn("cached", F.lit(False))
    known = keyed.select("prompt_hash").join(cache.select("prompt_hash", "answer"), "prompt_hash").select("prompt_hash", "answer", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    asked = keyed.join(cache, "prompt_hash", "left_anti").select("prompt_hash", "system", "user").mapInPandas(ask, "prompt_hash string, answer string, error string")
    return known.unionByName(asked.withColumn("cached", F.lit(False)))


def evaluated_or_heuristic(rows: DataFrame, answers: DataFrame, heuristic: Column) -> DataFrame:
    """``rows`` (prompt_hash, ..) with answer, source and verdict: the model's, or where it failed or wasn't asked ``heuristic`` (a struct)."""
    joined = rows.join(answers.select("prompt_hash", "answer", "error"), "prompt_hash", "left")
    failed = F.col("answer").isNull()
    return joined.withColumns({"source": F.when(failed, "heuristic").otherwise("llm"), "fallback": F.when(failed, heuristic)})
