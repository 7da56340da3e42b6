"""What is read from files and written to them, asked of a client, and kept apart by tenant; files are made from the tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.catalog.audit import _LEXICAL, GRID
from attestra.catalog.base import Catalog, documents, table
from attestra.functions import text as T
from attestra.operators import prompts, retrieval, term_index, vector_index, verification
from attestra.operators.tenancy import TenantScope
from attestra.plans import document_audit as plan
from attestra.sources import readers, sinks
from attestra.sources.landing import shared_dir

C = Catalog()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/landed/{uuid.uuid4().hex}/{name}"


@C.add(
    "partitions_replaced",
    """SELECT o_orderpriority AS part, count(*) AS n, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%' THEN o_orderkey + 1 ELSE o_orderkey END) AS BIGINT) AS keys
FROM orders WHERE NOT (o_orderpriority LIKE '1%' AND o_orderkey % 2 = 0) GROUP BY ALL""",
)
def partitions_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by priority, of which two priorities are written again: one with half its rows."""
    path, rows = _folder(spark, "orders"), table(spark, sf, "orders").select(F.col("o_orderpriority").alias("part"), F.col("o_orderkey").alias("key"))
    sinks.replace_partitions(rows, path, "part")
    again = rows.filter((F.startswith("part", F.lit("1")) & (F.col("key") % 2 != 0)) | F.startswith("part", F.lit("3")))
    sinks.replace_partitions(again.withColumn("key", F.col("key") + 1), path, "part")
    return spark.read.parquet(path).groupBy("part").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


_FILES = "SELECT sha256(string_agg(text, chr(10) ORDER BY doc_id, text) || chr(10)) AS sha256, CAST(sum(len(text)) + count(*) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL GROUP BY doc_id // 64"


def _texts(spark: SparkSession, sf: str) -> str:
    """Text files of 64 documents each."""
    path = _folder(spark, "texts")
    rows = documents(spark, sf, "doc_id", "text").filter("text is not null").groupBy(F.floor(F.col("doc_id") / 64).alias("file")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    rows.select("file", F.array_join(F.transform("d", lambda x: x["text"]), "\n").alias("value")).write.partitionBy("file").text(path)
    return path


def _told(rows: DataFrame) -> DataFrame:
    return rows.select(F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n"))


@C.add("texts_read", _FILES)
def texts_read(spark: SparkSession, sf: str) -> DataFrame:
    """Text files read whole."""
    return _told(readers.texts(spark, _texts(spark, sf)))


@C.add("blobs_read", _FILES)
def blobs_read(spark: SparkSession, sf: str) -> DataFrame:
    """The same files as blobs, whose text is taken out of their bytes."""
    return _told(readers.extract_text(readers.blobs(spark, _texts(spark, sf))).filter("problem is null"))


#: Labels stand for annotated verdicts: a document is one in fifty labels, an article the number within it.
_CASES = "(SELECT doc_id, CAST(doc_id // 50 AS VARCHAR) AS document, CAST(doc_id % 50 AS VARCHAR) AS article, CASE WHEN toxic = 1 THEN 'manquement' WHEN quality = 1 THEN 'conforme' WHEN doc_id % 2 = 0 THEN 'hors_perimetre' ELSE 'tolere' END AS verdict FROM labels)"
_NAMES = "CASE verdict WHEN 'manquement' THEN 'breach' WHEN 'conforme' THEN 'compliant' WHEN 'hors_perimetre' THEN 'out_of_scope' ELSE 'tolerated' END"


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    verdict = F.when(F.col("toxic") == 1, "manquement").when(F.col("quality") == 1, "conforme").when(key % 2 == 0, "hors_perimetre").otherwise("tolere")
    return table(spark, sf, "labels").select(F.floor(key / 50).cast("string").alias("document"), (key % 50).cast("string").alias("article"), verdict.alias("verdict"))


def _json(spark: SparkSession, rows: DataFrame, document: Column, key: str) -> str:
    """JSON files made of ``rows`` (annotated documents), twenty documents a file."""
    path = _folder(spark, "json")
    files = rows.groupBy(F.floor(F.regexp_extract(key, r"(\d+)$", 1).cast("long") / 20).alias("file")).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("all"))
    files.select("file", F.to_json(document).alias("value")).repartition("file").write.partitionBy("file").text(path)
    return path


@C.add("truth_read", f"SELECT document, CAST(doc_id // 50 AS DOUBLE) AS low, 90.0::DOUBLE AS high, article, {_NAMES} AS expected, CAST(article AS INTEGER) % 3 = 0 AS never_exclude FROM {_CASES}")
def truth_read(spark: SparkSession, sf: str) -> DataFrame:
    cases = _cases(spark, sf).groupBy("document").agg(F.map_from_entries(F.collect_list(F.struct("article", "verdict"))).alias("verdicts_attendus"))
    never = F.filter(F.map_keys("verdicts_attendus"), lambda a: a.cast("int") % 3 == 0)
    rows = cases.select(F.col("document").alias("fichier"), F.array(F.col("document").cast("double"), F.lit(90.0)).alias("score_attendu"), F.map_entries("verdicts_attendus").alias("v"), never.alias("jamais_exclure"))
    shaped = F.transform("all", lambda c: F.struct(c["fichier"].alias("fichier"), c["score_attendu"].alias("score_attendu"), F.map_from_entries(c["v"]).alias("verdicts_attendus"), c["jamais_exclure"].alias("jamais_exclure")))
    return readers.ground_truth(spark, _json(spark, rows, F.struct(shaped.alias("cas")), "fichier"))


@C.add("annotations_read", f"SELECT document, 10 AS low, 90 AS high, article, {_NAMES} AS expected, verdict = 'tolere' AS tolerated FROM {_CASES}")
def annotations_read(spark: SparkSession, sf: str) -> DataFrame:
    """A key with an underscore in front is a note, and no document."""
    cases = _cases(spark, sf).groupBy("document").agg(F.collect_list(F.struct("article", "verdict")).alias("v"))
    note = cases.filter("document % 40 = 0").select(F.concat(F.lit("_note"), "document").alias("document"), "v")
    entry = lambda c: F.struct(c["document"].alias("key"), F.struct(F.lit("p").alias("profil"), F.array(F.lit(10), F.lit(90)).alias("score_attendu"), F.map_from_entries(F.transform(c["v"], lambda x: F.struct(x["article"], F.struct(x["verdict"].alias("verdict"), F.lit("m").alias("motif"))))).alias("articles")).alias("value"))
    return readers.annotations(spark, _json(spark, cases.unionByName(note), F.map_from_entries(F.transform("all", entry)), "document"))


@C.add("report_read", f"SELECT document, article, verdict, 'because ' || article AS justification FROM {_CASES} WHERE article IN ('1', '2', '3', '5', '8')")
def report_read(spark: SparkSession, sf: str) -> DataFrame:
    """A written report, of which five articles are wanted."""
    cases = _cases(spark, sf).groupBy(F.col("document").alias("fichier")).agg(F.array_sort(F.collect_list(F.struct("article", "verdict", F.concat(F.lit("because "), "article").alias("justification")))).alias("verdicts"))
    return readers.report_verdicts(spark, _json(spark, cases, F.struct(F.col("all").alias("documents")), "fichier"), ["1", "2", "3", "5", "8"])


@C.add("json_reports", f"SELECT document, count(*) AS n, min(article) AS first_article, min_by(verdict, article) AS first_verdict, (SELECT count(*) FROM labels) AS total FROM {_CASES} GROUP BY document")
def json_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of all documents as JSON, read back from what was written."""
    rows, path = _cases(spark, sf), _folder(spark, "reports")
    sinks.json_report(rows.agg(F.count("*").alias("total")), rows).select(F.col("report").alias("value")).write.text(path)
    back = spark.read.schema("document string, metrics struct<total:long>, verdicts array<struct<article:string,verdict:string>>").json(path)
    first = F.get("verdicts", 0)
    return back.select("document", F.size("verdicts").cast("long").alias("n"), first["article"].alias("first_article"), first["verdict"].alias("first_verdict"), F.col("metrics.total").alias("total"))


@C.add("answers_latest", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def answers_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("position"), "event_id", "value")
    return verification.latest_answers(rows, ["user_id", "event_type"])


@C.add("json_values", "SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN len(props) > 0 ELSE TRUE END AS parsed, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id + 1 WHEN 2 THEN NULL END AS n FROM events")
def json_values(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that are an object, an array in a fence, what a page says about the event in prose, and nothing of the kind."""
    key = F.col("event_id")
    n = F.concat(F.lit('{"n": '), key.cast("string"), F.lit("}"))
    more = F.concat(F.lit('```json\n[{"n": '), (key + 1).cast("string"), F.lit("}]\n```"))
    answer = F.when(key % 4 == 0, n).when(key % 4 == 1, more).when(key % 4 == 2, F.concat(F.lit("It is "), "props", F.lit(" I think"))).otherwise("neither {nor")
    value = T.json_value(answer)
    got = F.when(key % 4 == 0, F.try_variant_get(value, "$.n", "bigint")).when(key % 4 == 1, F.try_variant_get(value, "$[0].n", "bigint"))
    return table(spark, sf, "events").select("event_id", F.when(value.isNotNull(), True).alias("parsed"), got.alias("n"))


def _excerpts(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("passage_id"), F.col("role").alias("section"), "text")
    return prompts.excerpts(turns, ["doc_id"])


_ASKED = f"""x AS (SELECT conv_id AS doc_id, string_agg('[p' || turn || ' · ' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS shown FROM conversations GROUP BY conv_id),
p AS (SELECT doc_id, requirement, 'Article ' || requirement || chr(10) || 'Condition: ' || query || chr(10) || chr(10) || 'Document:' || chr(10) || '\"\"\"' || shown || '\"\"\"' AS prompt FROM x CROSS JOIN {GRID.sql()})"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations stand for documents, the small grid for articles with a condition."""
    grid = GRID.df(spark).select(F.col("requirement").alias("article"), F.lit(None).cast("string").alias("title"), F.col("query").alias("condition"), F.lit(None).cast("string").alias("note"), F.array().cast("array<struct<element:string,title:string,hints:array<string>,blocking:boolean>>").alias("elements"), F.array().cast("array<struct<reference:string,title:string,condition:string,effect:string,ex_ante:boolean>>").alias("exemptions"))
    return prompts.prompts(_excerpts(spark, sf), grid, ("applicability",))


@C.add("prompts_made", f"WITH {_ASKED} SELECT doc_id, requirement AS article, 'applicability' AS kind, md5(prompt) AS prompt FROM p")
def prompts_made(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).select("doc_id", "article", "kind", F.md5(F.col("user").cast("binary")).alias("prompt"))


def _client(system: str, user: str) -> str:
    """Answers with the length of the question, refuses every seventh length and fails for every fifth."""
    if len(user) % 7 == 0:
        raise readers.Refused("not this one")
    if len(user) % 5 == 0:
        raise ValueError("nothing to say")
    return f'{{"length": {len(user)}}}'


_SAID = f"{_ASKED}, q AS (SELECT *, len(prompt) AS n, len(prompt) % 11 = 0 AS cached FROM p)"


@C.add(
    "model_answers",
    f"""WITH {_SAID} SELECT doc_id, requirement AS article, CASE WHEN cached THEN -1 WHEN n % 7 <> 0 AND n % 5 <> 0 THEN n END AS answer, CASE WHEN NOT cached AND (n % 7 = 0 OR n % 5 = 0) THEN 'heuristic' ELSE 'llm' END AS source,
  CASE WHEN NOT cached AND n % 7 = 0 THEN 'Refused: not this one' WHEN NOT cached AND n % 5 = 0 THEN 'ValueError: nothing to say' END AS error FROM q""",
)
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    """A client that refuses and fails, asked what a cache doesn't know, with a heuristic where it gave nothing."""
    rows = _asked(spark, sf).withColumn("prompt_hash", readers.prompt_hash("m"))
    cache = rows.filter(F.length("user") % 11 == 0).select("prompt_hash", F.lit('{"length": -1}').alias("answer")).distinct()
    told = readers.evaluate(rows.select("system", "user"), _client, model="m", attempts=2, failures=10**9, cache=cache)
    joined = readers.evaluated_or_heuristic(rows.select("doc_id", "article", "prompt_hash"), told, F.struct(F.lit("no").alias("outcome")))
    length = F.try_variant_get(T.json_object(F.col("answer")), "$.length", "bigint")
    return joined.select("doc_id", "article", length.alias("answer"), "source", "error")


@C.add("tenant_writes", "SELECT coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END, 7) AS tenant_id, count(*) AS n, (SELECT count(*) FROM orders WHERE o_custkey <> 7) AS others FROM orders WHERE o_custkey = 7 GROUP BY ALL")
def tenant_writes(spark: SparkSession, sf: str) -> DataFrame:
    """A tenant's rows, some without its number, added to a table; and how many rows are foreign to it."""
    scope, path = TenantScope(7), _folder(spark, "tenant")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("tenant_id"), F.col("o_orderkey").alias("key"))
    own = scope.read(orders)
    scope.append(own.withColumn("tenant_id", F.when(F.col("key") % 4 != 0, F.col("tenant_id"))), path)
    others = scope.foreign(orders).agg(F.count("*").alias("others"))
    return spark.read.schema(own.schema).parquet(path).groupBy("tenant_id").agg(F.count("*").alias("n")).crossJoin(others)  # one row


_VECTORS = "v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e, label FROM embeddings)"
_DIST = "round(1 - list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 6)"
_NEAR = f"""{_VECTORS}, p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_DIST} AS distance FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 AND q.e IS NOT NULL AND c.e IS NOT NULL),
n AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM p)"""


def _with_nulls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("vector"))
    return rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "id")


@C.add("knn_with_fallback", f"WITH {_NEAR}, f AS (SELECT vec_id AS query_id, CAST(1 AS INTEGER) AS rank, CAST(-1 AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS distance FROM embeddings WHERE vec_id % 20 = 0) SELECT * FROM n WHERE rank <= 3 UNION ALL SELECT * FROM f WHERE query_id NOT IN (SELECT query_id FROM n)")
def knn_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours where every seventh vector is missing: it is nobody's neighbour, and as a query gets the fallback."""
    queries, candidates = _with_nulls(spark, sf)
    fallback = queries.select("query_id", F.lit(1).alias("rank"), F.lit(-1).cast("long").alias("id"), F.lit(None).cast("double").alias("distance"))
    return retrieval.with_fallback(retrieval.nearest(queries, candidates, 3), fallback)


_H = "h AS (SELECT vec_id, e[1:16] AS e FROM v)"
_WIDE = f"""{_VECTORS}, {_H}, p1 AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_DIST} AS d FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 AND q.e IS NOT NULL AND c.e IS NOT NULL),
p2 AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_DIST} AS d FROM h q JOIN h c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 AND q.e IS NOT NULL AND c.e IS NOT NULL),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rk FROM p1 QUALIFY rk <= 16 UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rk FROM p2 QUALIFY rk <= 16),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rk)), 6) AS score FROM r GROUP BY ALL)"""


@C.add("rrf_widened", f"WITH {_WIDE} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 8")
def rrf_widened(spark: SparkSession, sf: str) -> DataFrame:
    """Eight of two rankings, each of which gives twice as many."""
    queries, candidates = _with_nulls(spark, sf)
    short = lambda df: df.withColumn("vector", F.slice("vector", 1, 16))
    wide = [retrieval.nearest(q, c, 16).filter(F.col("rank") <= retrieval.widened(F.lit(8))) for q, c in ((queries, candidates), (short(queries), short(candidates)))]
    return retrieval.fuse(wide, 8)


@C.add("context_passages", "WITH c AS (SELECT doc_id, CAST(i AS INTEGER) AS position, source FROM (SELECT doc_id, source, unnest(generate_series(0, CAST(ceil(len(text) / 700.0) AS BIGINT) - 1)) AS i FROM documents WHERE len(text) > 0)) SELECT doc_id, position, 1 AS part, source FROM c WHERE position % 2 = 0 UNION ALL SELECT doc_id, position, 2, source FROM c WHERE position % 3 = 0 AND position % 2 <> 0")
def context_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of a first question, then those that only a second one finds, each with its document's source."""
    from attestra.operators import chunking

    chunks = chunking.chunk_rows(documents(spark, sf, "doc_id", "text").filter("length(text) > 0"), chunking.hard_split(F.col("text"))).select("doc_id", F.col("chunk_index").alias("position"))
    found = retrieval.context(chunks.filter("position % 2 = 0"), chunks.filter("position % 3 = 0"))
    return found.join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")


@C.add(
    "knn_tenant_index",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(1 - list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 6) AS distance FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.label = c.label WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM p QUALIFY rank <= 3""",
)
def knn_tenant_index(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours within a label from an index on disk."""
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("tenant"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = vector_index.build(rows, _folder(spark, "index"), 64)
    return vector_index.search(index, rows.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 3)[0]


@C.add("lexical_indexed", f"WITH {_LEXICAL} SELECT doc_id, requirement, CAST(rank AS INTEGER) AS rank, CAST(position AS INTEGER) AS position, score FROM t WHERE rank <= greatest(5, least(12, 3 + elements)) AND (score > 0 OR best <= 0)")
def lexical_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of lexical_topk from an index of grams."""
    bodies = plan.documents(documents(spark, sf, "doc_id", "text")).select("doc_id", F.posexplode("bodies").alias("position", "body"))
    index = term_index.build(bodies, _folder(spark, "terms"))
    return term_index.search(index, GRID.df(spark), retrieval.evidence_k(F.col("elements")))[0].select("doc_id", "requirement", "rank", "position", "score")
