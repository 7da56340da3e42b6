"""Text, chunk and ingestion queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.catalog.base import Catalog, Literal, documents, table
from attestra.functions import text as T
from attestra.operators import chunking, ingestion

C = Catalog()

NORMAL = r"""trim(regexp_replace(regexp_replace(replace(replace(lower(strip_accents({})), '’', ''''), '‘', ''''), '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g'), '\s+', ' ', 'g'))"""


@C.add("text_normalize", f"SELECT doc_id, {NORMAL.format('text')} AS norm FROM documents")
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "text").select("doc_id", T.normalize(F.col("text")).alias("norm"))


@C.add(
    "document_keys",
    r"""
WITH p AS (SELECT page_id, url, html, trim(regexp_replace(html, '\s+', ' ', 'g')) AS flat FROM pages),
s AS (SELECT *, left(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(url), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS raw,
  left(lower(regexp_extract(url, '(\.[A-Za-z0-9]+)$', 1)), 10) AS suffix FROM p)
SELECT page_id, CAST(greatest(1, len(html) // 4) AS INTEGER) AS tokens,
  CASE WHEN len(flat) > 90 THEN left(flat, 90) || '…' ELSE flat END AS preview,
  CASE WHEN raw = '' THEN 'org' ELSE raw END AS slug, sha256(html) AS digest,
  't1/' || left(sha256(html), 2) || '/' || sha256(html) || CASE WHEN suffix = '' THEN '.bin' ELSE suffix END AS storage_key,
  left(html, 1500) AS prompt_body
FROM s""",
)
def document_keys(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id",
        T.token_estimate(html).alias("tokens"),
        T.preview(html).alias("preview"),
        T.slug(F.col("url")).alias("slug"),
        F.sha2(html, 256).alias("digest"),
        T.content_key(F.lit("t1"), html, F.col("url")).alias("storage_key"),
        F.left(html, F.lit(1500)).alias("prompt_body"),
    )


@C.add(
    "chunk_fixed",
    """
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substring(text, i * 700 + 1, 700) AS chunk
FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(len(text) / 700.0) AS BIGINT) - 1)) AS i FROM documents WHERE len(text) > 0)""",
)
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_rows(table(spark, sf, "documents"), chunking.hard_split(F.col("text")))


_GREEDY = r"""
SELECT doc_id, list_reduce(list_transform(list_filter(list_transform(string_split(regexp_replace(trim(replace(text, chr(10), repeat(chr(10), 3)), W), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda p: trim(p, W)), lambda p: p <> ''), lambda p: [p]),
  lambda acc, x: CASE
    WHEN len(acc[-1]) + len(x[1]) + 2 <= 700 THEN list_append(list_slice(acc, 1, len(acc) - 1), CASE WHEN acc[-1] = '' THEN x[1] ELSE acc[-1] || chr(10) || chr(10) || x[1] END)
    WHEN acc[-1] <> '' THEN list_append(acc, right(acc[-1], 150) || chr(10) || chr(10) || x[1])
    ELSE list_append(list_concat(list_slice(acc, 1, len(acc) - 1), list_transform(generate_series(0, CAST(ceil(len(x[1]) / 700.0) AS BIGINT) - 1), lambda i: substring(x[1], i * 700 + 1, 700))), '') END,
  ['']) AS c FROM documents""".replace(", W)", ", ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")


@C.add(
    "chunk_greedy",
    f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, c[i] AS chunk
FROM (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS i FROM ({_GREEDY})) WHERE NOT (i = len(c) AND c[i] = '')""",
)
def chunk_greedy(spark: SparkSession, sf: str) -> DataFrame:
    # the tables' texts have single line ends: three of each make paragraphs of them
    return chunking.chunk_rows(documents(spark, sf, "doc_id", "text"), chunking.greedy_chunks(F.replace("text", F.lit("\n"), F.lit("\n\n\n"))))


@C.add(
    "chunk_stats",
    """
WITH c AS (SELECT source, greatest(1, len(substring(text, i * 700 + 1, 700)) // 4) AS t
  FROM (SELECT source, text, unnest(generate_series(0, CAST(ceil(len(text) / 700.0) AS BIGINT) - 1)) AS i FROM documents WHERE len(text) > 0))
SELECT count(*) AS n_passages, count(DISTINCT source) AS n_sections, min(t) AS min_tokens, CAST(sum(t) // count(*) AS BIGINT) AS avg_tokens, max(t) AS max_tokens FROM c""",
)
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Of slices, a document's source standing for their section; :func:`section_stats` has real ones."""
    chunks = table(spark, sf, "documents").select("source", F.explode(chunking.hard_split(F.col("text"))).alias("chunk"))
    return chunking.chunk_stats(chunks, section="source")


@C.add("section_stats")
def section_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_stats(section_passages(spark, sf), "text", "section")


@C.add("section_passages")
def section_passages(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.section_passages(documents(spark, sf, "doc_id", "text"))


@C.add(
    "offset_slices",
    """
SELECT doc_id, s AS start, substring(text, s + 1, 120) AS slice, len(substring(text, s + 1, 120)) AS n
FROM (SELECT doc_id, text, unnest([0, len(text) // 3, len(text) // 2]) AS s FROM documents)""",
)
def offset_slices(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    starts = F.array(F.lit(0), F.floor(n / 3), F.floor(n / 2))
    rows = table(spark, sf, "documents").select("doc_id", "text", F.explode(starts).alias("start"))
    cut = F.substring("text", (F.col("start") + 1).cast("int"), F.lit(120))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), cut.alias("slice"), F.length(cut).cast("long").alias("n"))


def _html_sql() -> str:
    x = "html"
    for tag in ("script", "style"):
        x = f"regexp_replace({x}, '(?is)<{tag}.*?</{tag}>', ' ', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '(?i)</(p|div|br|tr|h[1-6]|li)\s*>', chr(10), 'g'), '(?i)<br\s*/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]+>', '', 'g')"
    for entity, plain in T.ENTITIES.items():
        x = f"replace({x}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace({x}, '&#\d+;', ' ', 'g')"


@C.add(
    "html_lines",
    rf"""
SELECT page_id, CAST(i AS INTEGER) AS line_no, l[i] AS line FROM (
  SELECT page_id, l, unnest(generate_series(1, len(l))) AS i FROM (
    SELECT page_id, list_filter(list_transform(string_split({_html_sql()}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x{{00A0}}\r]+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages))""",
)
def html_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(T.html_lines(F.col("html"))).alias("i", "line"))
    return rows.select("page_id", (F.col("i") + 1).alias("line_no"), "line")


#: Documents read as regulations: every sixth line is an article's header (numbers come again), some others a chapter's.
_LINES_OF = """(SELECT CAST(doc_id AS VARCHAR) AS source, CAST(i AS INTEGER) AS line_no,
  CASE WHEN i % 24 = 2 THEN 'CHAPITRE II' WHEN i % 24 = 14 THEN 'Titre ' || (i // 24 + 1) WHEN i % 6 = 3 THEN CASE (i // 6) % 5 WHEN 0 THEN 'Article premier' WHEN 3 THEN 'ARTICLE 4 bis' ELSE ' article ' || ((i // 6) % 5 * 7) END ELSE l[i] END AS line
  FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))"""


def _regulations(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    i = F.col("i") + 1
    nth = F.floor(i / 6) % 5
    header = F.when(nth == 0, "Article premier").when(nth == 3, "ARTICLE 4 bis").otherwise(F.concat(F.lit(" article "), (nth * 7).cast("string")))
    line = F.when(i % 24 == 2, "CHAPITRE II").when(i % 24 == 14, F.concat(F.lit("Titre "), (F.floor(i / 24) + 1).cast("string"))).when(i % 6 == 3, header).otherwise(F.col("line"))
    return lines.select("source", i.alias("line_no"), line.alias("line"))


_PARSE = rf"""
WITH l AS (SELECT *, regexp_matches(line, '(?i)^\s*(CHAPITRE|TITRE)\s+([IVXLC]+|\d+)\s*$') AS chap,
    regexp_matches(line, '(?i)^\s*Article\s+(premier|\d+(\s*(bis|ter|quater))?)\s*$') AS head FROM {_LINES_OF}),
m AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER w AS art,
    last_value(CASE WHEN chap THEN upper(left(trim(line), 1)) || lower(regexp_extract(line, '(?i)(CHAPITRE|TITRE)', 1)[2:]) || ' ' || regexp_extract(line, '(?i)(CHAPITRE|TITRE)\s+([IVXLC]+|\d+)', 2) END IGNORE NULLS) OVER w AS chapter,
    lead(line) OVER (PARTITION BY source ORDER BY line_no) AS nxt, lead(head) OVER (PARTITION BY source ORDER BY line_no) AS nxt_head
  FROM l WINDOW w AS (PARTITION BY source ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
h AS (SELECT source, art, chapter, CASE WHEN lower(regexp_extract(line, '(?i)Article\s+(.*\S)', 1)) = 'premier' THEN 'Article 1' ELSE 'Article ' || regexp_extract(line, '(?i)Article\s+(.*\S)', 1) END AS reference,
    CASE WHEN nxt IS NULL OR nxt_head THEN NULL ELSE nxt END AS title FROM m WHERE head),
b AS (SELECT m.source, m.art, string_agg(line, chr(10) ORDER BY line_no) AS body FROM m JOIN h USING (source, art)
  WHERE NOT head AND NOT chap AND line <> coalesce(h.title, h.reference) GROUP BY ALL),
a AS (SELECT h.source, h.art, h.chapter, h.reference, coalesce(h.title, h.reference) AS title, coalesce(nullif(trim(b.body), ''), h.title, h.reference) AS body
  FROM h LEFT JOIN b USING (source, art)),
f AS (SELECT *, row_number() OVER (PARTITION BY source, reference ORDER BY art) AS nth FROM a)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY art) AS INTEGER) AS ordering, reference, left(title, 400) AS title, body, chapter FROM f WHERE nth = 1"""


@C.add("article_parse", _PARSE)
def article_parse(spark: SparkSession, sf: str) -> DataFrame:
    return ingestion.articles(_regulations(spark, sf)).select("source", "ordering", "reference", "title", "body", "chapter")


@C.add(
    "source_registry",
    f"""WITH p AS (SELECT CASE page_id % 7 WHEN 0 THEN 'rgpd' WHEN 1 THEN 'nis2' WHEN 2 THEN 'csrd' WHEN 3 THEN 'ai_act' WHEN 4 THEN 'dora' ELSE 'unknown' END AS code, count(*) AS n_pages FROM pages GROUP BY ALL)
SELECT code, n_pages, name, pillar, celex, authority, 'https://eur-lex.europa.eu/legal-content/FR/TXT/HTML/?uri=CELEX:' || celex AS url, version_label, CAST(effective_date AS VARCHAR) AS effective_date FROM p LEFT JOIN {ingestion.REGISTRY.sql()} USING (code)""",
)
def source_registry(spark: SparkSession, sf: str) -> DataFrame:
    """What is registered of the sources that landed pages name; pages stand for deliveries of five regulations and an unknown one."""
    codes = F.array(*map(F.lit, ("rgpd", "nis2", "csrd", "ai_act", "dora")))
    code = F.coalesce(F.get(codes, (F.col("page_id") % 7).cast("int")), F.lit("unknown"))
    return ingestion.registered(table(spark, sf, "pages"), code).withColumn("effective_date", F.col("effective_date").cast("string"))


#: Versions known so far (suppliers stand for regulations, most with an older version), and what a fetch brings.
_VERSIONS = """(SELECT CAST(s_suppkey AS VARCHAR) AS code, CASE WHEN s_suppkey % 4 = 0 THEN '2020/1-v2' ELSE '2020/1' END AS version_label, md5(s_name) AS digest, TRUE AS is_current FROM supplier WHERE s_suppkey % 5 <> 0
  UNION ALL SELECT CAST(s_suppkey AS VARCHAR), '2019/9', 'old', FALSE FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0)"""
_FETCHED = """(SELECT CAST(s_suppkey AS VARCHAR) AS code, CASE WHEN s_suppkey % 3 = 0 THEN '2019/9' ELSE '2020/1' END AS version_label, CASE WHEN s_suppkey % 2 = 0 THEN md5(s_name) ELSE md5(s_name || 'x') END AS digest, DATE '2024-03-01' AS fetched FROM supplier WHERE s_suppkey % 7 <> 0)"""


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    key, rows = F.col("s_suppkey"), table(spark, sf, "supplier")
    digest = F.md5(F.col("s_name").cast("binary"))
    current = rows.filter(key % 5 != 0).select(key.cast("string").alias("code"), F.when(key % 4 == 0, "2020/1-v2").otherwise("2020/1").alias("version_label"), digest.alias("digest"), F.lit(True).alias("is_current"))
    older = rows.filter((key % 5 != 0) & (key % 3 == 0)).select(key.cast("string").alias("code"), F.lit("2019/9").alias("version_label"), F.lit("old").alias("digest"), F.lit(False).alias("is_current"))
    changed = F.when(key % 2 == 0, digest).otherwise(F.md5(F.concat("s_name", F.lit("x")).cast("binary")))
    fetched = rows.filter(key % 7 != 0).select(key.cast("string").alias("code"), F.when(key % 3 == 0, "2019/9").otherwise("2020/1").alias("version_label"), changed.alias("digest"), F.lit("2024-03-01").cast("date").alias("fetched"))
    return current.unionByName(older), fetched


@C.add(
    "change_detect",
    f"""
WITH v AS {_VERSIONS}, f AS {_FETCHED}, cur AS (SELECT * FROM v WHERE is_current),
s AS (SELECT f.*, CASE WHEN cur.code IS NULL THEN 'created' WHEN cur.digest = f.digest THEN 'unchanged' ELSE 'updated' END AS status FROM f LEFT JOIN cur USING (code)),
l AS (SELECT s.*, version_label || ' (' || strftime(fetched, '%Y-%m-%d') || ')' AS dated FROM s WHERE status <> 'unchanged'),
n AS (SELECT code, CASE WHEN NOT EXISTS (SELECT 1 FROM v WHERE v.code = l.code AND v.version_label = l.version_label) THEN version_label ELSE dated END AS version_label, digest, TRUE AS is_current FROM l)
SELECT code, version_label, digest, is_current AND code NOT IN (SELECT code FROM n) AS is_current FROM v UNION ALL SELECT * FROM n""",
)
def change_detect(spark: SparkSession, sf: str) -> DataFrame:
    versions, fetched = _versions(spark, sf)
    return ingestion.next_versions(versions, ingestion.status(versions, fetched))


@C.add(
    "ingest_counts",
    f"""
WITH v AS {_VERSIONS}, f AS {_FETCHED}, cur AS (SELECT * FROM v WHERE is_current),
s AS (SELECT CASE WHEN cur.code IS NULL THEN 'created' WHEN cur.digest = f.digest THEN 'unchanged' ELSE 'updated' END AS status FROM f LEFT JOIN cur USING (code))
SELECT count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'unchanged') AS unchanged FROM s""",
)
def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("status")
    return ingestion.status(*_versions(spark, sf)).agg(*[F.count_if(s == x).alias(x) for x in ("created", "updated", "unchanged")])


@C.add(
    "dry_run_preview",
    f"""
WITH a AS ({_PARSE})
SELECT source, count(*) AS n_articles, CAST(sum(len(body)) AS BIGINT) AS text_length, sha256(string_agg(body, chr(10) ORDER BY ordering)) AS digest,
  list(reference ORDER BY ordering)[1:5] AS first_references FROM a GROUP BY source""",
)
def dry_run_preview(spark: SparkSession, sf: str) -> DataFrame:
    return ingestion.preview(article_parse(spark, sf))


@C.add(
    "ingest_all",
    rf"""
WITH a AS ({_PARSE}), w AS (SELECT source, count(*) AS n, sha256(string_agg(body, chr(10) ORDER BY ordering)) AS digest, count(*) FILTER (TRY_CAST(nullif(regexp_extract(reference, '(?i)Article\s+(\d+)', 1), '') AS INTEGER) BETWEEN 5 AND 49) AS auditable FROM a GROUP BY source),
s AS (SELECT *, CASE WHEN CAST(source AS BIGINT) % 3 = 0 THEN 'created' WHEN CAST(source AS BIGINT) % 3 = 1 THEN 'unchanged' ELSE 'updated' END AS status FROM w)
SELECT status, count(*) AS sources, CAST(sum(n) AS BIGINT) AS articles, CAST(sum(auditable) AS BIGINT) AS auditable FROM s GROUP BY status""",
)
def ingest_all(spark: SparkSession, sf: str) -> DataFrame:
    """Of the sources, every third is new, one in three known with the same text, the others with another one."""
    found = ingestion.articles(_regulations(spark, sf))
    key = F.col("source").cast("long")
    known = ingestion.preview(found).filter(key % 3 != 0).select(F.col("source").alias("code"), F.lit("1").alias("version_label"), F.when(key % 3 == 1, F.col("digest")).otherwise("other").alias("digest"), F.lit(True).alias("is_current"))
    return ingestion.ingest_all(found, known, F.lit("rgpd")).groupBy("status").agg(F.count("*").alias("sources"), F.sum("n_articles").alias("articles"), F.sum("auditable").alias("auditable"))


@C.add(
    "regulation_pages",
    """WITH p AS (SELECT page_id % 12 AS k, string_agg(html, chr(10) ORDER BY page_id) || chr(10) AS html FROM pages WHERE page_id % 12 <> 10 GROUP BY ALL), w AS (SELECT k, CASE WHEN k = 11 THEN left(html, 99) || chr(10) ELSE html END AS html FROM p)
SELECT 's' || k AS code, len(html) AS n_chars, sha256(html) AS sha256, 1 AS attempts, 0 AS failed FROM w WHERE len(html) >= 1000 UNION ALL SELECT 's' || k, NULL, NULL, 1, 1 FROM w WHERE len(html) < 1000 UNION ALL SELECT 's10', NULL, NULL, 1, 1""",
)
def regulation_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages landed as twelve sources, of which one is cut short and one is missing, read through the format."""
    from attestra.sources import regulation_source
    from attestra.sources.landing import shared_dir, uri

    key = F.col("page_id") % 12
    joined = table(spark, sf, "pages").filter(key != 10).groupBy(key.alias("k")).agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("p"))
    html = F.array_join(F.transform("p", lambda x: x["html"]), "\n")
    path = f"{shared_dir(spark)}/pages/{uuid.uuid4().hex}"
    joined.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("code"), F.when(F.col("k") == 11, F.left(html, F.lit(99))).otherwise(html).alias("value")).repartition("code").write.partitionBy("code").text(path)
    regulation_source.register(spark)
    found = spark.read.format("regulation").options(at=f"{uri(path)}/code={{code}}", codes=",".join(f"s{i}" for i in range(12)), least="1000").load()
    return found.select("code", F.length("html").cast("long").alias("n_chars"), F.sha2("html", 256).alias("sha256"), "attempts", F.when(F.col("problem").isNull(), 0).otherwise(1).alias("failed"))


@C.add(
    "json_tolerant",
    r"""
SELECT event_id, json_extract_string(TRY_CAST(props AS JSON), '$.page') AS page, TRY_CAST(props AS JSON) IS NOT NULL AS parsed FROM events""",
)
def json_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    fenced = F.concat(F.lit("Here is the answer:\n```json\n"), F.col("props"), F.lit("\n```"))
    parsed = T.json_object(fenced)
    return table(spark, sf, "events").select("event_id", F.try_variant_get(parsed, "$.page", "string").alias("page"), parsed.isNotNull().alias("parsed"))


@C.add(
    "prompt_excerpts",
    '''
SELECT conv_id, string_agg('[' || turn || ' · ' || role || ']' || chr(10) || left(text, 600), chr(10) || chr(10) ORDER BY turn) AS excerpts,
  string_split('Check """' || min(role) || '""" now', '"""')[2] AS body
FROM conversations GROUP BY conv_id''',
)
def prompt_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    piece = T.excerpt(F.col("turn").cast("string"), F.col("role"), F.left("text", F.lit(600)))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", piece.alias("piece"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("p"), F.min("role").alias("r"))
    body = T.quoted_body(F.concat(F.lit('Check """'), F.col("r"), F.lit('""" now')))
    return grouped.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n").alias("excerpts"), body.alias("body"))


@C.add(
    "escape_and_redact",
    r"""
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped,
  trim(regexp_replace('Subject' || chr(13) || chr(10) || url, '[\r\n]+', ' ', 'g')) AS header,
  'access_token=[REDACTED],current_password=[REDACTED],new_password=[REDACTED],page=' || url || ',password=[REDACTED],passwords=' || url || ',refresh_token=' || url || ',token=[REDACTED]' AS payload,
  CASE page_id % 9 WHEN 0 THEN '10.0.0.1' WHEN 1 THEN '2001:db8::1' WHEN 2 THEN '::ffff:1.2.3.4' WHEN 3 THEN '::' WHEN 4 THEN '1:2:3:4:5:6:7:8' END AS ip
FROM pages""",
)
def escape_and_redact(spark: SparkSession, sf: str) -> DataFrame:
    """The payload has all secret keys and two that only look like it; of the addresses five are right and four aren't."""
    keys = ("access_token", "current_password", "new_password", "page", "password", "passwords", "refresh_token", "token")
    payload = T.redact(F.create_map(*[x for k in keys for x in (F.lit(k), F.col("url"))]))
    hops = ("10.0.0.1, 10.9.9.9", "2001:db8::1", " ::ffff:1.2.3.4", "::", "1:2:3:4:5:6:7:8", "300.1.1.1", "1:2:3:4:5:6:7:8:9", "1::2::3", "::ffff:1.2.3.256")
    raw = F.get(F.array(*map(F.lit, hops)), (F.col("page_id") % 9).cast("int"))
    return table(spark, sf, "pages").select(
        "page_id", T.html_escape(F.col("html")).alias("escaped"), T.header_safe(F.concat(F.lit("Subject\r\n"), "url")).alias("header"),
        F.array_join(F.transform(F.map_entries(payload), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("payload"), T.valid_ip(raw).alias("ip"),
    )


@C.add("hash_embedding")
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    from attestra.functions.vectors import hashing_embedder

    return table(spark, sf, "documents").select("doc_id", hashing_embedder()(F.col("text")).alias("embedding"))
