"""The registered queries of this subpackage and the SQL that some can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import chat, decontaminate, divergence, jaccard, langid, lmscore, mixing, periodic, pii, substring, suffixes, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = langid.is_training(5)
    found = langid.identify(docs.select("doc_id", "text"), langid.dictionaries(docs, training))
    return found.select("doc_id", (~training).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join(table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.domain_of_source(F.col("source")), mixing.SHARE, mixing.MAX_EPOCHS, mixing.WEIGHTS, mixing.SEED).drop("_t")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, training = table(spark, sf_dir, "documents"), langid.is_training(5)
    model = toxicity.fit(toxicity.sampled(docs, table(spark, sf_dir, "labels"), training))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", (~training).alias("held_out"), "score", "predicted")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digest(periodic.find(periodic.planted(docs)))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_chat_format": op3_chat_format,
    "op4_pii": op4_pii,
    "op5_decontaminate": op5_decontaminate,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_mix_sources": op7_mix_sources,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_id": op9_language_id,
    "op10_topk_search": op10_topk_search,
    "op11_toxicity": op11_toxicity,
    "op12_source_divergence": op12_source_divergence,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS win FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
), c AS (
  SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS pos FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS n FROM p) WHERE n > 1
), t AS (
  SELECT r, pos, w[pos] AS word FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS pos FROM d)
), k AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM t ANTI JOIN c USING (r, pos) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
""",
    "op8_suffix_dedup": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS win FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 100)) AS i FROM d WHERE len(h) >= 200)
), l AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(win) ORDER BY doc_id, i) AS n FROM p) WHERE n > 1
), g AS (
  SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM l
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM g) GROUP BY doc_id, span
), x AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1 AS last FROM s
), k AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS spans, string_agg(substring(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || any_value(CASE WHEN last THEN substring(h, 2 * b + 1) END) AS kept
  FROM x JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
""",
    "op6_ngram_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)
), c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other
), k AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM k LEFT JOIN c USING (doc_id)
""",
    "op7_mix_sources": """
WITH r AS (
  SELECT doc_id, coalesce(CASE CAST(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS INTEGER) % 4
           WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forums' WHEN 3 THEN 'news' END, '(none)') AS domain,
         coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
         md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o
  FROM documents
), leaf AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 2 AS DOUBLE) AS cap FROM r GROUP BY ALL
), n1 AS (
  SELECT domain, sum(cap) AS c, CAST(CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'forums' THEN 2 ELSE 1 END AS DOUBLE) AS w,
         floor((SELECT sum(tokens) FROM leaf) * CAST(0.6 AS DOUBLE)) AS g FROM leaf GROUP BY domain
), m1 AS (
  SELECT *, sum(w) OVER () AS aw, coalesce(sum(c) OVER b, 0) AS bc, coalesce(sum(w) OVER b, 0) AS bw
  FROM n1 WINDOW b AS (ORDER BY c / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f1 AS (SELECT *, c * (aw - bw) <= (g - bc) * w AS full_ FROM m1),
a1 AS (
  SELECT domain, CASE WHEN full_ THEN c ELSE floor((g - sum(CASE WHEN full_ THEN c ELSE 0 END) OVER ()) * w / (aw - sum(CASE WHEN full_ THEN w ELSE 0 END) OVER ())) END AS g FROM f1
), n2 AS (
  SELECT domain, lang, sum(cap) AS c, CAST(CASE lang WHEN 'en' THEN 6 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END AS DOUBLE) AS w, any_value(g) AS g
  FROM leaf JOIN a1 USING (domain) GROUP BY domain, lang
), m2 AS (
  SELECT *, sum(w) OVER p AS aw, coalesce(sum(c) OVER b, 0) AS bc, coalesce(sum(w) OVER b, 0) AS bw
  FROM n2 WINDOW p AS (PARTITION BY domain), b AS (PARTITION BY domain ORDER BY c / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f2 AS (SELECT *, c * (aw - bw) <= (g - bc) * w AS full_ FROM m2),
a2 AS (
  SELECT domain, lang, CASE WHEN full_ THEN c ELSE floor((g - sum(CASE WHEN full_ THEN c ELSE 0 END) OVER p) * w / (aw - sum(CASE WHEN full_ THEN w ELSE 0 END) OVER p)) END AS g
  FROM f2 WINDOW p AS (PARTITION BY domain)
), n3 AS (
  SELECT domain, lang, source, cap AS c, CAST(CASE source WHEN 'src0' THEN 3 ELSE 1 END AS DOUBLE) AS w, g FROM leaf JOIN a2 USING (domain, lang)
), m3 AS (
  SELECT *, sum(w) OVER p AS aw, coalesce(sum(c) OVER b, 0) AS bc, coalesce(sum(w) OVER b, 0) AS bw
  FROM n3 WINDOW p AS (PARTITION BY domain, lang), b AS (PARTITION BY domain, lang ORDER BY c / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f3 AS (SELECT *, c * (aw - bw) <= (g - bc) * w AS full_ FROM m3),
a3 AS (
  SELECT domain, lang, source, CAST(CASE WHEN full_ THEN c ELSE floor((g - sum(CASE WHEN full_ THEN c ELSE 0 END) OVER p) * w / (aw - sum(CASE WHEN full_ THEN w ELSE 0 END) OVER p)) END AS BIGINT) AS budget
  FROM f3 WINDOW p AS (PARTITION BY domain, lang)
), q AS (
  SELECT domain, lang, source, tokens, budget, CASE WHEN tokens > 0 THEN least(budget // tokens, 2) ELSE 0 END AS whole_ FROM leaf JOIN a3 USING (domain, lang, source)
), s AS (
  SELECT r.*, whole_, budget - whole_ * tokens AS rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
  FROM r JOIN q USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(CASE WHEN n_tokens = 0 THEN 0 ELSE whole_ + CASE WHEN e <= rest THEN 1 ELSE 0 END END AS BIGINT) AS copies FROM s
""",
    "op3_chat_format": """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id
), e AS (
  SELECT turns, n, min(conv_id) AS conv_id, count(*) AS n_equal FROM c GROUP BY turns, n
), k AS (
  SELECT * FROM e WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.n > e.n AND c.turns[1] = e.turns[1] AND list_slice(c.turns, 1, e.n) = e.turns)
), l AS (
  SELECT k.conv_id, k.n AS n_turns, k.n_equal, t.pos, CAST((t.pos - 1) // 512 AS INTEGER) AS part,
         '<|' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS line
  FROM k JOIN t USING (conv_id)
)
SELECT conv_id, n_turns, n_equal, part, CAST(ceil(n_turns / 512) AS INTEGER) AS n_parts, string_agg(line, '' ORDER BY pos) AS text
FROM l GROUP BY conv_id, n_turns, n_equal, part
""",
    "op5_decontaminate": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, s, s + least(13, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)
), p AS (
  SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n
), h AS (
  SELECT p.r, p.s, p.n, iw.item_id FROM p JOIN iw ON iw.n = p.n AND list_slice(p.w, p.s, p.s + p.n - 1) = iw.win
), c AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS pos FROM h) GROUP BY r
), t AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
""",
    "op10_topk_search": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), k AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN k USING (lang, term) GROUP BY ALL
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * CAST(coalesce(c.n, 0) + 1 AS HUGEINT) // CAST(g.total + v.v AS HUGEINT) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), l AS (
  SELECT lang, term, 1 + 1000000000 * CAST(sum(n) + 1 AS HUGEINT) // CAST(sum(sum(n)) OVER (PARTITION BY lang) + any_value(v) AS HUGEINT) AS q
  FROM c JOIN v USING (lang) GROUP BY lang, term
), a AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN p a ON a.lang = x.lang AND a.source = x.source LEFT JOIN p b ON b.lang = y.lang AND b.source = y.source AND b.term = a.term
  WHERE a.term IS NULL OR b.term IS NOT NULL GROUP BY ALL
), t AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p > q
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (FROM a UNION ALL FROM t)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= 200
""",
    "op13_periodic_runs": r"""
WITH b AS (
  SELECT r, doc_id, CAST(doc_id AS VARCHAR) AS s, w FROM (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), h AS (
  SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(generate_series(1, len(s)), lambda i: CAST(ascii(s[i]) AS BIGINT))),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)))) AS h
  FROM b
), e AS (
  SELECT *, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM h
), d AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(generate_series(0, n - 1), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM e
), t AS (
  SELECT r, n, i, word FROM (SELECT r, n, unnest(generate_series(0, n - 1)) AS i, unnest(w) AS word FROM d WHERE n > 0)
), m AS (
  SELECT x.r, x.i - y.i AS q, x.i FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n
), s AS (
  SELECT r, q, min(i) - q AS a, max(i) + 1 AS z FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM m) GROUP BY r, q, k
  HAVING max(i) + 1 - min(i) + q >= greatest(6, 4 * q)
), u AS (
  SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.r = s.r AND o.q < s.q AND o.a <= s.a AND o.z >= s.z)
), f AS (
  SELECT r, count(*) AS n_runs, string_agg(a || ',' || (z - a) || ',' || q || chr(10), '' ORDER BY a, q) AS lines,
         first({'start': a, 'length': z - a, 'period': q} ORDER BY z - a DESC, a, q) AS best
  FROM u GROUP BY r
), c AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM t
  ANTI JOIN (SELECT DISTINCT r, unnest(generate_series(a + q, z - 1)) AS i FROM u) USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
       CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN f USING (r) LEFT JOIN c USING (r)
""",
}
