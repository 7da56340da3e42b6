"""The audit of the grid's 18 articles over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.catalog.audit import INVENTED
from attestra.catalog.base import Catalog, documents
from attestra.catalog.text import NORMAL
from attestra.functions import text as T
from attestra.operators import grid
from attestra.plans import article_audit as plan

C = Catalog()

#: Words that the grid's texts are made of, and how many an element has.
WORDS, EACH = 600, 8
_N_ELEMENTS = len(grid.ELEMENT_ROWS.rows)


def known(spark: SparkSession, sf: str) -> DataFrame:
    """The grid with texts made of the documents' most common long words: eight an element, two a title, two a condition."""
    # long words are cut out at once: neither all words nor a test of each
    long = F.regexp_extract_all(T.normalize(F.col("text")), F.lit("(?<![^ ])[a-z]{6,}+(?![^ ])"), F.lit(0))
    words = documents(spark, sf, "doc_id", "text").filter("length(text) > 0").select(F.explode(F.array_distinct(long)).alias("w"))
    common = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(WORDS)
    words = common.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "w"))), lambda x: x["w"]).alias("words"))
    piece = lambda start, size: F.array_join(F.slice("words", start + 1, F.lit(size)), " ")
    numbered = grid.ELEMENT_ROWS.df(spark).join(grid.ARTICLES.df(spark).select("article", "ordering"), "article").crossJoin(words)
    order = {article: ordering for ordering, article, *_ in grid.ARTICLES.rows}
    before = {article: sum(order[r[0]] < order[article] for r in grid.ELEMENT_ROWS.rows) for article in order}
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    e = (F.element_at(offset, F.col("article")) + F.col("position")) * EACH
    elements = numbered.select("article", "element", piece(e, 4).alias("title"), F.array(piece(e + 4, 2), piece(e + 6, 2)).alias("hints"))
    a = _N_ELEMENTS * EACH + 2 * (F.col("ordering") - 1)
    articles = grid.ARTICLES.df(spark).crossJoin(words).select("article", piece(a, 2).alias("title"), piece(a + 36, 2).alias("condition"), F.lit(None).cast("string").alias("note"))
    return grid.described(grid.grid(spark), articles, elements)


def scripted(run: Column | None = None) -> plan.Ask:
    """A client whose answers about scope and exemptions follow from the document's and the article's number; evidence is the offline client's, in later passes withdrawn from every seventh document."""
    text = F.col("text")
    quote = F.substring(text, 11, 60)

    def ask(question: str, rows: DataFrame, wanted: Column) -> DataFrame:
        k = (F.col("doc_id") + F.col("ordering")) % 11
        if question == "applicability":
            said = F.struct((k == 4).alias("failed"), F.when(k == 3, True).alias("condition_met"), F.when(k > 3, True).otherwise(False).alias("applicable_said"), F.when(k == 0, quote).when(k == 1, INVENTED).alias("quote"))
            return rows.withColumn(question, said)
        if question == "exemption":
            d, article = F.col("doc_id") % 4, F.col("article")
            first = F.when(article == "9", "9(2)(a)").when(article == "14", "14(5)(b)").when(article == "30", "30(5)").otherwise("34(3)(a)")
            said = F.struct(F.when(d == 1, F.concat(article, F.lit("(2)(z)"))).when(d != 3, first).alias("reference"), F.when(d != 2, quote).alias("quote"))
            return rows.withColumn(question, F.when(wanted, said))
        answered = plan.offline(question, rows, wanted)
        if run is None:
            return answered
        withdrawn = (run > 1) & ((F.col("doc_id") + run) % 7 == 0)
        return answered.withColumn(question, F.when(withdrawn, F.transform(question, lambda e: F.struct(e["element"].alias("element"), F.lit(False).alias("claimed"), e["quotes"].alias("quotes")))).otherwise(F.col(question)))

    return ask


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    return plan.audit(plan.slices(documents(spark, sf, "doc_id", "text")), known(spark, sf), scripted())


def _in(c: str) -> str:
    return NORMAL.format(c)


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: len(s) >= 40)"
_AUDIT = rf"""
n AS (SELECT doc_id, text, {_in('text')} AS dn FROM documents WHERE len(text) > 0),
v AS (SELECT list(w ORDER BY c DESC, w) AS l FROM (SELECT w, count(*) AS c FROM (SELECT unnest(list_distinct(string_split(dn, ' '))) AS w FROM n) WHERE regexp_full_match(w, '[a-z]{{6,}}') GROUP BY w ORDER BY c DESC, w LIMIT {WORDS})),
el AS (SELECT article, ordering, element, blocking, position, array_to_string(l[e * {EACH} + 1:e * {EACH} + 4], ' ') AS title, array_to_string(l[e * {EACH} + 5:e * {EACH} + 8], ' ') AS hints
  FROM (SELECT x.*, ordering, row_number() OVER (ORDER BY ordering, position) - 1 AS e FROM {grid.ELEMENT_ROWS.sql()} x JOIN {grid.ARTICLES.sql()} USING (article)), v),
ar AS (SELECT a.*, array_to_string(l[{_N_ELEMENTS * EACH} + 2 * ordering - 1:{_N_ELEMENTS * EACH} + 2 * ordering], ' ') AS title, array_to_string(l[{_N_ELEMENTS * EACH + 36} + 2 * ordering - 1:{_N_ELEMENTS * EACH + 36} + 2 * ordering], ' ') AS condition FROM {grid.ARTICLES.sql()} a, v),
rq AS (SELECT article, 'e' AS kind, any_value(ar.title) || ' ' || string_agg(el.hints, ' ' ORDER BY position) AS query, greatest(5, least(12, 3 + count(*))) AS k FROM ar JOIN el USING (article) GROUP BY article
  UNION ALL SELECT article, 'c', title || ' ' || condition, 5 FROM ar),
rw AS (SELECT article, kind, k, list_filter(string_split(query, ' '), lambda t: len(t) > 3) AS words FROM rq),
ps AS (SELECT doc_id, CAST(i AS INTEGER) AS i, substring(text, i * 700 + 1, 700) AS piece, {_in('substring(text, i * 700 + 1, 700)')} AS body FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(len(text) / 700.0) AS BIGINT) - 1)) AS i FROM n)),
sc AS (SELECT doc_id, i, article, kind, k, round(list_sum(list_transform(words, lambda t: (len(body) - len(replace(body, t, ''))) // len(t))) / (1 + len(body) / 800.0::DOUBLE), 6) AS score FROM ps, rw),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, article, kind ORDER BY score DESC, i) AS rank, max(score) OVER (PARTITION BY doc_id, article, kind) AS best FROM sc),
px AS (SELECT doc_id, article, list(i ORDER BY rank) FILTER (kind = 'e') AS consulted, list(i ORDER BY rank) FILTER (kind = 'c') AS more FROM rk WHERE rank <= k AND (score > 0 OR best <= 0) GROUP BY ALL),
ex AS (SELECT doc_id, article, string_agg('[p' || lpad(CAST(i + 1 AS VARCHAR), 3, '0') || ' · text]' || chr(10) || piece, chr(10) || chr(10) ORDER BY rank) AS x FROM rk JOIN ps USING (doc_id, i) WHERE kind = 'e' AND rank <= k AND (score > 0 OR best <= 0) GROUP BY ALL),
st AS (SELECT doc_id, article, {_SENTENCES} AS l FROM ex),
so AS (SELECT doc_id, article, j, l[j] AS s, string_split({_in('l[j]')}, ' ') AS own FROM (SELECT *, unnest(generate_series(1, len(l))) AS j FROM st)),
ew AS (SELECT article, element, list_distinct(list_filter(string_split(title, ' '), lambda w: len(w) > 5)) AS words FROM el),
bs AS (SELECT doc_id, article, element, s FROM (SELECT so.*, element, len(list_intersect(words, own)) AS m FROM so JOIN ew USING (article)) WHERE m >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, article, element ORDER BY m DESC, j) = 1),
gt AS (SELECT doc_id, text, dn, ar.article, ar.ordering, ar.criticality, CASE (doc_id + ordering) % 11 WHEN 4 THEN 'no answer' WHEN 3 THEN 'contradiction'
    WHEN 2 THEN CASE WHEN needs_proof THEN 'exclusion without quotation' END
    WHEN 1 THEN CASE WHEN needs_proof AND NOT contains(dn, {_in(f"'{INVENTED}'")}) THEN 'exclusion quotation not found' END
    WHEN 0 THEN CASE WHEN NOT needs_proof THEN NULL WHEN coalesce(trim(substring(text, 11, 60)), '') = '' THEN 'exclusion without quotation' WHEN NOT (len({_in('substring(text, 11, 60)')}) >= 15 AND contains(dn, {_in('substring(text, 11, 60)')})) THEN 'exclusion quotation not found' END END AS why FROM n, ar),
gs AS (SELECT *, (doc_id + ordering) % 11 > 3 OR why IS NOT NULL AS applicable FROM gt),
pf AS (SELECT g.doc_id, g.article, count(*) FILTER (blocking) AS blocking, count(*) FILTER (blocking AND ok) AS proven, count(*) FILTER (s IS NOT NULL AND NOT ok) AS unverified, count(*) FILTER (NOT blocking AND NOT ok) AS minor
  FROM (SELECT g.doc_id, g.article, blocking, s, coalesce(g.applicable AND s IS NOT NULL AND len({_in('s')}) >= 25 AND contains(dn, {_in('s')}), FALSE) AS ok FROM gs g JOIN el USING (article) LEFT JOIN bs ON bs.doc_id = g.doc_id AND bs.article = g.article AND bs.element = el.element) g GROUP BY ALL),
xm AS (SELECT gs.*, pf.blocking, pf.proven, CASE WHEN applicable THEN unverified ELSE 0 END AS unverified, minor, pf.blocking > 0 AND pf.proven = pf.blocking AS all_proven,
  CASE WHEN doc_id % 4 = 1 THEN gs.article || '(2)(z)' WHEN doc_id % 4 <> 3 THEN CASE gs.article WHEN '9' THEN '9(2)(a)' ELSE '14(5)(b)' END END AS reference, CASE WHEN doc_id % 4 <> 2 THEN substring(text, 11, 60) END AS xq FROM gs JOIN pf USING (doc_id, article)),
xn AS (SELECT *, applicable AND NOT all_proven AND article IN ('9', '14') AND reference IS NOT NULL AS asked FROM xm),
xo AS (SELECT *, CASE WHEN asked THEN CASE WHEN doc_id % 4 = 1 THEN 'unknown exemption' WHEN coalesce(trim(xq), '') = '' THEN 'exemption without quotation' WHEN NOT (len({_in('xq')}) >= 15 AND contains(dn, {_in('xq')})) THEN 'exemption quotation not found' END END AS unheld FROM xn),
vd AS (SELECT *, CASE WHEN NOT applicable THEN 'out_of_scope' WHEN all_proven THEN 'compliant' WHEN asked AND unheld IS NULL THEN CASE article WHEN '9' THEN 'compliant' ELSE 'out_of_scope' END ELSE 'breach' END AS verdict,
  CASE WHEN applicable THEN unverified + (CASE WHEN why IS NOT NULL AND why <> 'no answer' THEN 1 ELSE 0 END) + (CASE WHEN unheld IS NOT NULL THEN 1 ELSE 0 END) ELSE 0 END AS diagnostics FROM xo),
vf AS (SELECT *, greatest(0, least(1, 0.9::DOUBLE - 0.2::DOUBLE * least(unverified, 3) - 0.1::DOUBLE * least(diagnostics, 3) - CASE WHEN verdict = 'compliant' THEN 0.05::DOUBLE * minor ELSE 0 END)) AS c0 FROM vd),
vg AS (SELECT *, CASE WHEN NOT applicable THEN 0.85::DOUBLE ELSE round(CASE WHEN article IN ('37', '35', '22') THEN least(c0, 0.6::DOUBLE) ELSE c0 END, 4) END AS confidence FROM vf),
au AS (SELECT vg.*, CASE WHEN verdict = 'compliant' THEN 1.0::DOUBLE WHEN verdict = 'breach' AND blocking > 0 THEN least(0.5::DOUBLE, proven / blocking) ELSE 0.0::DOUBLE END AS credit,
  CASE WHEN NOT applicable THEN NULL WHEN confidence < 0.70 THEN 'low confidence' WHEN diagnostics > 0 THEN 'diagnostics' END AS review, px.consulted, px.more FROM vg JOIN px USING (doc_id, article))"""


@C.add(
    "article_audit",
    f"""WITH {_AUDIT} SELECT doc_id, article, applicable, verdict, credit, confidence, review, diagnostics, proven, CASE WHEN asked AND unheld IS NULL THEN reference END AS exemption,
  array_to_string(list_transform(consulted, lambda i: 'p' || lpad(CAST(i + 1 AS VARCHAR), 3, '0')), ' ') AS consulted, len(consulted) + len(list_filter(more, lambda i: NOT list_contains(consulted, i))) AS context FROM au""",
)
def article_audit(spark: SparkSession, sf: str) -> DataFrame:
    """All 18 articles of every document that has text."""
    found = _audited(spark, sf)
    return found.select(
        "doc_id", "article", "applicable", "verdict", "credit", "confidence", "review", F.size("diagnostics").cast("long").alias("diagnostics"), "proven", "exemption",
        F.array_join("consulted", " ").alias("consulted"), F.size("context").cast("long").alias("context"),
    )


@C.add(
    "article_scores",
    f"""WITH {_AUDIT}, f AS (SELECT doc_id, coalesce(round(100.0::DOUBLE * sum(criticality * credit) FILTER (verdict IN ('compliant', 'breach')) / sum(criticality) FILTER (verdict IN ('compliant', 'breach')), 1), 0) AS score, count(*) FILTER (verdict IN ('compliant', 'breach')) AS n_scored FROM au GROUP BY doc_id)
SELECT *, CASE WHEN score >= 85 THEN 'high' WHEN score >= 70 THEN 'satisfactory' WHEN score >= 50 THEN 'partial' WHEN score >= 30 THEN 'low' ELSE 'critical' END AS level FROM f""",
)
def article_scores(spark: SparkSession, sf: str) -> DataFrame:
    return plan.scores(_audited(spark, sf))
