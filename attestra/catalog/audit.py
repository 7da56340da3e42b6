"""Retrieval, verification, verdict, score and metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.catalog.base import Catalog, Literal, documents, placed, table
from attestra.catalog.text import NORMAL
from attestra.functions import rules as R
from attestra.functions import text as T
from attestra.operators import metrics, quotations, retrieval, scoring, verdicts, verification
from attestra.plans import document_audit as plan

C = Catalog()

GRID = Literal(
    "requirement VARCHAR, query VARCHAR, criticality INTEGER, elements INTEGER",
    (("r1", "that with from hand hand", 5, 4), ("r2", "pour avec dans leurs", 4, 3), ("r3", "nicht eine para como", 3, 2)),
)

_CHUNKS = f"""c AS (SELECT doc_id, i AS position, {NORMAL.format('substring(text, i * 700 + 1, 700)')} AS body
  FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(len(text) / 700.0) AS BIGINT) - 1)) AS i FROM documents WHERE len(text) > 0))"""
_LEXICAL = f"""g AS (SELECT *, list_filter(string_split({NORMAL.format('query')}, ' '), lambda t: len(t) > 3) AS words FROM {GRID.sql()}),
{_CHUNKS},
s AS (SELECT doc_id, position, requirement, criticality, elements,
  round(list_sum(list_transform(words, lambda t: (len(body) - len(replace(body, t, ''))) // len(t))) / (1 + len(body) / 800.0::DOUBLE), 6) AS score FROM c CROSS JOIN g),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, requirement ORDER BY score DESC, position) AS rank, max(score) OVER (PARTITION BY doc_id, requirement) AS best FROM s)"""


@C.add("lexical_topk", f"WITH {_LEXICAL} SELECT doc_id, requirement, CAST(rank AS INTEGER) AS rank, CAST(position AS INTEGER) AS position, score FROM t WHERE rank <= greatest(5, least(12, 3 + elements)) AND (score > 0 OR best <= 0)")
def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.lexical_best(plan.documents(documents(spark, sf, "doc_id", "text")), GRID.df(spark), retrieval.evidence_k(F.col("elements")))
    return found.select("doc_id", "requirement", "rank", "position", "score")


@C.add(
    "document_audit",
    f"""
WITH {_LEXICAL}, e AS (SELECT doc_id, requirement, any_value(criticality) AS w, count(*) FILTER (score >= 1) AS proven FROM t WHERE rank <= 3 AND (score > 0 OR best <= 0) GROUP BY ALL),
k AS (SELECT *, CASE WHEN proven = 3 THEN 1.0::DOUBLE ELSE least(0.5::DOUBLE, proven / 3.0::DOUBLE) END AS credit FROM e),
f AS (SELECT doc_id, round(100.0::DOUBLE * sum(w * credit) / sum(w), 1) AS score, count(*) AS n_scored FROM k GROUP BY doc_id)
SELECT doc_id, score, n_scored, CASE WHEN score >= 85 THEN 'high' WHEN score >= 70 THEN 'satisfactory' WHEN score >= 50 THEN 'partial' WHEN score >= 30 THEN 'low' ELSE 'critical' END AS level FROM f""",
)
def document_audit(spark: SparkSession, sf: str) -> DataFrame:
    return plan.audit(documents(spark, sf, "doc_id", "text"), GRID.df(spark))


_VECTORS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings)"
_DIST = "round(1 - list_dot_product({0}.e, {1}.e) / (sqrt(list_dot_product({0}.e, {0}.e)) * sqrt(list_dot_product({1}.e, {1}.e))), 6)"


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings")
    return v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label"), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@C.add(
    "knn_topk",
    f"""
WITH {_VECTORS}, p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_DIST.format('q', 'c')} AS distance FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM p QUALIFY rank <= 3""",
)
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    q, c = _vectors(spark, sf)
    return retrieval.nearest(q, c.drop("label"), 3)


@C.add(
    "knn_by_tenant",
    f"""
WITH {_VECTORS}, p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_DIST.format('q', 'c')} AS distance FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.label = c.label WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM p QUALIFY rank <= 3""",
)
def knn_by_tenant(spark: SparkSession, sf: str) -> DataFrame:
    q, c = _vectors(spark, sf)
    return retrieval.nearest(q, c, 3, on=["label"])


_FUSE = f"""
{_VECTORS}, h AS (SELECT vec_id, e[1:16] AS e, label FROM v),
p1 AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_DIST.format('q', 'c')} AS d FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
p2 AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_DIST.format('q', 'c')} AS d FROM h q JOIN h c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rk FROM p1 QUALIFY rk <= 10 UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rk FROM p2 QUALIFY rk <= 10),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rk)), 6) AS score FROM r GROUP BY ALL)"""


@C.add("rrf_fuse", f"WITH {_FUSE} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 3")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    q, c = _vectors(spark, sf)
    short = lambda df: df.withColumn("vector", F.slice("vector", 1, 16)).drop("label")
    return retrieval.fuse([retrieval.nearest(q, c.drop("label"), 10), retrieval.nearest(short(q), short(c), 10)], 3)


@C.add(
    "retriever_comparison",
    f"""
WITH {_FUSE}, fused AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM f QUALIFY rk <= 3),
a AS (SELECT 'whole' AS retriever, query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rk FROM p1) WHERE rk <= 3 UNION ALL SELECT 'fused', query_id, id FROM fused),
m AS (SELECT retriever, round(avg(CASE WHEN q.label = c.label THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS accuracy FROM a JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = id GROUP BY retriever)
SELECT retriever, accuracy, round(accuracy - (SELECT accuracy FROM m WHERE retriever = 'whole'), 4) AS gain, abs(accuracy - (SELECT accuracy FROM m WHERE retriever = 'whole')) >= 0.02 AS significant FROM m""",
)
def retriever_comparison(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    both = knn_topk(spark, sf).select(F.lit("whole").alias("retriever"), "query_id", "id").unionByName(rrf_fuse(spark, sf).select(F.lit("fused").alias("retriever"), "query_id", "id"))
    rows = both.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id")
    m = rows.groupBy("retriever").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 4).alias("accuracy"))
    base = m.filter("retriever = 'whole'").select(F.col("accuracy").alias("base"))
    gain = F.round(F.col("accuracy") - F.col("base"), 4)
    return m.crossJoin(F.broadcast(base)).select("retriever", "accuracy", gain.alias("gain"), (F.abs(F.col("accuracy") - F.col("base")) >= 0.02).alias("significant"))


_Q = f"""q AS (SELECT doc_id, d.text AS document, b.text AS quote FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
  UNION ALL SELECT doc_id, text, substring(text, 11, 60) FROM documents UNION ALL SELECT doc_id, text, substring(text, len(text) // 3 + 1, 60) FROM documents UNION ALL SELECT doc_id, text, 'too short' FROM documents UNION ALL SELECT doc_id, text, ' ' FROM documents),
n AS (SELECT doc_id, quote, trim(quote) = '' AS blank, {NORMAL.format('quote')} AS qn, {NORMAL.format('document')} AS dn FROM q),
v AS (SELECT doc_id, md5(quote) AS quote_key, CASE WHEN blank THEN 'empty' WHEN len(qn) < 25 THEN 'too short' WHEN instr(dn, qn) > 0 THEN 'exact' ELSE 'not found' END AS reason, CAST(instr(dn, qn) - 1 AS INTEGER) AS pos FROM n)"""


def _quotes(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text and all quotations that are looked for in it, as an array."""
    docs, items = documents(spark, sf, "doc_id", "text"), table(spark, sf, "benchmark")
    n = items.agg(F.count("*").alias("n"))
    keyed = docs.crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n"))  # one row
    middle = F.substr("text", (F.length("text") / 3).cast("int") + 1, F.lit(60))
    quotes = F.array(F.col("quote"), F.substring("text", 11, 60), middle, F.lit("too short"), F.lit(" "))
    return keyed.join(items.select("item_id", F.col("text").alias("quote")), "item_id").select("doc_id", "text", quotes.alias("quotes"))


@C.add("quote_exact", f"WITH {_Q} SELECT doc_id, quote_key, reason = 'exact' AS valid, reason, CASE WHEN reason = 'exact' THEN pos ELSE -1 END AS position FROM v")
def quote_exact(spark: SparkSession, sf: str) -> DataFrame:
    checks = verification.verify_each(F.col("quotes"), F.col("text"))
    rows = _quotes(spark, sf).select("doc_id", F.inline(F.arrays_zip(F.col("quotes").alias("quote"), checks.alias("c"))))
    return rows.select("doc_id", F.md5(F.col("quote").cast("binary")).alias("quote_key"), "c.valid", "c.reason", "c.position")


@C.add("quote_tiers")
def quote_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Quotations from the start, the middle and the end of every document: with letters changed every 20 and every 9 characters, with a letter put in or left out every 25, and from elsewhere."""
    text, n = F.col("text"), F.length("text")
    piece = lambda part: F.substr(text, F.greatest(F.lit(1), ((n - 90) * part).cast("int") + 1), F.lit(90))
    changes = ((r"(?s)(.{19}).", "$1z"), (r"(?s)(.{8}).", "$1z"), (r"(?s)(.{25})", "$1z"), (r"(?s)(.{24}).", "$1"))
    quotes = F.array(*[F.regexp_replace(piece(F.lit(part)), *change) for part in (0.0, 0.5, 1.0) for change in changes], F.lit("nothing of this kind stands in any of the texts at all"))
    found = verification.checked(documents(spark, sf, "doc_id", "text"), quotes, F.col("text"), tolerance="edits")
    return found.select("doc_id", F.posexplode("checks").alias("kind", "c")).select("doc_id", "kind", "c.valid", "c.reason", F.round("c.similarity", 4).alias("similarity"), "c.position")


@C.add("quote_reject_rate", f"WITH {_Q} SELECT count(*) AS n, round(avg(CASE WHEN reason <> 'exact' THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS reject_rate FROM v")
def quote_reject_rate(spark: SparkSession, sf: str) -> DataFrame:
    rate = F.coalesce(F.round(F.avg((~F.col("valid")).cast("double")), 4), F.lit(0.0))
    return quote_exact(spark, sf).agg(F.count("*").alias("n"), rate.alias("reject_rate"))


@C.add(
    "sentence_evidence",
    rf"""
WITH p AS (SELECT doc_id, text AS document, list_distinct(list_filter(string_split({NORMAL.format('substring(text, 21, 300)')}, ' '), lambda w: len(w) > 5)) AS words FROM documents),
s AS (SELECT doc_id, words, list_filter(list_transform(string_split(regexp_replace(document, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: len(x) >= 40) AS l FROM p),
x AS (SELECT doc_id, words, i, l[i] AS s FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM s)),
y AS (SELECT doc_id, i, s, len(list_intersect(words, string_split({NORMAL.format('s')}, ' '))) AS n FROM x)
SELECT doc_id, CAST(n AS INTEGER) AS overlap, s AS sentence FROM y WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1""",
)
def sentence_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf, "doc_id", "text").select("doc_id", F.substring("text", 21, 300).alias("title"), F.col("text").alias("document"))
    return verification.best_sentences(rows, "doc_id").select("doc_id", F.col("n").alias("overlap"), "sentence")


@C.add("fuzzy_quotes")
def fuzzy_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Every item of the benchmark, looked for in every document: where it stands with a tenth of its characters edited at most."""
    items = table(spark, sf, "benchmark").select("item_id", T.normalize(F.col("text")).alias("quote"))
    found = quotations.join(items, documents(spark, sf, "doc_id", "text"), key="item_id", normal=T.normalize)
    return found.select("item_id", "doc_id", F.round("similarity", 4).alias("similarity"), "position")


#: Answers of a model about each document: elements of articles, claimed or not, with quotations from the text or from nowhere.
ELEMENTS = Literal(
    "idx INTEGER, article VARCHAR, criticality INTEGER, element VARCHAR, blocking BOOLEAN",
    ((0, "30", 4, "register", True), (1, "30", 4, "purposes", True), (2, "30", 4, "extra", False), (3, "32", 5, "encryption", True), (4, "32", 5, "tests", True), (5, "37", 4, "officer", True), (6, "9", 5, "basis", True), (7, "14", 2, "notice", True), (8, "22", 4, "none", False)),
)
KNOWN = Literal("article VARCHAR, reference VARCHAR, effect VARCHAR, ex_ante BOOLEAN", (("9", "9(2)(h)", "compliant", True), ("14", "14(5)(b)", "out_of_scope", True), ("30", "30(5)", "out_of_scope", False)))
INVENTED = "Invented quotation that is nowhere in any document of the tables"

_EV = f"""a AS (SELECT doc_id, coalesce(text, '') AS document, article, criticality, element, blocking, (doc_id + idx) % 5 <> 0 AS claimed,
  list_filter(CASE (doc_id * 3 + idx) % 6 WHEN 0 THEN [substring(text, 11, 60)] WHEN 1 THEN [substring(text, len(text) // 3 + 1, 80), substring(text, len(text) // 2 + 1, 40)] WHEN 2 THEN [' '] WHEN 3 THEN ['{INVENTED}'] WHEN 4 THEN ['short'] ELSE [left(text, 200)] END,
    lambda q: q IS NOT NULL AND trim(q) <> '') AS qs FROM documents CROSS JOIN {ELEMENTS.sql()}),
n AS (SELECT doc_id, text, {NORMAL.format("coalesce(text, '')")} AS dn FROM documents),
k AS (SELECT a.*, list_transform(qs, lambda q: CASE WHEN len({NORMAL.format('q')}) < 25 THEN 'too short' WHEN contains(n.dn, {NORMAL.format('q')}) THEN 'exact' ELSE 'not found' END) AS ck FROM a JOIN n USING (doc_id)),
e AS (SELECT *, claimed AND len(qs) > 0 AND len(list_filter(ck, lambda c: c <> 'exact')) = 0 AS verified FROM k)"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    text, n = F.col("text"), F.length("text")
    piece = lambda start, size: F.substr(text, start.cast("int") + 1, F.lit(size))
    kind = (F.col("doc_id") * 3 + F.col("idx")) % 6
    said = (
        F.when(kind == 0, F.array(F.substring(text, 11, 60))).when(kind == 1, F.array(piece(F.floor(n / 3), 80), piece(F.floor(n / 2), 40))).when(kind == 2, F.array(F.lit(" ")))
        .when(kind == 3, F.array(F.lit(INVENTED))).when(kind == 4, F.array(F.lit("short"))).otherwise(F.array(F.left(text, F.lit(200))))
    )
    rows = table(spark, sf, "documents").crossJoin(F.broadcast(ELEMENTS.df(spark)))  # nine rows
    quotes = verification.quotations(said, F.lit(None).cast("string"))
    return rows.select("doc_id", "article", "criticality", "element", "blocking", ((F.col("doc_id") + F.col("idx")) % 5 != 0).alias("claimed"), quotes.alias("quotes"), F.coalesce(text, F.lit("")).alias("document"))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return verification.evidence(_answers(spark, sf))


@C.add(
    "evidence_check",
    f"""
WITH {_EV} SELECT doc_id, article, element, verified, CASE WHEN verified THEN 1.0::DOUBLE ELSE 0.0 END AS similarity,
  CASE WHEN claimed AND len(qs) = 0 THEN 'no quotation' WHEN claimed THEN list_filter(ck, lambda c: c <> 'exact')[1] END AS reason,
  CASE WHEN len(qs) > 0 THEN array_to_string(qs, ' […] ') END AS quotation, claimed AND verified AS retained, claimed AND NOT verified AS rejected FROM e""",
)
def evidence_check(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).select("doc_id", "article", "element", "verified", "similarity", "reason", "quotation", "retained", "rejected")


_CLAIMED = f"""(SELECT doc_id, '9' AS article, '9(2)(h)' AS reference, substring(text, 11, 60) AS quote FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, '14', CASE WHEN doc_id % 2 = 0 THEN '14(5)(b)' ELSE '14(5)(z)' END, substring(text, 11, 60) FROM documents
  UNION ALL SELECT doc_id, '30', '30(5)', CASE WHEN doc_id % 4 = 0 THEN NULL ELSE substring(text, 11, 60) END FROM documents)"""
_VERDICTS = f"""{_EV}, x AS (SELECT c.doc_id, c.article, c.reference, k2.effect, CASE WHEN k2.effect IS NULL THEN 'unknown exemption' WHEN coalesce(trim(c.quote), '') = '' THEN 'exemption without quotation'
  WHEN NOT (len({NORMAL.format('c.quote')}) >= 15 AND contains(n.dn, {NORMAL.format('c.quote')})) THEN 'exemption quotation not found' END AS diagnostic
  FROM {_CLAIMED} c LEFT JOIN {KNOWN.sql()} k2 ON k2.article = c.article AND k2.reference = c.reference AND k2.ex_ante JOIN n ON n.doc_id = c.doc_id WHERE c.article IN (SELECT article FROM {KNOWN.sql()} WHERE ex_ante)),
g AS (SELECT doc_id, article, criticality, count(*) FILTER (blocking) AS blocking, count(*) FILTER (blocking AND claimed AND verified) AS proven, count(*) FILTER (claimed AND NOT verified) AS unverified,
  count(*) FILTER (NOT blocking AND NOT (claimed AND verified)) AS missing_minor FROM e GROUP BY ALL),
w AS (SELECT g.*, unverified + CASE WHEN blocking > 0 AND proven = blocking THEN 0 ELSE coalesce(unheld, 0) END AS diagnostics, CASE WHEN blocking > 0 AND proven = blocking THEN 'compliant' WHEN f.effect = 'compliant' THEN 'compliant' WHEN f.effect IS NOT NULL THEN 'out_of_scope' ELSE 'breach' END AS verdict
  FROM g LEFT JOIN (SELECT doc_id, article, min_by(effect, reference) FILTER (diagnostic IS NULL) AS effect, count(diagnostic) AS unheld FROM x GROUP BY doc_id, article) f USING (doc_id, article)),
z AS (SELECT *, greatest(0, least(1, 0.9::DOUBLE - 0.2::DOUBLE * least(unverified, 3) - 0.1::DOUBLE * least(diagnostics, 3) - CASE WHEN verdict = 'compliant' THEN 0.05::DOUBLE * missing_minor ELSE 0 END)) AS c0 FROM w),
u AS (SELECT *, round(CASE WHEN article IN ('37', '35', '22') THEN least(c0, 0.6::DOUBLE) ELSE c0 END, 4) AS confidence,
  CASE WHEN verdict = 'compliant' THEN 1.0::DOUBLE WHEN verdict = 'breach' AND blocking > 0 THEN least(0.5::DOUBLE, proven / blocking) ELSE 0.0::DOUBLE END AS credit FROM z)"""


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    found, docs = _evidence(spark, sf), table(spark, sf, "documents")
    quote, odd = F.substring("text", 11, 60), F.col("doc_id") % 2 != 0
    made = F.array(
        F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit("9").alias("article"), F.lit("9(2)(h)").alias("reference"), quote.alias("quote"))),
        F.struct(F.lit("14").alias("article"), F.when(odd, "14(5)(z)").otherwise("14(5)(b)").alias("reference"), quote.alias("quote")),
        F.struct(F.lit("30").alias("article"), F.lit("30(5)").alias("reference"), F.when(F.col("doc_id") % 4 != 0, quote).alias("quote")),
    )
    claims = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("document"), F.inline(F.filter(made, lambda x: x.isNotNull())))
    diagnostics = found.filter("rejected").groupBy("doc_id", "article").agg(F.count("*").alias("n"))
    return verdicts.article_verdicts(found, verdicts.exemptions(claims, KNOWN.df(spark), by=("doc_id",)), diagnostics, by=("doc_id",))


@C.add("article_verdicts", f"WITH {_VERDICTS} SELECT doc_id, article, criticality, blocking, proven, verdict, credit, confidence, CASE WHEN confidence < 0.70 THEN 'low confidence' WHEN diagnostics > 0 THEN 'diagnostics' END AS review FROM u")
def article_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf).select("doc_id", "article", "criticality", "blocking", "proven", "verdict", "credit", "confidence", "review")


@C.add(
    "weighted_score",
    f"""
WITH {_VERDICTS}, f AS (SELECT doc_id, coalesce(round(100.0::DOUBLE * sum(criticality * credit) FILTER (verdict IN ('compliant', 'breach')) / sum(criticality) FILTER (verdict IN ('compliant', 'breach')), 1), 0) AS score, count(*) FILTER (verdict IN ('compliant', 'breach')) AS n_scored FROM u GROUP BY doc_id)
SELECT *, CASE WHEN score >= 85 THEN 'high' WHEN score >= 70 THEN 'satisfactory' WHEN score >= 50 THEN 'partial' WHEN score >= 30 THEN 'low' ELSE 'critical' END AS level FROM f""",
)
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.weighted(_verdicts(spark, sf), "doc_id")


@C.add("loss_top5", f"WITH {_VERDICTS}, l AS (SELECT doc_id, article, round(criticality * (1 - credit), 2) AS lost FROM u WHERE verdict IN ('compliant', 'breach')) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lost DESC, article) AS INTEGER) AS rank, article, lost FROM l WHERE lost > 0 QUALIFY rank <= 5")
def loss_top5(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.losses(_verdicts(spark, sf), "doc_id")


@C.add("verdict_synopsis", f"WITH {_VERDICTS} SELECT doc_id, count(*) AS n, count(*) FILTER (verdict = 'compliant') AS compliant, count(*) FILTER (verdict = 'breach') AS breach, count(*) FILTER (verdict = 'out_of_scope') AS out_of_scope, count(*) FILTER (verdict = 'undetermined') AS undetermined FROM u GROUP BY doc_id")
def verdict_synopsis(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.synopsis(_verdicts(spark, sf), "doc_id")


#: Kinds of answers about an article's condition; "there" quotes the document, "no" is nowhere.
GATE = Literal(
    "article VARCHAR, failed BOOLEAN, condition_met BOOLEAN, applicable_said BOOLEAN, quoted VARCHAR, needs_proof BOOLEAN",
    (("1", True, None, False, None, True), ("2", False, True, False, "there", True), ("3", False, False, False, None, True), ("4", False, False, False, "no", True),
     ("5", False, False, False, "there", True), ("6", False, None, False, None, False), ("7", False, True, True, None, True), ("8", False, None, None, None, True)),
)


@C.add(
    "applicability_gate",
    f"""
WITH g AS (SELECT doc_id, {NORMAL.format("coalesce(text, '')")} AS dn, t.*, CASE quoted WHEN 'there' THEN substring(text, 11, 40) WHEN 'no' THEN '{INVENTED}' END AS quote, coalesce(applicable_said, TRUE) AS said FROM documents CROSS JOIN {GATE.sql()} t),
x AS (SELECT *, CASE WHEN failed THEN 'no answer' WHEN condition_met <> said THEN 'contradiction' WHEN said THEN NULL WHEN NOT needs_proof THEN NULL WHEN coalesce(trim(quote), '') = '' THEN 'exclusion without quotation'
  WHEN NOT (len({NORMAL.format('quote')}) >= 15 AND contains(dn, {NORMAL.format('quote')})) THEN 'exclusion quotation not found' END AS diagnostic FROM g)
SELECT doc_id, article, diagnostic, said OR diagnostic IS NOT NULL AS applicable FROM x""",
)
def applicability_gate(spark: SparkSession, sf: str) -> DataFrame:
    quote = F.when(F.col("quoted") == "there", F.substring("text", 11, 40)).when(F.col("quoted") == "no", INVENTED)
    rows = table(spark, sf, "documents").crossJoin(F.broadcast(GATE.df(spark)))  # eight rows
    rows = rows.withColumns({"quote": quote, "document": F.coalesce("text", F.lit(""))})
    return verdicts.applicability(rows).select("doc_id", "article", "diagnostic", "applicable")


_HEUR = f"""{_VECTORS}, p AS (SELECT q.vec_id AS query_id, min({_DIST.format('q', 'c')}) AS best FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.label = c.label WHERE q.vec_id % 20 = 0 GROUP BY ALL),
o AS (SELECT query_id, best, CASE WHEN best < 0.25 THEN 'yes' WHEN best < 0.45 THEN 'partial' ELSE 'no' END AS outcome, CASE WHEN best < 0.25 THEN 'info' WHEN best < 0.45 THEN 'minor' ELSE 'major' END AS severity,
  CASE WHEN best < 0.25 THEN 0.6::DOUBLE WHEN best < 0.45 THEN 0.5::DOUBLE ELSE 0.45::DOUBLE END AS confidence FROM p)"""


@C.add("heuristic_verdicts", f"WITH {_HEUR} SELECT * FROM o")
def heuristic_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    best = knn_by_tenant(spark, sf).filter("rank = 1").select("query_id", F.col("distance").alias("best"))
    return best.select("query_id", "best", verdicts.heuristic(F.col("best")).alias("h")).select("query_id", "best", "h.*")


#: Audits from line items: an audit is a supplier, a requirement a line, its outcome from the line's flags.
_LINES = """l AS (SELECT CAST(l_suppkey AS BIGINT) AS audit_id, 'rgpd' AS framework, CAST(l_orderkey % 55 AS INTEGER) AS number, 'Article ' || (l_orderkey % 55) AS reference, l_returnflag || l_linestatus AS title,
  CASE WHEN l_quantity < 5 THEN 'not_applicable' WHEN l_quantity < 20 THEN 'yes' WHEN l_quantity < 30 THEN 'partial' WHEN l_quantity < 35 THEN 'undetermined' ELSE 'no' END AS outcome,
  CASE WHEN l_discount < 0.02 THEN 'critical' WHEN l_discount < 0.05 THEN 'major' WHEN l_discount < 0.08 THEN 'minor' ELSE 'odd' END AS severity,
  CASE WHEN l_linenumber = 1 THEN 'heuristic' ELSE 'llm' END AS source, l_returnflag <> 'A' AS evaluated FROM lineitem)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    number = (F.col("l_orderkey") % 55).cast("int")
    return placed(spark, sf, "lineitem").select(
        "row", F.col("l_suppkey").alias("audit_id"), F.lit("rgpd").alias("framework"), number.alias("number"), F.concat(F.lit("Article "), number.cast("string")).alias("reference"),
        F.concat("l_returnflag", "l_linestatus").alias("title"),
        F.when(q < 5, "not_applicable").when(q < 20, "yes").when(q < 30, "partial").when(q < 35, "undetermined").otherwise("no").alias("outcome"),
        F.when(d < 0.02, "critical").when(d < 0.05, "major").when(d < 0.08, "minor").otherwise("odd").alias("severity"),
        F.when(F.col("l_linenumber") == 1, "heuristic").otherwise("llm").alias("source"), (F.col("l_returnflag") != "A").alias("evaluated"),
    )


_PENALTY = f"""{_LINES}, p AS (SELECT *, CASE outcome WHEN 'not_applicable' THEN 0 WHEN 'yes' THEN 0 WHEN 'partial' THEN 0.5::DOUBLE * w WHEN 'undetermined' THEN 0.2::DOUBLE ELSE w END AS pen FROM
  (SELECT *, CASE severity WHEN 'critical' THEN 1.0::DOUBLE WHEN 'minor' THEN 0.3::DOUBLE WHEN 'info' THEN 0.05::DOUBLE ELSE 0.85::DOUBLE END AS w FROM l)),
s AS (SELECT audit_id, CASE WHEN count(*) FILTER (outcome <> 'not_applicable') = 0 THEN 100.0::DOUBLE ELSE greatest(0, round(100.0::DOUBLE * (1 - sum(pen) / count(*) FILTER (outcome <> 'not_applicable')), 1)) END AS raw,
  round(coalesce(avg(CASE WHEN source <> 'llm' THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (evaluated), 0), 4) AS fallback_ratio, count(*) FILTER (outcome = 'not_applicable') AS not_applicable FROM p GROUP BY audit_id)"""


@C.add("penalty_score", f"WITH {_PENALTY} SELECT audit_id, fallback_ratio, not_applicable, fallback_ratio > 0.30 AS degraded, CASE WHEN NOT fallback_ratio > 0.30 THEN raw END AS score FROM s")
def penalty_score(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.penalties(_lines(spark, sf), "audit_id", "row")


_FINDINGS = f"""{_LINES}, f AS (SELECT audit_id, reference, left(reference || ' — ' || title, 300) AS title,
  CASE WHEN outcome = 'not_applicable' THEN 'info' WHEN severity IN ('critical', 'major', 'minor', 'info') THEN severity ELSE 'major' END AS severity,
  CASE WHEN outcome = 'not_applicable' THEN 'not_applicable' ELSE 'open' END AS status, CASE WHEN source = 'llm' THEN 'model-x' ELSE source END AS model_used FROM l WHERE outcome <> 'yes'),
k AS (SELECT *, CASE WHEN status = 'not_applicable' THEN 'not_applicable' WHEN severity IN ('critical', 'major') THEN 'non_conformity' ELSE 'improvement' END AS kind FROM f)"""


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    extra = {"statement": F.col("title"), "recommendation": F.lit(""), "evidence": F.lit(None).cast("string"), "model": F.lit("model-x"), "document_id": F.lit(None).cast("string")}
    return verdicts.findings(_lines(spark, sf).withColumns(extra))


@C.add("finding_rows", f"WITH {_FINDINGS} SELECT audit_id, kind, severity, status, model_used, count(*) AS n, min(title) AS first_title FROM k GROUP BY ALL")
def finding_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).groupBy("audit_id", "kind", "severity", "status", "model_used").agg(F.count("*").alias("n"), F.min("title").alias("first_title"))


@C.add(
    "severity_pivot",
    f"WITH {_FINDINGS} SELECT audit_id, count(*) FILTER (status <> 'not_applicable') AS findings, count(*) FILTER (status = 'not_applicable') AS not_applicable, "
    + ", ".join(f"count(*) FILTER (status <> 'not_applicable' AND severity = '{s}') AS {s}" for s in R.SEVERITIES)
    + " FROM k GROUP BY audit_id",
)
def severity_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.severity_counts(_findings(spark, sf), "audit_id")


_SAFE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _group_sql(kind: str, heading: str) -> str:
    return f"""'<h2>{heading} (' || count(*) FILTER (kind = '{kind}') || ')</h2>' || CASE WHEN count(*) FILTER (kind = '{kind}') = 0 THEN '<p>Nothing to report.</p>' ELSE
  string_agg(card, '' ORDER BY rk, reference, title, card) FILTER (kind = '{kind}') END"""


@C.add(
    "report_html",
    f"""
WITH {_FINDINGS}, c AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END AS rk,
  '<article class="' || severity || '"><span>' || reference || '</span><h3>' || {_SAFE.format("title")} || '</h3><p>' || {_SAFE.format("description")} || '</p>' || CASE WHEN status = 'not_applicable' THEN '' ELSE '<blockquote>' || {_SAFE.format("left(evidence, 400)")} || '</blockquote><aside>' || {_SAFE.format("recommendation")} || '</aside>' END
  || '<small>' || model_used || '</small></article>' AS card FROM k JOIN (SELECT DISTINCT audit_id AS a2, reference AS r2, left(reference || ' — ' || title, 300) AS t2, title || ' <b>' AS description, 'see "' || title || '" & ' || repeat('more ', 100) AS evidence, 'fix ' || reference AS recommendation FROM l) ON a2 = audit_id AND r2 = reference AND t2 = title),
h AS (SELECT audit_id, '<html><body><header>' || audit_id || ' v2</header><section>' || {" || ".join(f"CASE WHEN count(*) FILTER (status <> 'not_applicable' AND severity = '{x}') > 0 THEN '<b class=\"{x}\">{x} ' || count(*) FILTER (status <> 'not_applicable' AND severity = '{x}') || '</b>' ELSE '' END" for x in R.SEVERITIES)}
  || '</section>' || {" || ".join(_group_sql(k, t) for k, t in scoring.GROUPS)} || '</body></html>' AS html FROM c GROUP BY audit_id)
SELECT audit_id, 2 AS version, sha256(html) AS sha256, CAST(len(html) AS INTEGER) AS n FROM h""",
)
def report_html(spark: SparkSession, sf: str) -> DataFrame:
    extra = {"statement": F.concat("title", F.lit(" <b>")), "recommendation": F.concat(F.lit("fix "), "reference"), "evidence": F.concat(F.lit('see "'), "title", F.lit('" & '), F.repeat(F.lit("more "), F.lit(100))), "model": F.lit("model-x"), "document_id": F.lit(None).cast("string")}
    found = verdicts.findings(_lines(spark, sf).withColumns(extra))
    return scoring.html_report(found, "audit_id", F.lit(2)).select("audit_id", "version", "sha256", F.length("html").alias("n"))


@C.add(
    "dependency_propagation",
    f"""
WITH {_LINES}, dep(number, master) AS (VALUES {", ".join(f"({a}, {m})" for a, m in verdicts.DEPENDENCIES["rgpd"].items())}),
o AS (SELECT DISTINCT audit_id, number FROM l WHERE outcome = 'not_applicable'),
r AS (SELECT l.*, l.outcome <> 'not_applicable' AND o.number IS NOT NULL AS hit FROM l LEFT JOIN dep USING (number) LEFT JOIN o ON o.audit_id = l.audit_id AND o.number = dep.master)
SELECT audit_id, number, CASE WHEN hit THEN 'not_applicable' ELSE outcome END AS outcome, CASE WHEN hit THEN 'info' ELSE severity END AS severity, hit AS reclassified, count(*) AS n FROM r GROUP BY ALL""",
)
def dependency_propagation(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).withColumns({"statement": F.lit(""), "recommendation": F.lit("")})
    return verdicts.propagate(rows).groupBy("audit_id", "number", "outcome", "severity", "reclassified").agg(F.count("*").alias("n"))


#: Documents stand for articles of six frameworks; sentences with the markers' words are put behind some.
_SAYS = ("", " Les entreprises et l'entreprise; la commission", " la commission et les etats membres", " le comite et l'autorite de controle, les entreprises")
_SCOPES = f"""(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'rgpd' WHEN 1 THEN 'nis2' WHEN 2 THEN 'csrd' WHEN 3 THEN 'dora' WHEN 4 THEN 'ai_act' ELSE 'rgpd' END AS framework,
  CASE WHEN doc_id % 13 = 0 THEN 'Annexe' ELSE 'Article ' || (doc_id // 6 % 100) || CASE WHEN doc_id % 5 = 0 THEN ' bis' ELSE '' END END AS reference,
  lower(coalesce(text, '')) || CASE doc_id % 4 {" ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(_SAYS))} END AS body FROM documents)"""


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(body, '{pattern.replace(chr(39), chr(39) * 2)}'))"


@C.add(
    "scope_classify",
    f"""
WITH s AS (SELECT *, TRY_CAST(nullif(regexp_extract(reference, '(?i)Article\\s+(\\d+)', 1), '') AS INTEGER) AS number FROM {_SCOPES}),
m AS (SELECT *, {", ".join(f"{_count(p)} AS c_{n}" for n, p in verdicts.MARKERS.items())} FROM s),
g AS (SELECT *, greatest(c_entity, c_member_state, c_authority, c_commission) AS top FROM m),
a AS (SELECT doc_id, framework, reference, number, CASE
  WHEN framework = 'csrd' THEN CASE WHEN regexp_matches(lower(reference), 'bis|ter|quater|quinquies|sexies|septies') THEN 'entity' ELSE 'member_state' END
  WHEN framework = 'rgpd' AND number IS NOT NULL THEN CASE WHEN number BETWEEN 5 AND 49 THEN 'entity' WHEN number BETWEEN 1 AND 4 THEN 'structural' ELSE 'authority' END
  WHEN framework = 'nis2' AND number IS NOT NULL THEN CASE WHEN number IN (20, 21, 23, 24, 27, 28, 29, 30) THEN 'entity' WHEN number BETWEEN 1 AND 6 THEN 'structural' ELSE 'authority' END
  WHEN top = 0 THEN 'structural' WHEN c_entity = top THEN 'entity' WHEN c_member_state = top THEN 'member_state' WHEN c_authority = top THEN 'authority' ELSE 'commission' END AS audience FROM g)
SELECT doc_id, framework, reference, audience, audience = 'entity' AS auditable FROM a""",
)
def scope_classify(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    of = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    number = F.concat(F.lit("Article "), (F.floor(key / 6) % 100).cast("string"), F.when(key % 5 == 0, " bis").otherwise(""))
    rows = table(spark, sf, "documents").select(
        "doc_id", of(("rgpd", "nis2", "csrd", "dora", "ai_act", "rgpd"), key % 6).alias("framework"), F.when(key % 13 == 0, "Annexe").otherwise(number).alias("reference"),
        F.concat(F.lower(F.coalesce("text", F.lit(""))), of(_SAYS, key % 4)).alias("body"),
    )
    who = verdicts.audience(F.col("framework"), F.col("reference"), T.article_number(F.col("reference")), F.col("body"))
    return rows.withColumn("audience", who).select("doc_id", "framework", "reference", "audience", (F.col("audience") == "entity").alias("auditable"))


@C.add(
    "facts_coerced",
    """WITH f AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '12' WHEN 1 THEN 'true' WHEN 2 THEN '"12"' WHEN 3 THEN '1.5' WHEN 4 THEN 'null' ELSE CAST(c_custkey AS VARCHAR) END AS raw FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN CAST(raw AS BIGINT) END AS headcount, CASE raw WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS risk FROM f""",
)
def facts_coerced(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = F.when(key % 6 == 0, "12").when(key % 6 == 1, "true").when(key % 6 == 2, '"12"').when(key % 6 == 3, "1.5").when(key % 6 == 4, "null").otherwise(key.cast("string"))
    facts = F.try_parse_json(F.concat(F.lit('{"x": '), raw, F.lit("}")))
    return table(spark, sf, "customer").select("c_custkey", R.strict_int(facts, "$.x").alias("headcount"), R.strict_bool(facts, "$.x").alias("risk"))


#: Nullable profiles from customers.
_FACTS = {"occasional": (2, 3), "risk": (3, 4), "sensitive_data": (5, 6), "criminal_data": (7, 4), "public_body": (11, 5), "sole_professional": (13, 6), "large_scale": (17, 3), "core_activity": (19, 4), "monitoring": (23, 5), "direct_collection": (29, 3), "indirect_collection": (31, 4)}
_PROFILE = "p AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey % 500 AS INTEGER) END AS headcount, " + ", ".join(f"CASE WHEN (c_custkey * {a}) % {b} = 0 THEN NULL ELSE (c_custkey * {a}) % {b} = 1 END AS {n}" for n, (a, b) in _FACTS.items()) + " FROM customer)"


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    fact = lambda a, b: F.when((key * a) % b != 0, (key * a) % b == 1)
    return table(spark, sf, "customer").select("c_custkey", F.when(key % 10 != 0, (key % 500).cast("int")).alias("headcount"), *[fact(a, b).alias(n) for n, (a, b) in _FACTS.items()])


@C.add(
    "eligibility_rules",
    f"""
WITH {_PROFILE}, r(number) AS (VALUES (13), (14), (30), (37), (5))
SELECT c_custkey, number, CASE number
  WHEN 13 THEN CASE WHEN direct_collection THEN 'applicable' WHEN direct_collection IS FALSE AND indirect_collection THEN 'exempt' ELSE 'to_verify' END
  WHEN 14 THEN CASE WHEN indirect_collection THEN 'applicable' WHEN indirect_collection IS FALSE AND direct_collection THEN 'exempt' ELSE 'to_verify' END
  WHEN 30 THEN CASE WHEN headcount IS NULL THEN 'to_verify' WHEN headcount >= 250 THEN 'applicable' WHEN sensitive_data OR criminal_data OR risk OR occasional IS FALSE THEN 'applicable'
    WHEN occasional IS NULL OR risk IS NULL OR sensitive_data IS NULL THEN 'to_verify' ELSE 'exempt' END
  WHEN 37 THEN CASE WHEN public_body THEN 'applicable' WHEN sole_professional THEN 'exempt' WHEN public_body IS NULL THEN 'to_verify' WHEN large_scale IS FALSE THEN 'exempt'
    WHEN large_scale THEN CASE WHEN core_activity IS FALSE THEN 'exempt' WHEN monitoring OR sensitive_data OR criminal_data THEN 'applicable' WHEN core_activity IS NULL THEN 'to_verify' ELSE 'exempt' END ELSE 'to_verify' END
  ELSE 'applicable' END AS decision FROM p CROSS JOIN r""",
)
def eligibility_rules(spark: SparkSession, sf: str) -> DataFrame:
    numbers = F.explode(F.array(*[F.lit(n) for n in (13, 14, 30, 37, 5)]))
    return _profiles(spark, sf).withColumn("number", numbers).select("c_custkey", "number", R.eligibility(F.lit(" RGPD "), F.col("number")).alias("decision"))


@C.add("eligibility_filter", f"WITH {_PROFILE} SELECT CASE WHEN indirect_collection IS FALSE AND direct_collection THEN 'exempt' ELSE 'kept' END AS kept, count(*) AS n FROM p GROUP BY ALL")
def eligibility_filter(spark: SparkSession, sf: str) -> DataFrame:
    decision = R.eligibility(F.lit("rgpd"), F.lit(14))
    return _profiles(spark, sf).groupBy(F.when(decision == R.EXEMPT, "exempt").otherwise("kept").alias("kept")).agg(F.count("*").alias("n"))


_TRUTH = """t AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'breach' WHEN quality = 1 THEN 'compliant' ELSE 'out_of_scope' END AS expected, doc_id % 3 = 0 AS never_exclude FROM labels),
o AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'compliant' WHEN 'fr' THEN 'breach' WHEN 'de' THEN 'out_of_scope' ELSE 'undetermined' END AS obtained FROM documents WHERE doc_id % 7 <> 0),
r AS (SELECT * FROM t LEFT JOIN o USING (doc_id))"""
_COUNTS = f"""{_TRUTH}, k AS (SELECT count(*) AS total, count(*) FILTER (expected = obtained) AS correct, count(*) FILTER (expected = 'breach' AND obtained = 'breach') AS tp, count(*) FILTER (expected <> 'breach' AND obtained = 'breach') AS fp,
  count(*) FILTER (expected = 'breach' AND obtained <> 'breach') AS fn, count(*) FILTER (expected = 'out_of_scope' AND obtained IS NOT NULL) AS scope_expected, count(*) FILTER (expected = 'out_of_scope' AND obtained = 'out_of_scope') AS scope_correct,
  count(*) FILTER (never_exclude AND obtained = 'out_of_scope') AS wrongful_exclusions, count(*) FILTER (expected = 'breach' AND obtained = 'out_of_scope') AS excluded_breaches, count(*) FILTER (obtained = 'undetermined') AS undetermined, count(*) FILTER (obtained IS NULL) AS missing FROM r)"""


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    expected = F.when(F.col("toxic") == 1, "breach").when(F.col("quality") == 1, "compliant").otherwise("out_of_scope")
    t = table(spark, sf, "labels").select("doc_id", expected.alias("expected"), (F.col("doc_id") % 3 == 0).alias("never_exclude"))
    obtained = R.lookup(F.col("lang"), {"en": "compliant", "fr": "breach", "de": "out_of_scope"}, "undetermined")
    return metrics.compared(t, table(spark, sf, "documents").filter("doc_id % 7 <> 0").select("doc_id", obtained.alias("obtained")), ["doc_id"])


@C.add("confusion_counters", f"WITH {_COUNTS} SELECT * FROM k")
def confusion_counters(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.counters(_truth(spark, sf))


def _rates_sql(empty: str) -> str:
    return f"""WITH {_COUNTS}, q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE {empty} END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE {empty} END AS rc FROM k)
SELECT round(p, 4) AS precision, round(rc, 4) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 4) AS f1, round(correct / total, 4) AS accuracy FROM q"""


@C.add("prf_evidence_engine", _rates_sql("1.0"))
def prf_evidence_engine(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rates(metrics.counters(_truth(spark, sf)), 1.0)


#: The second engine: documents without a finding were found compliant, and every eleventh annotation is tolerated, which is compliant but not counted.
_JUDGED = """j AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'compliant' ELSE expected END AS expected, coalesce(obtained, 'compliant') AS obtained, doc_id % 11 = 0 AS tolerated FROM r)"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    rows = _truth(spark, sf)
    expected = rows.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "tolerated").otherwise(F.col("expected")).alias("expected"), "never_exclude")
    return metrics.judged(expected, rows.filter("obtained is not null").select("doc_id", "obtained"), ["doc_id"])


@C.add(
    "prf_tolerant",
    f"""WITH {_TRUTH}, {_JUDGED}, k AS (SELECT count(*) AS total, count(*) FILTER (expected = obtained) AS correct, count(*) FILTER (expected = 'breach' AND obtained = 'breach') AS tp, count(*) FILTER (expected <> 'breach' AND obtained = 'breach') AS fp,
  count(*) FILTER (expected = 'breach' AND obtained <> 'breach') AS fn FROM j WHERE NOT tolerated),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM k)
SELECT round(p, 4) AS precision, round(rc, 4) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 4) AS f1, round(correct / total, 4) AS accuracy FROM q""",
)
def prf_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rates(metrics.counters(metrics.counted(_judged(spark, sf))), 0.0)


@C.add("tolerated_verdicts", f"WITH {_TRUTH}, {_JUDGED} SELECT expected, obtained, tolerated, tolerated OR expected = obtained AS correct, count(*) AS n FROM j GROUP BY ALL")
def tolerated_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).groupBy("expected", "obtained", "tolerated", "correct").agg(F.count("*").alias("n"))


@C.add(
    "wilson_interval",
    f"""WITH {_TRUTH}, g AS (SELECT expected, count(*) AS n, count(*) FILTER (expected = obtained) AS hits FROM r GROUP BY expected), w AS (SELECT *, hits / n AS p, 1 + 1.96::DOUBLE * 1.96::DOUBLE / n AS d FROM g)
SELECT expected, n, hits, round(greatest(0, (p + 1.96::DOUBLE * 1.96::DOUBLE / (2 * n)) / d - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96::DOUBLE / (4 * n * n)) / d), 6) AS low,
  round(least(1, (p + 1.96::DOUBLE * 1.96::DOUBLE / (2 * n)) / d + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96::DOUBLE / (4 * n * n)) / d), 6) AS high FROM w""",
)
def wilson_interval(spark: SparkSession, sf: str) -> DataFrame:
    g = _truth(spark, sf).groupBy("expected").agg(F.count("*").alias("n"), F.count_if(F.col("expected") == F.col("obtained")).alias("hits"))
    return g.withColumn("w", metrics.wilson(F.col("hits"), F.col("n"))).select("expected", "n", "hits", "w.low", "w.high")


_KINDS = ["compliant", "breach", "out_of_scope", "undetermined"]


@C.add("confusion_matrix", f"WITH {_TRUTH}, {_JUDGED} SELECT expected, " + ", ".join(f"count(*) FILTER (obtained = '{k}') AS {k}" for k in _KINDS) + " FROM j WHERE NOT tolerated GROUP BY expected")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(metrics.counted(_judged(spark, sf)), _KINDS)


@C.add("common_confusions", f"WITH {_TRUTH} SELECT expected, obtained, count(*) AS n FROM r WHERE expected <> obtained GROUP BY ALL ORDER BY n DESC, expected, obtained LIMIT 5")
def common_confusions(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.most_common(_truth(spark, sf).filter("expected <> obtained"), ["expected", "obtained"])


#: Runs from events: a document is a user, a run a day of the week, an article an event type.
_RUNS = """e AS (SELECT user_id AS document, CAST(event_id % 4 + 1 AS INTEGER) AS run, event_type AS article, value FROM events),
s AS (SELECT document, run, round(avg(value), 1) AS score FROM e GROUP BY ALL), v AS (SELECT document, run, article, CASE WHEN max(value) > 150 THEN 'breach' ELSE 'compliant' END AS verdict FROM e GROUP BY ALL)"""


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = placed(spark, sf, "events").select("row", F.col("user_id").alias("document"), (F.col("event_id") % 4 + 1).cast("int").alias("run"), F.col("event_type").alias("article"), "value")
    added = metrics.totalled(e, ["document", "run"], F.col("value"), "row", "total").groupBy("document", "run")
    return added.agg(metrics.rounded(F.try_divide(F.max_by("total", "row"), F.count("value")), 1).alias("score")), e.groupBy("document", "run", "article").agg(F.when(F.max("value") > 150, "breach").otherwise("compliant").alias("verdict"))


@C.add(
    "reproducibility",
    f"""WITH {_RUNS}, a AS (SELECT document, count(*) AS runs, round(stddev_pop(score), 3) AS deviation, round(max(score) - min(score), 3) AS range FROM s GROUP BY document),
u AS (SELECT document, article, count(DISTINCT verdict) > 1 AS unstable FROM v GROUP BY ALL), b AS (SELECT document, count(*) FILTER (unstable) AS unstable, round(1 - count(*) FILTER (unstable) / count(*), 4) AS stability FROM u GROUP BY document)
SELECT * FROM a JOIN b USING (document)""",
)
def reproducibility(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.reproducibility(*_runs(spark, sf), "document")


@C.add("corpus_reproducibility", f"WITH {_RUNS}, a AS (SELECT document, stddev_pop(score) AS d FROM s GROUP BY document) SELECT round(max(d), 3) AS max_deviation, round(avg(d), 3) AS mean_deviation FROM a")
def corpus_reproducibility(spark: SparkSession, sf: str) -> DataFrame:
    each = _runs(spark, sf)[0].groupBy("document").agg(F.stddev_pop("score").alias("d"))
    return each.agg(F.round(F.max("d"), 3).alias("max_deviation"), F.round(F.avg("d"), 3).alias("mean_deviation"))


@C.add("first_run_stability", f"WITH {_RUNS}, f AS (SELECT DISTINCT document, article FROM v WHERE run = 1), x AS (SELECT document, article, count(DISTINCT verdict) = 1 AS same FROM v SEMI JOIN f USING (document, article) GROUP BY ALL) SELECT document, round(avg(CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS stability FROM x GROUP BY document")
def first_run_stability(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.first_run_stability(_runs(spark, sf)[1], "document")


@C.add("score_gaps", f"WITH {_RUNS}, m AS (SELECT document, avg(score) AS score FROM s GROUP BY document) SELECT document, round(CASE WHEN score IS NULL THEN 100 WHEN score BETWEEN 40 AND 60 THEN 0 ELSE least(abs(score - 40), abs(score - 60)) END, 4) AS gap, coalesce(score BETWEEN 40 AND 60, FALSE) AS in_range FROM m")
def score_gaps(spark: SparkSession, sf: str) -> DataFrame:
    m = _runs(spark, sf)[0].groupBy("document").agg(F.avg("score").alias("score"))
    low, high = F.lit(40.0), F.lit(60.0)
    return m.select("document", F.round(metrics.score_gap(F.col("score"), low, high), 4).alias("gap"), F.coalesce(F.col("score").between(40, 60), F.lit(False)).alias("in_range"))


@C.add(
    "ci_gates",
    f"""WITH {_RUNS}, {_COUNTS}, q AS (SELECT tp / (tp + fn) AS recall, tp / (tp + fp) AS precision, correct / total AS accuracy, wrongful_exclusions, undetermined / total AS u FROM k),
m AS (SELECT document, avg(score) AS score FROM s GROUP BY document), y AS (SELECT document, article, count(DISTINCT verdict) > 1 AS unstable FROM v GROUP BY ALL),
g(gate, value, bound, at_least) AS (SELECT 'recall', round(recall, 4), 0.90::DOUBLE, TRUE FROM q UNION ALL SELECT 'precision', round(precision, 4), 0.95::DOUBLE, TRUE FROM q UNION ALL SELECT 'accuracy', round(accuracy, 4), 0.90::DOUBLE, TRUE FROM q
  UNION ALL SELECT 'wrongful_exclusions', wrongful_exclusions, 0.0, FALSE FROM q UNION ALL SELECT 'out_of_range', count(*) FILTER (NOT coalesce(score BETWEEN 40 AND 60, FALSE)), 1.0, FALSE FROM m UNION ALL SELECT 'unstable_share', round(count(*) FILTER (unstable) / count(*), 4), 0.0, FALSE FROM y UNION ALL SELECT 'undetermined_share', round(u, 4), 0.05::DOUBLE, FALSE FROM q),
h AS (SELECT gate, CAST(value AS DOUBLE) AS value, CAST(bound AS DOUBLE) AS bound, at_least, CASE WHEN at_least THEN value >= bound ELSE value <= bound END AS passed FROM g)
SELECT *, bool_and(passed) OVER () AS all_passed FROM h""",
)
def ci_gates(spark: SparkSession, sf: str) -> DataFrame:
    counts = metrics.counters(_truth(spark, sf))
    rates = metrics.rates(counts, 1.0)
    one = rates.crossJoin(counts.select("wrongful_exclusions", F.round(F.col("undetermined") / F.col("total"), 4).alias("undetermined_share")))
    gaps = score_gaps(spark, sf).agg(F.count_if(~F.col("in_range")).cast("double").alias("out_of_range"))
    return metrics.gates(one.crossJoin(gaps).crossJoin(metrics.unstable_share(_runs(spark, sf)[1], "document")))  # one row each


@C.add(
    "observed_verdicts",
    f"""WITH {_LINES} SELECT CASE WHEN outcome = 'undetermined' THEN 'out_of_scope' WHEN severity = 'odd' THEN 'compliant' WHEN outcome = 'not_applicable' THEN 'out_of_scope' WHEN severity IN ('critical', 'major') THEN 'breach' ELSE 'compliant' END AS observed, count(*) AS n FROM l GROUP BY ALL""",
)
def observed_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("outcome") == "undetermined", "out_of_scope").otherwise(F.col("outcome"))
    severity = F.nullif("severity", F.lit("odd"))
    return _lines(spark, sf).groupBy(R.observed_verdict(outcome, severity).alias("observed")).agg(F.count("*").alias("n"))
