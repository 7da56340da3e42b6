"""Relational, lifecycle and tenant queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.catalog.base import Catalog, table
from attestra.functions import dates as D
from attestra.functions import rules as R
from attestra.functions import text as T
from attestra.operators import ingestion, lifecycle, records
from attestra.operators.tenancy import TenantScope

C = Catalog()
NOW = "2024-01-20 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def stamp(c: str | Column) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


_ROLE = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'owner' WHEN 'BUILDING' THEN 'admin' WHEN 'FURNITURE' THEN 'auditor' ELSE 'viewer' END"


def memberships(spark: SparkSession, sf: str) -> DataFrame:
    role = R.lookup(F.col("c_mktsegment"), {"AUTOMOBILE": "owner", "BUILDING": "admin", "FURNITURE": "auditor"}, "viewer")
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("user_id"), role.alias("role"))


@C.add("member_counts", "SELECT n_nationkey AS org_id, n_name AS name, count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def member_counts(spark: SparkSession, sf: str) -> DataFrame:
    orgs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("name"))
    return records.member_counts(orgs, memberships(spark, sf))


@C.add("active_organizations", "SELECT DISTINCT c_nationkey AS org_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def active_organizations(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("user_id"))
    return orders.join(memberships(spark, sf), "user_id").select("org_id").distinct()


#: Parts stand for requirements of five frameworks, line items for edges between them.
_CODES = ("rgpd", "nis2", "dora", "csrd", "ai_act")
_REQUIREMENTS = "(SELECT p_partkey AS requirement_id, CASE p_partkey % 5 WHEN 0 THEN 'rgpd' WHEN 1 THEN 'nis2' WHEN 2 THEN 'dora' WHEN 3 THEN 'csrd' ELSE 'ai_act' END AS code, 'Article ' || p_partkey AS reference, p_size % 4 <> 0 AS is_current FROM part)"
_EDGES = "(SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_partkey AS source_id, l_suppkey * 5 + 1 AS target_id, l_discount AS coverage FROM lineitem)"


def _requirements(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(key.alias("requirement_id"), F.get(F.array(*map(F.lit, _CODES)), (key % 5).cast("int")).alias("code"), F.concat(F.lit("Article "), key.cast("string")).alias("reference"), (F.col("p_size") % 4 != 0).alias("is_current"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_partkey").alias("source_id"), (F.col("l_suppkey") * 5 + 1).alias("target_id"), F.col("l_discount").alias("coverage"))


@C.add(
    "crosswalk_bidirectional",
    f"""WITH e AS {_EDGES}, r AS (SELECT * FROM {_REQUIREMENTS} WHERE is_current)
SELECT edge_id, a.reference AS own, b.code AS other_code, b.reference AS other, coverage FROM e JOIN r a ON a.requirement_id = source_id JOIN r b ON b.requirement_id = target_id WHERE a.code = 'nis2'
UNION ALL SELECT edge_id, a.reference, b.code, b.reference, coverage FROM e JOIN r a ON a.requirement_id = target_id JOIN r b ON b.requirement_id = source_id WHERE a.code = 'nis2' AND b.code <> 'nis2'""",
)
def crosswalk_bidirectional(spark: SparkSession, sf: str) -> DataFrame:
    return records.crosswalks(_edges(spark, sf), _requirements(spark, sf), "nis2")


#: Seeds from line items: every third known already, some whose sides aren't there.
_SEEDS = """(SELECT DISTINCT source_code, source_ref, target_code, target_ref FROM (SELECT CASE l_partkey % 5 WHEN 0 THEN 'rgpd' WHEN 1 THEN 'nis2' WHEN 2 THEN 'dora' WHEN 3 THEN 'csrd' ELSE 'ai_act' END AS source_code, 'Article ' || l_partkey AS source_ref,
  'nis2' AS target_code, 'Article ' || (l_suppkey * 5 + 1) AS target_ref FROM lineitem))"""


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    part = F.col("l_partkey")
    codes = F.get(F.array(*map(F.lit, _CODES)), (part % 5).cast("int"))
    rows = table(spark, sf, "lineitem").select(codes.alias("source_code"), F.concat(F.lit("Article "), part.cast("string")).alias("source_ref"), F.lit("nis2").alias("target_code"), F.concat(F.lit("Article "), (F.col("l_suppkey") * 5 + 1).cast("string")).alias("target_ref"))
    return rows.distinct()


@C.add(
    "crosswalk_seed",
    f"""WITH r AS (SELECT * FROM {_REQUIREMENTS} WHERE is_current), s AS {_SEEDS}, k AS (SELECT DISTINCT source_id, target_id, 1 AS edge_id FROM {_EDGES} WHERE edge_id % 3 = 0)
SELECT source_code, source_ref, target_code, target_ref, CASE WHEN a.requirement_id IS NULL THEN 'ignored: ' || source_code || ' ' || source_ref WHEN b.requirement_id IS NULL THEN 'ignored: ' || target_code || ' ' || target_ref
  WHEN k.edge_id IS NOT NULL THEN 'updated' ELSE 'created' END AS status
FROM s LEFT JOIN r a ON a.code = source_code AND a.reference = source_ref LEFT JOIN r b ON b.code = target_code AND b.reference = target_ref LEFT JOIN k ON k.source_id = a.requirement_id AND k.target_id = b.requirement_id""",
)
def crosswalk_seed(spark: SparkSession, sf: str) -> DataFrame:
    known = _edges(spark, sf).filter("edge_id % 3 = 0").select("source_id", "target_id").distinct()
    return records.seed_crosswalks(_seeds(spark, sf), _requirements(spark, sf), known).select("source_code", "source_ref", "target_code", "target_ref", "status")


#: The five frameworks' articles 1 to 40 in the versions of the parts, a fifth of them not current.
_GRID40 = "(SELECT p_partkey AS requirement_id, CASE p_partkey % 5 WHEN 0 THEN 'rgpd' WHEN 1 THEN 'nis2' WHEN 2 THEN 'dora' WHEN 3 THEN 'csrd' ELSE 'ai_act' END AS code, 'Article ' || (p_partkey // 5 % 40) AS reference, p_partkey < 200 AND p_partkey <> 106 AS is_current FROM part)"


@C.add(
    "crosswalk_seeded",
    f"""WITH r AS (SELECT * FROM {_GRID40} WHERE is_current), k AS (SELECT source_id, target_id, max(coverage) AS coverage FROM {_EDGES} WHERE source_id < 200 AND target_id < 200 GROUP BY ALL
  UNION SELECT a.requirement_id, b.requirement_id, 0.1 FROM r a, r b WHERE a.code = 'rgpd' AND a.reference = 'Article 28' AND b.code = 'dora' AND b.reference = 'Article 28'),
s AS (SELECT a.requirement_id AS source_id, b.requirement_id AS target_id, coverage AS fresh FROM {records.SEEDS.sql()} JOIN r a ON a.code = source_code AND a.reference = source_ref JOIN r b ON b.code = target_code AND b.reference = target_ref)
SELECT source_id, target_id, CAST(coalesce(fresh, coverage) AS DOUBLE) AS coverage FROM k FULL JOIN s USING (source_id, target_id)""",
)
def crosswalk_seeded(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed seeds, of which one is known with another coverage and one has a side that isn't current, put into the line items' edges."""
    key = F.col("p_partkey")
    grid = table(spark, sf, "part").select(key.alias("requirement_id"), F.get(F.array(*map(F.lit, _CODES)), (key % 5).cast("int")).alias("code"), F.concat(F.lit("Article "), (F.floor(key / 5) % 40).cast("string")).alias("reference"), ((key < 200) & (key != 106)).alias("is_current"))
    edges = _edges(spark, sf).filter("source_id < 200 and target_id < 200").groupBy("source_id", "target_id").agg(F.max("coverage").alias("coverage"))
    article = grid.filter("is_current and reference = 'Article 28'")
    old = article.filter("code = 'rgpd'").select(F.col("requirement_id").alias("source_id"), F.lit(1).alias("_")).join(article.filter("code = 'dora'").select(F.col("requirement_id").alias("target_id"), F.lit(1).alias("_")), "_")
    known = edges.unionByName(old.select("source_id", "target_id", F.lit(0.1).alias("coverage"))).distinct()
    return records.seeded_crosswalks(known, records.seed_crosswalks(records.SEEDS.df(spark), grid, known))


@C.add("feed_page", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 200 OFFSET 50")
def feed_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = records.optional(table(spark, sf, "events"), event_type="error", user_id=None)
    return records.page(rows, [F.desc("ts"), "event_id"], 200, 50, 200).select("event_id", "event_type", "user_id")


@C.add(
    "severity_order",
    """WITH f AS (SELECT DISTINCT CASE WHEN l_discount < 0.02 THEN 'critical' WHEN l_discount < 0.05 THEN 'major' WHEN l_discount < 0.08 THEN 'minor' ELSE 'info' END AS severity, 'Article ' || l_linenumber * 5 AS reference FROM lineitem)
SELECT severity, reference, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END, reference) AS INTEGER) AS position FROM f""",
)
def severity_order(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    d = F.col("l_discount")
    severity = F.when(d < 0.02, "critical").when(d < 0.05, "major").when(d < 0.08, "minor").otherwise("info")
    rows = table(spark, sf, "lineitem").select(severity.alias("severity"), F.concat(F.lit("Article "), (F.col("l_linenumber") * 5).cast("string")).alias("reference")).distinct()
    order = Window.partitionBy().orderBy(R.severity_rank(F.col("severity")), "reference")  # a few dozen rows
    return rows.withColumn("position", F.row_number().over(order))


@C.add(
    "score_history",
    """WITH a AS (SELECT o_orderkey AS audit_id, o_custkey AS org_id, o_orderdate AS completed_at, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE round(o_totalprice % 100, 1) END AS score FROM orders)
SELECT audit_id, org_id, score, round(score - lag(score) OVER (PARTITION BY org_id ORDER BY completed_at, audit_id), 2) AS change FROM a""",
)
def score_history(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_custkey").alias("org_id"), F.col("o_orderdate").alias("completed_at"), F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") % 100, 1)).alias("score"))
    return records.trajectory(a, "org_id").select("audit_id", "org_id", "score", "change")


@C.add("next_report_version", "SELECT l_orderkey AS audit_id, max(l_linenumber) + 1 AS next_version FROM lineitem GROUP BY ALL")
def next_report_version(spark: SparkSession, sf: str) -> DataFrame:
    return records.next_report_version(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("audit_id"), F.col("l_linenumber").alias("version")))


_REQ = "q AS (SELECT o_orderkey AS request, o_custkey AS user_id, CAST(o_orderkey % 25 AS INTEGER) AS org_id, CASE o_orderstatus WHEN 'O' THEN 'admin' WHEN 'F' THEN 'auditor' ELSE 'owner' END AS minimum FROM orders)"


@C.add(
    "role_gate",
    f"""WITH {_REQ}, m AS (SELECT c_nationkey AS org_id, c_custkey AS user_id, {_ROLE} AS role FROM customer),
l(role, lv) AS (VALUES ('viewer', 0), ('auditor', 1), ('admin', 2), ('owner', 3))
SELECT request, CASE WHEN a.lv IS NULL THEN 'not_found' WHEN a.lv >= b.lv THEN 'allowed' ELSE 'forbidden' END AS outcome FROM q LEFT JOIN m USING (user_id, org_id) LEFT JOIN l a ON a.role = m.role JOIN l b ON b.role = q.minimum""",
)
def role_gate(spark: SparkSession, sf: str) -> DataFrame:
    minimum = R.lookup(F.col("o_orderstatus"), {"O": "admin", "F": "auditor"}, "owner")
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 25).cast("int").alias("org_id"), minimum.alias("minimum"))
    return records.role_gate(q, memberships(spark, sf)).select("request", "outcome")


@C.add(
    "owner_guards",
    f"""WITH m AS (SELECT c_nationkey * 100 + c_custkey % 40 AS org_id, c_custkey AS user_id, {_ROLE} AS role FROM customer)
SELECT org_id, user_id, role <> 'owner' OR count(*) FILTER (role = 'owner') OVER (PARTITION BY org_id) > 1 AS removable, count(*) OVER (PARTITION BY org_id) = 1 AS sole FROM m""",
)
def owner_guards(spark: SparkSession, sf: str) -> DataFrame:
    m = memberships(spark, sf).withColumn("org_id", F.col("org_id") * 100 + F.col("user_id") % 40)
    return records.removable(m).select("org_id", "user_id", "removable", "sole")


@C.add(
    "invitations",
    f"""WITH m AS (SELECT c_nationkey AS org_id, c_custkey AS user_id FROM customer), u AS (SELECT c_custkey AS user_id, lower(c_name) AS email FROM customer),
i AS (SELECT o_orderkey AS invite, 'customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS email, CAST(o_orderkey % 25 AS INTEGER) AS org_id, CASE WHEN o_orderkey % 5 = 0 THEN 'owner' ELSE 'viewer' END AS role FROM orders)
SELECT invite, CASE WHEN u.user_id IS NULL THEN 'unknown user' WHEN m.user_id IS NOT NULL THEN 'already a member' WHEN role = 'owner' THEN 'only owners make owners' ELSE 'added' END AS status
FROM i LEFT JOIN u USING (email) LEFT JOIN m ON m.user_id = u.user_id AND m.org_id = i.org_id""",
)
def invitations(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lower("c_name").alias("email"))
    key = F.col("o_orderkey")
    invites = table(spark, sf, "orders").select(key.alias("invite"), F.concat(F.lit("customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("email"), (key % 25).cast("int").alias("org_id"), F.when(key % 5 == 0, "owner").otherwise("viewer").alias("role"))
    return records.invitations(invites, users, memberships(spark, sf), F.lit("admin")).select("invite", "status")


@C.add(
    "lifecycle_guard",
    """WITH a AS (SELECT o_orderkey AS audit_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'draft' END AS status FROM orders)
SELECT audit_id, action, CASE WHEN action = 'run' THEN status <> 'running' WHEN action IN ('report', 'schedule') THEN status = 'completed' ELSE TRUE END AS accepted FROM a CROSS JOIN (VALUES ('run'), ('report'), ('schedule'), ('read')) x(action)""",
)
def lifecycle_guard(spark: SparkSession, sf: str) -> DataFrame:
    status = R.lookup(F.col("o_orderstatus"), {"O": "running", "F": "completed"}, "draft")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("audit_id"), status.alias("status"), F.explode(F.array(*map(F.lit, ("run", "report", "schedule", "read")))).alias("action"))
    return rows.select("audit_id", "action", records.lifecycle_guard(F.col("status"), F.col("action")).alias("accepted"))


_USERS = f"""u AS (SELECT c_custkey AS user_id, lower(c_name) AS email, c_name AS name, c_nationkey AS org_id, c_acctbal > 0 AS is_active, CASE WHEN c_custkey % 17 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' END AS deleted_at,
  CASE WHEN c_custkey % 6 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' + (c_custkey % 3 - 1) * INTERVAL 1 DAY END AS locked_until FROM customer)"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("user_id"), F.lower("c_name").alias("email"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("org_id"), (F.col("c_acctbal") > 0).alias("is_active"),
        F.when(key % 17 == 0, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")).alias("deleted_at"), F.when(key % 6 == 0, now() + F.make_dt_interval((key % 3 - 1).cast("int"))).alias("locked_until"),
    )


@C.add("usable_accounts", f"WITH {_USERS} SELECT user_id, is_active AND deleted_at IS NULL AND NOT (locked_until IS NOT NULL AND locked_until > TIMESTAMP '{NOW}') AS usable FROM u")
def usable_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return users(spark, sf).select("user_id", records.account_usable(now()).alias("usable"))


@C.add("notification_recipients", f"WITH {_USERS} SELECT org_id, user_id, email FROM u WHERE is_active AND deleted_at IS NULL")
def notification_recipients(spark: SparkSession, sf: str) -> DataFrame:
    return records.recipients(users(spark, sf).drop("org_id"), memberships(spark, sf).select("org_id", "user_id"))


@C.add("account_anonymised", f"WITH {_USERS} SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'deleted-' || user_id || '@invalid' ELSE email END AS email, CASE WHEN user_id % 4 = 0 THEN 'deleted account' ELSE name END AS name, CASE WHEN user_id % 4 = 0 THEN '!' ELSE 'hash' END AS password_hash, is_active AND user_id % 4 <> 0 AS is_active FROM u")
def account_anonymised(spark: SparkSession, sf: str) -> DataFrame:
    accounts = users(spark, sf).withColumn("password_hash", F.lit("hash"))
    return records.anonymise(accounts, F.col("user_id") % 4 == 0, now()).select("user_id", "email", "name", "password_hash", "is_active")


_SESSIONS = "s AS (SELECT event_id AS session_id, user_id, CAST(event_id % 7 AS INTEGER) AS family, CASE WHEN event_id % 3 = 0 THEN ts END AS revoked_at FROM events)"


@C.add("sessions_revoked", f"WITH {_SESSIONS} SELECT session_id, strftime(CASE WHEN family = 2 AND revoked_at IS NULL THEN TIMESTAMP '{NOW}' ELSE revoked_at END, '%Y-%m-%d %H:%M:%S') AS revoked_at FROM s")
def sessions_revoked(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").select(F.col("event_id").alias("session_id"), (F.col("event_id") % 7).cast("int").alias("family"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("revoked_at"))
    return records.revoke(s, F.col("family") == 2, now()).select("session_id", stamp("revoked_at").alias("revoked_at"))


@C.add("valid_tokens", f"SELECT event_id FROM events WHERE event_type = 'signup' AND event_id % 4 <> 0 AND ts + INTERVAL 3 DAY > TIMESTAMP '{NOW}'")
def valid_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").select("event_id", F.col("event_type").alias("purpose"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("used_at"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("expires_at"))
    return records.valid_tokens(t, "signup", now()).select("event_id")


@C.add(
    "upload_checks",
    """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/png' ELSE 'text/markdown' END AS media, CASE WHEN page_id % 9 = 0 THEN 0 ELSE len(html) * 8000 END AS size FROM pages)
SELECT page_id, CASE WHEN media = 'image/png' THEN 'unsupported type' WHEN size = 0 THEN 'empty' WHEN size > 20971520 THEN 'too large' END AS problem FROM p""",
)
def upload_checks(spark: SparkSession, sf: str) -> DataFrame:
    media = F.get(F.array(*map(F.lit, ("application/pdf", "text/plain", "image/png", "text/markdown"))), (F.col("page_id") % 4).cast("int"))
    size = F.when(F.col("page_id") % 9 == 0, 0).otherwise(F.length("html") * 8000)
    return table(spark, sf, "pages").select("page_id", records.upload_problem(media, size).alias("problem"))


@C.add(
    "password_policy",
    r"""WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'Abcdefghijk ' WHEN 1 THEN 'Abcdefghij_k' WHEN 2 THEN 'QwertyUiop' ELSE left(url, CAST(8 + page_id % 20 AS INTEGER)) END || CASE WHEN page_id % 2 = 0 THEN 'X' ELSE '' END AS pw FROM pages)
SELECT page_id, len(pw) BETWEEN 12 AND 128 AND CAST(regexp_matches(pw, '[a-z]') AS INTEGER) + CAST(regexp_matches(pw, '[A-Z]') AS INTEGER) + CAST(regexp_matches(pw, '\p{Nd}') AS INTEGER) + CAST(regexp_matches(pw, '[^\p{L}\p{N}_\s]') AS INTEGER) >= 3
  AND lower(pw) NOT IN ('password', 'motdepasse', 'azertyuiop', '123456789012', 'qwertyuiop') AS accepted FROM p""",
)
def password_policy(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("page_id") % 7
    word = F.when(kind == 0, "Abcdefghijk ").when(kind == 1, "Abcdefghij_k").when(kind == 2, "QwertyUiop").otherwise(F.left("url", (F.col("page_id") % 20 + 8).cast("int")))
    pw = F.concat(word, F.when(F.col("page_id") % 2 == 0, "X").otherwise(""))
    return table(spark, sf, "pages").select("page_id", T.password_accepted(pw).alias("accepted"))


@C.add("audits_deleted", "SELECT o_orderkey AS audit_id, count(*) AS findings FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY ALL")
def audits_deleted(spark: SparkSession, sf: str) -> DataFrame:
    audits = table(spark, sf, "orders").select(F.col("o_orderkey").alias("audit_id"), "o_orderstatus")
    found = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("audit_id"))
    kept, findings = records.delete_cascading(audits, found, F.col("o_orderstatus") == "F", "audit_id")
    return kept.join(findings, "audit_id").groupBy("audit_id").agg(F.count("*").alias("findings"))


@C.add("schedules_unlinked", "SELECT o_orderkey AS schedule_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN o_custkey END AS source_id FROM orders JOIN customer ON c_custkey = o_custkey")
def schedules_unlinked(spark: SparkSession, sf: str) -> DataFrame:
    sources = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), "c_mktsegment")
    schedules = table(spark, sf, "orders").select(F.col("o_orderkey").alias("schedule_id"), F.col("o_custkey").alias("source_id"))
    return records.delete_cascading(sources, schedules, F.col("c_mktsegment") == "BUILDING", "source_id", set_null=True)[1].select("schedule_id", "source_id")


@C.add(
    "framework_upsert",
    """WITH o AS (SELECT n_name AS code, 'old ' || n_name AS name, 'u' || n_nationkey AS url, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'l' END AS license, 'x' AS authority FROM nation WHERE n_nationkey % 3 <> 0),
n AS (SELECT n_name AS code, n_name AS name, 'v' || n_nationkey AS url, 'm' AS license, 'y' AS authority FROM nation WHERE n_nationkey % 2 = 0)
SELECT code, coalesce(n.name, o.name) AS name, coalesce(n.url, o.url) AS url, coalesce(n.license, o.license) AS license, coalesce(o.authority, n.authority) AS authority FROM o FULL JOIN n USING (code)""",
)
def framework_upsert(spark: SparkSession, sf: str) -> DataFrame:
    key, nations = F.col("n_nationkey"), table(spark, sf, "nation")
    old = nations.filter(key % 3 != 0).select(F.col("n_name").alias("code"), F.concat(F.lit("old "), "n_name").alias("name"), F.concat(F.lit("u"), key.cast("string")).alias("url"), F.when(key % 4 != 0, "l").alias("license"), F.lit("x").alias("authority"))
    new = nations.filter(key % 2 == 0).select(F.col("n_name").alias("code"), F.col("n_name").alias("name"), F.concat(F.lit("v"), key.cast("string")).alias("url"), F.lit("m").alias("license"), F.lit("y").alias("authority"))
    return ingestion.upsert_frameworks(old, new)


@C.add("embedding_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS text, 'sec' || label AS section FROM embeddings UNION ALL SELECT vec_id + 1000000, 'new', 'none' FROM embeddings WHERE vec_id % 5 = 0")
def embedding_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    known = e.select(F.col("vec_id").alias("id"), F.lit("old").alias("text"), F.concat(F.lit("sec"), F.col("label").cast("string")).alias("section"))
    changed = e.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), F.lit("new").alias("text"), F.lit("none").alias("section"))
    fresh = e.filter("vec_id % 5 = 0").select((F.col("vec_id") + 1000000).alias("id"), F.lit("new").alias("text"), F.lit("none").alias("section"))
    return records.upsert(known, changed.unionByName(fresh), ["id"], ["text"])


@C.add("activity_log", r"SELECT event_id, 5 AS n_redacted, props AS near, event_type AS kind, CASE WHEN user_id % 2 = 0 THEN '10.0.0.' || user_id % 250 END AS ip, left(repeat(event_type, 100), 400) AS agent FROM events")
def activity_log(spark: SparkSession, sf: str) -> DataFrame:
    ip = F.concat(F.when(F.col("user_id") % 2 == 0, "10.0.0.").otherwise("10.0.x."), (F.col("user_id") % 250).cast("string"))
    rows = table(spark, sf, "events").select("event_id", F.create_map(*[x for k in (*T.SECRET_KEYS, "Token", "refresh_token", "token_id") for x in (F.lit(k), F.col("props"))], F.lit("kind"), F.col("event_type")).alias("payload"), ip.alias("ip"), F.repeat("event_type", 100).alias("agent"))
    logged = records.activity(rows)
    hidden = F.size(F.map_filter("payload", lambda k, v: v == "[REDACTED]"))
    near = F.when((F.col("payload")["Token"] == F.col("payload")["refresh_token"]) & (F.col("payload")["refresh_token"] == F.col("payload")["token_id"]), F.col("payload")["token_id"])
    return logged.select("event_id", hidden.alias("n_redacted"), near.alias("near"), F.col("payload")["kind"].alias("kind"), "ip", "agent")


@C.add("personal_export", "SELECT c_custkey AS user_id, count(o_orderkey) AS sessions, c_name AS name FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def personal_export(spark: SparkSession, sf: str) -> DataFrame:
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    sessions = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("session"), F.col("o_orderstatus").alias("state"))
    document = F.from_json("document", "name string, sessions array<struct<session:bigint,state:string>>")
    out = records.export(who, sessions=sessions).select("user_id", document.alias("d"))
    return out.select("user_id", F.when(F.col("d.sessions").isNull(), 0).otherwise(F.size("d.sessions")).cast("long").alias("sessions"), F.col("d.name").alias("name"))


_SCHED = "s AS (SELECT o_orderkey AS schedule_id, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_custkey END AS source_audit_id, CASE o_orderkey % 3 WHEN 0 THEN 'weekly' WHEN 1 THEN 'monthly' ELSE 'quarterly' END AS cadence, TIMESTAMP '2024-01-10 00:00:00' + (o_orderkey % 20) * INTERVAL 1 DAY AS next_run_at, o_orderstatus <> 'P' AS is_active FROM orders)"


def _schedules(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("schedule_id"), F.when(key % 8 != 0, F.col("o_custkey")).alias("source_audit_id"), F.when(key % 3 == 0, "weekly").when(key % 3 == 1, "monthly").otherwise("quarterly").alias("cadence"),
        (F.lit("2024-01-10 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((key % 20).cast("int"))).alias("next_run_at"), (F.col("o_orderstatus") != "P").alias("is_active"),
    )


@C.add("due_schedules", f"WITH {_SCHED} SELECT schedule_id FROM s WHERE is_active AND next_run_at <= TIMESTAMP '{NOW}'")
def due_schedules(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.due(_schedules(spark, sf), now()).select("schedule_id")


@C.add(
    "schedules_advanced",
    f"""WITH {_SCHED}, d AS (SELECT *, is_active AND next_run_at <= TIMESTAMP '{NOW}' AS due FROM s)
SELECT schedule_id, strftime(CASE WHEN due AND source_audit_id IS NOT NULL THEN TIMESTAMP '{NOW}' + CASE cadence WHEN 'weekly' THEN INTERVAL 7 DAY WHEN 'monthly' THEN INTERVAL 30 DAY ELSE INTERVAL 91 DAY END ELSE next_run_at END, '%Y-%m-%d %H:%M:%S') AS next_run_at,
  is_active AND NOT (due AND source_audit_id IS NULL) AS is_active FROM d""",
)
def schedules_advanced(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.advance(_schedules(spark, sf), now()).select("schedule_id", stamp("next_run_at").alias("next_run_at"), "is_active")


@C.add("stale_sources", f"SELECT event_id FROM events WHERE event_id % 5 = 0 OR ts < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR")
def stale_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("checked_at"))
    return lifecycle.stale(rows, now()).select("event_id")


_REC = "CASE event_type WHEN 'click' THEN 'document' WHEN 'view' THEN 'report' WHEN 'error' THEN 'journal' ELSE 'passage' END"
LATER = "2024-04-10 12:00:00"


@C.add(
    "retention_due",
    f"""WITH r AS (SELECT event_id, {_REC} AS record, ts FROM events), u AS (SELECT event_id, record, ts + CASE record WHEN 'report' THEN INTERVAL 1095 DAY WHEN 'journal' THEN INTERVAL 180 DAY ELSE INTERVAL 90 DAY END AS until FROM r)
SELECT event_id, record, strftime(until, '%Y-%m-%d %H:%M:%S') AS until, until <= TIMESTAMP '{LATER}' AS due FROM u""",
)
def retention_due(spark: SparkSession, sf: str) -> DataFrame:
    record = R.lookup(F.col("event_type"), {"click": "document", "view": "report", "error": "journal"}, "passage")
    r = table(spark, sf, "events").select("event_id", record.alias("record"), "ts")
    at = F.lit(LATER).cast("timestamp_ntz")
    return r.select("event_id", "record", stamp(D.retained_until(F.col("ts"), F.col("record"))).alias("until"), D.is_due(F.col("ts"), F.col("record"), at).alias("due"))


@C.add("passages_purged", f"SELECT event_id, CASE WHEN NOT ts + INTERVAL 90 DAY <= TIMESTAMP '{LATER}' THEN props END AS content, ts + INTERVAL 90 DAY <= TIMESTAMP '{LATER}' AS purged FROM events")
def passages_purged(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"), F.col("props").alias("content"))
    return lifecycle.purge(rows, F.lit(LATER).cast("timestamp_ntz")).select("event_id", "content", "purged")


_RUNS = "e AS (SELECT event_id, user_id, ts, event_type IN ('error', 'click') AS failed FROM events), i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e), r AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM i)"


def _failures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_type").isin("error", "click").alias("failed"))


@C.add("lockout_runs", f"WITH {_RUNS} SELECT event_id, user_id, CAST(run AS BIGINT) AS run FROM r WHERE failed AND run % 5 = 0")
def lockout_runs(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.lockouts(_failures(spark, sf), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "run")


@C.add("breaker_open", f"WITH {_RUNS} SELECT event_id, max(run) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 3 AS open FROM r")
def breaker_open(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.breaker(_failures(spark, sf), "user_id", ["ts", "event_id"]).select("event_id", "open")


@C.add(
    "token_replay",
    """WITH t AS (SELECT event_id, user_id AS family, event_type AS token, ts FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY family, token ORDER BY ts, event_id) > 1 AS replay FROM t)
SELECT event_id, replay, max(CASE WHEN replay THEN 1 ELSE 0 END) OVER (PARTITION BY family ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS revoked FROM a""",
)
def token_replay(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").select("event_id", F.col("user_id").alias("family"), F.col("event_type").alias("token"), F.struct("ts", "event_id").alias("at"))
    return lifecycle.replayed(t).select("event_id", "replay", "revoked")


@C.add("rate_window", "SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY ALL")
def rate_window(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.rate_windows(table(spark, sf, "events"), "user_id", "ts", "1 hour", 2).select("user_id", stamp("start").alias("start"), "n", "limited")


@C.add("watch_affected", "SELECT DISTINCT c_nationkey AS org_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 50 = 1")
def watch_affected(spark: SparkSession, sf: str) -> DataFrame:
    changed = table(spark, sf, "part").filter("p_partkey % 50 = 1").select(F.col("p_partkey").alias("framework"))
    audits = table(spark, sf, "lineitem").join(changed, F.col("l_partkey") == F.col("framework"), "left_semi").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    owners = table(spark, sf, "orders").join(audits, "o_orderkey").select(F.col("o_custkey").alias("user_id")).distinct()
    return memberships(spark, sf).join(owners, "user_id", "left_semi").select("org_id").distinct()


@C.add("tenant_erasure", "SELECT 'orders' AS table_name, (SELECT count(*) FROM orders WHERE o_custkey = 7) AS deleted, (SELECT count(*) FROM orders WHERE o_custkey <> 7) AS kept UNION ALL SELECT 'accounts', (SELECT count(*) FROM customer WHERE c_custkey = 7), (SELECT count(*) FROM customer WHERE c_custkey <> 7)")
def tenant_erasure(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"orders": table(spark, sf, "orders").withColumnRenamed("o_custkey", "tenant_id"), "accounts": table(spark, sf, "customer").withColumnRenamed("c_custkey", "tenant_id")}
    out = TenantScope(7).erase(tables, now())
    kept = out["orders"].agg(F.count("*").alias("kept")).select(F.lit("orders").alias("table_name"), "kept").unionByName(out["accounts"].agg(F.count("*").alias("kept")).select(F.lit("accounts").alias("table_name"), "kept"))
    return out["journal"].join(kept, "table_name").select("table_name", "deleted", "kept")


@C.add("tenant_scan", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def tenant_scan(spark: SparkSession, sf: str) -> DataFrame:
    scope = TenantScope(7)
    return scope.checked(scope.read(table(spark, sf, "orders"), "o_custkey"), "o_custkey").select("o_orderkey")
