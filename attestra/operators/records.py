"""Relational work on organisations, members, audits and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import dates as D
from attestra.functions import rules as R
from attestra.functions.literal import Literal
from attestra.functions import text as T


def member_counts(organizations: DataFrame, memberships: DataFrame) -> DataFrame:
    """Organisations with their number of members, none included."""
    n = memberships.groupBy("org_id").agg(F.count("*").alias("members"))
    return organizations.join(n, "org_id", "left").withColumn("members", F.coalesce("members", F.lit(0)))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """One page of a feed, never more than ``most`` rows."""
    return rows.orderBy(*order).offset(offset).limit(min(limit, most))


def optional(rows: DataFrame, **wanted) -> DataFrame:
    """Filters for the arguments that are set."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def crosswalks(edges: DataFrame, requirements: DataFrame, code: str) -> DataFrame:
    """edge_id, own, other_code, other, coverage of the edges from or to a framework's current requirements, each once.

    requirements: requirement_id, code, reference, is_current.
    """
    current = requirements.filter("is_current")
    own = current.filter(F.col("code") == code).select(F.col("requirement_id").alias("own_id"), F.col("reference").alias("own"))
    other = current.select(F.col("requirement_id").alias("other_id"), F.col("code").alias("other_code"), F.col("reference").alias("other"))

    def direction(a: str, b: str) -> DataFrame:
        return edges.join(own, F.col(a) == F.col("own_id")).join(other, F.col(b) == F.col("other_id")).select("edge_id", "own", "other_code", "other", "coverage")

    # an edge between two of the framework's own requirements is told from its source
    back = direction("target_id", "source_id").filter(F.col("other_code") != code)
    return direction("source_id", "target_id").unionByName(back)


# Which article of a framework covers how much of another one's.
SEEDS = Literal(
    "source_code VARCHAR, source_ref VARCHAR, target_code VARCHAR, target_ref VARCHAR, coverage DOUBLE",
    (
        ("rgpd", "Article 32", "nis2", "Article 21", 0.6),
        ("rgpd", "Article 33", "nis2", "Article 23", 0.5),
        ("rgpd", "Article 30", "dora", "Article 8", 0.35),
        ("rgpd", "Article 35", "ai_act", "Article 27", 0.45),
        ("rgpd", "Article 28", "dora", "Article 28", 0.4),
        ("nis2", "Article 21", "dora", "Article 9", 0.5),
    ),
)


def seed_crosswalks(seeds: DataFrame, requirements: DataFrame, known: DataFrame) -> DataFrame:
    """Seeds with status: created, updated, or ignored and which side is missing, the source named first."""
    current = requirements.filter("is_current").select("requirement_id", "code", "reference")
    a = current.select(F.col("requirement_id").alias("source_id"), F.col("code").alias("source_code"), F.col("reference").alias("source_ref"))
    b = current.select(F.col("requirement_id").alias("target_id"), F.col("code").alias("target_code"), F.col("reference").alias("target_ref"))
    rows = seeds.join(a, ["source_code", "source_ref"], "left").join(b, ["target_code", "target_ref"], "left")
    rows = rows.join(known.select("source_id", "target_id", F.lit(True).alias("_known")), ["source_id", "target_id"], "left")
    missing = lambda c, r: F.concat(F.lit("ignored: "), F.col(c), F.lit(" "), F.col(r))
    status = F.when(F.col("source_id").isNull(), missing("source_code", "source_ref")).when(F.col("target_id").isNull(), missing("target_code", "target_ref"))
    return rows.withColumn("status", status.when(F.col("_known"), "updated").otherwise("created")).drop("_known")


def seeded_crosswalks(known: DataFrame, seeded: DataFrame) -> DataFrame:
    """The edges (source_id, target_id, coverage) after seeding: a known edge takes the seed's coverage, a new one comes in, ignored seeds do nothing."""
    placed = seeded.filter(F.col("status").isin("created", "updated")).select("source_id", "target_id", F.col("coverage").alias("_fresh"))
    rows = known.select("source_id", "target_id", "coverage").join(placed, ["source_id", "target_id"], "full")
    return rows.select("source_id", "target_id", F.coalesce("_fresh", "coverage").alias("coverage"))


def role_gate(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """requests (user_id, org_id, minimum) with outcome: allowed, forbidden, or not_found for strangers."""
    rows = requests.join(memberships.select("user_id", "org_id", "role"), ["user_id", "org_id"], "left")
    have, need = R.lookup(F.col("role"), R.ROLES), R.lookup(F.col("minimum"), R.ROLES)
    return rows.withColumn("outcome", F.when(have.isNull(), "not_found").when(have >= need, "allowed").otherwise("forbidden"))


def removable(memberships: DataFrame) -> DataFrame:
    """Members with removable: not the last owner; and sole: the organisation has nobody else."""
    org = Window.partitionBy("org_id")
    owner = F.col("role") == "owner"
    rows = memberships.withColumns({"_owners": F.count_if(owner).over(org), "_all": F.count("*").over(org)})
    return rows.withColumns({"removable": ~owner | (F.col("_owners") > 1), "sole": F.col("_all") == 1}).drop("_owners", "_all")


def invitations(invites: DataFrame, users: DataFrame, memberships: DataFrame, inviter_role: Column) -> DataFrame:
    """invites (email, org_id, role) with status: unknown user, already a member, only owners make owners, or added."""
    rows = invites.join(users.select("email", "user_id"), "email", "left").join(memberships.select("user_id", "org_id", F.lit(True).alias("_in")), ["user_id", "org_id"], "left")
    status = F.when(F.col("user_id").isNull(), "unknown user").when(F.col("_in"), "already a member").when((F.col("role") == "owner") & (inviter_role != "owner"), "only owners make owners")
    return rows.withColumn("status", status.otherwise("added")).drop("_in")


def lifecycle_guard(status: Column, action: Column) -> Column:
    """Whether an audit in this state takes the action."""
    return F.when(action == "run", status != "running").when(action.isin("report", "schedule"), status == "completed").otherwise(True)


def account_usable(now: Column) -> Column:
    locked = F.col("locked_until").isNotNull() & (F.col("locked_until") > now)
    return F.col("is_active") & F.col("deleted_at").isNull() & ~locked


def recipients(users: DataFrame, memberships: DataFrame) -> DataFrame:
    """Active members, to be notified."""
    return users.filter("is_active and deleted_at is null").join(memberships, "user_id").select("org_id", "user_id", "email")


def valid_tokens(tokens: DataFrame, purpose: str, now: Column) -> DataFrame:
    return tokens.filter((F.col("purpose") == purpose) & F.col("used_at").isNull() & (F.col("expires_at") > now))


# Media types that are taken, and the most bytes.
MEDIA = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain", "text/markdown")
MOST_BYTES = 20 * 1024 * 1024


def upload_problem(media: Column, size: Column) -> Column:
    return F.when(~media.isin(*MEDIA), "unsupported type").when(size == 0, "empty").when(size > MOST_BYTES, "too large")


def revoke(sessions: DataFrame, which: Column, now: Column) -> DataFrame:
    """Sessions that fit and aren't revoked yet are, now."""
    return sessions.withColumn("revoked_at", F.when(which & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at")))


def anonymise(users: DataFrame, which: Column, now: Column) -> DataFrame:
    """Accounts that are picked lose e-mail, name and, if they have one, credential (``password_hash``: "!", which no password has); logs stay."""
    gone = F.concat(F.lit("deleted-"), F.col("user_id").cast("string"), F.lit("@invalid"))
    pick = lambda new, old: F.when(which, new).otherwise(F.col(old))
    credential = {"password_hash": pick(F.lit("!"), "password_hash")} if "password_hash" in users.columns else {}
    return users.withColumns({"email": pick(gone, "email"), "name": pick(F.lit("deleted account"), "name"), "is_active": F.col("is_active") & ~which, "deleted_at": pick(now, "deleted_at")} | credential)


def credential_changed(users: DataFrame, tokens: DataFrame, sessions: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accounts, tokens and sessions after changes (user_id, token_id, password_hash) of credentials.

    The credential is replaced and the failure counter and lock reset, the token
    that allowed it marked used, and every session of the account revoked.
    """
    new = changes.select("user_id", F.col("password_hash").alias("_new"))
    accounts = users.join(new, "user_id", "left")
    hit = F.col("_new").isNotNull()
    reset = {"password_hash": F.coalesce("_new", "password_hash"), "failures": F.when(hit, 0).otherwise(F.col("failures")), "locked_until": F.when(~hit, F.col("locked_until"))}
    used = tokens.join(changes.select("token_id", F.lit(True).alias("_used")), "token_id", "left")
    open_ = sessions.join(new.select("user_id", F.lit(True).alias("_hit")), "user_id", "left")
    return (
        accounts.withColumns(reset).drop("_new"),
        used.withColumn("used_at", F.when(F.col("_used") & F.col("used_at").isNull(), now).otherwise(F.col("used_at"))).drop("_used"),
        open_.withColumn("revoked_at", F.when(F.col("_hit") & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))).drop("_hit"),
    )


def notifications(events: DataFrame, users: DataFrame, memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is appended for events (org_id, kind, title, body): a notification each, and the mail that active members get."""
    kept = events.withColumn("notification_id", F.sha2(F.concat_ws("\x00", "org_id", "kind", "title", "body"), 256))
    return kept, kept.join(recipients(users, memberships), "org_id").select("notification_id", "org_id", "user_id", "email", "title", "body")


def status_updated(findings: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings after requests (request, audit_id, finding_id, status), and each request's outcome.

    A request changes the finding only within its audit; of several for one
    finding the last (by request) counts.  Outcome: changed or not_found.
    """
    keys = ["audit_id", "finding_id"]
    last = requests.groupBy(*keys).agg(F.max_by("status", "request").alias("_new"))
    after = findings.join(last, keys, "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
    there = requests.join(findings.select(*keys, F.lit(True).alias("_there")), keys, "left")
    return after, there.select("request", F.when(F.col("_there"), "changed").otherwise("not_found").alias("outcome"))


def schedules_set(schedules: DataFrame, requests: DataFrame, audits: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Schedules after requests (source_audit_id, cadence; null cancels), and each request's outcome.

    One schedule at most for each source audit: a first request creates it, a
    later one changes its cadence and switches it on again, a cancellation
    switches it off.  Only completed audits are scheduled.
    """
    asked = requests.join(audits.select(F.col("audit_id").alias("source_audit_id"), "org_id", "status"), "source_audit_id", "left")
    known = schedules.select("source_audit_id", F.lit(True).alias("_known"))
    asked = asked.join(known, "source_audit_id", "left")
    outcome = F.when(F.col("cadence").isNull(), F.when(F.col("_known"), "cancelled").otherwise("not_found")).when(F.col("status").isNull(), "not_found").when(F.col("status") != "completed", "conflict")
    asked = asked.withColumn("outcome", outcome.when(F.col("_known"), "updated").otherwise("created"))
    set_ = asked.filter(F.col("outcome").isin("updated", "cancelled")).select("source_audit_id", F.col("cadence").alias("_cadence"), "outcome")
    rows = schedules.join(set_, "source_audit_id", "left")
    on = F.col("outcome") == "updated"
    kept = rows.select(
        "source_audit_id", "org_id", F.when(on, F.col("_cadence")).otherwise(F.col("cadence")).alias("cadence"),
        F.when(on, D.next_run(now, F.col("_cadence"))).otherwise(F.col("next_run_at")).alias("next_run_at"),
        F.when(on, True).when(F.col("outcome") == "cancelled", False).otherwise(F.col("is_active")).alias("is_active"),
    )
    fresh = asked.filter("outcome = 'created'").select("source_audit_id", "org_id", "cadence", D.next_run(now, F.col("cadence")).alias("next_run_at"), F.lit(True).alias("is_active"))
    return kept.unionByName(fresh), asked.select("source_audit_id", "outcome")


def registered(requests: DataFrame, users: DataFrame, organizations: DataFrame) -> dict[str, DataFrame]:
    """What registrations (email, name, password_hash, organization) append: users, organizations, memberships, consents, tokens; and each outcome.

    An e-mail that is known, or comes a second time, is refused ("taken"), and
    terms have to be accepted.  Each account owns a new organisation, whose slug
    gets the account's key if another has it.
    """
    first = Window.partitionBy(F.lower("email")).orderBy("request")
    rows = requests.withColumn("_nth", F.row_number().over(first)).join(users.select(F.lower("email").alias("_mail"), F.lit(True).alias("_known")), F.lower("email") == F.col("_mail"), "left")
    outcome = F.when(~F.col("accepts_terms"), "terms").when(F.col("_known") | (F.col("_nth") > 1), "taken").otherwise("created")
    rows = rows.withColumn("outcome", outcome)
    new = rows.filter("outcome = 'created'").withColumns({"user_id": F.sha2(F.lower("email"), 256), "slug": T.slug(F.col("organization"))})
    same = Window.partitionBy("slug").orderBy("request")
    new = new.withColumn("_same", F.row_number().over(same)).join(organizations.select("slug", F.lit(True).alias("_slug")).distinct(), "slug", "left")
    slug = F.when(F.col("_slug") | (F.col("_same") > 1), F.concat("slug", F.lit("-"), F.left("user_id", F.lit(8)))).otherwise(F.col("slug"))
    new = new.withColumn("slug", slug)
    return {
        "outcomes": rows.select("request", "outcome"),
        "users": new.select("user_id", F.lower("email").alias("email"), "name", "password_hash"),
        "organizations": new.select(F.concat(F.lit("org-"), "user_id").alias("org_id"), F.col("organization").alias("name"), "slug"),
        "memberships": new.select("user_id", F.concat(F.lit("org-"), "user_id").alias("org_id"), F.lit("owner").alias("role")),
        "consents": new.select("user_id", F.lit("terms").alias("consent")),
        "tokens": new.select("user_id", F.lit("verify_email").alias("purpose")),
    }


def by_rank(rows: DataFrame, ranks: dict[str, int], column: str, *then: str) -> DataFrame:
    """``rows`` with position: their place in the order of a ranked column, then others; unknown values last."""
    rank = R.lookup(F.col(column), ranks, len(ranks))
    return rows.withColumn("position", F.row_number().over(Window.orderBy(rank, *then)))


def delete_cascading(parents: DataFrame, children: DataFrame, which: Column, key: str, set_null: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parents without those picked, and children without theirs, or with the reference nulled."""
    gone = parents.filter(which).select(key)
    if not set_null:
        return parents.filter(~which), children.join(gone, key, "left_anti")
    marked = children.join(gone.withColumn("_gone", F.lit(True)), key, "left")
    return parents.filter(~which), marked.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def upsert(known: DataFrame, incoming: DataFrame, keys: list[str], fresh: list[str]) -> DataFrame:
    """Rows by key: new ones come in, known ones take the ``fresh`` columns of what comes in and keep the rest."""
    joined = known.withColumn("_k", F.lit(True)).alias("k").join(incoming.withColumn("_i", F.lit(True)).alias("i"), keys, "full")
    pick = lambda c: F.when(F.col("_i") & ((F.lit(c in fresh)) | F.col("_k").isNull()), F.col(f"i.{c}")).otherwise(F.col(f"k.{c}")).alias(c)
    return joined.select(*keys, *[pick(c) for c in known.columns if c not in keys])


def activity(events: DataFrame) -> DataFrame:
    """Log rows as they are kept: secrets blanked, valid addresses only, agents cut to 400 characters."""
    return events.withColumns({"payload": T.redact(F.col("payload")), "ip": T.valid_ip(F.col("ip")), "agent": F.left("agent", F.lit(400))})


def trajectory(audits: DataFrame, by: str) -> DataFrame:
    """Completed audits in order with the change of score; withheld scores stay."""
    order = Window.partitionBy(by).orderBy("completed_at", "audit_id")
    return audits.filter("completed_at is not null").withColumn("change", F.round(F.col("score") - F.lag("score").over(order), 2))


def next_report_version(reports: DataFrame) -> DataFrame:
    return reports.groupBy("audit_id").agg((F.max("version") + 1).alias("next_version"))


def export(users: DataFrame, **related: DataFrame) -> DataFrame:
    """One JSON document for each user with the rows of every related table (keyed by user_id)."""
    out = users
    for name, rows in related.items():
        columns = [c for c in rows.columns if c != "user_id"]
        out = out.join(rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name)), "user_id", "left")
    return out.select("user_id", F.to_json(F.struct(*[c for c in out.columns if c != "user_id"])).alias("document"))
