"""Decision rules as Column expressions; null facts stay null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in rank order with their weights, and the factors of the penalty score.
SEVERITIES = ("critical", "major", "minor", "info")
SEVERITY_WEIGHT = {"critical": 1.00, "major": 0.85, "minor": 0.30, "info": 0.05}
PARTIAL_FACTOR, UNDETERMINED_PENALTY, DEGRADED_THRESHOLD = 0.5, 0.20, 0.30
# Roles by level, retention by record, cadence in days.
ROLES = {"viewer": 0, "auditor": 1, "admin": 2, "owner": 3}
RETENTION_DAYS = {"document": 90, "passage": 90, "report": 1095, "journal": 180}
CADENCE_DAYS = {"weekly": 7, "monthly": 30, "quarterly": 91}
ALWAYS_REVIEWED = ("37", "35", "22")

APPLICABLE, EXEMPT, VERIFY = "applicable", "exempt", "to_verify"


def lookup(key: Column, table: dict, default=None) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def _typed(facts: Column, path: str, kinds: tuple[str, ...], to: str) -> Column:
    value = F.try_variant_get(facts, path, "variant")
    return F.when(F.schema_of_variant(value).isin(*kinds), F.try_variant_get(facts, path, to))


def strict_int(facts: Column, path: str) -> Column:
    """A whole number of a raw fact; truth values, strings and fractions aren't one."""
    return _typed(facts, path, ("BIGINT",), "bigint")


def strict_bool(facts: Column, path: str) -> Column:
    """A truth value of a raw fact; nothing else is one."""
    return _typed(facts, path, ("BOOLEAN",), "boolean")


def severity_rank(severity: Column) -> Column:
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES)})


def coerce_severity(value: Column) -> Column:
    return F.when(value.isin(*SEVERITIES), value).otherwise("major")


def finding_kind(severity: Column, status: Column) -> Column:
    return F.when(status == "not_applicable", "not_applicable").when(severity.isin("critical", "major"), "non_conformity").otherwise("improvement")


def level(score: Column) -> Column:
    """Bands of a score out of 100."""
    return F.when(score >= 85, "high").when(score >= 70, "satisfactory").when(score >= 50, "partial").when(score >= 30, "low").otherwise("critical")


def _first(*rules: tuple[Column, str]) -> Column:
    """The outcome of the first rule that is true (not false, not null)."""
    (head, outcome), *rest = rules
    return reduce(lambda c, r: c.when(r[0], r[1]), rest, F.when(head, outcome))


def register_rule() -> Column:
    """Article 30: small organisations are exempt unless any of four conditions holds; unknown facts are to verify."""
    no = lambda c: F.col(c).eqNullSafe(F.lit(False))
    known = F.col("occasional").isNotNull() & F.col("risk").isNotNull() & F.col("sensitive_data").isNotNull()
    return _first(
        (F.col("headcount").isNull(), VERIFY),
        (F.col("headcount") >= 250, APPLICABLE),
        (F.col("sensitive_data") | F.col("criminal_data") | F.col("risk"), APPLICABLE),
        (no("occasional"), APPLICABLE),
        (~known, VERIFY),
        (F.lit(True), EXEMPT),
    )


def officer_rule() -> Column:
    """Article 37: public bodies, or large-scale monitoring or sensitive data as a core activity."""
    no = lambda c: F.col(c).eqNullSafe(F.lit(False))
    large = _first(
        (no("core_activity"), EXEMPT),
        (F.col("monitoring"), APPLICABLE),
        (F.col("sensitive_data") | F.col("criminal_data"), APPLICABLE),
        (F.col("core_activity").isNull(), VERIFY),
        (F.lit(True), EXEMPT),
    )
    return (
        F.when(F.col("public_body"), APPLICABLE)
        .when(F.col("sole_professional"), EXEMPT)
        .when(F.col("public_body").isNull(), VERIFY)
        .when(no("large_scale"), EXEMPT)
        .when(F.col("large_scale"), large)
        .otherwise(VERIFY)
    )


def notice_rule(own: str, other: str) -> Column:
    """Articles 13 and 14 mirror each other: collection from the person, or from elsewhere."""
    return _first((F.col(own), APPLICABLE), (F.col(own).eqNullSafe(F.lit(False)) & F.col(other), EXEMPT), (F.lit(True), VERIFY))


#: (framework, article) -> rule; what isn't listed is applicable.
RULES = {
    ("rgpd", 13): lambda: notice_rule("direct_collection", "indirect_collection"),
    ("rgpd", 14): lambda: notice_rule("indirect_collection", "direct_collection"),
    ("rgpd", 30): register_rule,
    ("rgpd", 37): officer_rule,
}


def eligibility(framework: Column, number: Column) -> Column:
    """The decision for a requirement and the profile columns in the same row."""
    code = F.lower(F.trim(framework))
    rules = [((code == f) & (number == n), rule()) for (f, n), rule in RULES.items()]
    return reduce(lambda c, r: c.when(*r), rules[1:], F.when(*rules[0])).otherwise(APPLICABLE)


def observed_verdict(outcome: Column, severity: Column) -> Column:
    """What a finding (or none) says about its article."""
    return (
        F.when(outcome == "out_of_scope", "out_of_scope")
        .when(severity.isNull(), "compliant")
        .when(outcome == "not_applicable", "out_of_scope")
        .when(severity.isin("critical", "major"), "breach")
        .otherwise("compliant")
    )
