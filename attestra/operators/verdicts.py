"""From verified evidence to verdicts and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import rules as R
from attestra.operators import verification as Q

# Which requirement depends on which, by framework and article.
DEPENDENCIES = {
    "rgpd": {38: 37, 39: 37, 36: 35, 41: 40, 43: 42, 45: 44, 46: 44, 47: 44, 48: 44, 49: 44},
    "nis2": {23: 21},
}
# Articles that bind the audited organisation, and those that only define; suffixes of inserted articles.
WHITELIST = {"rgpd": (list(range(5, 50)), [1, 2, 3, 4]), "nis2": ([20, 21, 23, 24, 27, 28, 29, 30], [1, 2, 3, 4, 5, 6])}
INSERTED = ("bis", "ter", "quater", "quinquies", "sexies", "septies")
# Who an obligation is addressed to, by phrases; ties go to the first.
MARKERS = {
    "entity": r"(?i)\b(le responsable du traitement|les responsables du traitement|le sous-traitant|les sous-traitants|les entites essentielles|les entites importantes|l'entreprise|les entreprises|l'organisation)\b",
    "member_state": r"(?i)\b(les etats membres|l'etat membre|chaque etat membre)\b",
    "authority": r"(?i)\b(l'autorite de controle|les autorites de controle|le comite|le controleur europeen|l'autorite competente|les autorites competentes|le groupe de cooperation|le reseau des csirt)\b",
    "commission": r"(?i)\bla commission\b",
}


def audience_by_markers(body: Column) -> Column:
    counts = [F.regexp_count(body, F.lit(p)) for p in MARKERS.values()]
    most = F.greatest(*counts)
    out = F.when(most == 0, "structural")
    for name, count in zip(MARKERS, counts, strict=True):
        out = out.when(count == most, name)
    return out


def audience(framework: Column, reference: Column, number: Column, body: Column) -> Column:
    """entity (auditable), member_state, authority, commission or structural."""
    inserted = F.lit(False)
    for suffix in INSERTED:
        inserted = inserted | F.contains(F.lower(reference), F.lit(suffix))
    out = F.when(framework == "csrd", F.when(inserted, "entity").otherwise("member_state"))
    for code, (binding, defining) in WHITELIST.items():
        out = out.when((framework == code) & number.isNotNull(), F.when(number.isin(binding), "entity").when(number.isin(defining), "structural").otherwise("authority"))
    return out.otherwise(audience_by_markers(body))


def master(framework: Column, number: Column) -> Column:
    """The article that an article depends on."""
    key = F.concat_ws(":", framework, number.cast("string"))
    return R.lookup(key, {f"{f}:{a}": m for f, pairs in DEPENDENCIES.items() for a, m in pairs.items()})


def propagate(verdicts: DataFrame) -> DataFrame:
    """Requirements whose master is out of scope go out of scope too: one step, as the masters stood before.

    verdicts: audit_id, framework, number, outcome, severity, statement, recommendation.
    """
    out = verdicts.filter("outcome = 'not_applicable' and number is not null").select("audit_id", "framework", F.col("number").alias("master")).distinct()
    rows = verdicts.withColumn("master", master(F.col("framework"), F.col("number")))
    rows = rows.join(out.withColumn("_out", F.lit(True)), ["audit_id", "framework", "master"], "left")
    hit = F.col("_out").isNotNull() & (F.col("outcome") != "not_applicable")
    return rows.withColumns(
        {
            "statement": F.when(hit, F.concat(F.lit("Depends on article "), F.col("master").cast("string"), F.lit(", which is out of scope."))).otherwise(F.col("statement")),
            "outcome": F.when(hit, "not_applicable").otherwise(F.col("outcome")),
            "severity": F.when(hit, "info").otherwise(F.col("severity")),
            "recommendation": F.when(~hit, F.col("recommendation")),
            "reclassified": hit,
        }
    ).drop("_out", "master")


def applicability(answers: DataFrame, tolerance: str | None = None) -> DataFrame:
    """applicable, diagnostic for rows (failed, condition_met, applicable_said, quote, needs_proof, document).

    A failed or contradictory answer keeps the article in scope, and so does an
    exclusion whose quotation isn't found, unless the article needs no proof.
    """
    answers = Q.checked(answers, F.array("quote"), F.col("document"), Q.SHORTEST_EXCLUSION, tolerance, "_proof")
    said, diagnostic = gate(*(F.col(c) for c in ("failed", "condition_met", "applicable_said", "needs_proof", "quote")), F.get("_proof", 0)["valid"])
    return answers.withColumns({"diagnostic": diagnostic, "applicable": said | diagnostic.isNotNull()}).drop("_proof")


def gate(failed: Column, condition_met: Column, said: Column, needs_proof: Column, quote: Column, proof: Column) -> tuple[Column, Column]:
    """What the answer says, and why it isn't followed (null if it is)."""
    said = F.coalesce(said, F.lit(True))
    diagnostic = (
        F.when(failed, "no answer")
        .when(condition_met != said, "contradiction")
        .when(said, None)
        .when(~needs_proof, None)
        .when(F.coalesce(F.trim(quote), F.lit("")) == "", "exclusion without quotation")
        .when(~proof, "exclusion quotation not found")
    )
    return said, diagnostic


def exemptions(claims: DataFrame, known: DataFrame, tolerance: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by, article, reference, effect, diagnostic of the claims (article, reference, quote, document) of exemptions.

    Only articles with exemptions that can be judged beforehand are asked about;
    claims about others are nothing, and so are claims without a reference.  A
    claim has an effect if the catalogue knows its reference and a verified
    quotation proves it, otherwise a diagnostic.  ``known`` is broadcast.
    """
    # a catalogue, which goes to the claims: dealt by article, they and their documents would meet in as many tasks as there are articles
    beforehand = known.filter("ex_ante").select("article", "reference", "effect")
    asked = claims.filter(F.coalesce(F.trim("reference"), F.lit("")) != "").join(F.broadcast(beforehand.select("article").distinct()), "article", "left_semi")
    rows = Q.checked(asked.join(F.broadcast(beforehand), ["article", "reference"], "left"), F.array("quote"), F.col("document"), Q.SHORTEST_EXCLUSION, tolerance, "_proof")
    rows = rows.withColumn("diagnostic", exemption_diagnostic(F.col("effect"), F.col("quote"), F.get("_proof", 0)["valid"]))
    return rows.select(*by, "article", "reference", F.when(F.col("diagnostic").isNull(), F.col("effect")).alias("effect"), "diagnostic")


def exemption_diagnostic(effect: Column, quote: Column, valid: Column) -> Column:
    """Why an exemption doesn't hold; null if it does."""
    return F.when(effect.isNull(), "unknown exemption").when(F.coalesce(F.trim(quote), F.lit("")) == "", "exemption without quotation").when(~valid, "exemption quotation not found")


def article_verdicts(evidence: DataFrame, exemptions: DataFrame, diagnostics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row an article (of each ``by``: a document, say): verdict, credit, confidence, review.

    evidence: article, criticality, blocking, claimed, verified, retained.
    exemptions: article, reference, effect, diagnostic of :func:`exemptions`.
    diagnostics: article, n.
    Compliant only if there are blocking elements and all are retained; an
    exemption turns a breach into compliant or out of scope, the first
    reference's if several hold.  What is no breach isn't asked for exemptions,
    so their diagnostics don't count there.
    """
    keys = [*by, "article"]
    n = evidence.groupBy(*keys, "criticality").agg(
        F.count_if("blocking").alias("blocking"),
        F.count_if(F.col("blocking") & F.col("retained")).alias("proven"),
        F.count_if(F.col("claimed") & ~F.col("verified")).alias("unverified"),
        F.count_if(~F.col("blocking") & ~F.col("retained")).alias("missing_minor"),
    )
    first = exemptions.groupBy(*keys).agg(F.expr("min_by(effect, reference) FILTER (WHERE effect IS NOT NULL)").alias("effect"), F.count("diagnostic").alias("_unheld"))
    rows = n.join(first, keys, "left").join(diagnostics, keys, "left")
    proven = all_proven(F.col("blocking"), F.col("proven"))
    rows = rows.withColumn("verdict", verdict(proven, F.col("effect")))
    rows = rows.withColumn("_diagnostics", F.coalesce("n", F.lit(0)) + F.when(~proven, F.coalesce("_unheld", F.lit(0))).otherwise(0))
    rows = rows.withColumn("confidence", confidence(F.col("article"), F.col("verdict"), F.col("unverified"), F.col("_diagnostics"), F.col("missing_minor")))
    return rows.withColumns({"credit": credit(F.col("verdict"), F.col("proven"), F.col("blocking")), "review": review(F.col("confidence"), F.col("_diagnostics"))}).drop("effect", "n", "_unheld", "_diagnostics")


def all_proven(blocking: Column, proven: Column) -> Column:
    return (blocking > 0) & (proven == blocking)


def verdict(proven: Column, effect: Column) -> Column:
    return F.when(proven | (effect == "compliant"), "compliant").when(effect.isNotNull(), "out_of_scope").otherwise("breach")


def confidence(article: Column, verdict: Column, unverified: Column, diagnostics: Column, missing_minor: Column) -> Column:
    found = 0.9 - 0.2 * F.least(unverified, F.lit(3)) - 0.1 * F.least(diagnostics, F.lit(3))
    found = found - F.when(verdict == "compliant", 0.05 * missing_minor).otherwise(0.0)
    found = F.greatest(F.lit(0.0), F.least(F.lit(1.0), found))
    return F.round(F.when(article.isin(*R.ALWAYS_REVIEWED), F.least(found, F.lit(0.6))).otherwise(found), 4)


def review(confidence: Column, diagnostics: Column) -> Column:
    """Why a person has to look at a verdict; null if nobody has to."""
    return F.when(confidence < 0.70, "low confidence").when(diagnostics > 0, "diagnostics")


def credit(verdict: Column, proven: Column, blocking: Column) -> Column:
    """1 if compliant; a breach has the share of proven blocking elements, half at most."""
    partial = F.when(blocking > 0, F.least(F.lit(0.5), proven / blocking)).otherwise(0.0)
    return F.when(verdict == "compliant", 1.0).when(verdict == "breach", partial).otherwise(0.0)


def heuristic(best: Column) -> Column:
    """outcome, severity, confidence from the best cosine distance (null: no passage)."""
    make = lambda o, s, c: F.struct(F.lit(o).alias("outcome"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"))
    return F.when(best.isNull(), make("no", "major", 0.4)).when(best < 0.25, make("yes", "info", 0.6)).when(best < 0.45, make("partial", "minor", 0.5)).otherwise(make("no", "major", 0.45))


def findings(verdicts: DataFrame) -> DataFrame:
    """What is stored: nothing for met requirements, a note without evidence for what isn't applicable, else an open finding."""
    na = F.col("outcome") == "not_applicable"
    cut = lambda c, n: F.left(F.col(c), F.lit(n))
    severity = F.when(na, "info").otherwise(R.coerce_severity(F.col("severity")))
    status = F.when(na, "not_applicable").otherwise("open")
    rows = verdicts.filter(F.coalesce(F.col("outcome"), F.lit("undetermined")) != "yes")
    return rows.select(
        "audit_id",
        "reference",
        F.left(F.concat_ws(" — ", "reference", "title"), F.lit(300)).alias("title"),
        cut("statement", 4000).alias("description"),
        F.when(~na, F.nullif(cut("recommendation", 4000), F.lit(""))).alias("recommendation"),
        F.when(~na, cut("evidence", 4000)).alias("evidence"),
        severity.alias("severity"),
        status.alias("status"),
        R.finding_kind(severity, status).alias("kind"),
        F.when(F.col("source") == "llm", F.col("model")).otherwise(F.coalesce("source", F.lit("heuristic"))).alias("model_used"),
        F.when(~na, F.col("document_id")).alias("document_id"),
    )
