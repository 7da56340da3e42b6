"""The grid of audited articles: what each has to prove, and what exempts from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.literal import Literal

# The articles of the grid in order, criticality (1 to 5), and whether leaving one out takes a proof.
ARTICLES = Literal(
    "ordering INTEGER, article VARCHAR, criticality INTEGER, needs_proof BOOLEAN",
    (
        (1, "5", 4, True), (2, "6", 4, True), (3, "7", 3, True), (4, "9", 5, True), (5, "12", 3, True), (6, "13", 3, True),
        (7, "14", 2, True), (8, "15-22", 3, True), (9, "22", 4, True), (10, "25", 2, True), (11, "28", 4, True), (12, "30", 4, True),
        (13, "32", 5, True), (14, "33", 4, True), (15, "34", 2, True), (16, "35", 4, True), (17, "37", 3, False), (18, "44-49", 5, True),
    ),
)
# The elements that prove each article, and whether they are blocking.
ELEMENTS = (
    ("5", "finalites", True), ("5", "minimisation", False), ("5", "duree_conservation", True), ("5", "exactitude", False),
    ("6", "base_identifiee", True), ("6", "adequation", False), ("6", "interet_legitime_balance", False),
    ("7", "preuve_consentement", True), ("7", "retrait", True), ("7", "libre_specifique", False),
    ("9", "fondement_derogatoire", True), ("9", "garanties_renforcees", True),
    ("12", "canal_exercice", True), ("12", "delai_reponse", True), ("12", "procedure_interne", True), ("12", "gratuite", False), ("12", "verification_identite", False),
    ("13", "identite_responsable", True), ("13", "coordonnees_dpo", False), ("13", "finalites_et_base", True), ("13", "destinataires", True), ("13", "duree_conservation", True), ("13", "liste_droits", True), ("13", "droit_reclamation", True), ("13", "transferts_hors_ue", False),
    ("14", "source_donnees", True), ("14", "categories_donnees", True), ("14", "delai_information", True), ("14", "mentions_communes", True),
    ("15-22", "acces_portabilite", True), ("15-22", "effacement", True), ("15-22", "opposition", True), ("15-22", "tracabilite_demandes", False),
    ("22", "fondement_autorise", True), ("22", "intervention_humaine", True), ("22", "logique_sous_jacente", True),
    ("25", "by_design", True), ("25", "by_default", True),
    ("28", "contrat_ecrit", True), ("28", "mentions_obligatoires", True), ("28", "sous_traitance_ulterieure", False), ("28", "liste_sous_traitants", False),
    ("30", "existence_support", True), ("30", "liste_traitements", True), ("30", "mentions_par_traitement", True), ("30", "mesures_securite", False), ("30", "mise_a_jour", True),
    ("32", "controle_acces", True), ("32", "chiffrement", True), ("32", "sauvegardes", True), ("32", "tracabilite", True), ("32", "revue_securite", False),
    ("33", "procedure_ecrite", True), ("33", "delai_72h", True), ("33", "destinataire_cnil", True), ("33", "registre_violations", True), ("33", "role_responsable", False),
    ("34", "critere_risque_eleve", True), ("34", "modalite_communication", True),
    ("35", "aipd_realisee", True), ("35", "contenu_aipd", True), ("35", "avis_dpo", False),
    ("37", "designation", True), ("37", "coordonnees_publiees", True), ("37", "independance_moyens", False),
    ("44-49", "identification_transferts", True), ("44-49", "outil_transfert", True), ("44-49", "mesures_supplementaires", False),
)
# Exemptions by article: references, what they do, and whether they can be judged before an incident.
EXEMPTIONS = {
    "9": ([f"9(2)({x})" for x in "abcdefghij"], "compliant", True),
    "14": ([f"14(5)({x})" for x in "abcd"], "out_of_scope", True),
    "30": (["30(5)"], "out_of_scope", False),
    "34": ([f"34(3)({x})" for x in "abc"], "out_of_scope", False),
}

ELEMENT_ROWS = Literal(
    "article VARCHAR, position INTEGER, element VARCHAR, blocking BOOLEAN",
    tuple((article, sum(x[0] == article for x in ELEMENTS[:i]), element, blocking) for i, (article, element, blocking) in enumerate(ELEMENTS)),
)
EXEMPTION_ROWS = Literal("article VARCHAR, reference VARCHAR, effect VARCHAR, ex_ante BOOLEAN", tuple((a, r, effect, ex_ante) for a, (refs, effect, ex_ante) in EXEMPTIONS.items() for r in refs))


def grid(spark: SparkSession) -> DataFrame:
    """One row an article, of :data:`SHAPE`, without texts: :func:`described` puts them in, :func:`load` reads whole grids."""
    elements = ELEMENT_ROWS.df(spark).groupBy("article").agg(F.array_sort(F.collect_list(F.struct("position", "element", "blocking"))).alias("elements"))
    exemptions = EXEMPTION_ROWS.df(spark).groupBy("article").agg(F.array_sort(F.collect_list(F.struct("reference", "effect", "ex_ante"))).alias("exemptions"))
    rows = ARTICLES.df(spark).join(elements, "article").join(exemptions, "article", "left")
    nothing = F.lit(None).cast("string")
    element = lambda e: F.struct(e["element"].alias("element"), nothing.alias("title"), F.array().cast("array<string>").alias("hints"), e["blocking"].alias("blocking"))
    exemption = lambda e: F.struct(e["reference"].alias("reference"), nothing.alias("title"), nothing.alias("condition"), e["effect"].alias("effect"), e["ex_ante"].alias("ex_ante"))
    listed = F.coalesce(F.transform("exemptions", exemption), F.array())
    return rows.select("ordering", "article", nothing.alias("title"), "criticality", nothing.alias("condition"), "needs_proof", nothing.alias("note"), F.transform("elements", element).alias("elements"), listed.alias("exemptions"))


#: A grid's columns, with titles, conditions, hints and notes.
SHAPE = (
    "ordering int, article string, title string, criticality int, condition string, needs_proof boolean, note string,"
    "elements array<struct<element:string,title:string,hints:array<string>,blocking:boolean>>,"
    "exemptions array<struct<reference:string,title:string,condition:string,effect:string,ex_ante:boolean>>"
)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A grid of one's own, from JSON in :data:`SHAPE`."""
    return spark.read.schema(SHAPE).json(path, multiLine=True)


def described(known: DataFrame, articles: DataFrame, elements: DataFrame) -> DataFrame:
    """``known`` with the texts of articles (article, title, condition, note) and elements (article, element, title, hints); what they lack stays as it was."""
    texts = elements.groupBy("article").agg(F.map_from_entries(F.collect_list(F.struct("element", F.struct("title", "hints")))).alias("_texts"))
    rows = known.join(articles.select("article", *[F.col(c).alias(f"_{c}") for c in ("title", "condition", "note")]), "article", "left").join(texts, "article", "left")

    def told(e: Column) -> Column:
        text = F.try_element_at("_texts", e["element"])
        return F.struct(e["element"].alias("element"), F.coalesce(text["title"], e["title"]).alias("title"), F.coalesce(text["hints"], e["hints"]).alias("hints"), e["blocking"].alias("blocking"))

    fresh = {c: F.coalesce(f"_{c}", c) for c in ("title", "condition", "note")} | {"elements": F.transform("elements", told)}
    return rows.withColumns(fresh).select(*known.columns)


def blocking(elements: Column) -> Column:
    return F.filter(elements, lambda e: e["blocking"])


def ex_ante(exemptions: Column) -> Column:
    """The exemptions that an audit of documents can judge."""
    return F.filter(exemptions, lambda e: e["ex_ante"])


def looked_up(rows: DataFrame, known: DataFrame, key: str = "article") -> DataFrame:
    """``rows`` with the grid's columns; an article that the grid doesn't have fails."""
    marked = rows.join(known.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("article not in the grid: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return marked.withColumn(key, F.when(F.col("_there"), F.col(key)).otherwise(missing.cast(dict(rows.dtypes)[key]))).drop("_there")


def summary(known: DataFrame) -> DataFrame:
    """article, criticality, n_elements, n_blocking, n_exemptions, n_ex_ante."""
    size = lambda c: F.size(c).cast("int")
    return known.select("article", "criticality", size("elements").alias("n_elements"), size(blocking(F.col("elements"))).alias("n_blocking"), size("exemptions").alias("n_exemptions"), size(ex_ante(F.col("exemptions"))).alias("n_ex_ante"))


def auditable(requirements: DataFrame, limit: int | None = None) -> DataFrame:
    """The current version's auditable requirements in order, the first ``limit`` of them if given."""
    rows = requirements.filter(F.col("is_current") & F.col("is_auditable")).orderBy("ordering")
    return rows if limit is None else rows.limit(limit)
