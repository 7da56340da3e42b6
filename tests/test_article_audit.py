"""The audit of a grid's articles: contexts, the gate, evidence, exemptions, and a client that is asked."""

import json

import pytest
from attestra.operators import catalogue, grid
from attestra.plans import article_audit as plan
from pyspark.sql import functions as F

TEXT = "The register of processing activities is kept and updated every month by the officer. Backups are encrypted and tested twice a year. Nothing else is said about transfers abroad here."


@pytest.fixture
def known(spark):
    element = lambda key, title, blocking: {"element": key, "title": title, "hints": ["register", "officer"], "blocking": blocking}
    ways = [{"reference": "9(2)(a)", "title": "consent", "condition": "it was given", "effect": "compliant", "ex_ante": True}]
    later = [{"reference": "30(5)", "title": "small", "condition": None, "effect": "out_of_scope", "ex_ante": False}]
    rows = [
        (1, "9", "Special data", 5, "sensitive data is processed", True, None, [element("basis", "derogation foundation relied", True)], ways),
        (2, "30", "Register of activities", 4, "the organisation processes data", True, "keep it short", [element("register", "register activities updated", True), element("tests", "backups encrypted tested", False)], later),
        (3, "37", "Officer", 3, "a public body", False, None, [element("officer", "publication designation", True)], []),
    ]
    return spark.createDataFrame(rows, grid.SHAPE)


@pytest.fixture
def docs(spark):
    return plan.slices(spark.createDataFrame([(1, TEXT), (2, ""), (3, None), (4, "x" * 1500)], "doc_id long, text string"))


def test_offline_client_proves_what_sentences_say(docs, known):
    found = {(r.doc_id, r.article): r for r in plan.audit(docs, known).collect()}
    assert set(found) == {(d, a) for d in (1, 4) for a in ("9", "30", "37")}  # a document without text has no passage
    assert found[1, "30"].verdict == "compliant" and found[1, "30"].credit == 1.0 and found[1, "30"].confidence == 0.9 and found[1, "30"].review is None
    assert [p.element for p in found[1, "30"].proofs if p.verified] == ["register", "tests"]
    assert found[1, "9"].verdict == "breach" and found[1, "9"].to_document == ["basis"] and found[4, "30"].verdict == "breach"
    assert found[1, "37"].confidence == 0.6 and found[1, "37"].review == "low confidence"
    assert plan.audit(docs.limit(0), known).count() == 0


def answers(question, applicable=None, evidence=None, exemption=None):
    return json.dumps({"applicability": applicable, "evidence": evidence or [], "exemption": exemption or {}}[question])


def client(**told):
    def ask(system, user):
        question = "applicability" if "whether an article applies" in system else "evidence" if "look for proof" in system else "exemption"
        article = user.split("\n")[0].split()[1]
        if told.get("fails") == question:
            raise RuntimeError("no answer")
        return answers(question, **told.get(article, {}))

    return ask


SAID = {"condition_met": True, "applicable": True}


CASES = [
    ("9", {"applicable": {"condition_met": False, "applicable": False, "quotation": "Nothing else is said about transfers"}}, "out_of_scope", []),
    ("9", {"applicable": {"condition_met": False, "applicable": False, "quotation": "We never process anything of the kind"}}, "breach", ["exclusion quotation not found"]),
    ("9", {"applicable": {"condition_met": False, "applicable": False}}, "breach", ["exclusion without quotation"]),
    ("9", {"applicable": {"condition_met": True, "applicable": False}}, "breach", ["contradiction"]),
    ("37", {"applicable": {"condition_met": False, "applicable": False}}, "out_of_scope", []),
    ("30", {"applicable": SAID, "evidence": [{"element": "register", "found": True, "quotations": ["The register of processing activities is kept"]}]}, "compliant", []),
    ("30", {"applicable": SAID, "evidence": [{"element": "register", "found": True, "quotations": ["The register of processing activities is kept", "Invented words that nobody has written"]}]}, "breach", ["register: not found"]),
    ("30", {"applicable": SAID, "evidence": [{"element": "register", "found": True}]}, "breach", ["register: no quotation"]),
    ("30", {"applicable": SAID, "evidence": [{"element": "register", "found": True, "quotation": "The register"}]}, "breach", ["register: too short"]),
    ("9", {"applicable": SAID, "exemption": {"reference": "9(2)(a)", "quotation": "Backups are encrypted and tested"}}, "compliant", []),
    ("9", {"applicable": SAID, "exemption": {"reference": "9(2)(z)", "quotation": "Backups are encrypted and tested"}}, "breach", ["unknown exemption"]),
    ("9", {"applicable": SAID, "exemption": {"reference": "9(2)(a)"}}, "breach", ["exemption without quotation"]),
    ("9", {"applicable": SAID, "exemption": {"reference": "9(2)(a)", "quotation": "All of them have consented in writing"}}, "breach", ["exemption quotation not found"]),
    ("30", {"applicable": SAID, "exemption": {"reference": "30(5)", "quotation": "Backups are encrypted and tested"}}, "breach", []),  # not to be judged beforehand, so not asked
    ("9", {"applicable": ["not an object"]}, "breach", []),
]


def test_answers_of_a_client(spark, known):
    """Every case is a document of its own, which says its number at the end."""
    docs = plan.slices(spark.createDataFrame([(i, f"{TEXT} Case {i}.") for i in range(len(CASES))], "doc_id long, text string"))

    def ask(system, user):
        article, told, *_ = CASES[int(user.rsplit("Case ", 1)[1].split(".")[0])]
        return client(**{article: told})(system, user)

    found = {(r.doc_id, r.article): r for r in plan.audit(docs, known, plan.model(ask)).collect()}
    assert len(found) == 3 * len(CASES)
    for i, (article, _, verdict, diagnostics) in enumerate(CASES):
        assert (found[i, article].verdict, found[i, article].diagnostics) == (verdict, diagnostics), CASES[i]


def test_client_that_fails_keeps_articles_in_scope(docs, known):
    found = plan.audit(docs, known, plan.model(client(fails="applicability"), attempts=1)).collect()
    assert {(r.verdict, tuple(r.diagnostics)) for r in found} == {("breach", ())}


def test_condition_adds_passages_to_the_context(spark, known):
    text = ("register officer " * 42)[:700] + ("sensitive data is processed " * 30)[:700] + "nothing " * 100
    row = {r.article: r for r in plan.contexts(plan.slices(spark.createDataFrame([(1, text)], "doc_id long, text string")), known).collect()}
    assert row["30"].consulted == [0] and row["30"].context == [0, 1] and row["37"].context == [0]


def test_sections_are_passages_too(spark, known):
    rows = plan.sections(spark.createDataFrame([(1, "# Register\n\n" + TEXT), (2, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, [p.section for p in r.passages]) for r in rows] == [(1, ["# Register"])]


def test_grid_with_texts(spark):
    known = grid.described(grid.grid(spark), spark.createDataFrame([("5", "Principles", "always", None)], "article string, title string, condition string, note string"), spark.createDataFrame([("5", "finalites", "purposes", ["why"])], "article string, element string, title string, hints array<string>"))
    first = known.filter("article = '5'").first()
    assert (first.title, first.condition, first.elements[0].title, first.elements[0].hints, first.elements[1].title) == ("Principles", "always", "purposes", ["why"], None)
    assert known.count() == 18 and known.schema.simpleString() == grid.grid(spark).schema.simpleString()


def test_catalogues_are_sent_only_if_they_are_small(spark):
    rows, small = spark.range(5), spark.range(3).withColumnRenamed("id", "n")
    assert catalogue.paired(rows, small).count() == 15 and catalogue.paired(rows, small, most=2).count() == 15
    plan_of = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint (strategy=broadcast)" in plan_of(catalogue.paired(rows, small)) and "ResolvedHint" not in plan_of(catalogue.paired(rows, small, most=2))
    assert catalogue.paired(rows, small.filter(F.col("n") < 0)).count() == 0
