"""Rules and operators on small tables made by hand."""

import json

import pytest
from attestra.functions import rules as R
from attestra.functions import text as T
from attestra.operators import chunking, lifecycle, quotations, records, retrieval, verdicts, verification
from attestra.operators.tenancy import TenantScope
from attestra.sources import readers, sinks
from pyspark.sql import functions as F

FACTS = ["headcount", "sensitive_data", "criminal_data", "risk", "occasional", "public_body", "sole_professional", "large_scale", "core_activity", "monitoring", "direct_collection", "indirect_collection"]


def decide(spark, number, framework="rgpd", **facts):
    schema = ", ".join(f"{f} {'int' if f == 'headcount' else 'boolean'}" for f in FACTS)
    row = spark.createDataFrame([tuple(facts.get(f) for f in FACTS)], schema)
    return row.select(R.eligibility(F.lit(framework), F.lit(number)).alias("d")).first().d


@pytest.mark.parametrize(
    ("number", "facts", "expected"),
    [
        (30, {}, "to_verify"),
        (30, {"headcount": 250}, "applicable"),
        (30, {"headcount": 249}, "to_verify"),
        (30, {"headcount": 10, "risk": True}, "applicable"),
        (30, {"headcount": 10, "occasional": False}, "applicable"),
        (30, {"headcount": 10, "occasional": True, "risk": False, "sensitive_data": False}, "exempt"),
        (30, {"headcount": 10, "occasional": True, "risk": False, "sensitive_data": False, "criminal_data": True}, "applicable"),
        (37, {}, "to_verify"),
        (37, {"public_body": True}, "applicable"),
        (37, {"sole_professional": True}, "exempt"),
        (37, {"public_body": False}, "to_verify"),
        (37, {"public_body": False, "large_scale": False}, "exempt"),
        (37, {"public_body": False, "large_scale": True}, "to_verify"),
        (37, {"public_body": False, "large_scale": True, "core_activity": False}, "exempt"),
        (37, {"public_body": False, "large_scale": True, "monitoring": True}, "applicable"),
        (37, {"public_body": False, "large_scale": True, "core_activity": True}, "exempt"),
        (13, {"direct_collection": True}, "applicable"),
        (13, {"direct_collection": False, "indirect_collection": True}, "exempt"),
        (14, {"direct_collection": True, "indirect_collection": False}, "exempt"),
        (14, {"direct_collection": True}, "to_verify"),
        (32, {}, "applicable"),
    ],
)
def test_eligibility(spark, number, facts, expected):
    assert decide(spark, number, **facts) == expected


def test_eligibility_of_other_frameworks(spark):
    assert decide(spark, 30, framework="nis2") == "applicable"
    assert decide(spark, 37, framework=" RGPD ", sole_professional=True) == "exempt"


def test_45_of_99_articles_are_auditable(spark):
    rows = spark.range(1, 100).select(F.concat(F.lit("Article "), F.col("id").cast("string")).alias("reference"))
    who = verdicts.audience(F.lit("rgpd"), F.col("reference"), T.article_number(F.col("reference")), F.lit(""))
    assert rows.filter(who == "entity").count() == 45


def test_propagation_is_one_step(spark):
    rows = [(1, "rgpd", 37, "not_applicable", "info", "", ""), (1, "rgpd", 39, "no", "major", "", "do"), (1, "rgpd", 30, "no", "major", "", "do"), (2, "rgpd", 39, "no", "major", "", "do")]
    found = verdicts.propagate(spark.createDataFrame(rows, "audit_id long, framework string, number int, outcome string, severity string, statement string, recommendation string"))
    assert {(r.audit_id, r.number) for r in found.filter("reclassified").collect()} == {(1, 39)}


def test_verification_tiers(spark):
    rows = [("The Régister is kept; up to date, always.", "the register is kept up to date"), ("abc", "too short"), ("abc", " "), ("abc", None), ("x" * 50, "y" * 30)]
    found = spark.createDataFrame(rows, "d string, q string").select(verification.verify(F.col("q"), F.col("d")).alias("v")).collect()
    assert [r.v.reason for r in found] == ["exact", "too short", "empty", "empty", "not found"]
    assert [r.v.position for r in found] == [0, -1, -1, -1, -1]


def test_quotations_and_answers(spark):
    row = spark.createDataFrame([(["a", " ", "b"], "c"), (["a"], "a"), (None, "z"), (None, None)], "m array<string>, s string")
    assert [r[0] for r in row.select(verification.quotations(F.col("m"), F.col("s"))).collect()] == [["c", "a", "b"], ["a"], ["z"], []]
    answers = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "element string, position int, quote string")
    assert verification.latest_answers(answers, ["element"]).first().quote == "new"


def test_tolerant_json(spark):
    texts = ['{"a": 1}', '```json\n{"a": 2}\n```', 'Sure: {"a": 3} done', "nothing", "[1, 2]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(F.try_variant_get(T.json_object(F.col("t")), "$.a", "int")).collect()] == [1, 2, 3, None, None]
    assert df.filter(T.json_value(F.col("t")).isNotNull()).count() == 4


def test_passages_keep_offsets_and_sections():
    text = "Intro line\n\nMore.\n\n# Security\n\n" + "Encrypted data. " * 200 + "\n\n" + "x" * 3000 + "\n\n2. Access\n\nNobody gets in."
    found = chunking.passages(text, repeat_tail=False)
    assert all(text[s:e] == t for _, t, _, s, e, _ in found)
    assert [f[0] for f in found] == [f"p{i:03d}" for i in range(1, len(found) + 1)]
    assert {"(preamble)", "# Security", "2. Access"} == {f[2] for f in found}
    assert chunking.passages("  ") == [] and chunking.passages(None) == []


def test_oversized_paragraph_repeats_its_tail():
    paragraph = "word " * 520  # between target and limit
    assert len(chunking.passages(paragraph.strip())) == 2
    assert len(chunking.passages(paragraph.strip(), repeat_tail=False)) == 1


def test_empty_texts_have_no_chunks(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "abc")], "doc_id int, text string")
    assert chunking.chunk_rows(df, chunking.hard_split(F.col("text"))).collect() == [(3, 0, "abc")]
    assert [r.doc_id for r in chunking.chunk_rows(df, chunking.greedy_chunks(F.col("text"))).collect()] == [3]


@pytest.mark.parametrize(("outcomes", "is_open"), [("FFF", True), ("FFSFF", False), ("FFSFFF", True), ("SSS", False)])
def test_breaker(spark, outcomes, is_open):
    df = spark.createDataFrame([("a", i, o == "F") for i, o in enumerate(outcomes)], "k string, i int, failed boolean")
    assert lifecycle.breaker(df, "k", ["i"]).orderBy(F.desc("i")).first().open is is_open


def test_lexical_fallback_gives_first_passages(spark):
    passages = spark.createDataFrame([(1, 0, "nothing here"), (1, 1, "nor here"), (2, 0, "encryption encryption"), (2, 1, "none")], "doc_id int, position int, body string")
    asked = spark.createDataFrame([("r", "Encryption of it")], "requirement string, query string")
    found = {(r.doc_id, r.position) for r in retrieval.lexical_topk(passages, asked, F.lit(1)).collect()}
    assert found == {(1, 0), (2, 0)}


def test_context_and_fallback(spark):
    a = spark.createDataFrame([(1, "p1")], "query_id int, id string")
    b = spark.createDataFrame([(1, "p1"), (1, "p2"), (2, "p3")], "query_id int, id string")
    assert {(r.query_id, r.id, r.part) for r in retrieval.context(a, b).collect()} == {(1, "p1", 1), (1, "p2", 2), (2, "p3", 2)}
    assert {(r.query_id, r.id) for r in retrieval.with_fallback(a, b).collect()} == {(1, "p1"), (2, "p3")}


def test_tenant_scope(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "tenant_id int, v string")
    scope = TenantScope(1)
    assert [r.v for r in scope.read(df).collect()] == ["a"]
    assert [r.v for r in scope.foreign(df).collect()] == ["b"]
    with pytest.raises(Exception, match="another tenant"):
        scope.checked(df).collect()
    for nobody in (None, " "):
        with pytest.raises(ValueError, match="tenant"):
            TenantScope(nobody)


def test_cascade_and_null(spark):
    parents = spark.createDataFrame([(1, True), (2, False)], "k int, gone boolean")
    children = spark.createDataFrame([(10, 1), (11, 2)], "c int, k int")
    assert [r.c for r in records.delete_cascading(parents, children, F.col("gone"), "k")[1].collect()] == [11]
    assert {(r.c, r.k) for r in records.delete_cascading(parents, children, F.col("gone"), "k", set_null=True)[1].collect()} == {(10, None), (11, 2)}


def test_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/01_a.txt").write_text("hello\nworld")
    (tmp_path / "t/02_b.txt").write_text("bye")
    assert {(r.name, r.text) for r in readers.texts(spark, str(tmp_path / "t")).collect()} == {("01_a.txt", "hello\nworld"), ("02_b.txt", "bye")}
    assert readers.texts(spark, str(tmp_path / "t"), "02").count() == 1
    found = readers.extract_text(readers.blobs(spark, str(tmp_path / "t"))).collect()
    assert {r.text for r in found} == {"hello\nworld", "bye"}
    truth = {"version": "1", "cas": [{"fichier": "a", "description": "", "score_attendu": [10, 20.5], "verdicts_attendus": {"15-22": "conforme", "30": "manquement"}, "jamais_exclure": ["30"]}]}
    (tmp_path / "truth.json").write_text(json.dumps(truth))
    rows = readers.ground_truth(spark, str(tmp_path / "truth.json")).collect()
    assert {(r.article, r.expected, r.never_exclude, r.low, r.high) for r in rows} == {("15-22", "compliant", False, 10.0, 20.5), ("30", "breach", True, 10.0, 20.5)}
    notes = {"_reading": {}, "d": {"profil": "p", "score_attendu": [1, 2], "articles": {"5": {"verdict": "tolere", "motif": "m"}}}}
    (tmp_path / "notes.json").write_text(json.dumps(notes))
    assert [(r.document, r.article, r.expected, r.tolerated) for r in readers.annotations(spark, str(tmp_path / "notes.json")).collect()] == [("d", "5", "tolerated", True)]
    (tmp_path / "h").mkdir()
    (tmp_path / "h/short.html").write_text("<p>x</p>")
    (tmp_path / "h/long.html").write_text("<p>x</p>" * 4000)
    assert [r.name for r in readers.regulations(spark, str(tmp_path / "h")).collect()] == ["long.html"]


def test_model_is_asked_once_and_stops(spark):
    prompts = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b")], "system string, user string")
    found = readers.evaluate(prompts, lambda system, user: user.upper())
    assert sorted(r.answer for r in found.collect()) == ["A", "B"]

    def broken(system, user):
        raise RuntimeError("down")

    many = spark.createDataFrame([("s", str(i)) for i in range(8)], "system string, user string").coalesce(1)
    errors = [r.error for r in readers.evaluate(many, broken, attempts=1, failures=2).collect()]
    assert all(errors) and any("breaker" in e for e in errors)


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    sinks.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    sinks.append(spark.createDataFrame([("d", 3)], "v string, k int"), str(tmp_path / "log"))
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    verdict = spark.createDataFrame([("doc", "5", "breach")], "document string, article string, verdict string")
    report = sinks.json_report(spark.createDataFrame([(0.5,)], "recall double"), verdict).first().report
    assert json.loads(report)["verdicts"] == [{"article": "5", "verdict": "breach"}]


def test_every_place_of_a_piece_is_tried(spark):
    quote = "alpha beta gamma delta epsilon zeta eta theta iota"
    decoy = "alpha beta gamma wrong words follow here in this part "
    odd = "".join(c if i % 9 else "#" for i, c in enumerate(quote, 1))  # no twelve characters are whole
    assert quotations.Document(decoy * 50 + quote.replace("delta", "delto") + " end").find(quote) == (1 - 1 / len(quote), len(decoy) * 50)
    assert quotations.Document("x " * 300 + odd + " end").find(quote) == (1 - 5 / len(quote), 600)
    assert verification.closest_window(quote, "1234567890 " * 40)[0] < 0.3 and verification.closest_window("", "a") == (0.0, -1)
    assert verification.closest_window(quote, "start " + quote.replace("delta", "delto") + " and much more follows here")[0] < 0.9  # margins keep it down
    rows = [(0, "the quick brown fox jumps over the lazy dog, twice", ["the quick brown fox jumps over", "the quick brawn fox jumps over", "short", " ", "nothing of the kind is in the text"])]
    df = spark.createDataFrame(rows, "i int, d string, q array<string>")
    found = verification.checked(df, F.col("q"), F.col("d"), tolerance="edits").first().checks
    assert [c.reason for c in found] == ["exact", "approximate", "too short", "empty", "not found"] and [c.valid for c in found] == [True, True, False, False, False]
    assert [c.reason for c in verification.checked(df, F.col("q"), F.col("d")).first().checks] == ["exact", "not found", "too short", "empty", "not found"]


def test_grid_has_18_articles(spark):
    from attestra.operators import grid

    known = grid.grid(spark)
    rows = {r.article: r for r in grid.summary(known).collect()}
    assert len(rows) == 18 and (rows["13"].n_elements, rows["13"].n_blocking) == (8, 6) and (rows["9"].n_exemptions, rows["9"].n_ex_ante) == (10, 10)
    assert (rows["34"].n_exemptions, rows["34"].n_ex_ante) == (3, 0) and known.filter("not needs_proof").first().article == "37"
    with pytest.raises(Exception, match="article not in the grid: 99"):
        grid.looked_up(spark.createDataFrame([("99",)], "article string"), known).collect()


def test_grid_from_a_file(spark, tmp_path):
    from attestra.operators import grid

    own = [{"ordering": 1, "article": "1", "title": "t", "criticality": 2, "needs_proof": True, "elements": [{"element": "a", "blocking": True, "hints": ["x"]}], "exemptions": []}]
    (tmp_path / "grid.json").write_text(json.dumps(own))
    assert grid.summary(grid.load(spark, str(tmp_path / "grid.json"))).first().asDict() == {"article": "1", "criticality": 2, "n_elements": 1, "n_blocking": 1, "n_exemptions": 0, "n_ex_ante": 0}


def test_client_waits_refuses_and_remembers(spark):
    prompts = spark.createDataFrame([("s", "a"), ("s", "b")], "system string, user string").coalesce(1)

    def client(system, user):
        if user == "a":
            raise readers.Refused("no")
        return user * 2

    found = {r.answer: r for r in readers.evaluate(prompts, client, "m", 0.0).collect()}
    assert found[None].error.startswith("Refused") and found["bb"].cached is False
    cache = spark.createDataFrame([(found["bb"].prompt_hash, "known")], "prompt_hash string, answer string")
    again = {r.answer: r.cached for r in readers.evaluate(prompts, client, "m", 0.0, cache=cache).collect()}
    assert again == {None: False, "known": True}
    assert not readers.evaluate(prompts, client, "m", 0.5, cache=cache).filter("cached").count()  # another temperature is another prompt
    late = [r.error for r in readers.evaluate(prompts, client, deadline=-1.0).collect()]
    assert late == ["not asked: deadline"] * 2


def test_prompts_quote_the_document(spark):
    from attestra.operators import grid, prompts

    docs = spark.createDataFrame([(1, "[p1 · s]\ntext")], "doc_id int, excerpts string")
    rows = prompts.prompts(docs, grid.grid(spark)).collect()
    kinds = {k: sum(r.kind == k for r in rows) for k in prompts.SYSTEM}
    assert kinds == {"applicability": 18, "evidence": 18, "exemption": 2}
    asked = next(r.user for r in rows if r.kind == "evidence" and r.article == "5")
    assert "- finalites (blocking)\n- minimisation\n" in asked and spark.createDataFrame([(asked,)], "p string").select(T.quoted_body(F.col("p"))).first()[0] == "[p1 · s]\ntext"


def test_lockouts_count_in_event_order(spark, tmp_path):
    from attestra.streaming import limits

    base = [(7, f"2024-01-01 00:0{i}:00", i, True) for i in range(6)] + [(8, "2024-01-01 00:00:30", 20, False)]
    path = str(tmp_path / "events")
    for part in (base[3:], base[:3], [(9, "2024-02-01 00:00:00", 99, False)]):  # the later ones come first
        spark.createDataFrame(part, "user_id long, ts string, event_id long, failed boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)
    stream = limits.event_stream(spark, path, spark.read.parquet(path).schema)
    found = limits.drain(limits.lockouts(stream, failures=5, late="2 days")).collect()
    assert [(r.user_id, str(r.locked_at)) for r in found] == [(7, "2024-01-01 00:04:00")]
