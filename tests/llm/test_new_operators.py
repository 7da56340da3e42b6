"""Toxicity, source divergence and periodic runs against plain Python, and on odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from attestra.llm import divergence, langid, periodic, queries, toxicity
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = {c: c + 32 for c in range(65, 91)}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# periodic runs


def runs_by_definition(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            a = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            smallest = not any(all(w[k] == w[k - d] for k in range(a + d, i)) for d in range(1, q))
            if i - a >= max(6, 4 * q) and smallest:
                out.append((a, i - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts():
    r = random.Random(3)
    out = ["", " \n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b c " * 3, "é " * 40, "x y " * 3000, "a a b " * 30 + "c " + "a a b " * 12]
    for _ in range(150):
        base = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(1, 30))]
        p = r.randint(1, len(base))
        out.append(r.choice([" ", "\t\n"]).join(base + (base[-p:] * r.randint(1, 7)) + [r.choice("abc") for _ in range(r.randint(0, 8))]))
    return out


def test_periodic_runs(spark):
    texts = [*periodic_texts(), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find(df).collect()}
    some = 0
    for i, t in enumerate(texts):
        w = (t or "").split()
        runs = runs_by_definition(w) if len(w) < 500 else [(0, len(w), 2)]
        some += len(runs)
        assert found[i] == (len(w), runs, collapsed(w, runs)), t
    assert some > 100


def test_runs_in_one_long_text_of_one_word():
    start, length, period = periodic.runs_of(np.full(200_000, 7, np.uint64), np.array([0, 200_000]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [200_000], [1])


def test_planted_texts_and_digests(spark):
    texts = ["w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "one", "", None, "a b\tc\nd " * 9]
    ids = [*range(60), None]
    df = spark.createDataFrame([(i, texts[(i or 0) % 5]) for i in ids], "doc_id long, text string")
    found = {r.doc_id: r for r in periodic.digest(periodic.find(periodic.planted(df))).collect()}
    changed = 0
    for i in ids:
        w = (texts[(i or 0) % 5] or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
            changed += 1
        runs = runs_by_definition(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        r = found[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *told)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest() and r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert changed > 2


# source divergence


def audit_by_definition(rows, least, top):
    docs = collections.defaultdict(list)
    for _, text, lang, source in rows:
        docs[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))))
    out = []
    for lang, own in docs.items():
        df = collections.Counter(t for _, w in own for t in set(w))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: collections.Counter() for s, _ in own}
        for s, w in own:
            counts[s].update(t for t in w if t in kept)
        whole = sum(counts.values(), collections.Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in counts.items():
            pairs = sorted(((o, sum(f(p(c, t), p(d, t)) for t in kept)) for o, d in counts.items() if o != s), key=lambda x: (-x[1], x[0].encode()))
            terms = sorted(((t, f(p(c, t), p(whole, t))) for t in kept if c[t] and p(c, t) > p(whole, t)), key=lambda x: (-x[1], x[0].encode()))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(found, 1)]
    return sorted(out, key=repr)


def audited_rows():
    r = random.Random(9)
    words = [f"w{x}" for x in ("a", "b", "é", "É", "ZZ", "zz", "q", "r", "s", "long", "ß")]
    rows = []
    for i in range(160):
        text = r.choice([" ", "-", "1"]).join(r.choice(words) for _ in range(r.randint(0, 14)))
        rows.append((i, text, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s3", "s4", None])))
    rows += [(200 + i, rows[i % 7][1], rows[i % 7][2], f"s{i % 3}") for i in range(60)]  # copies in several sources
    rows += [(400, None, "en", "silent"), (401, "12 34", "es", "s1"), (402, "only once", "es", "s2"), (403, "x", "de", "s1"), (403, "x", "de", "s1"), (403, "x", "de", "s1")]
    return rows


@pytest.mark.parametrize("most", [divergence.BROADCAST_BYTES, 0])
def test_source_divergence(spark, monkeypatch, most):
    monkeypatch.setattr(divergence, "BROADCAST_BYTES", most)  # 0: all texts are shuffled
    monkeypatch.setattr(divergence, "COMPARISONS", 7)
    rows = audited_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("own") for c in ("n", "held", "term", "_h", "w")})
    found = divergence.audit(df, least=3, terms=5)
    assert rows_of(found) == audit_by_definition(rows, 3, 5)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(empty).collect() == []
    rows = [(1, None, None, None), (None, "", "en", "a"), (None, None, "en", "b")]
    assert rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_wide_counts_are_exact(spark):
    df = spark.createDataFrame([(c, 10**13, 77) for c in (0, 8_999_999_999, 9_000_000_000, 10**13 - 5)], "c long, n long, v long")
    found = [r[0] for r in df.select(divergence._p(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert found == [1 + 10**9 * (c + 1) // (10**13 + 77) for c in (0, 8_999_999_999, 9_000_000_000, 10**13 - 5)]


# toxicity


def features_by_definition(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {*words, *((1, *p) for p in zip(words, words[1:], strict=False)), *((2, *p) for p in zip(words, words[2:], strict=False))}


def learned_by_definition(rows):
    """FTRL-proximal over features by name: no hashing."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f):
        over = abs(z[f]) if f == "bias" else max(abs(z[f]) - toxicity.L1, 0.0)
        return -math.copysign(over, z[f]) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    def probability(text):
        return 1 / (1 + math.exp(-sum(weight(f) for f in [*features_by_definition(text), "bias"])))

    for text, label in rows:
        own = [*features_by_definition(text), "bias"]
        before = {f: weight(f) for f in own}
        g = probability(text) - label
        for f in own:
            z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * before[f]
            n[f] += g * g
    return probability


def toxic_rows():
    r = random.Random(2)
    out = []
    for i in range(400):
        toxic = r.random() < 0.4
        words = [r.choice("alpha Beta gamma delta éps eta".split()) for _ in range(r.randint(1, 12))]
        if toxic:
            words[r.randrange(len(words))] = r.choice(["bad", "VILE"])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_follows_the_updates(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    training = langid.is_training(5)
    picked = toxicity.sampled(docs, labels, training)
    learned = [tuple(r) for r in picked.collect()]
    assert len(learned) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows)
    told = learned_by_definition(learned)
    scored = {r.doc_id: r for r in toxicity.score(docs.unionByName(spark.createDataFrame([(1000, None), (1001, "")], "doc_id long, text string")), toxicity.fit(picked)).collect()}
    for i, t, _ in [*rows, (1000, None, 0), (1001, "", 0)]:
        assert scored[i].score == pytest.approx(told(t), abs=1e-9) and scored[i].predicted == (scored[i].score >= 0.5)
    held_out = [(scored[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held_out) > 0.95 * len(held_out)


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "en", "a"), (2, "", "en", "a"), (None, "some words", None, None), (3, "bad " * 50000, "fr", "b"), (3, "twice", "fr", "b")], SCHEMA).withColumns({c: F.lit("own") for c in ("score", "predicted", "toxic", "at")})
    none = toxicity.sampled(docs, spark.createDataFrame([], "doc_id long, toxic int"), langid.is_training(5))
    assert {r.score for r in toxicity.score(docs, toxicity.fit(none)).collect()} == {0.5}
    labels = spark.createDataFrame([(3, 1), (3, 0), (3, None), (2, 7), (None, 1), (99, 1)], "doc_id long, toxic int")
    some = toxicity.sampled(docs, labels, F.lit(True))
    assert [tuple(r) for r in some.collect()] == [("bad " * 50000, 1)]
    found = toxicity.score(docs, toxicity.fit(some))
    assert found.count() == 5 and found.columns == [*[c for c in docs.columns if c not in ("score", "predicted")], "score", "predicted"]
    assert toxicity.score(docs.limit(0), toxicity.fit(some.limit(0))).count() == 0


def test_a_sample_is_about_as_large_as_asked(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert 420 < toxicity.sampled(docs, labels, F.lit(True), sample=500).count() < 580


def test_features_do_not_cross_texts():
    row, at = toxicity.features(pa.array(["a b", "c", None, "", "d e f"]))
    assert np.bincount(row, minlength=5).tolist() == [3, 1, 0, 0, 6] and len(set(at.tolist())) == 10


def test_held_out_accuracy(spark, sf_dir):
    found = queries.op11_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out")
    right, n = found.agg(F.count_if(F.col("predicted") == F.col("toxic")), F.count("*")).first()
    assert right >= 0.8 * n
