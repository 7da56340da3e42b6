"""Fuzzy quotations against every stretch of every document."""

import random

import numpy as np
import pyarrow as pa
import pytest
from attestra.operators import quotations as Q
from pyspark.sql import functions as F


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
        row = fresh
    return row[-1]


def closest(quote, text):
    """Of all stretches: the fewest edits, then the first end, then the shortest."""
    k, best = Q.most_edits(len(quote)), None
    for end in range(len(text) + 1):
        for size in range(max(0, len(quote) - k), min(end, len(quote) + k) + 1):
            n = edits(quote, text[end - size : end])
            if n <= k and (best is None or n < best[0]):
                best = n, end - size
    return (1 - best[0] / len(quote), best[1]) if best else (0.0, -1)


def altered(r, text, letters, many):
    out = list(text)
    for _ in range(many):
        at, how = r.randrange(len(out) + 1), r.random()
        if how < 0.34:
            out.insert(at, r.choice(letters))
        elif out:
            at = min(at, len(out) - 1)
            out[at : at + 1] = [r.choice(letters)] if how < 0.67 else []
    return "".join(out)


@pytest.fixture(scope="module")
def cases():
    r = random.Random(5)
    texts = ["".join(r.choice("ab" if i % 3 == 0 else "abcdefgh é") for _ in range(r.randint(0, 110))) for i in range(8)]
    quotes = []
    for _ in range(12):
        source = r.choice([t for t in texts if len(t) > 50])
        at, size = r.randint(0, 10), r.randint(14, 45)
        quotes.append(altered(r, source[at : at + size], "abx", r.randint(0, 6)))
    return quotes, texts


def test_bit_parallel_distance():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 15))) for _ in range(2))
        assert Q.distance(a, b) == edits(a, b)


def test_closest_stretch_of_all(cases):
    quotes, texts = cases
    found = 0
    for text in texts:
        document = Q.Document(text)
        for quote in (*quotes, "a", "ab", "b" * 12):
            expected = closest(quote, text)
            assert document.find(quote) == expected
            found += expected[1] >= 0
    assert found > 15


def test_join_finds_what_every_pair_would(spark, cases):
    quotes, texts = cases
    q = spark.createDataFrame([*enumerate(quotes), (900, None), (901, ""), (902, "zzz")], "quote_id long, quote string")
    d = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string").withColumn("band", F.lit("own"))
    long = [(i, a) for i, a in enumerate(quotes) if Q.gram_of(len(a))]  # the others are left out
    expected = {(i, j, *closest(a, b)) for i, a in long for j, b in enumerate(texts) if closest(a, b)[1] >= 0}
    assert {tuple(r) for r in Q.join(q, d).collect()} == expected and len(expected) >= 5
    assert Q.join(q.limit(0), d).count() == 0 and Q.join(q, d.limit(0)).count() == 0


def test_join_finds_short_quotations(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 150))) for _ in range(12)] + ["x", "aaaa", None]
    quotes = ["a", "x", "ab", "dab", "a ba", "abcda", *(altered(r, t[20:31][:n], "ab", 1) for t in texts[:12] if t and len(t) > 60 for n in (10, 11)), ""]
    assert {len(q) for q in quotes} >= {1, 2, 3, 4, 5, 10, 11}
    q, d = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = {(i, j): closest(a, b) for i, a in enumerate(quotes) for j, b in enumerate(texts) if a and b}
    expected = {(*k, *v) for k, v in pairs.items() if v[1] >= 0}
    assert {tuple(x) for x in Q.join(q, d).collect()} == expected and any(0 < x[2] < 1 for x in expected)
    assert {k: Q.Document(texts[k[1]]).find(quotes[k[0]]) for k in pairs} == pairs


def test_a_short_gram_of_a_document_travels_once():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["abab", "ba" * 1000])], ["doc_id", "text"])
    (found,) = Q.cut_grams(iter([batch]), {1: np.ones(1 << Q.FILTER_BITS, bool)})
    assert list(zip(found.column(0).to_pylist(), found.column(3).to_pylist(), strict=True)) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_quotations_of_a_row(spark):
    quote = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(["x " + quote[:20] + quote[22:], None, "something else entirely here"], "start " + quote + " end"), (None, "x"), ([quote], None)], "q array<string>, d string")
    found = [r.c for r in df.select(Q.closest()("q", "d").alias("c")).collect()]
    assert found[0][0].position >= 4 and found[0][0].similarity > 0.9 and found[0][1] is None and found[0][2].position == -1
    assert found[1] is None and found[2][0].asDict() == {"similarity": 0.0, "position": -1}


def test_the_start_of_a_stretch_takes_one_pass(monkeypatch):
    r = random.Random(9)
    quote = "".join(r.choice("abcdefgh ") for _ in range(90))
    text = "xyz" * 20 + altered(r, quote, "abx", 7) + "zyx" * 20
    expected, passes, places = closest(quote, text), [], Q._places
    monkeypatch.setattr(Q, "_places", lambda q: passes.append(q) or places(q))
    assert Q._told(quote, Q.closest_stretch(quote, text)) == expected and expected[1] >= 0
    assert len(passes) == 2  # one for where it ends, one for where it starts
    assert list(Q.distances("abc", "abcd")) == [3, 2, 1, 0, 1] and list(Q.distances("", "ab")) == [0, 1, 2]


def test_grams_of_many_documents_are_cut_at_once():
    texts = [None, "", "short", *(f"some text number {i} of a few" for i in range(300))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    found = list(Q.cut_grams(iter([batch]), {8: np.ones(1 << Q.FILTER_BITS, bool)}))
    assert len(found) == 1 and found[0].schema.names == ["doc_id", "gram", "hash", "place"]
    expected = [(d, 8, int(h), at) for d, t in enumerate(texts) for at, h in enumerate(Q.gram_hashes(t or "", 8).view(np.int64))]
    assert list(zip(*(c.to_pylist() for c in found[0].columns), strict=True)) == expected
    assert len(list(Q.cut_grams(iter([batch]), {8: np.ones(1 << Q.FILTER_BITS, bool)}, characters=100))) > 50
    assert not list(Q.cut_grams(iter([batch]), {})) and not list(Q.cut_grams(iter([batch]), {6: np.zeros(1 << Q.FILTER_BITS, bool)}))


def test_join_normalises_again_only_what_it_verifies(spark, cases):
    quotes, texts = cases
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")
    d = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string")
    plain, upper = Q.join(q, d), Q.join(q, d.withColumn("text", F.upper("text")), normal=F.lower)
    assert plain.count() > 0 and sorted(map(tuple, upper.collect())) == sorted(map(tuple, plain.collect()))
    plan = upper._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("lower(") < plan.index("Join Inner")  # above the join with the few that are left
