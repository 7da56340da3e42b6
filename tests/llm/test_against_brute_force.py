"""Operators against plain Python, on fixtures with copies, edited copies, shared passages and odd texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from attestra.llm import chat, decontaminate, jaccard, langid, lmscore, pii, substring, suffixes, topk
from pyspark.sql import functions as F

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(n)] for n in (3, 9, 12, 40, 61, 90, 150, 200)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(240):
        own = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        if r.random() < 0.3:
            at = r.randrange(len(own))
            own[at:at] = passage
        rows.append((i, r.choice([" ", "\n", " \t"]).join(own)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "é" * 200), (1004, "x " * 400), (1005, "ab" * 300), (1006, rows[3][1]), (1007, rows[3][1]), (1008, "one two")]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5)


def test_substring_dedup(frame, docs):
    parts = {d: (t or "").encode().split() for d, t in docs}
    width, seen = 35, collections.Counter()
    for w in parts.values():
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    expected = {}
    for d, w in parts.items():
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        expected[d] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.deduplicate(frame).collect()} == expected
    assert any(v[1] for v in expected.values())


def test_byte_dedup_keeps_the_first(frame, docs):
    seen, expected = set(), {}
    for d, t in sorted(docs):
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(b[i : i + 100])
        spans = sum(1 for j in gone if j - 1 not in gone)
        expected[d] = (len(b), len(gone), spans, bytes(x for j, x in enumerate(b) if j not in gone))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.deduplicate(frame).collect()} == expected


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(frame, docs, n, percent):
    def shingles(text):
        w = words((text or "").translate(LOWER))
        return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    expected = {d: (len(sets[d]), root(d)) for d in ids}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame, n, percent).collect()} == expected
    kept = [r.doc_id for r in jaccard.keep_one(frame, n, percent).collect()]
    assert sorted(kept) == sorted({root(d) for d in ids if sets[d]} | {d for d in ids if not sets[d]})


def test_tiles_of_blocks_find_all_links(frame, docs, monkeypatch):
    whole = {r.doc_id: r.component_id for r in jaccard.join(frame, 5, 80).collect()}
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 3)
    assert {r.doc_id: r.component_id for r in jaccard.join(frame, 5, 80).collect()} == whole


def _small_sets(seed, pairs):
    """Texts of 12 to 16 words (8 to 12 shingles of 5), each with a second one that has a few words more, or one other word."""
    r = random.Random(seed)
    out = []
    for i in range(pairs):
        own = [f"p{i}x{j}" for j in range(r.randint(12, 16))]
        other = [*own, *(f"q{i}x{j}" for j in range(r.randint(0, 2)))] if r.random() < 0.8 else [f"q{i}", *own[1:]]
        out.append((" ".join(own), " ".join(other)))
    return out


@pytest.mark.parametrize("listed", [0, 0.3])
def test_linked_sets_share_the_keys_that_they_need(listed):
    import numpy as np
    import pyarrow as pa

    r, linked = random.Random(11), 0
    values, offsets = jaccard.shingle_sets(pa.array([t for pair in _small_sets(5, 6000) for t in pair]), 5)
    common = np.array(sorted(x for x in set(values.tolist()) if r.random() < listed), np.uint64)
    keys, owners, need = jaccard.part_keys(values, offsets, 80, common)
    of = collections.defaultdict(set)
    for key, owner in zip(keys.tolist(), owners.tolist(), strict=True):
        of[owner].add(key)
    for i in range(0, len(need), 2):
        a, b = (set(values[offsets[x] : offsets[x + 1]].tolist()) for x in (i, i + 1))
        if a != b and 100 * len(a & b) >= 80 * len(a | b):
            linked += 1
            assert len(of[i] & of[i + 1]) >= max(need[i], need[i + 1])
    assert linked > 3000


def test_a_pair_of_small_sets_is_linked(spark):
    """Alone, as keys of empty parts are shared by chance among many."""
    own = [f"p84x{j}" for j in range(12)]
    rows = [(1, " ".join(own)), (2, " ".join([*own, "q84x0", "q84x1"]))]  # 8 of 10 shingles
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 8, 1), (2, 10, 1)]


def test_decontamination(spark, frame, docs, monkeypatch):
    long, short = docs[0][1] or "", "One two"
    items = [(1, " ".join(words(dict(docs)[5])[2:30])), (2, short), (3, None), (4, "  --  "), (5, "w1"), (5, "w2 w3"), (None, long)]

    def tokens(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    windows = collections.defaultdict(set)
    for i, t in items:
        w = tokens(t)
        m = min(13, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[s : s + m])].add("null" if i is None else str(i))
    expected = {}
    for d, t in docs:
        w, hit, found = tokens(t), set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit.update(range(s, s + m))
                    found |= windows[tuple(w[s : s + m])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected[d] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for limit in (8 << 20, 40):  # one block, and one for about each item
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        got = decontaminate.digest(decontaminate.contamination(frame, benchmark)).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == expected


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii_base_spans(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("01234567890 .-+()@ab_%\né") for _ in range(r.randint(0, 120)))) for i in range(600)]
    rows += [(901, None), (902, ""), (903, "1" * 20000), (904, "a@b.c_d@e.f x@y." + "z." * 3000), (905, "+1" * 3000), (906, "4111 1111-1111 1111, 256.1.1.1 1.2.3.4.5.6.7.8")]
    expected = {}
    for d, t in rows:
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if passes(k, m[0])]
        counts = collections.Counter(s[0] for s in spans)
        expected[d] = (*(counts[k] for k in BASE), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())
    got = pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {x.doc_id: (x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in got} == expected


def test_pii_bootstrap_and_redaction(spark):
    rows = [(i, f"write to callme: +1 (555) 000-{1000 + i} today") for i in range(12)] + [(50, "reach callme: 555 0100 4477 now"), (51, "year 2024 05 06 07 and the 5550100447 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    found = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    assert found[50].spans == "phone:14:27" and found[50].n_phone == 0
    assert found[51].spans == "" and found[0].spans == "phone:17:34"
    text = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert text[50] == ("reach callme: [phone] now", 25) and text[0][0] == "write to callme: [phone] today" and text[51][0] == rows[13][1]


def test_pii_patterns_grow_from_what_they_discover(spark):
    rows = [(i, f"write to callme: +1 (555) 000-{1000 + i} today") for i in range(40)]
    rows += [(100 + i, f"reach callme: 555 0100 44{10 + i} now") for i in range(8)]  # found behind a pattern of the seeds
    rows += [(200 + i, f"or dial: 555 0100 44{10 + i} now") for i in range(8)]  # make a pattern of "dial:"
    rows += [(300, "or dial: 555 0100 9977 now"), (301, "555 0100 9977"), (302, "year 555 0100 8866")]
    found = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(found[100 + i] == "phone:14:27" and found[200 + i] == "phone:9:22" for i in range(8))
    assert found[300] == "phone:9:22" and found[301] == "phone:0:13" and found[302] == ""


def test_chat_snapshots(spark):
    full = [("user", "a"), ("assistant", "b"), ("user", "c")]
    talks = {1: full[:1], 2: full[:2], 3: full, 4: full, 5: [("user", "a"), ("assistant", "x")], 6: [("assistant", "a")], 7: [("user", None)], 8: [("user", "")], 9: [(None, "<|end|>")]}
    rows = [(c, i, role, text) for c, turns in talks.items() for i, (role, text) in enumerate(turns)] + [(None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.render(df).collect()}
    assert set(got) == {3, 5, 6, 7, 8, 9, None}
    assert got[3].text == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n" and got[3].n_equal == 2
    assert got[9].text == "<|unknown|>\n< |end|><|end|>\n"
    parts = chat.render(df, part_turns=2).filter("conv_id = 3").orderBy("part").collect()
    assert [p.part for p in parts] == [0, 1] and "".join(p.text for p in parts) == got[3].text and parts[0].n_parts == 2


def test_language_model_counts_and_gain(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(90001, None), (90002, "")], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    tokens = {d: words((t or "").translate(LOWER)) + [None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lmscore.score(frame).collect()}
    assert set(got) == set(tokens)
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert math.isfinite(r.score) and r.score < 0
    gains = [got[d].score - got[d].base_score for d in tokens if held[d] and len(tokens[d]) > 20]
    assert sum(g > 0 for g in gains) > 0.9 * len(gains)


def test_attention_model_sums_to_one_and_scores_each_place_once():
    import numpy as np
    from attestra.llm import attention as A

    m = A.train([np.array([0, 1, 2, 3] * 12 + [4])] * 8, 4, steps=150)
    stream, offsets = np.array([0, 1, 2, 3] * 12 + [4]), np.array([0, 49])
    whole = A.score(m, stream, offsets)
    assert whole.mean() > -0.3  # it has learned the cycle
    for at in (0, 20, 48):
        total = 0.0
        for symbol in range(5):
            other = stream.copy()
            other[at] = symbol
            total += 10 ** A.score(m, other, offsets)[at]
        assert total == pytest.approx(1, abs=1e-3)
        changed = stream.copy()
        changed[at + 1 :] = 0
        assert np.allclose(A.score(m, changed, offsets)[: at + 1], whole[: at + 1], atol=1e-4)  # nothing looks ahead
    two = A.score(m, np.concatenate([stream, stream]), np.array([0, 49, 98]))
    assert np.allclose(two[:49], whole, atol=1e-4) and np.allclose(two[49:], whole, atol=1e-4)


def test_attention_reads_all_ids_of_a_word():
    import numpy as np
    from attestra.llm import attention as A

    r = np.random.default_rng(2)
    # words 0 and 1 are of one class and begin with the same id: only the second id tells that 2 or 3 follows
    words = [np.append(np.stack([first := r.integers(0, 2, 24), first + 2], 1).ravel(), 4) for _ in range(40)]
    streams = [np.array([0, 0, 1, 2, 3])[x] for x in words]
    pieces, lens = np.array([5, 0, 5, 1, 2, 3]), np.array([2, 2, 1, 1])
    m = A.train(streams, 3, steps=200, words=words, pieces=pieces, lens=lens, ids=6)
    vectors = A.word_vectors(m.f, pieces, lens)
    assert A.score(m, streams[0], np.array([0, 49]), words[0], vectors)[1:48:2].mean() > -0.1  # a coin's, by class alone: -0.3
    long = "internationalisation" * 20 + "xq"
    found, n = lmscore.pieces_of([long.encode(), b"a"], lmscore.RANKS)
    assert found[: n[0]].tolist() == lmscore._encoding(lmscore.RANKS).encode_ordinary(" " + long) and n[0] > 32 and n[1] == 1


def test_language_model_score_against_plain_numpy(spark, sf_dir):
    import numpy as np

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("doc_id < 60").unionByName(spark.createDataFrame([(90001, None), (90002, "one"), (90003, "ab " * 700)], "doc_id long, text string"))
    training = lmscore.is_training()
    classes, m = lmscore.fit(docs, training)
    got = {r.doc_id: r.score for r in lmscore.score(docs).collect()}
    encode = lmscore._encoding(lmscore.RANKS).encode_ordinary
    tokens = {r.doc_id: words((r.text or "").translate(LOWER)) for r in docs.collect()}
    ids = {w: encode(" " + w) for ws in tokens.values() for w in ws}
    kind = lambda w: 64 if w is None else int(classes[ids[w][0]])
    count = collections.Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in [*ws, None])
    of_class, distinct = collections.Counter(), collections.Counter()
    for w, n in count.items():
        of_class[kind(w)] += n
        distinct[kind(w)] += 1
    for d, ws in tokens.items():
        stream, total = [*ws, None], 0.0
        before = [m.e[65], *(m.e[kind(w)] + m.f[ids[w]].sum(0) for w in ws)]  # "begin", then what was predicted
        for i, w in enumerate(stream):
            low = (i // 16 - 1) * 16  # windows of 32 that overlap by half
            at = range(max(0, low), i + 1)
            h = np.stack([before[j] + m.p[j - low] for j in at])
            q = (h[-1] @ m.q) / 4
            weight = np.exp(h @ m.k @ q - (h @ m.k @ q).max())
            out = (h[-1] + (weight / weight.sum()) @ (h @ m.v) @ m.o) @ m.u + m.b
            p_class = np.exp(out[kind(w)] - out.max()) / np.exp(out - out.max()).sum()
            total += math.log10(p_class) + math.log10((count[w] + 1) / (of_class[kind(w)] + distinct[kind(w)] + 1))
        assert got[d] == pytest.approx(total, rel=1e-4), d


def test_language_model_is_fitted_on_everything_without_bounds(spark):
    docs = spark.createDataFrame([(i, f"w{i} x y z") for i in range(50)], "doc_id long, text string")
    few, _ = lmscore.fit(docs, lmscore.is_training(), sample=3)
    every, model = lmscore.fit(docs, lmscore.is_training(), sample=None, sample_words=None)
    assert model.f.any() and len(few) == len(every)
    assert lmscore.score(docs, sample=None, sample_words=None).count() == 50


def test_language_id(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    training = langid.is_training(5)
    trained = langid.dictionaries(frame, training)
    assert set(trained) == {"en", "fr", "de", "es"} and all(len(x) <= langid.DICTIONARY_BYTES for x in trained.values())
    found = langid.identify(frame, trained).filter(~training)
    right, rejected, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("rejected").cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.95 and rejected < 0.03
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 --")], "doc_id long, text string")
    assert [(r.lang_pred, r.score, r.rejected) for r in langid.identify(odd, trained).orderBy("doc_id").collect()] == [("und", 0.0, True)] * 3


def test_topk(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-1.0, -0.5, 0.001, 0.5, 2.0]) for _ in range(20)]) for i in range(300)]
    rows += [(400, None), (401, [None] * 20), (402, [float("nan")] * 20), (403, [float("inf")] * 20), (450, [1.0] * 3), (451, [2.0] * 3), (None, [1.0] * 20), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = set()
    for q, a in good:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))
            expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])}
    assert {tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()} == expected


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_with_boilerplate_against_all_pairs(spark, n, percent):
    """Documents with a passage that others repeat, beside copies that lack one to four words, or have others: no link is lost."""
    r, rows = random.Random(31), []
    licence = [[f"l{k}x{j}" for j in range(r.randint(6, 30))] for k in range(6)]
    for i in range(500):
        own = [f"w{i}x{j}" for j in range(r.randint(4, 40))]
        body = [*own, *r.choice(licence)] if r.random() < 0.8 else own
        rows.append(body)
        for _ in range(r.choice([0, 1, 1, 2])):
            cut = r.randint(1, 4)
            rows.append(r.choice([body[:-cut], body[cut:], [*body, *(f"y{i}x{j}" for j in range(cut))], [*body[:2], f"z{i}", *body[3:]]]))
    texts = [" ".join(x) for x in rows]
    sets = [{tuple(x[i : i + n]) for i in range(len(x) - n + 1)} or ({tuple(x)} if x else set()) for x in rows]
    holders = collections.defaultdict(list)
    for i, own in enumerate(sets):
        for s in own:
            holders[s].append(i)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a, b in {(min(p), max(p)) for own in holders.values() for i, x in enumerate(own) for y in own[i + 1 :] for p in [(x, y)]}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert links > 200
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    assert {q.doc_id: q.component_id for q in jaccard.join(frame, n, percent).collect()} == {i: root(i) for i in range(len(rows))}


def test_keys_are_judged_across_batches():
    import numpy as np
    import pyarrow as pa

    r = random.Random(3)
    rows = sorted((False, r.randrange(60), r.randrange(6), 0) for _ in range(400)) + [(True, 7, 1, 0), (True, 7, 2, 0)]
    rows = sorted(rows)
    expected = {(k, s) for _, k, s, _ in rows if len({x[2] for x in rows if x[1] == k and not x[0]}) > 1} | {(7, 1), (7, 2)}
    for size in (1, 2, 3, 7, 1000):
        batches = [rows[i : i + size] for i in range(0, len(rows), size)]
        made = (pa.RecordBatch.from_arrays([pa.array([x[1] for x in b]), pa.array([x[2] for x in b]), pa.array(np.ones(len(b), np.int32)), pa.array([x[0] for x in b])], jaccard._KEYS) for b in batches)
        got = {(k, s) for b in jaccard._judge(made) for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        assert got == expected


def _bootstrap_twin(rows):
    """Spans of the method in plain Python, for texts with phones and secrets only."""
    mentions = []
    for d, t in rows:
        base = [m.span() for m in re.finditer(BASE["phone"], t) if passes("phone", m[0])]
        cut = {"phone": [(m.span(), False) for m in re.finditer(pii.SHAPES["phone"], t)], "secret": [(m.span(), bool(re.match(pii.SECRET_SEED, m[0]))) for m in re.finditer(pii.SHAPES["secret"], t)]}
        free = {k: [(s, seed) for s, seed in found if all(s[1] <= a or b <= s[0] for a, b in base)] for k, found in cut.items()}
        for kind, found, edges in (("phone", [(s, True) for s in base], base), ("phone", free["phone"], [s for s, _ in cut["phone"]]), ("secret", free["secret"], [s for s, _ in cut["secret"]])):
            for (a, b), seed in found:
                before, after = max([0, *(y for _, y in edges if y <= a)]), min([len(t), *(x for x, _ in edges if x >= b)])
                left, right = ([w for w in re.split(r"[\W_]+", x.lower()) if w] for x in (t[before:a], t[b:after]))
                at = {(f"{left[-1]} _", left[-1])} if left else set()
                if len(left) > 1:
                    at |= {(f"{left[-2]} {left[-1]} _", f"{left[-2]} {left[-1]}"), (f"{left[-2]} * _", left[-2])}
                if right:
                    at.add((f"_ {right[0]}", right[0]))
                mentions.append((d, kind, a, b, t[a:b], seed, at))
    total = collections.Counter()
    for _, t in rows:
        w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        total.update(w)
        total.update(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))
    edges, seeds = collections.Counter(), {}
    for _, kind, _, _, value, seed, at in mentions:
        seeds[kind, value] = seeds.get((kind, value), False) or seed
        for p in at:
            edges[kind, p, value] += 1
    sides = collections.defaultdict(list)
    for (kind, p, value), n in edges.items():
        sides[kind, p].append((value, n))
    usable = {p: v for p, v in sides.items() if len(v) >= pii.SUPPORT and sum(n for _, n in v) >= pii.SPECIFIC * total[p[1][1]]}
    score = {k: float(s) for k, s in seeds.items()}
    while True:
        confidence = {p: min(0.999, sum(n * score[p[0], x] for x, n in v) / sum(n for _, n in v)) for p, v in usable.items() if sum(score[p[0], x] > 0 for x, _ in v) >= pii.SUPPORT}
        chance = {k: 1 - math.prod(1 - c for p, c in confidence.items() if p[0] == k[0] and any(x == k[1] for x, _ in usable[p])) for k in seeds}
        new = {k: 1.0 if seeds[k] else chance[k] if chance[k] >= pii.TRUST else 0.0 for k in seeds}
        done = {k for k in new if chance[k] >= pii.TRUST} == {k for k in score if score[k] > 0 and not seeds[k]} | {k for k in new if chance[k] >= pii.TRUST and seeds[k]}
        score = new
        if done:
            break
    spans = collections.defaultdict(set)
    for d, kind, a, b, value, seed, _ in mentions:
        if kind == "phone" and seed or chance[kind, value] >= pii.TRUST:
            spans[d].add((kind, a, b))
    return {d: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans[d])) for d, _ in rows}


def test_pii_graph_against_plain_python(spark):
    r, rows = random.Random(8), []
    filler = [f"w{chr(97 + i)}" for i in range(20)]
    number = lambda: f"{r.randrange(100, 999)} 0{r.randrange(100, 999)} {r.randrange(1000, 9999)}"
    for i in range(300):
        some = lambda: " ".join(r.choice(filler) for _ in range(r.randint(0, 5)))
        secret = r.choice(["".join(r.choice("0123456789abcdef") for _ in range(40)), "".join(r.choice("0123456789ABCxyz") for _ in range(20))])
        piece = r.choice([f"call me: +1 555 {number()[:8]}", f"call me {number()}", f"ring her {number()} anytime", f"{number()} extension", f'token = "{secret}"', f"commit {secret[:24]}", f"the key xx {secret} end", "the key of it"])
        rows.append((i, f"{some()} {piece} {some()} {piece if r.random() < 0.3 else ''} {some()}"))
    rows += [(900, "about 500 0100 2000 people"), (901, "a1" * 20), (902, "")]
    expected = _bootstrap_twin(rows)
    got = {x.doc_id: x for x in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect()}
    assert {d: x.spans for d, x in got.items()} == expected
    assert sum("secret" in x.spans for x in got.values()) > 20 and got[901].spans == "" and got[900].spans == ""
    assert all(x.n_added == x.n_spans - x.n_phone for x in got.values())


def test_language_model_learns_from_training_documents_outside_the_start(spark):
    docs = spark.createDataFrame([(i, f"cat dog house tree number{i} " * 8) for i in range(60)], "doc_id long, text string").repartition(3, "doc_id")
    _, model = lmscore.fit(docs, lmscore.is_training(), sample=2, sample_words=50)
    moved = model.f.any(1)
    for i in range(60):
        ids, _ = lmscore.pieces_of([f"number{i}".encode()], lmscore.RANKS)
        if zlib.crc32(str(i).encode()) % 7 != 2:
            assert moved[ids].all(), i


def test_words_are_encoded_in_one_call(monkeypatch):
    made, encoding = [], lmscore._encoding(lmscore.RANKS)

    class Counting:
        n_vocab, decode_single_token_bytes = encoding.n_vocab, encoding.decode_single_token_bytes

        def encode_ordinary(self, text):
            made.append(text)
            return encoding.encode_ordinary(text)

    monkeypatch.setattr(lmscore, "_encoding", lambda ranks: Counting())
    some = [w.encode() for w in ["one", "'s", "don't", "été", "中文", "12ab!!", "'", "internationalisation" * 20, "\U0001f600"]]
    for list_of, calls in ((some, 1), ([*some, "a b".encode()], len(some) + 1), ([], 1)):  # white space of its own: one by one
        made.clear()
        pieces, lens = lmscore.pieces_of(list_of, lmscore.RANKS)
        assert pieces.tolist() == [i for w in list_of for i in encoding.encode_ordinary(" " + w.decode())]
        assert lens.tolist() == [len(encoding.encode_ordinary(" " + w.decode())) for w in list_of] and len(made) <= calls


def test_attention_gradients_of_neighbours_and_against_differences():
    import numpy as np
    from attestra.llm import attention as A

    r = np.random.default_rng(5)
    offsets = np.array([0, 40, 41, 90, 90, 300])  # short, empty and longer streams
    words = r.integers(0, 12, 300)
    ends = np.flatnonzero(np.isin(np.arange(300) + 1, offsets[1:]))
    words[ends] = 12  # no word
    stream = np.append(r.integers(0, 4, 12), 4)[words]
    lens = r.integers(1, 4, 12)
    m = A.Model.new(4, ids=9)
    m.f[:] = 0.3 * r.standard_normal(m.f.shape)
    corpus = A.Corpus(stream, offsets, words, r.integers(0, 9, lens.sum()), lens, 4)
    n = len(corpus.blocks.first)
    assert corpus.blocks.place[corpus.blocks.inside].tolist() == list(range(300))  # every place is a target once
    together, singly = corpus.gradients(m, slice(0, n)), corpus.gradients(m, np.arange(n))
    loss = lambda: -np.log(10) * A.score(m, stream, offsets, words, A.word_vectors(m.f, corpus.pieces, lens)).mean()
    for weight, g, other in zip(m.weights(), together, singly, strict=True):
        assert np.allclose(g, other, atol=1e-6)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, up = weight[at], 0.0
        for sign in (1, -1):
            weight[at] = kept + sign * 0.01
            up += sign * loss() / 0.02
        weight[at] = kept
        assert g[at] == pytest.approx(up, rel=0.02)
