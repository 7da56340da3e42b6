"""The pipeline stage by stage: what each one keeps of its own input, against plain Python and SQL."""

import collections
import re

import duckdb
import zstandard
from attestra.llm import base, decontaminate, langid, pii, queries
from pyspark.sql import functions as F

import corpus_pipeline

LOWER = {c: c + 32 for c in range(65, 91)}


def _languages(rows, trained):
    """The rows whose language is told apart clearly, by compressing block after block."""
    models = {}
    for lang, content in sorted(trained.items()):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=langid.LEVEL)
        made = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        lead = content[len(content) // 2 : len(content) // 2 + langid.LEAD]
        models[lang] = made, lead, len(made.compress(lead))
    kept = {}
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            continue
        data = r.text.lower().encode()
        sizes = {lang: sum(len(m.compress(lead + data[c : c + langid.BLOCK])) - n for c in range(0, len(data), langid.BLOCK)) for lang, (m, lead, n) in models.items()}
        best = min(sizes, key=lambda k: (sizes[k], k))
        least = max(sizes[best], 1)
        if (sorted(sizes.values())[1] - least) / least >= langid.MARGIN:
            kept[r.doc_id] = r.lang or best
    return kept


def _one_of_each_group(rows):
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER)) for r in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for d, w in words.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for d, own in sets.items():
        for s in own:
            holders[s].append(d)
    for a, b in {(min(x, y), max(x, y)) for own in holders.values() for i, x in enumerate(own) for y in own[i + 1 :]}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d for d in sets if not sets[d] or root(d) == d}


def _contaminated(rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for i in items:
        w = split(i.text)
        n = min(13, len(w))
        windows |= {tuple(w[s : s + n]) for s in range(len(w) - n + 1)} if n else set()
    bad = set()
    for r in rows:
        w, hit = split(r.text), set()
        for n in {len(x) for x in windows}:
            hit |= {j for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for j in range(s, s + n)}
        if hit and 20 * len(hit) >= len(w):
            bad.add(r.doc_id)
    return bad


def _redacted(text, spans):
    if text is None or not spans:
        return text
    out, at = "", 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
        if a >= at:
            out += f"{text[at:a]}[{kind}]"
        at = max(at, b)
    return out + text[at:]


def test_every_stage_against_its_own_input(spark, sf_dir, tmp_path):
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = []
    for name, stage in corpus_pipeline.STAGES:
        after = base.written(stage(spark, before, sf_dir), "stage")
        stages.append((name, before, after, before.collect(), after.collect()))
        before = after
    (_, d0, _, a, b), (_, _, _, c, d), (_, _, _, e, f), (_, d3, _, g, h), (_, d4, _, i, j) = stages
    assert {r.doc_id: r.lang for r in b} == _languages(a, langid.dictionaries(d0, langid.is_training(5)))
    assert {r.doc_id for r in d} == _one_of_each_group(c) and len(d) < len(c)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    bad = _contaminated(e, items)
    assert {r.doc_id for r in f} == {r.doc_id for r in e} - bad and bad
    assert decontaminate.contamination(d3, spark.createDataFrame(items)).filter("contaminated").count() == 0
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find(d3)).collect()}
    assert {r.doc_id: r.text for r in h} == {r.doc_id: _redacted(r.text, spans[r.doc_id]) for r in g}
    assert any("[email]" in (r.text or "") for r in h)
    path = str(tmp_path / "documents")
    d4.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    expected = dict(con.execute(f"SELECT doc_id, copies FROM ({queries.SQL['op7_mix_sources']}) WHERE copies > 0").fetchall())
    assert {r.doc_id: r.copies for r in j} == expected
    assert d4.select(F.sum(F.length("text"))).first()[0] > 0
