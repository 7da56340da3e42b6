"""Personal data: exact base patterns, widened by bootstrapped contextual extraction.

Base spans come from fixed patterns and checks for e-mail addresses, IP
addresses, payment cards and phone numbers.  They are the seeds of a
bootstrap, together with long hexadecimal strings for a fifth kind, secrets
(keys and tokens, which no check can tell).  The words around an entity are
its lexical patterns: the one in front ("token _"), the two in front
("call me _"), the one before the last ("token * _": a gap) and the one
after ("_ extension").  Patterns and instances form a graph.  In each round

* a pattern's confidence is the weight of the trusted instances among all
  mentions of the kind's shape that it stands at; it needs ``SUPPORT``
  different trusted instances, and ``SPECIFIC`` of what the corpus has of its
  words must stand at such mentions ("the" stands at some of everything);
* an instance's score is the chance that one of its patterns is right;
  instances over ``TRUST`` become trusted.

Rounds go on until no instance is new; as nothing is ever taken back, they end.
Identifier-like strings (of a shape that could be the kind) that end up trusted
are spans too.  A secret is one only where a trusted pattern says so.

All of it is DataFrame functions.

Scale: base spans are computed row by row; only mentions (patterns, a value, a
kind) are shuffled, aggregated by pattern and by value before any join, so a
frequent word is one row.  Words and pairs of words are counted over all
documents with partial sums; Spark joins with the words of enough distinct
values before the sums only if those words' written size is below its
broadcast threshold, and after them otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.base import written

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  Each is the plain pattern made linear for
# long runs: a match can't start within a run unless the last match ended there,
# and repetitions that never give back are possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a kind's pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Shapes of strings that might be an identifier of a kind though the base pattern or check fails.
SHAPES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]{2,}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:[.:-][0-9]{1,3}){2,4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9+])[(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
}
#: Which strings of a secret's shape are seeds.
SECRET_SEED = "^[0-9a-f]{32,}$"
EVERY = (*KINDS, "secret")
SUPPORT, SPECIFIC, TRUST = 3, 0.1, 0.8
SPAN = "array<struct<start:int,end:int,value:string,left:array<string>,right:string>>"
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN_WORDS), lambda w: w != "")


def located(text: Column, pattern: str) -> Column:
    """start, end (code points), value, the two words in front (left) and the one after (right) of every match, from the pieces between matches."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    around = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), _words(p).alias("w")))
    ends = F.transform(around, lambda p: F.struct(p["n"].alias("n"), F.slice(p["w"], F.greatest(F.size(p["w"]) - 1, F.lit(1)), F.lit(2)).alias("last"), F.get(p["w"], 0).alias("first")))
    beside = F.zip_with(ends, F.slice(ends, F.lit(2), F.size(ends)), lambda p, q: F.struct(p["n"].alias("n"), p["last"].alias("left"), q["first"].alias("right")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]["n"]
        end = start + F.length(x["v"])
        found = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"), x["p"]["left"].alias("left"), x["p"]["right"].alias("right"))
        return F.when(x["v"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], found).alias("out")))

    walked = F.aggregate(F.zip_with(beside, values, lambda p, v: F.struct(p.alias("p"), v.alias("v"))), empty, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(F.array().cast(SPAN))


def patterns_of(left: Column, right: Column) -> Column:
    """A mention's patterns: how they are written, and the word or pair of words that they count by."""
    last, before = F.get(left, F.size(left) - 1), F.get(left, F.size(left) - 2)
    pair = F.concat_ws(" ", before, last)
    made = [(last, F.concat(last, F.lit(" _")), last), (before, F.concat(pair, F.lit(" _")), pair), (before, F.concat(before, F.lit(" * _")), before), (right, F.concat(F.lit("_ "), right), right)]
    all_ = F.array(*[F.when(there.isNotNull(), F.struct(text.alias("pattern"), words.alias("words"))) for there, text, words in made])
    return F.filter(all_, lambda x: x.isNotNull())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digit string passes the Luhn check."""
    at = lambda i: F.ascii(F.substring(digits, -i, F.lit(1))) - 48
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda n, i: n + F.when(i % 2 == 0, twice(at(i))).otherwise(at(i)))
    return total % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}")
    n = F.length(_digits(value))
    return n.between(16, 19) & luhn(_digits(value)) if kind == "card" else n.between(8, 15)


def _passing(kind: str):
    return lambda x: _passes(kind, x["value"])


def _named(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def _written_out(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with an array column for each kind: start, end, value, left."""
    out = docs
    for kind in KINDS:
        text = F.coalesce("text", F.lit(""))
        found = located(text, PATTERNS[kind])
        if HINTS[kind]:
            found = F.when(F.contains(text, F.lit(HINTS[kind])), found).otherwise(F.array().cast(SPAN))
        out = out.withColumn(kind, F.filter(found, _passing(kind)))
    return out


def _mentions(spans: DataFrame, kind: str, trusted: Column) -> DataFrame:
    rows = spans.select("_d", "_t", F.lit(kind).alias("kind"), F.inline(kind))
    return rows.select("_d", "_t", "kind", "start", "end", "value", patterns_of(F.col("left"), F.col("right")).alias("patterns"), trusted.alias("seed"))


def _candidates(docs: DataFrame, kind: str) -> DataFrame:
    """Strings of the kind's shape that touch no base span of any kind."""
    text = F.col("text")
    shaped = docs.filter(F.contains(text, F.lit("@")) if kind == "email" else text.rlike("[0-9]")).withColumn("_shaped", located(text, SHAPES[kind]))
    base = F.concat(*[F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS])
    free = F.filter("_shaped", lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    seed = F.col("value").rlike(SECRET_SEED) if kind == "secret" else F.lit(False)
    return shaped.withColumn(kind, free).transform(lambda d: _mentions(d, kind, seed))


def graph(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """kind, pattern, value, n (mentions), seed, score (of the instance, 0 or 1 to begin with): the graph's edges.

    Only of patterns that could be trusted in some round: with enough distinct
    values, and specific enough.
    """
    each = mentions.select("kind", "value", "seed", F.inline("patterns"))
    edges = each.groupBy("kind", "pattern", "words", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    usable = edges.groupBy("kind", "pattern", "words").agg(F.count("*").alias("values"), F.sum("n").alias("at")).filter(F.col("values") >= SUPPORT)
    usable = written(usable.select("kind", "pattern", "words", "at"), "patterns")
    wanted = usable.select("words").distinct()
    words = _words(F.col("text"))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    counted = docs.filter("text is not null").select(F.explode(F.concat(words, F.filter(pairs, lambda x: x.isNotNull()))).alias("words")).groupBy("words").agg(F.count("*").alias("total"))
    specific = usable.join(counted.join(wanted, "words", "left_semi"), "words").filter(F.col("at") >= SPECIFIC * F.col("total")).select("kind", "pattern")
    return edges.join(specific, ["kind", "pattern"], "left_semi").select("kind", "pattern", "value", "n", "seed", F.col("seed").cast("double").alias("score"))


def scored(edges: DataFrame) -> DataFrame:
    """``edges`` with every instance's score after one more round, and ``chance``: what its patterns alone say."""
    confidence = edges.groupBy("kind", "pattern").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("confidence"), F.count_if(F.col("score") > 0).alias("support"))
    confidence = confidence.filter(F.col("support") >= SUPPORT).withColumn("confidence", F.least("confidence", F.lit(0.999)))
    chance = edges.select("kind", "pattern", "value").join(confidence, ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("chance"))
    rows = edges.select("kind", "pattern", "value", "n", "seed").join(chance, ["kind", "value"], "left").withColumn("chance", F.coalesce("chance", F.lit(0.0)))
    return rows.withColumn("score", F.when(F.col("seed"), 1.0).when(F.col("chance") >= TRUST, F.col("chance")).otherwise(0.0))


def bootstrap(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """_d, _t, kind, start, end of the identifiers that trusted patterns discover."""
    mentions = _candidates(spans, EVERY[0])
    for kind in EVERY[1:]:
        mentions = mentions.unionByName(_candidates(spans, kind))
    for kind in KINDS:
        mentions = mentions.unionByName(_mentions(spans, kind, F.lit(True)))
    mentions = written(mentions, "mentions")
    edges, trusted, round_ = written(graph(docs, mentions), "edges"), -1, 0
    while True:
        edges = written(scored(edges), f"edges{round_}")
        now = edges.filter((F.col("chance") >= TRUST) & ~F.col("seed")).select("kind", "value").distinct().count()
        if now == trusted:  # nothing is taken back, so the same number is the same set
            break
        trusted, round_ = now, round_ + 1
    found = edges.filter(F.col("chance") >= TRUST).filter("not seed or kind = 'secret'").select("kind", "value").distinct()
    unseen = mentions.filter("not seed or kind = 'secret'").select("_d", "_t", "kind", "value", "start", "end")
    return unseen.join(found, ["kind", "value"]).select("_d", "_t", "kind", "start", "end").distinct()


def _joined(columns: dict[str, Column]) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    parts = [F.transform(c, _written_out(k)) for k, c in columns.items()]
    return F.array_join(F.concat(*parts), ",")


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, and per kind an array of base spans (email, ..) and of all spans (all_email, .., all_secret).

    Base spans are leftmost and don't overlap within a kind; matches that fail
    their check are dropped.  Null and empty texts have none.  Repeated rows are
    documents each.  Discovered spans touch no base span.
    """
    key = {"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_t": F.xxhash64("text")}
    rows = docs.withColumns(key)
    based = base_spans(rows.select("text", *{"doc_id", *keep} - {"text"}, "_d", "_t"))
    pure = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    marked = based.filter(F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False)))  # what has neither holds no mention
    spans = written(marked.select("_d", "_t", "text", *KINDS).dropDuplicates(["_d", "_t"]), "spans")
    found = bootstrap(rows, spans).groupBy("_d", "_t").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end")))).alias(f"more_{k}") for k in EVERY])
    # its written size decides whether Spark broadcasts it or shuffles both sides
    found = written(found, "discovered")
    out = based.select(*keep, "_d", "_t", *[pure(k).alias(k) for k in KINDS]).join(found, ["_d", "_t"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    both = [F.sort_array(F.concat(F.col(k) if k in KINDS else none, F.coalesce(f"more_{k}", none))).alias(f"all_{k}") for k in EVERY]
    return out.select(*keep, *KINDS, *both)


def digest(found: DataFrame) -> DataFrame:
    """The counts and hashes of the registered query; n_spans counts all spans, n_added those beside the base."""
    base, every = _joined({k: F.col(k) for k in KINDS}), _joined({k: F.col(f"all_{k}") for k in EVERY})
    n_base, n_all = sum((F.size(k) for k in KINDS), F.lit(0)), sum((F.size(f"all_{k}") for k in EVERY), F.lit(0))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), n_all.cast("long").alias("n_spans"), (n_all - n_base).cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by "[kind]"; where spans overlap, the first one stands for both.

    n_chars, if there, follows the text.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    found = find(rows, ("text", "_row"))
    spans = F.sort_array(F.concat(*[F.transform(f"all_{k}", _named(k)) for k in EVERY]))
    walked = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring("text", acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))),
    )
    found = found.withColumn("_spans", spans)
    found = found.withColumn("_new", F.when(F.size("_spans") == 0, F.col("text")).otherwise(walked))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("_spans") == 0, F.col("_row.n_chars")).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
