"""Language identification by compression.

Every language gets a zstandard raw-content dictionary made of sampled text.
A text is cut into blocks, each block is compressed with each dictionary, and
the language whose dictionary gives the smallest total is chosen.  The margin
is the second smallest total less the smallest, over the smallest; a text with
a narrow margin is rejected.

Every dictionary sees every text, so the number of languages that labels name
should be small: work grows with it.

Scale: the dictionaries are the only thing learned, ``SAMPLE`` documents a
language at most, chosen by a hash of doc_id (the per-language limit is taken
before the shuffle), ``DICTIONARY_BYTES`` each.  Scoring is one pass over the
documents without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the sample that the classifier is fitted on.
SAMPLE, DICTIONARY_BYTES = 400, 96 << 10
#: Text is scored in blocks of so many bytes, so that all of a long text is compared with the dictionary.
BLOCK = 2 << 10
#: Each block follows so many bytes of the dictionary itself, so that the shortest text is encoded rather than stored; what they take is subtracted.
LEAD = 128
#: Relative size differences below this are too narrow to tell.
MARGIN = 0.002
LEVEL = 9
SALTS = 64


def is_training(modulus: int = 5) -> Column:
    """Whether a document may be learned from: crc32 of its id as text leaves a remainder.  Never without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) != 0, F.lit(False))


def dictionaries(docs: DataFrame, training: Column, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Language -> dictionary content, from labelled training rows.

    A language's content is equal shares of its sampled texts, taken from
    their middle where a text is longer than its share.
    """
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    share = max(64, size // sample)
    usable = docs.filter(training & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    picked = usable.select("lang", "doc_id", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(SALTS)).alias("_salt")).distinct()
    for group in (["lang", "_salt"], ["lang"]):  # so that no task gets what every task has kept of a language
        picked = picked.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*by))).filter(F.col("_n") <= sample)
    # texts of the picked ids only: sample rows a language at most, small enough to broadcast
    cut = F.substring("text", F.greatest(F.lit(1), ((F.length("text") - 4 * share) / 2).cast("int")), F.lit(4 * share))
    picked = usable.select("lang", "doc_id", cut.alias("text")).join(F.broadcast(picked.select("lang", "doc_id", "_n")), ["lang", "doc_id"])
    texts = defaultdict(list)
    for row in picked.groupBy("lang", "doc_id", "_n").agg(F.min("text").alias("text")).orderBy("lang", "_n").collect():  # sample rows a language at most
        texts[row.lang].append(row.text)
    out = {}
    for lang, rows in sorted(texts.items()):
        content, each = b"", max(share, size // len(rows))
        for text in rows:
            content += text.lower().encode()[:each] + b"\n"
        out[lang] = content[:size]
    return out


_RESULT = [("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())]


def _score(trained: list[tuple[str, bytes]], margin: float):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs = [lang for lang, _ in trained]
        models, leads = [], []
        for _, content in trained:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            leads.append(content[len(content) // 2 : len(content) // 2 + LEAD])
            models.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        alone = [len(m.compress(lead)) for m, lead in zip(models, leads, strict=True)]
        for texts in batches:
            found = []
            for text in (x.as_py() for x in texts):  # one at a time: a batch of texts isn't held twice
                if text is None or not langs or not any(map(str.isalpha, text)):
                    found.append(("und", 0.0, 0.0, True))
                    continue
                data = text.lower().encode("utf-8", "surrogatepass")
                cuts = range(0, len(data), BLOCK)
                sizes = np.array([sum(len(m.compress(lead + data[c : c + BLOCK])) - n for c in cuts) for m, lead, n in zip(models, leads, alone, strict=True)], float)
                best = int(sizes.argmin())
                smallest = max(sizes[best], 1.0)
                gap = (np.partition(sizes, 1)[1] - smallest) / smallest if len(sizes) > 1 else 1.0
                share = np.exp2(-(sizes - sizes[best]))
                found.append((langs[best], float(1 / share.sum()), float(gap), bool(gap < margin)))
            columns = [pa.array([r[i] for r in found], t) for i, (_, t) in enumerate(_RESULT)]
            yield pa.StructArray.from_arrays(columns, [n for n, _ in _RESULT])

    return score


def identify(docs: DataFrame, trained: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), margin and rejected.

    A null text, or one without a letter, is ``und``, scores 0 and is
    rejected; so is everything if nothing was learned.  Ties go to the language
    that sorts first.  Only the text is looked at.
    """
    udf = F.arrow_udf(_score(sorted(trained.items()), margin), "lang_pred string, score double, margin double, rejected boolean")
    made = ["lang_pred", "score", "margin", "rejected"]
    kept = docs.drop(*made, "_id")
    return kept.withColumn("_id", udf("text")).select(*[F.col(f"`{c}`") for c in kept.columns], *[F.col(f"_id.{c}") for c in made])
