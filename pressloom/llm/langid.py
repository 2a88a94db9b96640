"""Language identification with bit-sliced Bloom filters of character n-grams.

``learn`` counts n-grams of labelled texts and keeps, for every language, the ones that are frequent
in it. All languages share one Bloom filter whose cells are bit masks: cell ``i`` holds bit ``l`` if
language ``l`` has set it. The cells of an n-gram's hashes, combined with AND, are the set of all
languages that contain it, in one look-up for any number of languages.

``predict`` looks up every n-gram of a text, counts the bits of each language and takes off what
false positives are expected to add: with ``n`` n-grams, ``c`` hits and a false-positive rate ``p``
of that language's slice, ``(c - n p) / (1 - p)`` hits are real. The language with most real hits
wins, ties go to the first by code point; the score is its share of the text's n-grams (0 to 1).

N-grams are those of the lower-cased letters of a text, runs of other characters being one space.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything
when nothing could be learned; texts whose n-grams are all unknown get the commonest language of
the sample with score 0. Texts are used whole; repeated rows give equal rows; other columns of the
input pass through (new columns replace columns of the same name).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
SIZES = (2, 3, 4)
#: About so many different labelled texts of each language are learned from.
SAMPLE_PER_LANGUAGE = 2_000
#: An n-gram belongs to a language in which it makes up this share of the n-grams of its size, and
#: at least this part of its share in the language that uses it most. The first bounds a filter
#: to the inverse of the share, whatever the size of the corpus.
LEAST_SHARE, LEAST_PART = 5e-5, 0.25
HASHES = 2
#: Cells for each n-gram that is stored.
CELLS = 8
_OTHER = regex.compile(r"[^\p{L}]+")


@dataclass
class Filters:
    """Languages in order of code points, cell masks (cells x words of 64 bits), false-positive
    rates, and which language to take when nothing is known."""

    languages: list[str]
    masks: np.ndarray
    rates: np.ndarray
    fallback: int


def ngrams(text: str) -> dict[int, np.ndarray]:
    """Hashes of the n-grams of each size; of a text without a letter, none."""
    letters = _OTHER.sub(" ", text.lower())
    if not letters.strip():
        return {}
    codes = np.frombuffer(f" {letters.strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, h = {}, codes + np.uint64(1)
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            break
        h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        if n in SIZES:
            out[n] = _mixed(h + np.uint64(n << 56))
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _cells(h: np.ndarray, cells: int) -> list[np.ndarray]:
    """Places of each hash; ``cells`` is a power of two."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(cells - 1)).astype(np.int64) for i in range(HASHES)]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Filters from the rows of ``labelled`` that have a text and a language.

    Fitted on a bounded sample: texts are taken by their hash, each once however many copies it has, so that about
    ``sample`` different texts of each language are learned from and a group of copies weighs as one. Counting is a Spark
    aggregation; what comes to the driver is the numbers of rows and texts of each language and at most ``1 / LEAST_SHARE`` n-grams for
    each language and size.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).dropna()
    rows = rows.withColumn("hash", F.xxhash64("text"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("hash", 0.02).alias("different")).collect()
    found, different = {r.lang: r.n for r in counted}, {r.lang: max(1, r.different) for r in counted}
    languages = sorted(found)
    if not languages:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0), 0)
    part = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / different[k]))])
    chosen = rows.where(F.pmod("hash", F.lit(1 << 20)) < part[F.col("lang")] * (1 << 20)).dropDuplicates(["lang", "hash"])
    grams = chosen.select("lang", "text").mapInPandas(_counted, "lang string, size int, gram long, n long")
    counts = grams.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    totals = {(r.lang, r.size): r.n for r in counts.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0), 0)
    share = F.create_map(*[F.lit(x) for (k, s), n in sorted(totals.items()) for x in (f"{k}/{s}", 1.0 / n)])
    frequent = counts.select(
        "lang", "gram", (F.col("n") * share[F.concat_ws("/", "lang", "size")]).alias("share")
    ).where(F.col("share") >= LEAST_SHARE)
    return _filters(languages, frequent.toPandas(), max(languages, key=lambda k: found[k]))


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lang, rows in frame.groupby("lang"):
            by_size: dict[int, list[np.ndarray]] = {}
            for t in rows["text"]:
                for size, h in ngrams(t).items():
                    by_size.setdefault(size, []).append(h)
            for size, hashes in by_size.items():
                gram, n = np.unique(np.concatenate(hashes), return_counts=True)
                yield pd.DataFrame({"lang": lang, "size": size, "gram": gram.view(np.int64), "n": n})


def _filters(languages: list[str], frequent: pd.DataFrame, fallback: str) -> Filters:
    best = frequent.groupby("gram")["share"].transform("max")
    kept = frequent[frequent["share"] >= LEAST_PART * best]
    cells = 1 << int(np.ceil(np.log2(CELLS * max(1, kept["gram"].nunique()))))
    masks = np.zeros((cells, (len(languages) + 63) // 64), np.uint64)
    fill = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        grams = kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        for at in _cells(grams, cells):
            masks[at, i // 64] |= np.uint64(1 << (i % 64))
        fill[i] = np.count_nonzero(masks[:, i // 64] & np.uint64(1 << (i % 64))) / cells
    return Filters(languages, masks, fill**HASHES, languages.index(fallback))


def judge(text: str | None, filters: Filters) -> tuple[str, float]:
    """(language, score) of one text."""
    grams = ngrams(text or "")
    if not grams or not filters.languages:
        return UNKNOWN, 0.0
    h = np.concatenate(list(grams.values()))
    sets = filters.masks[_cells(h, len(filters.masks))[0]]
    for at in _cells(h, len(filters.masks))[1:]:
        sets = sets & filters.masks[at]
    hits = np.array([np.count_nonzero(sets[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(filters.languages))])
    real = np.clip((hits - len(h) * filters.rates) / (1 - filters.rates), 0, None)
    best = int(np.argmax(real)) if real.any() else filters.fallback
    return filters.languages[best], float(min(1.0, real[best] / len(h)))


def predict(df: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; only ``text`` is looked at."""
    shared = df.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("struct<lang string, score double>")
    def judged(texts: pa.Array) -> pa.Array:
        found = [judge(t.as_py(), shared.value) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang", "score"]
        )

    with_both = df.withColumn("_judged", judged(F.col(f"`{text}`")))
    return with_both.withColumns({"lang_pred": F.col("_judged.lang"), "score": F.col("_judged.score")}).drop("_judged")
