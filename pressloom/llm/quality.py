"""Quality rules: gradient-boosted trees over document statistics.

``statistics`` measures a text, ``learn`` fits boosted trees to labelled documents, ``judge`` scores
documents. Trees are grown on histograms with Newton steps of the logistic loss. Chosen features are
monotonic: more symbols, repeated lines, repeated words, exclamation marks or bars never raise a
score; a split that would is not made, and both sides of a split keep to their side of its middle.
The trees are flattened into arrays of nodes (feature, threshold, children, value), and a whole batch
walks down all trees at once.

Words are runs of characters other than the space and U+0009 to U+000D. Windows of words are
compared by 64-bit hashes.

Defined results: null is the empty text and has no words; texts are used whole; repeated rows give
equal rows. Without labelled rows of both classes the trees are empty and only the base rules
decide. Labels of one id are used once, the lowest. Other columns of the input pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most about this many labelled rows are fitted to.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, SHRINK, LEAST_ROWS = 60, 3, 64, 0.2, 1.0, 5
KEEP_FROM = 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and whether a higher value may only lower the score.
FEATURES = {
    "log_words": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": 0, "digits": 0, "marks": 0,
    "exclaims": -1, "bars": -1, "word_length": 0, "distinct": 0, "line_words": 0, "sentence_ends": 0, "short_words": 0,
}
# The symbols counted, and how far repeats may go, are set by the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
_SPACE = " \t\n\v\f\r"


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(128, bool)
    out[[ord(c) for c in chars]] = True
    return out


_IS_SPACE, _IS_SYMBOL, _IS_MARK, _IS_END = _flags(_SPACE), _flags(SYMBOLS), _flags(".,;:!?'\"()-"), _flags(".!?")
_POWER = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: the sum of its mixed characters times powers of their place in it."""
    size, first = ends - starts, starts[0]
    place = np.arange(first, len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
    # Places repeat beyond a few thousand; the block number keeps them apart.
    value = _mixed(codes[first:].astype(np.uint64) + (place >> 12).astype(np.uint64) * np.uint64(1 << 32) + np.uint64(1))
    total = np.r_[np.uint64(0), np.cumsum(value * _POWER[place & 4095])]
    return _mixed(total[ends - first] - total[starts - first] + size.astype(np.uint64))


def measure(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """(base counts, features) of one text."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(codes, 127).astype(np.int64)
    space = _IS_SPACE[small] & (codes < 128)
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(starts)
    if not n:
        return (0, 0, int((_IS_SYMBOL[small] & (codes < 128)).sum()), 0, 0), [0.0] * len(FEATURES)
    hashes = _word_hashes(codes, starts, ends)
    seen, lines, dups = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            lines += 1
            dups += line in seen
            seen.add(line)
    repeated = 0
    if n >= WINDOW:
        h = hashes
        for step in (1, 2, 4):
            h = _mixed(h[:-step] * np.uint64(0x100000001B3) + h[step:])
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), np.int64)
        twice[order[1:][same]] = 1
        twice[order[:-1][same]] = 1
        cover = np.zeros(n + 1, np.int64)
        cover[: len(twice)] += twice
        np.subtract.at(cover, np.flatnonzero(twice) + WINDOW, 1)
        repeated = int(np.count_nonzero(np.cumsum(cover)[:n]))
    chars = int((ends - starts).sum())
    ascii_ = codes < 128
    symbols = int((_IS_SYMBOL[small] & ascii_).sum())
    counts = lambda table: int((table[small] & ascii_).sum())
    features = [
        float(np.log1p(n)), symbols / chars, dups / lines, repeated / n, sum(map(str.isupper, text)) / chars,
        int(((codes >= 48) & (codes < 58)).sum()) / chars, counts(_IS_MARK) / chars, text.count("!") / n, text.count("|") / n,
        chars / n, len(np.unique(hashes)) / n, n / lines, int((_IS_END[small[ends - 1]] & ascii_[ends - 1]).sum()) / n,
        int((ends - starts <= 3).sum()) / n,
    ]
    return (n, chars, symbols, dups, repeated), features


@dataclass
class Trees:
    """All trees in one set of node arrays; ``roots`` are where they begin. A leaf is its own child."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities (0 to 1) of rows of features."""
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        pick = np.arange(len(rows))[:, None]
        for _ in range(DEPTH):
            at = np.where(rows[pick, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def grow(rows: np.ndarray, good: np.ndarray, directions: list[int]) -> Trees:
    """Boosted trees for ``good`` (0 or 1); ``directions``: -1, 0 or 1 for each feature."""
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    rate = float(np.clip(good.mean(), 1e-3, 1 - 1e-3)) if len(good) else 0.5
    start, roots = float(np.log(rate / (1 - rate))), []
    if len(np.unique(good)) < 2:
        return Trees(start if len(good) else 10.0, np.zeros(0, int), *(np.zeros(0, t) for t in (int, float, int, int, float)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, rows.T)], axis=1)
    logit = np.full(len(rows), start)

    def leaf(value: float) -> int:
        for k, v in zip(nodes, (0, np.inf, len(nodes["left"]), len(nodes["left"]), value)):
            nodes[k].append(v)
        return len(nodes["left"]) - 1

    def split(at: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        own = lambda a, b: np.clip(-a / (b + SHRINK), low, high)
        worth = lambda a, b, v: a * v + (b + SHRINK) * v * v / 2
        total_g, total_h = g[at].sum(), h[at].sum()
        value = own(total_g, total_h)
        best, gain = None, 1e-6
        for f in range(rows.shape[1]) if depth < DEPTH else ():
            bins = binned[at, f]
            lg, lh, ln = (np.cumsum(np.bincount(bins, w, len(edges[f]) + 1))[:-1] for w in (g[at], h[at], None))
            lv, rv = own(lg, lh), own(total_g - lg, total_h - lh)
            better = worth(total_g, total_h, value) - worth(lg, lh, lv) - worth(total_g - lg, total_h - lh, rv)
            allowed = (ln >= LEAST_ROWS) & (len(at) - ln >= LEAST_ROWS) & (directions[f] * (rv - lv) >= 0)
            better = np.where(allowed, better, -np.inf)
            if len(better) and better.max() > gain:
                b = int(better.argmax())
                best, gain = (f, b, float(lv[b] + rv[b]) / 2), float(better[b])
        node = leaf(float(value) * RATE)
        if best:
            f, b, middle = best
            goes = binned[at, f] <= b
            sides = [(low, high), (low, high)]
            if directions[f] < 0:
                sides = [(middle, high), (low, middle)]
            elif directions[f] > 0:
                sides = [(low, middle), (middle, high)]
            nodes["feature"][node], nodes["threshold"][node] = f, float(edges[f][b])
            nodes["left"][node] = split(at[goes], g, h, depth + 1, *sides[0])
            nodes["right"][node] = split(at[~goes], g, h, depth + 1, *sides[1])
        return node

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        roots.append(split(np.arange(len(rows)), p - good, p * (1 - p), 0, -np.inf, np.inf))
        one = Trees(0.0, np.array(roots[-1:]), *(np.array(nodes[k]) for k in nodes))
        p = one.score(rows)
        logit += np.log(p / (1 - p))
    return Trees(start, np.array(roots), *(np.array(nodes[k]) for k in nodes))


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base counts and ``features`` of ``text``."""

    @F.arrow_udf(f"struct<{', '.join(f'{b} long' for b in BASE)}, features array<double>>")
    def measured(texts: pa.Array) -> pa.Array:
        return _measured(texts)

    done = df.withColumn("_measured", measured(F.col(f"`{text}`")))
    return done.withColumns({c: F.col(f"_measured.{c}") for c in (*BASE, "features")}).drop("_measured")


def _measured(texts: pa.Array) -> pa.Array:
    found = [measure(t.as_py()) for t in texts]
    base = [pa.array([b[i] for b, _ in found], pa.int64()) for i in range(len(BASE))]
    return pa.StructArray.from_arrays([*base, pa.array([f for _, f in found], pa.list_(pa.float64()))], [*BASE, "features"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees fitted to the documents that ``labels`` (``doc_id``, ``label``) covers.

    Labels are sampled by a hash of the id, so that about ``sample`` of them are used, and broadcast (ids and
    labels of the sample only); the features of that sample come to the driver.
    """
    known = labels.select("doc_id", F.col(label).cast("double").alias("good")).dropna().groupBy("doc_id").agg(F.min("good").alias("good"))
    part = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("doc_id", "good", "features").toPandas()
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
    features = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return grow(features, rows["good"].to_numpy(float), list(FEATURES.values()))


def judge(df: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``df`` with the base counts, ``base_failed``, ``quality_score`` and ``kept``."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf(f"struct<{', '.join(f'{b} long' for b in BASE)}, quality_score double>")
    def judged(texts: pa.Array) -> pa.Array:
        found = _measured(texts)
        features = np.array(found.field("features").to_pylist(), float).reshape(-1, len(FEATURES))
        scores = pa.array(shared.value.score(features), pa.float64())
        return pa.StructArray.from_arrays([*(found.field(b) for b in BASE), scores], [*BASE, "quality_score"])

    done = df.withColumn("_judged", judged(F.col(f"`{text}`")))
    done = done.withColumns({c: F.col(f"_judged.{c}") for c in (*BASE, "quality_score")}).drop("_judged")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    done = done.withColumn("base_failed", failed)
    return done.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= KEEP_FROM))
