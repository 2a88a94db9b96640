"""Alignment of the tokens of two tokenizers, each distinct text once.

Texts are shuffled whole and grouped, so a text that many documents share is tokenised and aligned once. What it
says about pairs of tokens counts as often as it occurs, and its measures are joined to all its documents at the end.

A text is encoded by two vocabularies, A (byte-level pieces) and B (sentence pieces with byte fallback); both spell the text
with a space before it. Byte offsets at which a token of A and one of B both end cut the tokens into groups. Every token
of A is linked with every token of B in its group. The count of a pair of ids is the number of documents
that hold it linked.

How counts reach the texts: a task takes a stretch of texts at a time (``STRETCH`` bytes or one text) and
lists the distinct pairs of the stretch once; its texts refer to that list by place. Within a stretch texts are aligned in
parts (``PART`` bytes or one text), so that what is held for each token is held for one part. Counts are added over all lists, go
back to each list, and a list meets its texts again. So a pair is moved once per stretch however many texts hold it, no
key is hot, and no table of all pairs is broadcast.

Defined results: null and empty texts, and those whose tokens of either kind do not spell the text (characters that a vocabulary
changes or cannot write), have no tokens: zeros and an empty digest. Very long texts are aligned whole, in a stretch
of their own; a group of many tokens is counted by its distinct ids, not pair by pair. Strings of special tokens are plain
text. Repeated rows and null ids give rows of their own; other columns pass through, and the names made
here replace columns of the same name. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.bpe import byte_letters
from pressloom.operators.skew import lookup_join
from pressloom.sources.scratch import cut_lineage

#: Bytes of text whose pairs are listed together, and that are encoded and aligned together.
STRETCH = 1 << 21
PART = 1 << 18
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
# How pieces write a space, and the pattern that splits byte-level texts.
PIECE_SPACE = "▁"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteVocabulary:
    """Vocabulary A: a tokenizer file of byte-level pieces."""

    def __init__(self, content: str):
        self.content = content
        spec = json.loads(content)
        ids = spec["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode("utf-8")
        self.ranked = self._ranked(spec, ids)

    @cached_property
    def library(self):
        """Made only where ids have no ranks."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.content)
        made.encode_special_tokens = True
        made.no_truncation()
        made.no_padding()
        return made

    def _ranked(self, spec: dict, ids: dict[str, int]):
        """The same vocabulary by ranks, which is encoded several times faster; None if its ids are not in
        the order of the merges or its texts are split in another way."""
        import tiktoken

        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [ids[a + b] for a, b in pairs]
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        if not plain or spec.get("normalizer") or any(x >= y for x, y in zip(made, made[1:])):
            return None
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {self.bytes[i]: i for t, i in ids.items() if t not in special}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.ranked.encode_ordinary(t) for t in texts]


class PieceVocabulary:
    """Vocabulary B: a model file of sentence pieces."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = len(self.library)
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.library.is_byte(i)
            else b"" if self.library.is_control(i) or self.library.is_unknown(i)
            else piece.replace(PIECE_SPACE, " ").encode("utf-8")
            for i, piece in ((i, self.library.id_to_piece(i)) for i in range(n))
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Spelling:
    """Token bytes by id, joined and compared without a step per token."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = pa.array(tokens, pa.large_binary())
        self.sizes = np.array([len(t) for t in tokens], np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens in a row."""
        taken = self.tokens.take(pa.array(ids))
        return _bytes_of(taken)


def _bytes_of(taken: pa.Array) -> np.ndarray:
    _, offsets, data = taken.buffers()
    if data is None or not len(taken):
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each text has."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, counts.sum()), counts


def _grouped(keys: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, times) of each distinct id under each key; keys ascend."""
    both, times = np.unique(keys * width + ids, return_counts=True)
    return both // width, both % width, times


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of all ranges in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Aligner:
    """Aligns stretches of texts."""

    def __init__(self, a: ByteVocabulary, b: PieceVocabulary):
        self.a, self.b = a, b
        self.spell_a, self.spell_b = Spelling(a.bytes), Spelling(b.bytes)
        self.n_b = len(b.bytes)
        most = max(len(a.bytes), len(b.bytes))
        #: Decimal ids with what follows them: at 3 * id, 3 * id + 1, 3 * id + 2.
        self.written = pa.array([f"{i}{c}".encode() for i in range(most) for c in ",|;"], pa.large_binary())

    def _encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By A and by B: ids of all texts in a row and how many each text has; none where the tokens do not spell it."""
        a, b = self.a.encode([" " + t for t in texts]), self.b.encode(texts)
        raw = [b" " + t.encode("utf-8") for t in texts]
        whole = np.frombuffer(b"".join(raw), np.uint8)
        stops = np.cumsum([0, *map(len, raw)])
        both = [_flat(a), _flat(b)]
        wrong: set[int] = set()
        for (flat, counts), spell in zip(both, (self.spell_a, self.spell_b)):
            ends = np.r_[0, np.cumsum(spell.sizes[flat])][np.r_[0, np.cumsum(counts)]]
            if np.array_equal(ends, stops) and np.array_equal(spell.joined(flat), whole):
                continue
            firsts = np.cumsum(counts) - counts
            wrong |= {i for i, r in enumerate(raw) if spell.joined(flat[firsts[i] : firsts[i] + counts[i]]).tobytes() != r}
        if not wrong:
            return both
        return [_flat([[] if i in wrong else x for i, x in enumerate(ids)]) for ids in (a, b)]

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """Measures of each text, its digest, and its distinct pairs as ``text, pair, times`` in three arrays."""
        n = len(texts)
        (a, n_a), (b, n_b) = self._encoded(texts)
        end_a, end_b = np.cumsum(self.spell_a.sizes[a]), np.cumsum(self.spell_b.sizes[b])
        # Both kinds spell the same bytes, text by text, so the offsets of all texts in a row can be compared at once.
        ends = [np.zeros(max(end_a[-1:].sum(), end_b[-1:].sum()) + 1, bool) for _ in "ab"]
        ends[0][end_a], ends[1][end_b] = True, True
        cut = ends[0] & ends[1]
        cuts = np.flatnonzero(cut)
        # The group of a token: how many cuts lie before its end.
        before = np.cumsum(cut, dtype=np.int64) - cut
        group_a, group_b = before[end_a], before[end_b]
        size_a, size_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        text_of = np.zeros(len(cuts), np.int64)
        text_of[group_a] = np.repeat(np.arange(n), n_a)
        digests = self._digests(a, b, group_a, group_b, size_a, size_b, n_a, n_b)
        text, pair, times = self._pairs(a, b, group_a, group_b, size_a, size_b, text_of)
        links = np.zeros(n, np.int64)
        np.add.at(links, text_of, size_a * size_b)
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(text_of, minlength=n), "n_links": links, "groups_sha256": digests,
            "text": text, "pair": pair, "times": times,
        }

    def _pairs(self, a, b, group_a, group_b, size_a, size_b, text_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times), sorted. Groups of one token each need no product; in the others distinct ids are multiplied."""
        first_b = np.cumsum(size_b) - size_b
        single = (size_a == 1) & (size_b == 1)
        alone = single[group_a]
        texts, pairs, times = [text_of[group_a[alone]]], [a[alone] * self.n_b + b[first_b[group_a[alone]]]], [None]
        if not single.all():
            in_a, in_b = ~alone, ~single[group_b]
            key_a, id_a, times_a = _grouped(group_a[in_a], a[in_a], len(self.a.bytes))
            key_b, id_b, times_b = _grouped(group_b[in_b], b[in_b], self.n_b)
            start, stop = np.searchsorted(key_b, key_a), np.searchsorted(key_b, key_a, "right")
            at_b, at_a = _spread(start, stop - start), np.repeat(np.arange(len(key_a)), stop - start)
            texts.append(text_of[key_a[at_a]])
            pairs.append(id_a[at_a] * self.n_b + id_b[at_b])
            times.append(times_a[at_a] * times_b[at_b])
        # Pairs of single tokens are counted first, so that the rest has a row for each distinct one.
        width = len(self.a.bytes) * self.n_b
        keys, counts = np.unique(texts[0] * width + pairs[0], return_counts=True)
        if len(texts) > 1:
            keys, counts = np.r_[keys, texts[1] * width + pairs[1]], np.r_[counts, times[1]]
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
            keys, counts = keys[new], np.add.reduceat(counts, new) if len(new) else counts
        return keys // width, keys % width, counts

    def _digests(self, a, b, group_a, group_b, size_a, size_b, n_a, n_b) -> list[str]:
        """The digest of the groups of each text, written as one row of ids for all texts."""
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        places_a, places_b = np.arange(len(a)), np.arange(len(b))
        items = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = places_a == (first_a + size_a - 1)[group_a], places_b == (first_b + size_b - 1)[group_b]
        items[places_a + first_b[group_a]] = a * 3 + last_a
        items[places_b + (first_a + size_a)[group_b]] = b * 3 + 2 * last_b
        taken = self.written.take(pa.array(items))
        data = _bytes_of(taken)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(items) + 1] if len(items) else np.zeros(1, np.int64)
        stops = np.cumsum(n_a + n_b)
        starts = stops - n_a - n_b
        return [
            hashlib.sha256(data[ends[i] - ends[0] : ends[j] - ends[0] - 1]).hexdigest() if j > i else ""
            for i, j in zip(starts.tolist(), stops.tolist())
        ]


@lru_cache(maxsize=2)
def _aligner(a: str, b: str) -> Aligner:
    """One for each worker process and pair of vocabularies (file contents)."""
    return Aligner(ByteVocabulary(a), PieceVocabulary(base64.b64decode(b)))


_TEXT = pa.struct([*[(c, pa.int64()) for c in ("m1", "m2", *MEASURES[:4])], ("groups_sha256", pa.string()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])
#: A row is a stretch, named by the marks of its first text: its texts, and its distinct pairs with the number of
#: documents that hold each. ``at`` are places in ``pairs``.
_STRETCH = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("pairs", pa.list_(pa.int64())), ("documents", pa.list_(pa.int64())), ("texts", pa.list_(_TEXT))])
_STRETCH_DDL = (
    "s1 long, s2 long, pairs array<long>, documents array<long>, texts array<struct<m1: long, m2: long, n_a: long, n_b: long, "
    "n_groups: long, n_links: long, groups_sha256: string, at: array<int>, times: array<long>>>"
)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _stretch(batch: pa.RecordBatch, aligner: Aligner) -> pa.RecordBatch:
    """One row of ``_STRETCH`` for the texts of ``batch`` (text, m1, m2, copies)."""
    parts = []
    for start, part in _runs(batch.select(["text"]), PART):
        parts.append(aligner.align(part.column("text").to_pylist()))
        parts[-1]["text"] += start
    done = {k: list(chain.from_iterable(p[k] for p in parts)) if k == "groups_sha256" else np.concatenate([p[k] for p in parts]) for k in parts[0]}
    n = len(batch)
    pairs, at = np.unique(done["pair"], return_inverse=True)
    documents = np.zeros(len(pairs), np.int64)
    np.add.at(documents, at, batch.column("copies").to_numpy()[done["text"]])
    ends = np.searchsorted(done["text"], np.arange(n + 1))
    columns = [batch.column("m1"), batch.column("m2"), *[pa.array(done[c], pa.int64()) for c in MEASURES[:4]], pa.array(done["groups_sha256"], pa.string())]
    texts = pa.StructArray.from_arrays([*columns, _lists(at, ends, pa.int32()), _lists(done["times"], ends, pa.int64())], fields=list(_TEXT))
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    row = [batch.column("m1")[:1], batch.column("m2")[:1], one(pa.array(pairs, pa.int64())), one(pa.array(documents)), one(texts)]
    return pa.RecordBatch.from_arrays(row, schema=_STRETCH)


def _runs(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Neighbouring rows with ``most`` bytes of text in all, or a single row, and the place of the first."""
    start, total = 0, 0
    for i, size in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if i > start and total + size > most:
            yield start, batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(batch):
        yield start, batch.slice(start)


def _weighed(texts: pa.Array, facts: pa.Array) -> pa.Array:
    """Of each stretch its texts' measures with ``n_best`` and ``count_sum``."""
    rows, ends = [], [0]
    for i in range(len(texts)):
        held, known = texts[i].values, facts[i].values
        counts, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        place = known.field("place").to_numpy()
        counts[place], best[place] = known.field("count").to_numpy(), known.field("best").to_numpy()
        at, times = held.field("at"), held.field("times").flatten().to_numpy()
        of = np.repeat(np.arange(len(held)), pc.list_value_length(at).to_numpy())
        at = at.flatten().to_numpy()
        sums = []
        for value in (best, counts):
            total = np.zeros(len(held), np.int64)
            np.add.at(total, of, value[at] * times)
            sums.append(pa.array(total))
        rows.append(pa.StructArray.from_arrays(
            [*[held.field(c) for c in ("m1", "m2", *MEASURES[:4])], *sums, held.field("groups_sha256")], ["m1", "m2", *MEASURES, "groups_sha256"]
        ))
        ends.append(ends[-1] + len(held))
    flat = pa.concat_arrays(rows) if rows else pa.array([], pa.struct([*[(c, pa.int64()) for c in ("m1", "m2", *MEASURES)], ("groups_sha256", pa.string())]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def _marks(text: str = "text") -> dict:
    return {f"m{i}": F.xxhash64(F.lit(i), F.col(f"`{text}`")) for i in (1, 2)}


def measures(texts: DataFrame, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """``m1, m2`` (marks), the measures and the digest for every row of ``texts(text, copies)``, whose texts differ and are
    not empty."""
    spark = texts.sparkSession
    with open(vocabulary_a, encoding="utf-8") as a, open(vocabulary_b, "rb") as b:
        content_a, content_b = a.read(), b.read()
    # Files of a fixed size, read once here: workers need not have them.
    shared = spark.sparkContext.broadcast((content_a, base64.b64encode(content_b).decode()))
    n_b = len(PieceVocabulary(content_b).bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        for batch in batches:
            for _, part in _runs(batch, STRETCH):
                yield _stretch(part, aligner)

    marked = texts.withColumns(_marks()).select("text", "m1", "m2", "copies")
    stretches = cut_lineage(marked.mapInArrow(run, _STRETCH_DDL))
    each = stretches.select("s1", "s2", F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "p"))
    each = each.select("s1", "s2", "place", F.col("p.pairs").alias("pair"), F.col("p.documents").alias("documents"))
    counts = cut_lineage(each.groupBy("pair").agg(F.sum("documents").alias("count")))
    # One id of A has at most as many pairs as B has ids.
    highest = F.max("count").over(Window.partitionBy(F.floor(F.col("pair") / n_b)))
    counts = counts.withColumn("best", (F.col("count") == highest).cast("int"))
    known = each.select("s1", "s2", "place", "pair").hint("merge").join(counts, "pair")
    facts = known.groupBy("s1", "s2").agg(F.collect_list(F.struct("place", "count", "best")).alias("facts"))
    empty = F.array().cast("array<struct<place:int,count:bigint,best:int>>")
    both = stretches.select("s1", "s2", "texts").hint("merge").join(facts, ["s1", "s2"], "left").withColumn("facts", F.coalesce("facts", empty))
    kind = "array<struct<m1: long, m2: long, n_a: long, n_b: long, n_groups: long, n_links: long, n_best: long, count_sum: long, groups_sha256: string>>"
    weighed = F.arrow_udf(_weighed, kind)
    return both.select(F.explode(weighed("texts", "facts")).alias("t")).select("t.*")


def aligned(df: DataFrame, vocabulary_a: str, vocabulary_b: str, text: str = "text", spread_by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``df`` with ``n_a, n_b, n_groups, n_links, n_best, count_sum`` (long) and ``groups_sha256``: tokens of either kind, groups,
    links, links whose pair has the highest count of all pairs of their A id, the sum of the counts over all links, and the
    digest of the groups as ``a1,a2|b1;a3|b2,b3``. ``vocabulary_a`` and ``vocabulary_b`` are paths of the files; ``spread_by``
    tells documents of one text apart."""
    given = df.select(F.col(f"`{text}`").alias("text")).where("text <> ''")
    distinct = given.groupBy("text").agg(F.count("*").alias("copies"))
    found = cut_lineage(measures(distinct, vocabulary_a, vocabulary_b))
    marks = {f"_{c}": made for c, made in _marks(text).items()}
    rows = df.drop(*MEASURES, "groups_sha256").withColumns(marks)
    out = lookup_join(rows, found.withColumnsRenamed({"m1": "_m1", "m2": "_m2"}), list(marks), list(spread_by))
    zeros = {c: F.coalesce(c, F.lit(0)) for c in MEASURES}
    return out.withColumns({**zeros, "groups_sha256": F.coalesce("groups_sha256", F.lit(""))}).drop(*marks)
