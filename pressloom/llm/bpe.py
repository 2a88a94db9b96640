"""BPE encoding and decoding with a pair occurrence index.

``encode`` turns texts into token ids, ``decode`` turns ids back into text. The vocabulary is a
tokenizer file of the common JSON layout (``model.vocab``, ``model.merges``, word ends); its path is
a parameter, it is read once on the driver and broadcast (its size does not grow with the data).

Within a task the distinct new words of a batch are laid out as one linked list of symbols. An
index maps every mergeable pair to all its positions in that list. Ranks that have positions are
taken in ascending order; each merge updates the lists of the pairs beside it. Positions are numpy
arrays, so one step merges all occurrences of a pair in all words. Parts between white space that a
worker has met before come from a cache of bounded size.

Defined results: null and empty texts have no tokens; words of any length are encoded whole;
repeated rows give equal rows; other columns pass through untouched (the new column replaces a
column of the same name).
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts between white space that a worker remembers; beyond it the cache starts anew.
CACHE_PARTS = 400_000
#: Characters of text that are split and encoded together.
STRETCH = 3_000_000
#: Ids decoded at once.
DECODED_IDS = 500_000
# The split pattern and the word-end mark are those of the tokenizer file.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
WORD_END = "</w>"
#: What str.split takes for white space and the pattern does not.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Begins the part of a special token. It is white space, so no other part holds it.
MARK = " "


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes for the characters from 256 on, in order."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and special tokens of one tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        tokens = {i: t for t, i in [*ids.items(), *self.special.items()]}
        self.names = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)], pa.string())
        self.inner = np.array([ids[c] for c in byte_letters()], np.int64)
        self.final = np.array([ids[c + WORD_END] for c in byte_letters()], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.size = len(tokens)
        keys = self.left * self.size + self.right
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]
        # Whether a merge can make a pair that ranks before it.
        first = np.full(self.size, len(pairs))
        rank = np.arange(len(pairs))
        np.minimum.at(first, self.left, rank)
        np.minimum.at(first, self.right, rank)
        self.stepwise = first[self.made] < rank
        self.word = regex.compile(WORD)
        self.space = regex.compile(r"\p{White_Space}+")
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of merges where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._order[at], len(self._keys))

    def spaced(self, text: str) -> str:
        """The normalised text with one space between its parts; special tokens are parts with a mark."""
        if self.marks is None or not self.marks.search(text):
            return self._spaced(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self._spaced(text[at : m.start()]), MARK + m[0]]
            at = m.end()
        return " ".join(filter(None, [*out, self._spaced(text[at:])]))

    def _spaced(self, text: str) -> str:
        if not text.isascii():
            # Each capital is lowered by itself, so a final sigma is an ordinary one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return " ".join(filter(None, self.space.split(text)) if SEPARATORS.search(text) else text.split())


def merge_words(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of all words in a row and where each word ends, by one pair occurrence
    index over all of them. No word is empty."""
    raw = [w.encode("utf-8") for w in words]
    sizes = np.array([len(x) for x in raw], np.int64)
    stops = np.cumsum(sizes)
    letters = np.frombuffer(b"".join(raw), np.uint8)
    symbol = vocab.inner[letters]
    symbol[stops - 1] = vocab.final[letters[stops - 1]]
    n = len(symbol)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[stops - 1] = -1
    before[stops - sizes] = -1
    word = np.repeat(np.arange(len(words)), sizes)
    none = len(vocab.made)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(at: np.ndarray) -> None:
        """Add the positions whose pair can be merged to the lists of their ranks."""
        rank = vocab.ranks(symbol[at], symbol[after[at]])
        at, rank = at[rank < none], rank[rank < none]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, places in zip(rank[np.r_[0, cuts]].tolist() if len(rank) else (), np.split(at, cuts)):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(places)

    note(np.flatnonzero(after >= 0))
    while active:
        rank = heapq.heappop(active)
        at = np.unique(np.concatenate(index.pop(rank)))
        at = at[(symbol[at] == vocab.left[rank]) & (after[at] >= 0)]
        at = at[symbol[after[at]] == vocab.right[rank]]
        if vocab.stepwise[rank] and len(at):
            # What the first merge in a word makes may come before the second one.
            rest = np.r_[False, word[at[1:]] == word[at[:-1]]]
            if rest.any():
                index[rank] = [at[rest]]
                heapq.heappush(active, rank)
                at = at[~rest]
        elif vocab.left[rank] == vocab.right[rank] and len(at) > 1:
            # In a run of equal symbols the pairs begin at every second one.
            begins = np.r_[True, at[1:] != after[at[:-1]]]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        following = after[gone]
        symbol[at], symbol[gone], after[at] = vocab.made[rank], -1, following
        before[following[following >= 0]] = at[following >= 0]
        previous = before[at]
        note(np.r_[at[following >= 0], previous[previous >= 0]])
    alive = symbol >= 0
    return symbol[alive].astype(np.int32), np.cumsum(np.bincount(word[alive], minlength=len(words)))


def _runs(flat: np.ndarray, ends: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``picked`` of ``flat`` one after the other, and the ends of these runs."""
    size = np.diff(ends, prepend=0)[picked]
    stop = np.cumsum(size)
    shift = (ends[picked] - stop).repeat(size) if len(picked) else np.zeros(0, np.int64)
    return flat[np.arange(len(shift)) + shift], stop


class Encoder:
    """Encodes texts and remembers the ids of the parts it has seen."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self, parts: list[str]) -> None:
        cut = [[p] if p[0] == MARK else self.vocab.word.findall(p) for p in parts]
        words = list({w for ws in cut for w in ws})
        plain = [w for w in words if w[0] != MARK]
        flat, ends = merge_words(plain, self.vocab) if plain else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        marked = [w for w in words if w[0] == MARK]
        flat = np.r_[flat, np.array([self.vocab.special[w[1:]] for w in marked], np.int32)]
        ends = np.r_[ends, (ends[-1] if len(ends) else 0) + np.arange(1, len(marked) + 1)].astype(np.int64)
        place = {w: i for i, w in enumerate([*plain, *marked])}
        picked = np.array([place[w] for ws in cut for w in ws], np.int64)
        flat, stop = _runs(flat, ends, picked)
        count = np.cumsum([len(ws) for ws in cut])
        own = np.where(count > 0, stop[np.maximum(count - 1, 0)], 0) if len(stop) else np.zeros(len(cut), np.int64)
        base = len(self.flat)
        self.places.update((p, len(self.ends) + i) for i, p in enumerate(parts))
        self.flat, self.ends = np.r_[self.flat, flat], np.r_[self.ends, base + own]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the texts. Their new parts are merged together."""
        parts = pc.split_pattern(pa.array([self.vocab.spaced(t) for t in texts], pa.string()), " ")
        coded = parts.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = np.array([self.places.get(p, -1) for p in names], np.int64)
        missing = np.flatnonzero(known < 0)
        if len(self.places) + len(missing) > CACHE_PARTS:
            self.forget()
            missing = np.arange(len(names))
        # An empty text is one empty part, which has no ids.
        if len(missing := missing[np.array([names[i] != "" for i in missing], bool)]):
            known[missing] = len(self.ends) + np.arange(len(missing))
            self._learn([names[i] for i in missing])
        picked = known[coded.indices.to_numpy(zero_copy_only=False)]
        size = np.where(picked < 0, 0, np.diff(self.ends, prepend=0)[picked]) if len(self.ends) else np.zeros(len(picked), np.int64)
        ids, _ = _runs(self.flat, self.ends, picked[picked >= 0])
        return ids, np.r_[0, np.cumsum(size)][parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(content: str) -> Encoder:
    """One encoder for each worker process and vocabulary: later tasks find the cache filled."""
    if (key := hash(content)) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(content))
    return _ENCODERS[key]


def _stretches(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows with ``most`` in all, or a single row."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encoded(batch: pa.Array, encoder: Encoder) -> pa.Array:
    done = [pa.array([], pa.list_(pa.int32()))]
    batch = batch.fill_null("")
    for a, b in _stretches(pc.binary_length(batch).to_pylist(), STRETCH):
        ids, ends = encoder.encode(batch[a:b].to_pylist())
        done.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32())))
    return pa.concat_arrays(done)


def _decoded(batch: pa.Array, names: pa.Array) -> pa.Array:
    done = [pa.array([], pa.string())]
    sizes = pc.fill_null(pc.list_value_length(batch), 0)
    for a, b in _stretches(sizes.to_pylist(), DECODED_IDS):
        ends = np.r_[0, np.cumsum(sizes[a:b].to_numpy())]
        tokens = names.take(batch[a:b].flatten())
        done.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), " "))
    return pa.concat_arrays(done)


def encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``, the token ids of ``text`` as array<int>. ``vocabulary``: path of the file."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value)
        for batch in batches:
            yield _encoded(batch, encoder)

    return df.withColumn(out, ids_of(F.col(f"`{text}`")))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the tokens of ``ids`` joined by one space, special tokens included (the
    tokenizer file names no decoder, and this is what its library returns then). Null ids give ''."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = _encoder(shared.value).vocab.names
        for batch in batches:
            yield _decoded(batch, names)

    return df.withColumn(out, text_of(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` in one pass and one worker."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.arrow_udf("struct<ids array<int>, decoded string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value)
        for batch in batches:
            coded = _encoded(batch, encoder)
            yield pa.StructArray.from_arrays([coded, _decoded(coded, encoder.vocab.names)], ["ids", "decoded"])

    done = df.withColumn("_coded", both(F.col(f"`{text}`")))
    return done.withColumns({ids: F.col("_coded.ids"), out: F.col("_coded.decoded")}).drop("_coded")
