import random

import pytest
from small_docs import AWKWARD, docs, with_clashes
from pressloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
files = pytest.importorskip("public_tokenizers")
FILE = files.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(FILE)


def drawn(seed, letters, n):
    random.seed(seed)
    return ["".join(random.choice(letters) for _ in range(random.randint(0, 120))) for _ in range(n)]


TEXTS = [
    *[r[1] for r in AWKWARD], "a<|endoftext|>B <|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "ΑΣ ΣΑΣ İstanbul ǅ", "don't I'LL ’s 日本語 １２ ½",
    "a" * 3001, "abcab" * 400, *drawn(1, "abcdetioΣé' 1$日İﬀ\n\x1d", 200), *drawn(2, "aab ", 100),
]


def test_equals_the_library(spark, library):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    for r in bpe.round_trip(df, FILE).collect():
        wanted = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == wanted, r.text
        assert r.decoded == library.decode(wanted, skip_special_tokens=False)


def test_apart_as_together(spark):
    df = with_clashes(docs(spark, *AWKWARD))
    apart = bpe.decode(bpe.encode(df, FILE), FILE)
    assert sorted(map(str, apart.collect())) == sorted(map(str, bpe.round_trip(df, FILE).select(apart.columns).collect()))
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), FILE).first().decoded == ""
    assert bpe.encode(df.limit(0), FILE).count() == 0


def test_lower_rank_made_on_the_way():
    """A merge that makes a pair of lower rank gives way to it within the word."""
    import json

    letters = bpe.byte_letters()
    vocab = {t: i for i, t in enumerate([*letters, *[c + "</w>" for c in letters], "ab", "aba", "ab</w>", "bab"])}
    merges = [["ab", "a"], ["b", "ab"], ["a", "b"], ["a", "b</w>"]]
    content = json.dumps({"model": {"vocab": vocab, "merges": merges}})
    v = bpe.Vocabulary(content)
    names = {i: t for t, i in vocab.items()}

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        rank = {tuple(m): i for i, m in enumerate(merges)}
        while True:
            best = min(((rank.get((a, b), 99), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(99, 0))
            if best[0] == 99:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = ["abab", "ababab", "aabbab", "babab", "abaabaab"]
    ids, ends = bpe.merge_words(words, v)
    at = 0
    for w, end in zip(words, ends):
        assert [names[i] for i in ids[at:end]] == plain(w), w
        at = end


def test_cache_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PARTS", 50)
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary(FILE)))
    for part in (TEXTS[i : i + 7] for i in range(0, len(TEXTS), 7)):
        texts = [t or "" for t in part]
        ids, ends = encoder.encode(texts)
        at = 0
        for t, end in zip(texts, ends):
            assert ids[at:end].tolist() == library.encode(t, add_special_tokens=False).ids
            at = end
