import hashlib
import json
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from small_docs import AWKWARD, docs, with_clashes
from tokenizers import Tokenizer

from pressloom.llm import bpe, tokenalign
from pressloom.llm.queries import tokenizer_file

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
COLUMNS = [*tokenalign.MEASURES, "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    """Tokens of one text by the two libraries as (id, bytes), or None where they do not spell it."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(bpe.byte_letters())}
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece_bytes(i):
        return bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()

    def tokens(text):
        a = [(i, bytes(letters[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, piece_bytes(i)) for i in pieces.encode(text)]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None

    return tokens


def brute(texts, tokens):
    """The measures of every text, link by link."""
    groups = []
    for text in texts:
        cut = []
        if text and (both := tokens(text)):
            ends = []
            for side in both:
                at, places = 0, []
                for _, raw in side:
                    at += len(raw)
                    places.append(at)
                ends.append(places)
            start = [0, 0]
            for cutting in sorted(set(ends[0]) & set(ends[1])):
                stop = [e.index(cutting) + 1 for e in ends]
                cut.append(tuple([i for i, _ in side[x:y]] for side, x, y in zip(both, start, stop)))
                start = stop
        groups.append(cut)
    links = [Counter((a, b) for ga, gb in cut for a in ga for b in gb) for cut in groups]
    count = Counter(pair for held in links for pair in held)
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for cut, held in zip(groups, links):
        best = sum(n for pair, n in held.items() if count[pair] == highest[pair[0]])
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in cut)
        out.append((
            sum(len(a) for a, _ in cut), sum(len(b) for _, b in cut), len(cut), held.total(), best,
            sum(n * count[p] for p, n in held.items()), hashlib.sha256(written.encode()).hexdigest() if cut else "",
        ))
    return out


ODD = ["a", " ", "  two   spaces ", "naïve café — \x00\x01", "tab\tand\nline\r\n\n", "<|endoftext|> <s> </s> <unk>", "▁ below", "\u0085 　x", "a" * 5_000, "한국어 日本語 🎉🎉",
       "don't we'll I'M 'tis 12345 6.7", "ÀÁ́ é", "x" * 700 + " " * 700, "\x1c\x1d a​b", "!?" * 300]


def test_byte_vocabulary_by_ranks_is_the_librarys():
    vocabulary = tokenalign.ByteVocabulary(open(A, encoding="utf-8").read())
    assert vocabulary.ranked is not None
    random.seed(5)
    letters = list("ab cd'st\n\t 12.!é▁한🎉\u0085 ​\x1c")
    texts = [*ODD, *["".join(random.choices(letters, k=random.randrange(60))) for _ in range(2_000)]]
    quick = vocabulary.encode(texts)
    vocabulary.ranked = None
    assert quick == vocabulary.encode(texts)
    # A vocabulary in another order of ids has no ranks.
    spec = json.load(open(A, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    assert tokenalign.ByteVocabulary(json.dumps(spec)).ranked is None


def test_measures_equal_links_counted_one_by_one(spark, plain, monkeypatch):
    random.seed(6)
    words = ["the", "unbelievable", "naïve", "Straße", "tokenisation", "한국", "x1y2", "don't", "--", "ﬁn", "\n", "🎉", "  "]
    texts = [" ".join(random.choices(words, k=random.randrange(1, 40))) for _ in range(120)] + ODD
    texts += texts[:30] + texts[:3] * 10 + [None, ""]
    df = docs(spark, *[(i, t) for i, t in enumerate(texts)]).repartition(5)
    monkeypatch.setattr(tokenalign, "STRETCH", 700)
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in tokenalign.aligned(df, A, B).collect()}
    for i, (text, row) in enumerate(zip(texts, brute(texts, plain))):
        assert found[i] == row, repr(text)


def test_sample_documents(spark, plain):
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sample.toPandas()
    found = tokenalign.aligned(sample, A, B).toPandas().set_index("doc_id")
    for i, row in zip(rows.doc_id, brute(list(rows.text), plain)):
        assert tuple(found.loc[i, COLUMNS]) == row


def test_awkward_rows(spark, plain):
    df = with_clashes(docs(spark, *AWKWARD)).withColumns({c: F.lit("x") for c in ("n_a", "m1", "m2", "copies", "pair", "place", "at", "count", "best", "texts")})
    out = tokenalign.aligned(df, A, B)
    assert len(set(out.columns)) == len(out.columns) and set(df.columns) < set(out.columns)
    rows = out.collect()
    wanted = Counter((r[0], *m) for r, m in zip(AWKWARD, brute([r[1] for r in AWKWARD], plain)))
    assert Counter((r.doc_id, *[r[c] for c in COLUMNS]) for r in rows) == wanted
    assert tokenalign.aligned(df.limit(0), A, B).count() == 0
    blank = tokenalign.aligned(df.where("doc_id < 3"), A, B).select(*COLUMNS).distinct().collect()
    assert [tuple(r) for r in blank] == [(0, 0, 0, 0, 0, 0, "")]


def test_a_stretch_is_aligned_in_parts(monkeypatch):
    aligner = tokenalign.Aligner(tokenalign.ByteVocabulary(open(A, encoding="utf-8").read()), tokenalign.PieceVocabulary(open(B, "rb").read()))
    texts = [*ODD, "the naïve end. " * 200, *ODD[::-1]]
    n = len(texts)
    columns = [pa.array(texts), *[pa.array(range(n), pa.int64()) for _ in range(2)], pa.array([1 + i % 3 for i in range(n)], pa.int64())]
    batch = pa.RecordBatch.from_arrays(columns, ["text", "m1", "m2", "copies"])
    monkeypatch.setattr(tokenalign, "PART", 1 << 30)
    whole = tokenalign._stretch(batch, aligner).to_pylist()
    held, align = [], aligner.align
    monkeypatch.setattr(aligner, "align", lambda part: held.append([len(t.encode()) for t in part]) or align(part))
    monkeypatch.setattr(tokenalign, "PART", 1_000)
    assert tokenalign._stretch(batch, aligner).to_pylist() == whole
    assert len(held) > 3 and sum(map(len, held)) == n
    assert all(len(part) == 1 or sum(part) <= 1_000 for part in held)
