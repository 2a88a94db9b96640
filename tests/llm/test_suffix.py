import random
from collections import defaultdict

import numpy as np
import pytest
from pressloom.llm import queries, suffix
from small_docs import AWKWARD, docs, with_clashes


def plain(rows, length, keep):
    """Kept bytes of (order, text) rows, by the places of every window."""
    places = defaultdict(list)
    raws = [(t or "").encode() for t in rows]
    for n, raw in enumerate(raws):
        for p in range(len(raw) - length + 1):
            places[raw[p : p + length]].append((n, p))
    gone = defaultdict(set)
    for at in places.values():
        for n, p in (at if keep == "none" else at[1:]) if len(at) > 1 else ():
            gone[n].update(range(p, p + length))
    return [bytes(c for i, c in enumerate(raw) if i not in gone[n]) for n, raw in enumerate(raws)]


def texts(seed):
    random.seed(seed)
    words = ["".join(random.choice("abé") for _ in range(12)) for _ in range(6)]
    return ["".join(random.choice(words) for _ in range(random.randint(0, 12))) for _ in range(60)] + [None, "x" * 50, "", "short"]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("together", [400, 2])
def test_against_all_windows(spark, monkeypatch, keep, together):
    monkeypatch.setattr(suffix, "TOGETHER", together)
    rows = texts(5)
    df = with_clashes(docs(spark, *enumerate(rows)))
    found = {r.doc_id: r for r in suffix.remove_repeats(df, keep, 20, 10).collect()}
    wanted = plain(rows, 20, keep)
    for i, t in enumerate(rows):
        assert bytes(found[i].kept) == wanted[i]
        assert found[i].n_bytes == len((t or "").encode())
        assert len(wanted[i]) == found[i].n_bytes - sum(s.b - s.a for s in found[i].spans)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_one_passage_in_many_texts(spark, monkeypatch, keep):
    """One anchor with far more segments than go into one array, equal at its left, at its right, on both sides or on none."""
    monkeypatch.setattr(suffix, "TOGETHER", 5)
    random.seed(9)
    some = lambda n: "".join(random.choice("abcdef") for _ in range(n))
    passage, lefts, rights = some(14), [some(9) for _ in range(4)], [some(9) for _ in range(4)]
    rows = [random.choice([*lefts, some(9)]) + passage + random.choice([*rights, some(random.randint(0, 9))]) for _ in range(120)]
    found = {r.doc_id: bytes(r.kept) for r in suffix.remove_repeats(docs(spark, *enumerate(rows)), keep, 20, 10).collect()}
    assert [found[i] for i in range(len(rows))] == plain(rows, 20, keep)


def test_longest_previous_factors():
    random.seed(6)
    for _ in range(30):
        codes = np.array([random.randrange(3) for _ in range(random.randint(1, 40))])
        n = len(codes)
        order, lcp = suffix.suffix_order(codes, 64)
        assert order.tolist() == sorted(range(n), key=lambda i: codes[i:].tolist())
        match = lambda i, j: next((k for k in range(n - max(i, j)) if codes[i + k] != codes[j + k]), n - max(i, j))
        found = suffix.previous_factors(order, lcp, np.arange(n))
        for at, value in zip(order, found):
            assert value == max((match(at, j) for j in range(at)), default=0)


def test_awkward_rows(spark):
    df = docs(spark, *AWKWARD)
    found = suffix.remove_repeats(df, "none").collect()
    assert len(found) == len(AWKWARD)
    by_id = {r.doc_id: r for r in found}
    assert by_id[7].n_bytes == 150_000 and bytes(by_id[7].kept) == b""
    assert bytes(by_id[5].kept) == b"the same text twice over"
    long = docs(spark, (1, "q" + "ab" * 300), (1, "q" + "ab" * 300), (2, "ab" * 150))
    assert sorted(len(r.kept) for r in suffix.remove_repeats(long, "none").collect()) == [0, 0, 300]
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_documents(spark):
    """All windows of 400 bytes of the sample, by their hashes."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    seen = defaultdict(int)
    for r in rows:
        raw = r.text.encode()
        for p in range(len(raw) - 399):
            seen[hash(raw[p : p + 400])] += 1
    found = {r.doc_id: r for r in queries.QUERIES["op6_suffixes"](spark, sf).collect()}
    for r in rows:
        raw, gone = r.text.encode(), set()
        for p in range(len(raw) - 399):
            if seen[hash(raw[p : p + 400])] > 1:
                gone.update(range(p, p + 400))
        assert found[r.doc_id].n_removed == len(gone)
