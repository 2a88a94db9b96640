import hashlib
import random

from small_docs import AWKWARD, docs, with_clashes
from pressloom.llm import winnow


def plain(text, k, w):
    """All windows one by one."""
    if not text:
        return []
    k = min(k, len(text))
    hashes = []
    for i in range(len(text) - k + 1):
        v = 0
        for c in text[i : i + k]:
            v = (v * 0x100000001B3 + ord(c) + 1) % (1 << 64)
        hashes.append((((v ^ (v >> 31)) * 0x9E3779B97F4A7C15) % (1 << 64)) >> 32)
    w, out = min(w, len(hashes)), []
    for i in range(len(hashes) - w + 1):
        best = max(range(i, i + w), key=lambda j: (-hashes[j], j))
        if not out or out[-1][1] != best:
            out.append((hashes[best], best))
    return out


def test_windows():
    random.seed(1)
    for n in (0, 1, 5, 15, 16, 17, 40, 47, 48, 300):
        for k, w in ((16, 32), (5, 7), (13, 10), (1, 1)):
            text = "".join(random.choice("abé🎉") for _ in range(n))
            hashes, places = winnow.chosen(text, k, w)
            assert list(zip(hashes.tolist(), places.tolist())) == plain(text, k, w)


def test_shared_passages_share_a_hash():
    random.seed(2)
    draw = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        passage = draw(winnow.K + winnow.WINDOW - 1)
        a, b = (winnow.chosen(draw(99) + passage + draw(50), winnow.K)[0] for _ in range(2))
        assert set(a) & set(b)


def covered(text, other, k=winnow.K, w=winnow.WINDOW):
    """Spans by marking every character of a shared k-gram."""
    shared = {h for h, _ in plain(other, k, w)}
    marks = [False] * len(text)
    for h, p in plain(text, k, w):
        if h in shared:
            marks[p : p + min(k, len(text))] = [True] * min(k, len(text))
    out, i = [], 0
    while i < len(marks):
        j = i
        while j < len(marks) and marks[j]:
            j += 1
        if j > i:
            out.append(f"{i}-{j}")
        i = j + 1
    return ",".join(out)


def test_shared_passages_are_located(spark):
    random.seed(5)
    draw = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    for _ in range(50):
        passage = draw(winnow.K + winnow.WINDOW - 1)
        a, b = draw(random.randrange(99)) + passage + draw(50), draw(70) + passage
        found = winnow.located(*winnow.chosen(a), winnow.chosen(b)[0], winnow.K)
        assert ",".join(f"{x}-{y}" for x, y in found) == covered(a, b)
        at = a.index(passage)
        assert any(x < at + len(passage) and y > at for x, y in found)
    rows = {i: draw(random.randrange(300)) for i in range(40)} | {40: "", 41: "short"}
    rows[7] = rows[6]
    got = {r.doc_id: r for r in winnow.compared_with_edits(docs(spark, *rows.items())).collect()}
    for i, text in rows.items():
        after, half = rows[(i - 1) % len(rows)], len(text) // 2
        assert got[i].next_spans == covered(text, after) and got[i].edited_spans == covered(text, text[: len(text) - half] + after[:half])
    assert got[40].next_spans == "" == got[40].edited_spans


def test_edits_and_order(spark):
    random.seed(3)
    rows = [(random.randrange(10**6), "".join(random.choice("ab cé") for _ in range(random.randrange(200)))) for _ in range(120)]
    rows += [(r[0], r[1]) for r in AWKWARD]
    found = winnow.compared_with_edits(with_clashes(docs(spark, *rows))).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    wanted = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, following = ({h for h, _ in plain(t, winnow.K, winnow.WINDOW)} if len(t) < 9999 else None for t in (text, edited, after))
        near = [None if None in (own, x) else (len(own & x) / len(own | x) if own | x else 1.0) for x in (changed, following)]
        wanted.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(), *near))
    got = sorted(((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found), key=lambda x: x[:3])
    for g, w in zip(got, sorted(wanted, key=lambda x: x[:3]), strict=True):
        assert g[:3] == w[:3]
        assert all(b is None or abs(a - b) < 1e-9 for a, b in zip(g[3:], w[3:]))


def test_places_and_empty(spark):
    rows = winnow.fingerprints(docs(spark, (1, "a fairly long text with some words in it"), (2, None))).collect()
    assert [(p.hash, p.pos) for p in rows[0].fingerprint] == plain(rows[0].text, winnow.K, winnow.WINDOW)
    assert rows[1].fingerprint == []
    assert winnow.compared_with_edits(docs(spark, (1, "a")).limit(0)).count() == 0
    assert winnow.compared_with_edits(docs(spark, (1, "abcd"))).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
