import random
import re

import numpy as np
import xxhash
from small_docs import AWKWARD, docs, with_clashes
from pressloom.llm import simhash
from pressloom.llm.components import components


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Smallest index that each fingerprint reaches over links of two bits."""
    least = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    least[i] = min(least[i], least[j])
    return least


def test_fingerprints():
    random.seed(1)
    texts = [r[1] for r in AWKWARD if r[0] != 7] + ["AÄ b  C\x0bd\x1ce\x85 f"] + [" ".join(random.choices(["Ab", "c", "dÉ", "e"], k=n)) for n in range(30)]
    for t in texts:
        assert simhash.fingerprint(t) % (1 << 64) == plain_print(t), t


def test_golay_code_is_perfect():
    golay = simhash.Golay()
    assert len(set(golay.error.tolist())) == 2048
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    # Words up to two bits apart have an index in common.
    for a, near in zip(words, golay.near(words)):
        flipped = np.array([a ^ (1 << i) ^ (1 << j) for i in range(23) for j in range(i + 1)])
        assert all(set(near) & set(other) for other in golay.near(flipped))


def test_all_links_are_found(spark):
    random.seed(2)
    prints = []
    for _ in range(12):
        base = random.getrandbits(64)
        prints += [base] + [base ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(4)]
    # A group that is larger than a bucket may be, and a chain.
    base = random.getrandbits(64)
    prints += [base ^ (1 << i) for i in range(20, 64)]
    prints += [(1 << (2 * i)) - 1 for i in range(20)]
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fingerprint long")
    found = {r.doc_id: r.component_id for r in simhash._with_components(df).collect()}
    assert [found[i] for i in range(len(prints))] == groups([p % (1 << 64) for p in prints])


def test_awkward_rows(spark):
    df = with_clashes(docs(spark, *AWKWARD))
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {r.doc_id: r for r in rows}
    assert {by_id[i].component_id for i in (1, 2, 3)} == {1}
    assert by_id[5].component_id == by_id[6].component_id == 5
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(80), random.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert found == least
