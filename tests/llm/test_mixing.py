from collections import Counter

from pressloom.llm import mixing
from pyspark.sql import functions as F
from small_docs import AWKWARD, docs, with_clashes


def targets(sizes):
    """Weights 5, 2, 1 by name, excess shared again until none is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight, fixed = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}, {}
    while True:
        rest, total = sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in names if s not in fixed)
        out = {s: fixed.get(s, rest * weight[s] / total if total else 0.0) for s in names}
        over = [s for s in names if s not in fixed and out[s] > 3 * sizes[s]]
        if not over:
            return out
        fixed.update({s: 3 * sizes[s] for s in over})


def check(df):
    found = mixing.taken(df).collect()
    sizes = Counter()
    for r in found:
        sizes[r.source] += r.size
    wanted = targets(sizes)
    for s in sizes:
        own = [r for r in found if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - wanted[s]) < 1e-6 * max(1, wanted[s]) for r in own)
        assert abs(sum(r.taken for r in own) - wanted[s]) <= 1.5 * mixing.BLOCK + 0.02 * wanted[s]
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    return found


def test_permutations(spark):
    for n in (1, 2, 3, 10, 127, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k")).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(n))


def test_targets_and_caps(spark):
    rows = [(i, "w " * (i % 700), None, "abcd"[min(3, i % 9)]) for i in range(400)]
    rows += [(1000 + i, "v " * 30, None, s) for i, s in enumerate(["", "e", None, "tiny"])] + [(2000, "u " * 60_000, None, "f")]
    first = check(docs(spark, *rows))
    again = check(docs(spark, *rows[::-1]).repartition(7))
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_mix_holds_what_was_counted(spark):
    rows = [(i, " ".join(f"{i}.{k}" for k in range(i * 3 % 500)), "en", "ab"[i % 2]) for i in range(80)]
    df = with_clashes(docs(spark, *rows))
    mixed, counted = mixing.mixed(df).collect(), mixing.taken(df).collect()
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(r.text.split())
        assert r.text.split() == rows[r.doc_id][1].split()[r.from_word :][: len(r.text.split())] and r.n_chars == len(r.text)
    assert words == Counter({r.doc_id: r.taken for r in counted if r.taken})
    slots = {r.slot for r in mixed}
    assert slots == set(range(len(slots)))
    assert all(sum(len(r.text.split()) for r in mixed if r.slot == s) <= mixing.BLOCK for s in list(slots)[:20])


def test_awkward_rows(spark):
    df = with_clashes(docs(spark, *AWKWARD))
    found = check(df)
    assert len(found) == len(AWKWARD)
    assert all(r.taken == 0 for r in found if r.doc_id in (1, 2, 3))
    assert mixing.taken(df.limit(0)).count() == mixing.mixed(df.limit(0)).count() == 0
    blank = docs(spark, (1, None), (2, " ", None, "a"))
    assert [(r.size, r.target, r.taken) for r in mixing.taken(blank).collect()] == [(0, 0.0, 0)] * 2


def test_equal_rows_without_words_stay_apart(spark):
    rows = [(1, None, None, "a"), (1, None, None, "a"), (1, "", None, "a"), (2, " ", None, None), (2, " ", None, None), (3, "some words", None, "a"), (3, "some words", None, "a")]
    found = check(docs(spark, *rows))
    assert Counter((r.doc_id, r.size) for r in found) == {(1, 0): 3, (2, 0): 2, (3, 2): 2}
