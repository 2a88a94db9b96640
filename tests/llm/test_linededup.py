import random

import corpus_pipeline
from pressloom.llm import QUERIES, linededup
from pyspark.sql import functions as F
from small_docs import AWKWARD, docs, with_clashes


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def changed(text, n, letters):
    out = list(text)
    for _ in range(n):
        i, kind = random.randrange(len(out)), random.randrange(3)
        out[i : i + (kind > 0)] = [random.choice(letters)] * (kind < 2)
    return "".join(out)


def plain(rows):
    """(doc_id, kept text, links) of rows in order, by comparing all lines."""
    lines = [(n, i, x.strip(" \t\r\v\f")) for n, (_, t) in enumerate(rows) for i, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= linededup.LEAST]
    kinds = list(dict.fromkeys(x[2] for x in lines))
    links = {(a, b) for i, a in enumerate(kinds) for b in kinds[:i] if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}
    root = {k: i for i, k in enumerate(kinds)}
    for _ in kinds:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    seen, gone, count = set(), set(), [0] * len(rows)
    for n, i, x in lines:
        count[n] += sum(x in pair for pair in links)
        if root[x] in seen:
            gone.add((n, i))
        seen.add(root[x])
    out = []
    for n, (doc_id, t) in enumerate(rows):
        parts = (t or "").split("\n")
        left = [x for i, x in enumerate(parts) if (n, i) not in gone]
        out.append((doc_id, t if len(left) == len(parts) else "\n".join(left), count[n]))
    return out


def test_distance_and_masks(spark):
    random.seed(1)
    pairs = []
    while len(pairs) < 400:
        a = "".join(random.choice("abc") for _ in range(random.randint(4, 14)))
        a, b = sorted((a, changed(a, random.randrange(5), "abc")), key=len)
        if len(a) > 2 and len(b) - len(a) <= 2:
            pairs.append((a, b))
    chars = [F.split(c, "") for c in ("a", "b")]
    flips = [F.bit_count(linededup.parity_mask(chars[0], r).bitwiseXOR(linededup.parity_mask(chars[1], r))) for r in linededup.RUNS]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.distance(*chars).alias("d"), F.array(*flips).alias("flips"))
    for r in df.collect():
        assert min(r.d, 3) == min(edits(r.a, r.b), 3)
        assert all(f <= 2 * run * edits(r.a, r.b) for f, run in zip(r.flips, linededup.RUNS))


def test_against_all_pairs(spark):
    random.seed(2)
    base = ["".join(random.choice("abé ") for _ in range(random.randint(18, 40))).strip() + "x" for _ in range(25)]
    lines = base + [changed(random.choice(base), random.randrange(1, 4), "abé ") for _ in range(120)] + base[:8] + ["Short.", "Short.", ""]
    random.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 6 : i * 6 + 6])) for i in range(27)] + [(90, None), (91, ""), (92, "  " + base[0] + "\t\n\nend")]
    found = {r.doc_id: r for r in linededup.dedup_lines(with_clashes(docs(spark, *rows))).collect()}
    assert len(found) == len(rows)
    for doc_id, text, links in plain(rows):
        assert (found[doc_id].text, found[doc_id].n_links) == (text, links)
    assert sum(r.n_near for r in found.values()) > 20


def test_hot_line_is_keyed_once(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 5)
    line = "a line that is nearly everywhere"
    rows = [(i, f"{line}\nown line number {i * 7919:09} of this text") for i in range(60)] + [(70, line + "!"), (71, "b" + line)]
    found = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, *rows)).collect()}
    assert [i for i in range(60) if line in found[i].text] == [0]
    assert found[70].text == found[71].text == "" and found[70].n_near == 1


def test_awkward_rows(spark):
    df = with_clashes(docs(spark, *AWKWARD))
    found = linededup.dedup_lines(df).collect()
    assert len(found) == len(AWKWARD)
    assert [r.text for r in found if r.doc_id == 5] == ["the same text twice over"] * 2
    assert [r.text for r in found if r.doc_id == 6] == [""]
    assert [r.text for r in found if r.doc_id in (1, 2, 3)] == [None, "", " \n\t"]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_equal_short_lines_go(spark, tmp_path):
    rows = [(1, "Share\nsome longer line of the first text\nOK"), (2, " Share\t\n\nShane\nsome longer line of the first texts"), (3, None), (4, "Share\nOK\nOK\n\n"), (4, "Share\nOK\nOK\n\n")]
    docs(spark, *rows).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    wanted = [(1, rows[0][1]), (2, "\nShane"), (3, None), (4, "\n"), (4, "\n")]
    for done in (linededup.dedup_lines(with_clashes(df), shortest=1), corpus_pipeline.line_dedup(spark, df, "")):
        assert sorted((r.doc_id, r.text) for r in done.collect()) == wanted
    counted = {r.doc_id: (r.n_removed, r.n_near, r.n_links) for r in QUERIES["op3_lines"](spark, str(tmp_path)).collect()}
    assert counted == {1: (0, 0, 1), 2: (2, 1, 1), 3: (0, 0, 0), 4: (3, 0, 0)}


def test_long_texts_of_equal_lines(spark):
    line = "a line that is repeated very many times"
    rows = [(1, "\n".join([line] * 60_000)), (2, "\n".join([f"{line}{i % 7}{chr(97 + i % 5)}" for i in range(60_000)] + ["end"]))]
    found = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, *rows), shortest=1).collect()}
    assert found[1].text == line and found[1].n_removed == 59_999
    assert found[2].text == "end" and found[2].n_removed == 60_000


def test_clashing_results_are_replaced(spark):
    df = docs(spark, (1, "one line\none line")).withColumns({"n_lines": F.lit("x"), "gone": F.lit("mine"), "a b": F.lit(1)})
    out = linededup.dedup_lines(df, shortest=1)
    assert len(set(out.columns)) == len(out.columns) and out.columns[-4:] == ["n_lines", "n_removed", "n_near", "n_links"]
    assert [(r.text, r.n_lines, r.gone, r["a b"]) for r in out.collect()] == [("one line", 2, "mine", 1)]


def test_keys_are_compiled_and_near_lines_meet(spark):
    random.seed(8)
    pairs = []
    for i in range(300):
        line = "".join(random.choices("abcdé ", k=random.randrange(20, 60)))
        near = list(line)
        for _ in range(linededup.EDITS):
            at, kind = random.randrange(len(near)), random.randrange(3)
            near[at : at + (kind > 0)] = [] if kind == 1 else ["x"]
        pairs.append((2 * i, line))
        pairs.append((2 * i + 1, "".join(near).ljust(18, "z")))
    lines = spark.createDataFrame(pairs, "h1 long, line string").withColumn("n", F.length("line"))
    tried = linededup.keyed(lines)
    assert "lambda" not in tried._jdf.queryExecution().toString()
    found = {}
    for r in tried.collect():
        found.setdefault((r.h1, r.probe), set()).add(r.key)
    for (a, short), (b, long) in zip(pairs[::2], pairs[1::2]):
        # A line of the same length may be the one that probes, too.
        sides = [(x, y) for x, y, shorter in ((a, b, len(long) - len(short)), (b, a, len(short) - len(long))) if shorter >= 0]
        assert any(found[x, False] & (found[y, True] | found[y, False]) for x, y in sides), (short, long)
