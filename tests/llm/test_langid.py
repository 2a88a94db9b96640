import random
from collections import Counter

from small_docs import AWKWARD, docs, with_clashes
from pressloom.llm import langid, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    found = queries.QUERIES["op2_language"](spark, SF).where("held_out")
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right, n = found.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.98
    assert found.where("score < 0 OR score > 1").isEmpty()


def test_awkward_rows(spark):
    english = ["the cat and the dog", "this is the text", "that was then", "another thing there"] * 5
    german = ["der hund und die katze", "das ist ein text", "nicht schlecht", "schon wieder eine sache"] * 5
    known = docs(spark, *[(i, t, "en") for i, t in enumerate(english)], *[(i, t, "de") for i, t in enumerate(german)])
    filters = langid.learn(known)
    assert filters.languages == ["de", "en"]
    rows = langid.predict(with_clashes(docs(spark, *AWKWARD, (20, "der hund ist schlecht", None), (21, "жук", None))), filters).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(AWKWARD) + 2
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 9))
    assert by_id[20].lang_pred == "de" and by_id[20].score > 0.5
    assert by_id[21].lang_pred in ("de", "en") and by_id[21].score == 0


def test_nothing_to_learn(spark):
    filters = langid.learn(docs(spark, (1, "text", None)))
    assert [r.lang_pred for r in langid.predict(docs(spark, (1, "text", None)), filters).collect()] == ["und"]
    assert langid.predict(docs(spark, (1, "t")).limit(0), filters).count() == 0


def test_more_languages_than_bits(spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}xy" for i in range(70)]
    known = docs(spark, *[(i, f"{w} {w} {w}", f"l{i:02}") for i, w in enumerate(words)])
    filters = langid.learn(known)
    assert len(filters.languages) == 70
    assert all(langid.judge(f"{w} {w}", filters)[0] == f"l{i:02}" for i, w in enumerate(words))


def grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    letters = " " + " ".join(letters.split()) + " "
    return [letters[i : i + n] for n in langid.SIZES for i in range(len(letters) - n + 1)]


def test_against_plain_sets_of_ngrams(spark):
    """The languages of each n-gram as sets, its occurrences in a text counted one by one."""
    random.seed(8)
    sounds = {"aa": "ka lo mi tu re sa", "bb": "ka lo vi zu ne pa", "cc": "cho lo mi zu que ra"}
    say = lambda k, n: " ".join("".join(random.choices(sounds[k].split(), k=random.randint(1, 4))) for _ in range(n))
    known = [(say(k, 30), k) for k in sounds for _ in range(20)]
    filters = langid.learn(docs(spark, *[(i, t, k) for i, (t, k) in enumerate(known)]))
    counts = {(k, n): Counter(g for t, lang in known if lang == k for g in grams(t) if len(g) == n) for k in sounds for n in langid.SIZES}
    share = {(k, g): c / sum(counts[k, n].values()) for k, n in counts for g, c in counts[k, n].items()}
    best = Counter()
    for (_, g), s in share.items():
        best[g] = max(best[g], s)
    sets = {k: {g for (lang, g), s in share.items() if lang == k and s >= langid.LEAST_SHARE and s >= langid.LEAST_PART * best[g]} for k in sounds}
    for _ in range(200):
        text = " ".join(say(k, random.randint(0, 8)) for k in sounds)
        if not text.strip():
            continue
        all_grams = grams(text)
        hits = {k: sum(g in sets[k] for g in all_grams) for k in sounds}
        lang, score = langid.judge(text, filters)
        assert abs(score - max(hits.values()) / len(all_grams)) < 0.08
        first, second, *_ = sorted(hits.values(), reverse=True)
        assert first - second < 0.1 * len(all_grams) or hits[lang] == first


def test_copies_weigh_once(spark):
    """One text in thousands of copies among others of its language: all are learned from."""
    others = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} stands here" for i in range(100)]
    many = docs(spark, *[(i, "the same text", "en") for i in range(3_000)], *[(9_000 + i, t, "en") for i, t in enumerate(others)])
    once = docs(spark, (1, "the same text", "en"), *[(9_000 + i, t, "en") for i, t in enumerate(others)])
    a, b = langid.learn(many, sample=200), langid.learn(once, sample=200)
    assert (a.masks == b.masks).all() and (a.rates == b.rates).all()
