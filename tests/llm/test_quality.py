import math
import random
import re

from pyspark.sql import functions as F

from corpus_pipeline import quality_stage
from lonewood.llm.quality import MAX_CLASS_DISTANCE, MAX_COMMON_CHARS, N_COMMON, WORD_MARGIN, WORD_SHARE, js_distance, language_references, quality_rules
from llm_cases import DOCS, ODD, make_docs  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = WORD.findall(t)
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i:i + 5]), []).append(i)
    inside = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def classes(t):
    n = [len(re.findall(c, t)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[ \t-\r]", "[^\x00-\x7f]")]
    return [*n[:4], len(t) - sum(n), n[4]]


def js(p, q):
    if not sum(p) or not sum(q):
        return None
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    total = sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q))
    return math.sqrt(max(0, total / 2))


def corpus():
    plain = "The quick brown fox and the lazy dog went to the river with a friend of the house\nand they sat in the sun. "
    texts = [" ".join(f"{w}{(i * 7 + k) % 13 if k % 9 == 0 else ''}" for k, w in enumerate((plain * (3 + i % 3)).split(" "))) for i in range(30)]
    return texts + ["one two three four five " * 30, "a b c d e f a b c d e f g", "a a a a a a a", "%%% ### $$$ x&& " * 40, "l1 a\nl1 a\n\n \nl1 a", "1 2 3 4 5 6 7 8 9 10 11", *ODD]


def test_counts_and_distances_by_brute_force(make_docs):
    texts = corpus() + corpus()[:9]
    got = {r.doc_id: r.quality for r in quality_rules(make_docs(texts).repartition(4)).collect()}
    total = {}
    for t in {t or "" for t in texts}:
        for w in WORD.findall(t or ""):
            total[w] = total.get(w, 0) + 1
    common = sorted((w for w in total if len(w) <= MAX_COMMON_CHARS), key=lambda w: (-total[w], w.encode()))[:N_COMMON]
    ref_words = [total[w] for w in common] + [sum(total.values()) - sum(total[w] for w in common)]
    ref_classes = [sum(x) for x in zip(*[classes(t) for t in {t or "" for t in texts}])]
    ceiling = js([0] * len(common) + [1], ref_words)
    for i, t in enumerate(texts):
        g, b = got[i], base(t)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == b, (i, t)
        assert g.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        w = WORD.findall(t or "")
        d1 = js(classes(t or ""), ref_classes) if len(t or "") >= 200 else None
        d2 = js([w.count(x) for x in common] + [sum(x not in common for x in w)], ref_words) if len(w) >= 60 else None
        for have, want in ((g.class_distance, d1), (g.word_distance, d2)):
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-9)
        assert g.kept == (not g.base_failed and (d1 or 0) <= MAX_CLASS_DISTANCE and (d2 or 0) <= WORD_SHARE * ceiling + WORD_MARGIN / max(1, len(w)) ** 0.5)


def test_texts_that_differ_in_long_words_only_are_different(make_docs):
    rows = ["the cat extraordinary", "the cat unbelievable", "the cat unbelievable", "the eightlet ninechars"]
    r = language_references(make_docs(rows)).first()
    assert dict(zip(r.ref_words, r.ref_counts)) == {"the": 3, "cat": 2, "eightlet": 1} and r.ref_counts[-1] == 3
    r = language_references(make_docs(rows), distinct=False).first()
    assert dict(zip(r.ref_words, r.ref_counts)) == {"the": 4, "cat": 3, "eightlet": 1} and r.ref_counts[-1] == 4


def test_languages_have_their_own_references(spark):
    rows = [(1, "the cat", "en"), (2, "der hund", "de"), (3, "x y", None)]
    refs = language_references(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.ref_lang: sorted(r.ref_words) for r in refs} == {"en": ["cat", "the"], "de": ["der", "hund"], "": ["x", "y"]}


def test_distance_of_arrays(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 1.0], [3.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "p array<double>, q array<double>")
    assert [r.d for r in df.select(js_distance(F.col("p"), F.col("q")).alias("d")).collect()] == [1.0, 0.0, None]


def test_no_python_in_the_plan_and_clashing_names(spark, make_docs):
    d = quality_rules(make_docs(corpus()).withColumnRenamed("source", "n_words").withColumnRenamed("n_chars", "ref_lang"))
    plan = d._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert d.columns == ["doc_id", "text", "lang", "n_words", "ref_lang", "quality"] and d.count() == len(corpus())
    assert quality_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_a_filter_on_the_verdict_computes_it_once(make_docs):
    d = quality_rules(make_docs(corpus())).where("quality.kept").select("doc_id")
    assert d._jdf.queryExecution().executedPlan().toString().count("[a-z]+") == 1


def test_copies_do_not_become_the_reference_of_the_stage(spark, make_docs):
    rng = random.Random(1)
    common = "the of and to in a is that for it was on with as by at".split()
    clean = [" ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(120)) for _ in range(40)]
    junk = [" ".join(rng.choice(common) + rng.choice("&%$#") * 5 for _ in range(120)) for _ in range(4)]
    rows = list(enumerate(clean + junk))
    copies = [(100 + i, junk[0]) for i in range(22)]
    want = set(range(40))
    assert {r.doc_id for r in quality_stage(spark, make_docs(rows), None).collect()} == want
    assert {r.doc_id for r in quality_stage(spark, make_docs(rows + copies).repartition(5), None).collect()} == want
    assert language_references(make_docs(rows + copies), distinct=True).collect() == language_references(make_docs(rows), distinct=True).collect()


def test_the_cut_follows_the_language(spark, make_docs):
    """Texts without common words go where these make up a fifth of the language or a tenth."""
    rng = random.Random(3)
    common = "the of and to in a is that for it was on with as by at".split()
    rare = lambda: "".join(rng.choices("etaoinshrdlu", k=9))
    for share in (0.25, 0.12):
        clean = [" ".join(rng.choice(common) if rng.random() < share else rare() for _ in range(600)) for _ in range(60)]
        junk = [" ".join(rare() for _ in range(600)) for _ in range(3)]
        got = {r.doc_id for r in quality_rules(make_docs(clean + junk)).where("quality.kept").collect()}
        assert got == set(range(60)), share


def test_a_word_is_compared_with_the_common_words_of_its_slot(spark, make_docs):
    """Words are looked up by a hash, not along the list of common words: more common words than
    slots give the same counts, and the plan searches no list of all of them."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") + str(int(rng.paretovariate(0.4)) % 700) for _ in range(400)) for _ in range(12)]
    n = 600
    d = quality_rules(make_docs(texts), n_common=n)
    assert "array_contains(ref_words" not in d._jdf.queryExecution().optimizedPlan().toString()
    total = {}
    for w in [w for t in texts for w in t.split()]:
        total[w] = total.get(w, 0) + 1
    common = sorted((w for w in total if len(w) <= MAX_COMMON_CHARS), key=lambda w: (-total[w], w.encode()))[:n]
    ref = [total[w] for w in common] + [sum(total.values()) - sum(total[w] for w in common)]
    for r in d.collect():
        w = texts[r.doc_id].split()
        own = [w.count(x) for x in common]
        assert abs(r.quality.word_distance - js(own + [len(w) - sum(own)], ref)) < 1e-9


def test_repeated_windows_of_any_place_by_brute_force(make_docs):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["a", "b", "cc", "d é"], k=rng.randrange(0, 40))) for _ in range(150)]
    for r in quality_rules(make_docs(texts)).collect():
        assert r.quality.n_repeat_words == base(texts[r.doc_id])[4]


def test_unknown_languages_of_given_references(make_docs):
    refs = language_references(make_docs(["the cat sat on the mat"]).selectExpr("text", "'xx' as lang"))
    d = quality_rules(make_docs(corpus()[:3]), references=refs).collect()
    assert all(r.quality.word_distance is None and r.quality.kept == (not r.quality.base_failed) for r in d)
