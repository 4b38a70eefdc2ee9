import hashlib
import re

import numpy as np
import pytest

from lonewood.llm.postings import build_index, decontaminate, search, words_of
from llm_cases import DOCS, ODD, make_docs  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def expected(texts, items, window=10):
    found = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[k:k + window]), set()).add(i)
    out = []
    for t in texts:
        w, hit, mine = words(t), set(), set()
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in found:
                    mine |= found[tuple(w[k:k + n])]
                    hit.update(range(k, k + n))
        ids = sorted(str(i) for i in mine if i is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def corpus():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "THE", "a1"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(20)] + [(20, "to be, or NOT to be"), (21, ""), (22, None), (None, text(12)), (3, text(15)), (3, text(15))]
    texts = [text(int(rng.integers(0, 200))) for _ in range(40)]
    for k in range(0, 40, 3):
        texts[k] = texts[k] + " " + (items[k % len(items)][1] or "") + " " + texts[k][:30]
    return texts + ["To be or not to be. to be or not to be", *ODD], items


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 500, "block_bytes": 200}])
def test_matches_by_brute_force(spark, make_docs, options):
    texts, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r.leak)[:5] for r in decontaminate(make_docs(texts).repartition(3), benchmark, **options).collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts, items)


def test_words():
    for t in ODD[:7] + ["A-b C_d 9x é"]:
        assert [w.decode() for w in words_of((t or "").encode())] == words(t)


def test_proximity(spark, make_docs):
    item = "one two three four five six seven eight nine ten"
    texts = [item, "ten nine x eight seven six y five four three two one", item.replace("ten", "x " * 30 + "ten"), "one two three"]
    r = {x.doc_id: x.leak for x in decontaminate(make_docs(texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert [r[i].contaminated for i in range(4)] == [True, False, False, False]
    assert [r[i].n_near for i in range(4)] == [1, 1, 0, 0]
    assert [tuple(s) for s in r[0].spans] == [(0, 10)]


def test_search_of_a_stored_index(spark, make_docs):
    index = build_index(make_docs(["x a b c y", "a b", "c a b c"]), keep=["doc_id"])
    hits = search(index, spark.createDataFrame([("q", "a b c")], "item_id string, text string")).collect()
    assert sorted((h["begins"], h["ends"], h["items"]) for h in hits) == [([1], [4], ["q"]), ([1], [4], ["q"])]


def test_empty_tables_and_clashing_names(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [x.leak.contaminated for x in decontaminate(make_docs(["a b", None]), none).collect()] == [False, False]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate(spark.createDataFrame([], DOCS), some).count() == 0
    d = make_docs(["a b"]).withColumnRenamed("lang", "rows").withColumnRenamed("source", "n_words")
    assert [(x.rows, x.n_words, x.leak.n_hit) for x in decontaminate(d, some).collect()] == [("en", "s", 2)]
    with pytest.raises(ValueError):
        decontaminate(make_docs(["a"]).withColumnRenamed("lang", "leak"), some)
