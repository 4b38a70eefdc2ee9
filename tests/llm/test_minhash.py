import numpy as np
import pytest

from lonewood.llm import minhash
from lonewood.llm.minhash import Signer, WordHashes, floor_of, hub_pairs, minhash_groups, shingle_set, similar
from llm_cases import DOCS, ODD, make_docs  # noqa: F401


def slow_set(text, k=2):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in lower.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if x]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected(rows, percent=80, k=2):
    """(n_shingles, component_id) of every row by comparing all pairs."""
    sets = [slow_set(t, k) for _, t in rows]
    label = list(range(len(rows)))
    near = [[j for j, y in enumerate(sets) if i == j or (x and y and 100 * len(x & y) >= percent * len(x | y))] for i, x in enumerate(sets)]
    changed = True
    while changed:
        new = [min(label[j] for j in near[i]) for i in range(len(rows))]
        changed, label = new != label, new
    best = {}
    for (i, _), root in zip(rows, label, strict=True):
        best[root] = i if best.get(root) is None else best[root] if i is None else min(best[root], i)
    return [(len(s), best[r]) for s, r in zip(sets, label, strict=True)]


def family(n, seed, words=100, edits=4):
    """A text and ``n`` copies, each with some words changed: most are linked with the text only."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = [" ".join(base)]
    for k in range(n):
        copy = list(base)
        for j in rng.choice(words, edits + k % 3, replace=False):
            copy[j] = f"other{seed}-{k}-{j}"
        out.append(" ".join(copy))
    return out


def check(got, rows, **options):
    want = {}
    for (i, _), w in zip(rows, expected(rows, **options), strict=True):
        want.setdefault(i, []).append(w)
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.minhash.n_shingles, r.minhash.component_id))
    assert {i: sorted(v, key=repr) for i, v in have.items()} == {i: sorted(v, key=repr) for i, v in want.items()}


@pytest.mark.parametrize("small, piece, pack", [(6, 1024, 512), (2, 8, 5)])
def test_groups_by_brute_force(make_docs, small, piece, pack):
    texts = [t for s in range(6) for t in family(3, s)] + ODD + family(40, 77) + family(30, 78, words=120, edits=7) + family(2, 8) + ["A  b", "a B", "a b a", "one", "ONE"]
    rows = list(enumerate(texts))[::-1]
    got = minhash_groups(make_docs(rows).repartition(4), small=small, piece_rows=piece, pack=pack).collect()
    check(got, rows)
    classes = {(r.minhash.component_id, r.minhash.n_shingles > 0) for r in got}
    assert sum(r.minhash.first for r in got) == len(classes) and all(r.doc_id == r.minhash.component_id for r in got if r.minhash.first)


def test_other_shingles_and_thresholds(make_docs):
    rows = list(enumerate([t for s in range(4) for t in family(6, s, edits=1)]))
    for k, percent in ((5, 80), (1, 95)):
        got = minhash_groups(make_docs(rows), shingle=k, percent=percent).collect()
        check(got, rows, percent=percent, k=k)


def test_null_ids_repeated_rows_empty_table_and_clashing_names(spark, make_docs):
    a, b = family(1, 3, edits=2)
    rows = [(None, a), (7, b), (7, b), (9, a), (None, "alone in the world"), (None, None), (11, ""), (12, " ")]
    got = minhash_groups(make_docs(rows).coalesce(1)).collect()
    check(got, rows)
    assert sum(r.minhash.first for r in got if r.minhash.component_id == 7) == 1
    assert minhash_groups(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.minhash.n_shingles for r in minhash_groups(make_docs([None, ""])).collect()] == [0, 0]
    d = make_docs([a, b]).withColumnRenamed("lang", "key").withColumnRenamed("source", "a.b").withColumnRenamed("n_chars", "signature")
    got = minhash_groups(d)
    assert got.columns == ["doc_id", "text", "key", "a.b", "signature", "minhash"] and sorted(r.minhash.component_id for r in got.collect()) == [0, 0]
    with pytest.raises(ValueError):
        minhash_groups(d.withColumnRenamed("a.b", "minhash"))
    named = make_docs([a, b]).selectExpr("concat('id', doc_id) as doc_id", "text")
    assert {r.minhash.component_id for r in minhash_groups(named).collect()} == {"id0"}


def test_sets_and_signatures():
    h = WordHashes()
    for t in [*ODD, *family(3, 1)]:
        assert len(shingle_set((t or "").encode("utf-8", "surrogatepass"), h)) == len(slow_set(t))
    a, b = (shingle_set(t.encode(), h) for t in family(1, 5, words=2000, edits=100))
    s = Signer()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s.minima(a) == s.minima(b)).mean() - true) < 0.1
    assert (s.band_values(s.minima(a)) == s.band_values(s.minima(a))).all()
    assert similar(np.arange(8, dtype=np.uint64), np.arange(10, dtype=np.uint64), 80) and not similar(np.arange(79, dtype=np.uint64), np.arange(100, dtype=np.uint64), 80)
    assert 0.67 * 384 < floor_of(80, 384) < 0.69 * 384


def test_intersections_by_brute_force(monkeypatch):
    rng = np.random.default_rng(4)
    for often, columns in ((64, 4096), (0, 16), (3, 7)):
        monkeypatch.setattr(minhash, "OFTEN", often)
        monkeypatch.setattr(minhash, "_SLICE", columns)
        x, y = ([np.unique(rng.integers(0, 60, int(rng.integers(1, 50))).astype(np.uint64)) for _ in range(n)] for n in (9, 14))
        assert minhash.common_counts(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]


def test_words_remembered_are_bounded(monkeypatch):
    monkeypatch.setattr(minhash, "WORDS", 3)
    h = WordHashes()
    want = shingle_set(b"a b c d e f a b", WordHashes())
    assert (shingle_set(b"a b c d e f a b", h) == want).all() and len(h) <= 4


def test_hub_is_the_common_ancestor():
    s, h = Signer(), WordHashes()
    texts = family(60, 9, words=200, edits=5)
    signatures = np.array([s.minima(shingle_set(t.encode(), h)).astype(np.uint8) for t in texts])
    a, b = hub_pairs(signatures, floor_of(80, 384))
    assert set(a.tolist()) == {0} and sorted(b.tolist()) == list(range(1, 61))
    assert [x.tolist() for x in hub_pairs(signatures[:1], 200)] == [[], []]
