import numpy as np
import pytest
import xxhash

from lonewood.llm.components import connected_components
from lonewood.llm.simhash import _forest, block_keys, fingerprint, near_links, pivot_table, pivots, simhash_groups
from llm_cases import DOCS, ODD, make_docs  # noqa: F401


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in [9, 10, 11, 12, 13]}).split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(fps, ids, bits):
    """Least id of each component by brute force."""
    label = list(range(len(fps)))
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None]) <= bits
    changed = True
    while changed:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(fps))]
        changed, label = new != label, new
    best = {}
    for root, i in zip(label, ids, strict=True):
        best[root] = min(best.get(root, i), i)
    return [best[r] for r in label]


def near_copies(n=40):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(n):
        base = list(rng.choice(words, 150))
        for k in range(int(rng.integers(1, 4))):
            copy = list(base)
            for j in rng.choice(150, k, replace=False):
                copy[j] = "other"
            out.append(" ".join(copy))
    return out


def test_fingerprint_by_brute_force():
    for t in [*ODD[:7], *ODD[8:], *near_copies(5), "A b  C\td e\nF"]:
        assert fingerprint((t or "").encode("utf-8", "surrogatepass")) == slow_fingerprint(t)


@pytest.mark.parametrize("shape", [[], [0, 1, 2, 3]])
def test_groups_by_brute_force(make_docs, shape):
    texts = near_copies() + ODD if not shape else ODD[:1] * 4
    d = make_docs(texts)
    got = {r.doc_id: r.simhash for r in simhash_groups(d.repartition(4)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    want = classes(fps, list(range(len(texts))), 4)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert sorted(i for i in got if got[i].first) == sorted(set(want))


def random_cluster(n, rng):
    """Fingerprints within few bits of a few centres."""
    centres = rng.integers(0, 1 << 64, 5, np.uint64)
    fp = rng.choice(centres, n)
    for _ in range(4):
        fp ^= np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(np.concatenate([fp, centres]))


@pytest.mark.parametrize("chunk", [4096, 20])
def test_links_connect_what_is_near(spark, chunk):
    fp = random_cluster(600, np.random.default_rng(1))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    edges = near_links(df, chunk=chunk).collect()
    for e in edges:
        assert (int(e.a) ^ int(e.b)).bit_count() <= 4 or ((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 4
    parent = {int(x): int(x) for x in fp.view(np.int64)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[find(e.a)] = find(e.b)
    want = classes(fp.tolist(), list(range(len(fp))), 4)
    roots = [find(int(x)) for x in fp.view(np.int64)]
    assert len(set(zip(roots, want, strict=True))) == len(set(want)) == len(set(roots))


def test_pivot_bound_and_forest():
    fp = random_cluster(200, np.random.default_rng(2))
    table = pivot_table(fp, pivots())
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    assert (np.abs(table[:, None].astype(int) - table[None]).max(axis=2) <= 4)[near].all()
    a, b = _forest(fp, table, 4)
    assert near[a, b].all() and len(a) == len(fp) - len(set(classes(fp.tolist(), list(range(len(fp))), 4)))


def test_block_keys_meet_every_linked_pair():
    rng = np.random.default_rng(4)
    for n in (10, 1e7, 1e9):
        masks = block_keys(n, 4)
        for _ in range(200):
            d = 0
            for k in rng.choice(64, 4, replace=False):
                d |= 1 << int(k)
            assert any(d & m == 0 for m in masks)


def test_components(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    label = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in label.items() if x != r}


def test_null_ids_empty_table_and_clashing_names(spark, make_docs):
    t = " ".join(f"w{i}" for i in range(50))
    r = simhash_groups(make_docs([(None, t), (3, t), (9, t), (None, "alone in the world")])).collect()
    assert sorted((x.doc_id or 0, x.simhash.component_id, x.simhash.first) for x in r if x.text == t) == [(0, 3, False), (3, 3, True), (9, 3, False)]
    assert [x.simhash.component_id for x in r if x.text != t] == [None]
    assert simhash_groups(spark.createDataFrame([], DOCS)).count() == 0
    d = make_docs([t, t]).withColumnRenamed("lang", "fp").withColumnRenamed("source", "rep")
    assert sorted((x.fp, x.rep, x.simhash.first) for x in simhash_groups(d).collect()) == [("en", "s", False), ("en", "s", True)]
