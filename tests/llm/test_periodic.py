from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lonewood.llm.catalog import op11_periodic_runs, with_periodic_tail
from lonewood.llm.periodic import collapsed, numbered, periodic_runs, runs_of
from llm_cases import DOCS, ODD, SF001, make_docs  # noqa: F401


def slow_runs(w, least=12):
    """All runs by definition: every stretch of every period that cannot be extended."""
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if size >= max(least, 2 * q) and not any(all(w[k] == w[k - p] for k in range(s + p, j)) for p in range(1, q)):
                out.append((s, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def strings():
    rng = np.random.default_rng(5)
    yield from ([], [1], [1] * 11, [1] * 12, [1] * 300, [1, 2] * 6, [1, 2] * 5 + [1], list(range(40)))
    fib = [[1], [1, 2]]
    while len(fib[-1]) < 350:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    yield (([1, 2] * 20 + [3]) * 3 + [4]) * 3  # runs of runs
    yield [1] * 30 + [2] + [1] * 31 + [2] + [1] * 30 + [2] + [1] * 40
    for k in (2, 3, 5, 50):
        for n in (60, 200, 333):
            yield rng.integers(0, k, n).tolist()
    for _ in range(25):
        parts = []
        for _ in range(4):
            unit = rng.integers(0, int(rng.integers(1, 30)) + 1, int(rng.integers(1, 40))).tolist()
            parts += (unit * int(rng.integers(1, 7)))[:int(rng.integers(1, 150))]
            parts += rng.integers(0, 4, int(rng.integers(0, 5))).tolist()
        yield parts


def test_runs_by_brute_force():
    for s in strings():
        assert runs_of(np.array(s, np.int64)) == slow_runs(s), s
    for least in (3, 8, 20):
        for s in list(strings())[8:16]:
            assert runs_of(np.array(s, np.int64), least) == slow_runs(s, least)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=20), st.integers(1, 6)), max_size=6))
def test_runs_of_any_repetition(parts):
    s = [x for unit, k in parts for x in unit * k]
    assert runs_of(np.array(s, np.int64)) == slow_runs(s)


def test_long_texts_take_no_quadratic_work():
    assert runs_of(np.zeros(300000, np.int64)) == [(0, 300000, 1)]
    s = np.tile(np.arange(5000), 20)
    assert runs_of(s) == [(0, 100000, 5000)]


def expected(doc_id, text):
    """The contract, word by word."""
    w = (text or "").encode().split()
    n, h = len(w), crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *top, top[0] is not None and 1000 * top[1] // top[2] or None, sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_query_by_brute_force(spark):
    rows = [r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect() if len(r.text or "") < 6000]
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, SF001).collect()}
    assert got == got | {r.doc_id: expected(r.doc_id, r.text) for r in rows} and sum(crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows) > 5
    assert any(r[1] for r in got.values())


def test_edge_cases(spark, make_docs):
    texts = [*ODD, "a b " * 10 + "c " * 20, " ".join(["x"] * 11)]
    d = make_docs(texts).repartition(3)
    got = {r.doc_id: r for r in periodic_runs(d).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode("utf-8", "surrogatepass").split()
        runs = slow_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        p = got[i].periodic
        assert (p.n_words, [tuple(r) for r in p.runs]) == (len(w), runs)
        assert p.collapsed.encode() == collapsed(w, runs)
    assert sorted(got[0].asDict()) == sorted([*d.columns, "periodic"])
    assert periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    clash = d.withColumnRenamed("lang", "runs").withColumnRenamed("source", "a.b").withColumnRenamed("n_chars", "n_words")
    assert periodic_runs(clash).columns == ["doc_id", "text", "runs", "a.b", "n_words", "periodic"]
    assert periodic_runs(clash).count() == len(texts)
    with pytest.raises(ValueError):
        periodic_runs(d.withColumnRenamed("lang", "periodic"))
    assert numbered([b"a", b"b", b"a"]).tolist() == [0, 1, 0]
    odd = d.select(with_periodic_tail(d.text, d.doc_id.cast("long") * 0 + 28).alias("t"))  # crc32("28") % 10
    assert odd.count() == len(texts)
