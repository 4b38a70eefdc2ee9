import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lonewood.llm import sais
from lonewood.llm.suffixes import remove_repeats
from llm_cases import DOCS, ODD, make_docs  # noqa: F401


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.booleans())
def test_suffix_array_and_common_prefixes(values, names_by_doubling):
    t = np.array([*values, 0], np.uint8)
    kept, sais.MAX_BUCKETS = sais.MAX_BUCKETS, 0 if names_by_doubling else 2048
    try:
        sa = sais.suffix_array(t)
    finally:
        sais.MAX_BUCKETS = kept
    x = t.tolist()
    assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
    shared = sais.common_prefixes(t, sa)
    for a, b in zip(sa, sa[1:], strict=False):
        n = 0
        while max(a, b) + n < len(x) and x[a + n] == x[b + n]:
            n += 1
        assert shared[b] == n


def expected(rows, length):
    """By brute force: id -> (bytes, removed, spans, sha256 of the rest), for distinct ids."""
    first, out = {}, {}
    for i, t in sorted(((np.inf if i is None else i, t) for i, t in rows), key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            w = raw[a:a + length]
            if first.setdefault(w, i) < i:
                gone[a:a + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def found(df):
    return {np.inf if r.doc_id is None else r.doc_id: tuple(r.dedup)[:4] for r in df.select("doc_id", "dedup").collect()}


def corpus():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh é"), rng.integers(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = [text(40) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rng.integers(0, 30)) for _ in range(3)]
        for k in rng.choice(6, 2):
            parts.insert(int(rng.integers(0, 4)), shared[k][: int(rng.integers(40, 300))])
        rows.append((i, " ".join(parts)))
    return rows + [(60, "ab" * 400), (61, "ab" * 300), (62, rows[3][1]), (63, rows[3][1] + "!"), (64, "\n" * 200), (None, rows[5][1])]


@pytest.mark.parametrize("options", [{}, {"hot": 2, "block_bytes": 1500}, {"length": 30, "gram": 16}])
def test_repeats_by_brute_force(make_docs, options):
    rows = corpus() + [(100 + i, t) for i, t in enumerate(ODD)]
    got = found(remove_repeats(make_docs(rows).repartition(5), **options))
    assert got == expected(rows, options.get("length", 50))


def test_text_that_stays(make_docs):
    one, two = "é" * 30 + " the first document", "xy " + "é" * 30 + " another"
    r = {x.doc_id: x for x in remove_repeats(make_docs([one, two])).collect()}
    assert r[0].text == one and r[0].dedup.n_removed == 0
    assert r[1].text == "xy another" and r[1].dedup.n_removed == 61 and r[1].lang == "en"


def test_repeated_rows_are_no_copies(make_docs):
    t = "a long sentence that stands in the table twice, under one id both times"
    r = remove_repeats(make_docs([(7, t), (7, t), (8, t)])).collect()
    assert sorted((x.doc_id, x.dedup.n_removed) for x in r) == [(7, 0), (7, 0), (8, len(t))]


def test_empty_table_and_clashing_names(spark, make_docs):
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(make_docs(["a"]).withColumnRenamed("lang", "dedup"))
    d = make_docs(["a b", "c d"]).withColumnRenamed("lang", "block").withColumnRenamed("source", "bucket")
    assert [x.block for x in remove_repeats(d).collect()] == ["en", "en"]
