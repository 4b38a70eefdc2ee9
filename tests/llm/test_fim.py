import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lonewood.llm import fim
from lonewood.llm.catalog import op13_fill_in_middle
from lonewood.llm.fim import Summaries, Units, chunk_ends, fill_in_middle, pieces, restored, summarise
from llm_cases import DOCS, ODD, SF001, make_docs  # noqa: F401

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def expected(key, text, seed=1):
    """(n, form, prefix_chars, middle_chars, output) by listing the units."""
    text = text or ""
    u = UNIT.findall(text)
    x = sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def parts_of(text):
    raw = text.encode("utf-8", "surrogatepass")
    return pieces(raw, chunk_ends(np.frombuffer(raw, np.uint8)).tolist())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZ é日\U0001f600\n<P>.1"), max_size=400), st.integers(1, 40), st.integers(1, 60))
def test_units_of_any_pieces(text, size, limit):
    raw = text.encode()
    parts = pieces(raw, list(range(size, len(raw), size)))
    assert b"".join(parts) == raw
    starts = [m.start() for m in UNIT.finditer(text)] + [len(text)]
    units = Units(parts, Summaries(limit))
    assert units.n == len(starts) - 1
    assert [units.start(k) for k in range(units.n + 1)] == [len(text[:i].encode()) for i in starts]


def test_chunks_follow_the_content(monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in rng.integers(0, 3000, 20000)]
    a = " ".join(words)
    b = "other beginning " + " ".join(words[7:])
    pa, pb = parts_of(a), parts_of(b)
    assert len(set(pa) & set(pb)) > 0.95 * len(pa) > 100  # shared text, shared chunks
    assert b"".join(pa).decode() == a and 200 < len(a) / len(pa) < 1200
    assert max(map(len, parts_of("x" * 50000))) <= fim.MAX_CHUNK
    assert max(map(len, parts_of("é" * 50000))) <= fim.MAX_CHUNK + 1
    monkeypatch.setattr(fim, "STEP", 100)  # steps cut nowhere else
    assert parts_of(a[:3000]) == [p for p in pieces(a[:3000].encode(), chunk_ends(np.frombuffer(a[:3000].encode(), np.uint8)).tolist())]
    monkeypatch.undo()
    assert b"".join(parts_of(a[:3000])) == a[:3000].encode()


def test_steps_cut_at_the_same_places(monkeypatch):
    raw = np.random.default_rng(3).integers(0, 256, 20000).astype(np.uint8)
    whole = chunk_ends(raw).tolist()
    monkeypatch.setattr(fim, "STEP", 37)
    assert chunk_ends(raw).tolist() == whole and whole


def test_cache_is_bounded_and_compares_contents():
    cache = Summaries(limit=1000)
    for i in range(100):
        assert cache(b"chunk %d" % i) == summarise(b"chunk %d" % i)
        assert cache.size <= 1000 + 250
    assert summarise(b"ab, c") == (4, True, True) and summarise("é9".encode()) == (2, False, False)


def test_operator_by_brute_force(spark, make_docs):
    texts = [*ODD, "a <P> b", "x<S>", "<M", "<<P<S<M" * 5, "é" * 9000, *(f"Some text, number {i}: <x> y{i} <" for i in range(150))]
    d = make_docs([*enumerate(texts), (None, "no id at all"), (3, "a")]).repartition(3)
    f = fill_in_middle(d).select("*", "fim.*")
    rows = f.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", restored(f["output"], f["form"]).alias("back")).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = expected("" if r.doc_id is None else r.doc_id, r.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
        assert r.back == (r.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_query_by_brute_force(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for r in op13_fill_in_middle(spark, SF001).collect():
        n, form, p, m, out = expected(r.doc_id, text[r.doc_id])
        assert tuple(r)[1:] == (n, form, p, m, sha256(out.encode()).hexdigest(), sha256(text[r.doc_id].encode()).hexdigest())


def test_other_columns_and_empty_table(spark, make_docs):
    assert fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0
    d = make_docs(["one two", None]).withColumnRenamed("lang", "output").withColumnRenamed("source", "a.b")
    assert [r["output"] for r in fill_in_middle(d).collect()] == ["en", "en"]
    with pytest.raises(ValueError):
        fill_in_middle(d.withColumnRenamed("n_chars", "fim"))
