import os

import duckdb
import pytest

from lonewood.llm.catalog import ORACLE, QUERIES
from llm_cases import SF001


def test_one_query_per_operator():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """The tables with columns more: every name of a result or of a step, and odd names."""
    import duckdb

    folder = str(tmp_path_factory.mktemp("wide"))
    names = """quality simhash leak dedup minhash periodic fim toxicity row block place key signature bands root value piece n runs output form fingerprint
        component_id kept first id ids start length offset sequence_id score predicted held_out n_words n_hit n_items contaminated payload payload_digest record_type
        refers_to rendered n_lines host hash salt templates path part file none r w t h m __d __text __id __row""".split()
    for f in os.listdir(SF001):
        at = f"{SF001}/{f}"
        have = {c[0] for c in duckdb.sql(f"DESCRIBE SELECT * FROM '{at}'").fetchall()}
        more = [n for n in [*names, "text", "n_chars", "role", "lang"] if n not in have]
        extra = ", ".join([*(f"'{n}' AS \"{n}\"" for n in more), "1 AS \"a.b\"", "2 AS \"c d\""])
        duckdb.sql(f"COPY (SELECT *, {extra} FROM '{at}') TO '{folder}/{f}' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", [*sorted(QUERIES), "pipeline"])
def test_other_columns_of_any_name(spark, wide, name):
    import corpus_pipeline

    query = corpus_pipeline.run if name == "pipeline" else QUERIES[name]
    got, want = query(spark, wide), query(spark, SF001)
    drop = [c for c in ("sequence_id", "offset") if c in want.columns]  # any numbers
    assert got.columns == want.columns
    assert sorted(map(repr, got.drop(*drop).collect())) == sorted(map(repr, want.drop(*drop).collect()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF001)
    rows = got.collect()
    assert rows and len(set(got.columns)) == len(got.columns)
    if name in ORACLE:
        con = duckdb.connect()
        for f in os.listdir(SF001):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF001}/{f}'")
        want = con.execute(ORACLE[name])
        order = [d[0] for d in want.description]
        assert sorted(order) == sorted(got.columns)
        assert sorted(map(repr, ([r[c] for c in order] for r in rows))) == sorted(map(repr, (list(r) for r in want.fetchall())))
