import numpy as np

import corpus_pipeline
from lonewood.llm.common import staged
from llm_cases import DOCS, ODD, SF001, make_docs  # noqa: F401
from test_postings import expected as leaks
from test_simhash import classes, slow_fingerprint
from test_suffixes import expected as repeats


def test_stages_follow_each_other(spark):
    """Every stage against brute force, on all that the one before has kept."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]

    kept = staged(stages["quality_rules"](spark, docs, SF001), "test")
    assert kept.columns == columns and 0 < kept.count() < docs.count()

    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    single = staged(stages["simhash_near_dedup"](spark, kept, SF001), "test")
    want = set(classes([slow_fingerprint(t) for _, t in rows], [i for i, _ in rows], 4))
    assert single.columns == columns and {r.doc_id for r in single.collect()} == want

    rows = [(r.doc_id, r.text) for r in single.collect()]
    cut = staged(stages["suffix_array_dedup"](spark, single, SF001), "test")
    want = repeats(rows, 50)
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and set(got) == set(want)
    for i, (n, removed, _, _) in want.items():
        assert n - removed - 6 * 8 <= len(got[i].text.encode()) <= n - removed and got[i].n_chars == len(got[i].text)

    rows = [(r.doc_id, r.text) for r in cut.collect()]
    clean = staged(stages["benchmark_decontamination"](spark, cut, SF001), "test")
    want = {i for (i, _), leak in zip(rows, leaks([t for _, t in rows], benchmark), strict=True) if not leak[4]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == want

    packed = stages["best_fit_packing"](spark, clean, SF001).toPandas()
    assert set(packed.doc_id) == want and packed.groupby("sequence_id").length.sum().max() <= 2048
    whole = corpus_pipeline.run(spark, SF001).toPandas()
    assert sorted(zip(whole.doc_id, whole.piece, whole.ids_crc32, strict=True)) == sorted(zip(packed.doc_id, packed.piece, packed.ids_crc32, strict=True))
    assert np.array_equal(np.sort(whole.length), np.sort(packed.length))


def test_edge_cases(spark, make_docs):
    for d in (spark.createDataFrame([], DOCS), make_docs([(None, t) for t in ODD] * 2)):
        for _, stage in corpus_pipeline.STAGES:
            d = staged(stage(spark, d, SF001), "test")
        assert d.columns[0] == "doc_id"
