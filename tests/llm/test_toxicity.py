import zlib

import numpy as np

from lonewood.llm.toxicity import fit_noisy_or, held_out, toxicity, train
from llm_cases import DOCS, ODD, make_docs  # noqa: F401


def corpus(n=1200):
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in "ba de fi go lu mi no pe ra su".split() for b in "ka le mo ni po ru sa te vo za".split()]
    rows, labels, where = [], [], {}
    for i in range(n):
        s = [" ".join(rng.choice(words, 8)) for _ in range(int(rng.integers(2, 12)))]
        bad = rng.random() < 0.15
        if bad:
            k = int(rng.integers(0, len(s)))
            s[k] += " zzyk" + str(rng.choice(["a", "en", "ist", "ung", "o", "al", "est"])) + " indeed"
            where[i] = s[k].strip()
        rows.append((i, ". ".join(s) + "."))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return rows, labels, where


def test_held_out_documents_and_their_sentences(spark, make_docs):
    rows, labels, where = corpus()
    d = make_docs(rows)
    model = train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity(d, model).select("doc_id", "text", held_out("doc_id").alias("held"), "toxicity").collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    right = [(r.toxicity.score >= 0.3) == (r.doc_id in where) for r in out if r.held]
    assert np.mean(right) > 0.98 and all(0 <= r.toxicity.score <= 1 for r in out)
    located = [any(where[r.doc_id] in r.text[x.begin:x.end] for x in r.toxicity.offending) for r in out if r.doc_id in where]
    assert np.mean(located) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark, make_docs):
    rows, labels, _ = corpus(400)
    d = make_docs(rows)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (train(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.features == b.features and np.allclose(a.weights, b.weights) and a.leak == b.leak


def test_edge_cases(spark, make_docs):
    d = make_docs([*ODD, "fine words only"])
    one_label = train(d, spark.createDataFrame([(i, 0) for i in range(8)] + [(None, 1), (3, None)], "doc_id long, toxic int"))
    assert np.allclose([r.toxicity.score for r in toxicity(d, one_label).collect()], one_label.leak)
    none = train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 < none.leak < 1 and toxicity(spark.createDataFrame([], DOCS), none).count() == 0


def test_gradient_fits_the_rates():
    # two features: one always toxic, one never; a tenth of the documents without either is toxic
    label = np.array([1] * 50 + [0] * 50 + [1] * 10 + [0] * 90)
    doc = np.arange(100)
    w, b, leak = fit_noisy_or(label, doc, np.arange(100), np.array([0] * 50 + [1] * 50), 2, steps=1500)
    p = 1 / (1 + np.exp(-(b + w)))
    assert p[0] > 0.9 and p[1] < 0.1 and 0.03 < leak < 0.13
