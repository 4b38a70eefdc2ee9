"""Subprocess body of test_faults: first attempts of many tasks fail after they have worked;
results must equal an undisturbed run."""

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession  # noqa: E402

spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "6").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lonewood-fault-")).getOrCreate())
spark.sparkContext.setLogLevel("OFF")

import lonewood.llm.common as common  # noqa: E402
from lonewood.llm import catalog  # noqa: E402

names = ["op2_postings_decontamination", "op10_suffix_dedup", "op6_simhash_pivots", "op5_warc_roundtrip", "op8_seekable_tokens", "op4_best_fit_packing", "op1_chat_viterbi",
         "op11_periodic_runs", "op12_minhash_components", "op13_fill_in_middle"]


def results():
    out = {}
    for name in names:
        df = catalog.QUERIES[name](spark, sys.argv[1])
        drop = [c for c in ("sequence_id", "offset") if c in df.columns]  # any numbers
        out[name] = sorted(map(repr, df.drop(*drop).collect()))
    return out


clean = results()
plain = common.tidy


def flaky(run):
    inner = plain(run)

    def failing(batches):
        yield from inner(batches)
        from pyspark import TaskContext

        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() % 2 == 0:
            raise RuntimeError("injected failure: executor lost")

    return failing


for module in ("chat", "common", "minhash", "packing", "postings", "simhash", "suffixes", "tokenfile", "warc"):
    setattr(sys.modules[f"lonewood.llm.{module}"], "tidy", flaky)
faulty = results()
print(json.dumps({n: [len(clean[n]), clean[n] == faulty[n]] for n in names}))
