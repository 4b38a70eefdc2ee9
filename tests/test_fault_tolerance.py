"""Retry safety: tasks that fail mid-way are re-run and produce the same model/scores
(keyed draws, no order dependence, model read from the shared folder)."""

import json
import os
import subprocess
import sys

from conftest import SF001

HERE = os.path.dirname(os.path.abspath(__file__))


def test_lost_tasks_give_identical_results():
    out = subprocess.run([sys.executable, os.path.join(HERE, "fault_run.py"), f"{SF001}/orders.parquet"],
                         capture_output=True, text=True, timeout=600)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("{")]
    assert line, out.stdout[-2000:] + out.stderr[-3000:]
    res = json.loads(line[-1])
    assert res["n_nodes"] > 0 and res["n_scores"] == 1500
    assert res["nodes_equal"] and res["scores_equal"]
