import json
import os
import subprocess
import sys

from llm_cases import SF001


def test_failed_attempts_change_nothing():
    run = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fault_run.py")
    out = subprocess.run([sys.executable, run, SF001], capture_output=True, text=True, timeout=900)
    lines = [x for x in out.stdout.splitlines() if x.startswith("{")]
    assert lines, out.stderr[-3000:]
    assert all(n > 0 and same for n, same in json.loads(lines[-1]).values()), lines[-1]
