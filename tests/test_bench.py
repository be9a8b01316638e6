"""bench.py prints exactly one JSON line on stdout with the fields the driver reads."""

import json
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2",
               BENCH_QUERIES="context_rank,first_wins", BENCH_DRIVER_MEM="2g")
    out = subprocess.run([sys.executable, os.path.join(REPO, "bench.py")], cwd=REPO, env=env,
                         capture_output=True, text=True, timeout=600)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1, out.stdout[-2000:] + out.stderr[-2000:]
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["failed"] == []
    assert set(d["queries"]) == {"context_rank", "first_wins"}
    assert d["value"] == round(sum(d["queries"].values()), 3)
