"""Executors must import the package even when the driver starts elsewhere."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
import __spark_entry__ as se
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("ROWS", se.queries()["extract_chunks"](spark, "/root/testdata/sf0.001").count())
print("ROWS", se.queries()["split_pack"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_python_worker_queries_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="chunkgraph-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    rows = [line for line in out.stdout.splitlines() if line.startswith("ROWS")]
    assert len(rows) == 2, out.stderr[-2000:]
    assert all(int(r.split()[1]) > 0 for r in rows)
