"""Queries where driver and executors are processes of their own."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb

REPO = Path(__file__).resolve().parents[1]
RUN = """
import json, sys
from pyspark.sql import SparkSession
from tablewright import catalog

name, sf, at = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,2,1024]", "spark.executor.memory": "700m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{at}/shared", "spark.sql.warehouse.dir": f"{at}/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
frames = [catalog.QUERIES[name](spark, sf) for _ in range(2)]
print("ROWS", json.dumps([[df.dtypes, sorted(map(list, df.collect()))] for df in frames]))
spark.stop()
"""


def test_load_database(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "_PYSPARK"))} | {"PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", RUN, "load_database", sf, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, "\n".join(x for x in done.stderr.splitlines() if "WARN" not in x and not x.lstrip().startswith("at "))[-3000:]
    rows = [list(r) for r in duckdb.sql(f"SELECT n_nationkey, n_name FROM read_parquet('{sf}/nation.parquet') ORDER BY 1").fetchall()]
    want = [[["n_nationkey", "int"], ["n_name", "string"]], rows]
    assert json.loads(done.stdout.split("ROWS ")[1]) == [want, want]  # each call has a database of its own
