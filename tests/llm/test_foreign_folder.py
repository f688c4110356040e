"""Workers find the package although neither the folder nor the path of the driver's process shows it to them."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import os, sys
os.environ.pop("PYTHONPATH", None)
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://" + os.getcwd() + "/shared").getOrCreate()
{body}
"""


def run(tmp_path, body):
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), body=body)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()


def test_url_filter_comes_first(tmp_path):
    body = """from subsidia.llm import url_filter
print(url_filter.url_verdicts(spark.createDataFrame([(1, "http://a.com/en/x")], "page_id long, url string")).first()["verdict"])"""
    assert run(tmp_path, body) == ["block"]


def test_runs_and_neighbours(tmp_path):
    body = """from subsidia.llm import hnsw, runs
print(runs.periodic_runs(spark.createDataFrame([(1, "a b " * 9)], "doc_id long, text string")).first()["collapsed"].replace(" ", "-"))
print(hnsw.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).first()["vec_id"])"""
    assert run(tmp_path, body) == ["a-b", "1"]
