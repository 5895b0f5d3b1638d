"""Queries run where the workers cannot import the package: only the driver needs it."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from __spark_entry__ import queries
spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.shuffle.partitions", "4").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
for name, query in queries().items():
    if name.startswith({prefixes!r}):
        query(spark, {sf!r}).write.format("noop").mode("overwrite").save()
        print("ran", name)
"""


@pytest.mark.parametrize("prefixes", [("op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op11_", "op12_"), ("op7_", "op8_", "op9_", "op10_", "op13_", "pipeline")])
def test_away_from_the_repository(sf, tmp_path, prefixes):
    code = RUN.format(root=ROOT, prefixes=prefixes, sf=sf)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len([line for line in done.stdout.splitlines() if line.startswith("ran")]) == len(prefixes)
