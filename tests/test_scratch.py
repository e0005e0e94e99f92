"""Tables in the shared folder go with their scope or their session."""

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from colloquy.operators.sequence import numbered, running
from colloquy.session import scratch_scope, shared_dir


def test_scope_removes_what_was_written_in_it(spark):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with scratch_scope():
        df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
        assert numbered(df, ["g"], ["id"]).count() == running(df, ["g"], [F.col("id")], ["id"]).count() == 100
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_stopped_session_leaves_an_empty_folder(tmp_path):
    code = f'''
from pyspark.sql import SparkSession
from colloquy.operators.graph import components
from colloquy.operators.sequence import numbered
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
df = spark.range(50)
numbered(df, ["id"], ["id"]).count()
components(df.selectExpr("id as a", "id + 1 as b")).count()
import os
mine = lambda: [x for x in os.listdir("{tmp_path}") if x.startswith("colloquy-")]  # Spark makes a folder of its own
assert mine()
spark.stop()
assert not mine(), mine()
'''
    root = str(Path(__file__).resolve().parent.parent)
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": root}, timeout=180)
