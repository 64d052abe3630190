"""The library without the training-data operators: what is left imports, registers its queries and runs one."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CHECK = """
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 200 and not any(k.startswith("op") and k[2].isdigit() for k in names) and "pipeline" not in names
assert set(entry.oracle_sql()) <= set(names)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.entry(spark).columns == ["seq", "subject", "predicate", "match"]
print("fine")
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_them(tmp_path, pipeline):
    """With the pipeline's file left behind, and without it."""
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    env = os.environ | {"PYTHONPATH": str(tree)}
    got = subprocess.run([sys.executable, "-c", CHECK], cwd=tree, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0 and "fine" in got.stdout, got.stderr[-2000:]
