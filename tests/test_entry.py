"""The entry module with and without the training-data part."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__spark_entry__.__file__).parent


def test_sql_belongs_to_queries():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries) and len(queries) > 80


def test_without_training_data(tmp_path):
    """A copy without that part imports, and a query of it runs."""
    skip = lambda folder, names: {n for n in names if n in {"llm", ".git", "__pycache__", "corpus_pipeline.py"}}
    shutil.copytree(REPO, tmp_path / "copy", ignore=skip)
    code = (
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "rows = spark.createDataFrame([(1, 2, 3)], 'o_orderkey long, o_custkey long, x long')\n"
        f"rows.write.parquet({str(tmp_path / 'sf' / 'orders.parquet')!r})\n"
        f"assert e.queries()['top_n_per_probe'](spark, {str(tmp_path / 'sf')!r}).count() == 1\n"
        "assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=240, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
