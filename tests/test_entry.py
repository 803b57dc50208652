import importlib
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

HERE = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_core_needs_no_subpackage():
    code = "import sys; sys.modules['lectern.llm'] = None; import __spark_entry__ as e; assert 'search_topk' in e.queries(); assert not [k for k in e.queries() if k[0] == 'p' and k[1].isdigit()]; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=HERE)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_rows_equal_sql(spark):
    entry = importlib.import_module("lectern.catalog")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name in ("idf", "search_topk", "answer_pipeline", "clean_page", "capture_match", "dataset_gate", "eval_verdicts", "near_duplicate_links"):
        df = entry.queries()[name](spark, str(DATA))
        cols = sorted(df.columns)
        got = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
        rel = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert got == sorted(map(repr, rel)), name


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_workers_get_the_package(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(HERE)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(s).count() > 0
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env, timeout=300)
