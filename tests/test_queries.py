"""Every registered query of the engine against its SQL on DuckDB, and the entry points without the subpackage."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from larkspur.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    res = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in res.fetchall())
    assert sorted(df.columns) == sorted(names) and got == want


def test_entry_points_without_the_training_data_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op1') or q == 'pipeline']; print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
