"""The driver's contract: every query runs, the flagship gives rows, and the rest lives without the llm folders."""

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = [n for n in __spark_entry__.queries() if not n.startswith(("op", "pipeline"))]


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def plain(rows, columns):
    text = lambda v: "null" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    rows = df.collect()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        found = duck.sql(sql)
        assert sorted(found.columns) == sorted(df.columns)
        assert plain(rows, sorted(df.columns)) == plain([dict(zip(found.columns, r)) for r in found.fetchall()], sorted(df.columns))


def test_imports_without_the_text_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith(('op', 'pipe')) for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
