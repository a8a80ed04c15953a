import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.plans import queries as log_queries

REPO = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_without_the_llm_folders(tmp_path):
    """The rest imports and lists its queries when that subpackage and its pipeline are gone."""
    for name in ("tidelog", "__spark_entry__.py"):
        src = REPO / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "tidelog/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline']; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) == len(log_queries.queries())


def test_nothing_else_imports_llm():
    for path in (REPO / "tidelog").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidelog.llm" not in path.read_text(), path


@needs_tables
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["key", "value"] and df.count() > 0


@needs_tables
@pytest.mark.parametrize("name", [n for n in log_queries.queries()])
def test_query_against_sql(spark, name):
    df = log_queries.queries()[name](spark, SF)
    sql = log_queries.oracle_sql()[name]
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("events", "documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(names).collect()), key=key) == sorted(want.fetchall(), key=key)
