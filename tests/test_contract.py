"""Every query that has SQL, against DuckDB on the smallest tables; the others give rows of a stable shape."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lectern import queries as own

SF_DIR = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF_DIR.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(frame.where(frame.notna(), None).itertuples(index=False, name=None), key=repr)


#: Queries without SQL, and where they are held against a plain version.
APART = {"vector_approximate": "test_vectors.py"}


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, name):
    got = own.QUERIES[name](spark, str(SF_DIR)).toPandas()
    if name not in own.SQL:
        assert name in APART and len(got)
        return
    want = duck.sql(own.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_registered():
    assert set(own.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_bm25_plan_prunes_columns_and_joins_without_products(spark):
    plan = own.bm25_top(spark, str(SF_DIR))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("gone", [("lectern/llm", "tests/llm"), ("lectern/llm", "tests/llm", "corpus_pipeline.py")])
def test_works_without_the_subpackage(tmp_path, gone):
    root = Path(entry.__file__).parent
    for name in ("lectern", "tests"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
        (tmp_path / name).unlink(missing_ok=True) if name.endswith(".py") else None
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(e.oracle_sql()) == sorted(k for k in e.oracle_sql() if k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.split() == [str(len(own.QUERIES)), "True"], done.stderr


@pytest.mark.parametrize("name", ["search_filter_after", "search_filter_before"])
def test_filters_ask_for_language_and_source(spark, duck, name):
    """Every row that is found has both, and the filter before search finds as many as there may be."""
    found = {r.chunk_id for r in own.QUERIES[name](spark, str(SF_DIR)).collect()}
    both = {f"{r[0]:012d}" for r in duck.sql("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3'").fetchall()}
    assert {c.split("#")[0] for c in found} <= both and "source = 'src3'" in own.SQL[name]
    assert name == "search_filter_after" or len(found) == 10
