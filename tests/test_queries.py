"""Every registered query of the core against DuckDB over the driver's smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from tidemark.plans import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
TABLES = "customer events documents embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = core.queries()[name](spark, SF)
    got = df.collect()
    want = duck.execute(core.oracle_sql()[name])
    names = [d[0] for d in want.description]
    data = want.fetchall()
    assert rows(df.columns, [tuple(r) for r in got]) == rows(names, data)


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    import shutil

    shutil.copytree(f"{root}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_topk' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_scans_read_only_what_they_use(spark):
    from tidemark.operators.etl import keep_first, long_enough

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = keep_first(long_enough(docs), "doc_id").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in plan and "n_chars" not in plan
