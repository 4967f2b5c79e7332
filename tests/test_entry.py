"""The driver's contract, with and without the training-data operators."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.plans import registry

SF = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 9) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "lineitem", "events", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {n for n in registry.QUERIES if n.startswith("layout_") and n.endswith("_check")}))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.SQL:
        assert df.columns
        return
    cursor = duck.execute(registry.SQL[name])
    names, cols = [d[0] for d in cursor.description], sorted(df.columns)
    wanted = cursor.fetchall()
    assert sorted(names) == cols
    assert sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr) == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in wanted), key=repr)


def test_imports_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
