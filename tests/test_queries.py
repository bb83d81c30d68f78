import importlib
import os
import subprocess
import sys

import duckdb
import pytest

from lectern.plans import oracle
from lectern.plans import queries as Q

SF = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["bucket_counts", "pg_near_dup", "bk_backend_order", "ln_code_nb", "xs_filter_be", "kp_valid", "kp_dedup", "tr_synonym", "tr_label"])
def test_against_duckdb(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(oracle.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    got, want = sorted(str(tuple(r[c] for c in cols)) for r in df.collect()), sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert got and got == want


def test_flagship(spark):
    assert Q.flagship(spark, SF).count() > 0


def test_entry_without_training_data(tmp_path):
    """The contract imports, and keeps its other queries, where the subpackage and the pipeline are gone."""
    for d in ("operators", "plans", "functions", "sources", "streaming"):
        os.makedirs(tmp_path / "lectern" / d)
        for f in os.listdir(f"{HERE}/lectern/{d}"):
            if f.endswith(".py"):
                os.symlink(f"{HERE}/lectern/{d}/{f}", tmp_path / "lectern" / d / f)
    for f in ("__init__.py", "settings.py", "schema.py"):
        os.symlink(f"{HERE}/lectern/{f}", tmp_path / "lectern" / f)
    (tmp_path / "__spark_entry__.py").write_text(open(f"{HERE}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_names():
    sys.path.insert(0, HERE)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
