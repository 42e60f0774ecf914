"""Every registered query with an SQL form agrees with DuckDB on the smallest tables; the others run and give rows."""

import glob
import os

import duckdb
import pytest

from conftest import rows
from incidentry.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
SLOW = {"m2_tree_rules", "m8_root_causes", "m9_mitigation_effects", "r9_heuristics"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, db, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), db.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if got[c].dtype.kind == "f" and want[c].dtype.kind in "fiIuO":
            want[c] = want[c].astype(float)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - SLOW))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["m7_bayes_tree", "m7_mutual_information", "m2_tree_rules"])
def test_models_count_written_features(spark, name):
    """The texts are read once, before the model: what counts and predicts reads a written frame."""
    d = registry.QUERIES[name](spark, SF)
    assert "EvalPython" not in d._jdf.queryExecution().executedPlan().toString()
