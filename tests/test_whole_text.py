"""Incident descriptions hold whole texts: against small cases, and against DuckDB with the same SQL over whole texts."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import rows
from incidentry.operators import labeling as L
from incidentry.plans import registry
from incidentry.plans.views import incidents

SF = "/root/testdata/sf0.001"
CUT = "substr(text, 1, 400)"


def test_keyword_after_a_long_beginning(spark, tmp_path):
    filler = "plain words " * 200
    docs = [(i, filler + tail) for i in range(1, 25) for tail in ("", "zebra cctv surveillance camera facial recognition")]
    spark.createDataFrame([(2 * i + (t != filler), t) for i, t in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = incidents(spark, str(tmp_path))
    assert got.where("doc_id % 2 = 1 and doc_id % 53 <> 0").where(~F.col("description").endswith("facial recognition")).count() == 0
    scored = L.with_category_scores(got, F.lower("description")).select("doc_id", F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.when(s["category"] == "surveillance", s["score"]).otherwise(0.0)).alias("s"))
    assert scored.where("doc_id % 2 = 1 and doc_id % 53 <> 0 and s < 2").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", ["a17_micro_scores", "a6_multi_label", "ff_features", "fs3_offline_arm", "m7_mutual_information", "r2_select_rules"])
def test_matches_sql_over_whole_texts(spark, name):
    """Descriptions are whole texts in the registered SQL as well."""
    assert CUT not in registry.ORACLE_SQL[name]
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), c.sql(registry.ORACLE_SQL[name]).df()
    for col in got.columns:
        if got[col].dtype.kind == "f" and want[col].dtype.kind in "fiIuO":
            want[col] = want[col].astype(float)
    assert rows(got) == rows(want)
