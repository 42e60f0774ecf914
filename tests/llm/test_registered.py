"""The registered queries over small tables: splits, thresholds, types, and workers that have no copy of the library."""

import os
import subprocess
import sys
import zlib

import duckdb
import pandas as pd
import pytest

from conftest import rows
from incidentry.llm import queries
from incidentry.llm.lm_scoring import op1_lm_scoring
from incidentry.llm.pii import op6_pii
from incidentry.llm.toxicity import op5_toxicity

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TYPES = {
    "op1_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op2_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op8_topk_search": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op10_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op11_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op12_fill_in_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    "op13_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Tables with nulls, an empty text, a tie and a document of each remainder."""
    root = tmp_path_factory.mktemp("small")
    text = lambda i: f"Plain words here. You vermin {i}. mail u{i}@x.yz under the MIT license" if i % 3 == 0 else f"plain words number {i}.\nA line that many documents hold\nmore"
    docs = [(i, text(i), "en", f"s{i % 4}" if i % 5 else None) for i in range(60)] + [(60, None, "en", "s1"), (61, "", None, None), (62, text(1), "en", "s1")]
    d = pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source"])
    d["n_chars"] = d.text.str.len().astype("Int64")
    d.to_parquet(root / "documents.parquet")
    pd.DataFrame({"doc_id": range(60), "quality": 1, "toxic": [int(i % 3 == 0) for i in range(60)]}).to_parquet(root / "labels.parquet")
    pd.DataFrame({"item_id": [1, 2], "text": [text(4), "vermin"]}).to_parquet(root / "benchmark.parquet")
    pd.DataFrame({"page_id": range(5), "url": ["https://WWW.example.com/en/x", "http://a.net/es/?q", None, "no url", "x://b.com#f"], "html": ""}).to_parquet(root / "pages.parquet")
    pd.DataFrame({"vec_id": range(45), "embedding": [[i % 7 / 8, -i % 5 / 4, 0.5] if i % 11 else None for i in range(45)], "label": 0}).to_parquet(root / "embeddings.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns(spark, small, name):
    out = queries.QUERIES[name](spark, small)
    want = [tuple(c.split()) for c in TYPES[name].split(", ")]
    assert out.dtypes[: len(want)] == want
    got = out.toPandas()
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        expected = c.sql(queries.ORACLE_SQL[name]).df()
        assert sorted(expected.columns) == sorted(got.columns) and rows(got) == rows(expected)


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_folds(spark, small):
    one, five = op1_lm_scoring(spark, small).toPandas(), op5_toxicity(spark, small).toPandas()
    assert len(one) == len(five) == 63
    assert all(r.held_out == (crc(r.doc_id, 5) == 1) for r in one.itertuples())
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.3) for r in five.itertuples())
    assert one[one.doc_id == 60].n_tokens.item() == 1 and five[five.doc_id.isin([60, 61])].score.tolist() == [0.0, 0.0]
    tokens = pd.read_parquet(f"{small}/documents.parquet").set_index("doc_id").text.fillna("").str.split().str.len() + 1
    assert one.train_tokens.iloc[0] == sum(n for i, n in tokens.items() if crc(i, 5) != 1)


def test_one_class_of_labels(spark, small, tmp_path):
    for t in ("documents", "labels"):
        f = pd.read_parquet(f"{small}/{t}.parquet")
        f.assign(toxic=0).to_parquet(tmp_path / f"{t}.parquet") if t == "labels" else f.to_parquet(tmp_path / f"{t}.parquet")
    assert op5_toxicity(spark, str(tmp_path)).where("predicted = 1").count() == 0


def test_personal_data_columns(spark, small):
    got = op6_pii(spark, small).toPandas().set_index("doc_id")
    assert all(got.n_email[i] == (i % 3 == 0) for i in range(60)) and got.spans[60] == "" and (got.n_spans >= got.n_email).all()


@pytest.mark.skipif(not os.path.isdir(SF.replace("0.001", "0.01")), reason="driver tables are absent")
def test_held_out_toxicity(spark):
    sf = SF.replace("0.001", "0.01")
    got = op5_toxicity(spark, sf).where("held_out").toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() >= 0.6 and clean.predicted.mean() <= 0.05


def test_workers_without_the_library(small):
    """Tasks whose Python path lacks the library: code and models travel with them."""
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.range(1).repartition(1).mapInPandas(lambda b: b, "id long").count()
sys.path.insert(0, {REPO!r})
from incidentry.llm import queries
for name in ("op5_toxicity", "op6_pii", "op10_license_scan", "op4_url_filter", "op8_topk_search", "op11_token_counts", "op12_fill_in_middle"):
    assert queries.QUERIES[name](spark, {small!r}).count()
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
