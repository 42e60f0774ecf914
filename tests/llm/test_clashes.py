"""Columns of the user whose names are those that operators use inside, bounds of samples, and large groups."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from incidentry.llm import decontamination, license_scan, line_dedup, mixing, near_dedup, pii, toxicity, url_filter

NAMES = ("_row", "_id", "__id", "_th", "__th", "_r", "r", "_s", "s", "_found", "_said", "_t", "_text", "_h", "_gone", "_split", "_lines", "_key", "_p", "_n", "_x", "_size", "t", "d", "nid", "fp", "key", "id", "th", "_pos", "_first")


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["Some words. You vermin here.\nunder the MIT license now, write a@b.cd", "one two three four five six seven\na line of many words here", "one two three four five six seven\na line of many words here", None, ""]
    return spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)] + [(0, texts[0], "s0")], "doc_id long, text string, source string")


OPERATORS = {
    "near": lambda d: near_dedup.near_duplicates(d),
    "lines": lambda d: line_dedup.drop_repeated_lines(d),
    "mix": lambda d: mixing.mix(d),
    "leaks": lambda d: decontamination.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "licences": lambda d: license_scan.scan_licenses(d),
    "pii": lambda d: pii.find_pii(d),
    "urls": lambda d: url_filter.judge_urls(d.withColumn("url", F.lit("http://a.net/es/"))),
}


def check(plain, mixed, columns):
    kept = [c for c in NAMES if c in mixed.columns]
    assert set(kept) == set(NAMES) - (set(plain.columns) - set(columns))
    assert all((mixed[c] == "mine").all() for c in kept)
    added = [c for c in plain.columns if c not in columns]
    as_text = lambda f: f[["doc_id", *added]].astype(str)
    assert rows(as_text(plain)) == rows(as_text(mixed))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names(spark, docs, name):
    named = docs.select("*", *[F.lit("mine").alias(c) for c in NAMES])
    check(OPERATORS[name](docs).toPandas(), OPERATORS[name](named).toPandas(), docs.columns)


def test_clashing_names_of_scores(spark, docs):
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    named = docs.select("*", *[F.lit("mine").alias(c) for c in NAMES])
    check(toxicity.score_toxicity(docs, model).toPandas(), toxicity.score_toxicity(named, model).toPandas(), docs.columns)


def test_training_rows_are_bounded(spark):
    """One id in many rows, equal and different: the bound holds for rows, not ids."""
    data = [(1, f"text {i % 30}") for i in range(60)] + [(i, "other") for i in range(2, 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(1, 9)] + [(1, 1), (1, 1)], "doc_id long, toxic int")
    for most in (1, 3, 100):
        got = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", most).toPandas()
        assert (got._y.value_counts() <= most).all() and not got.duplicated().any()
        assert len(got) == min(most, 33 if 1 in got._id.values else 3) + min(most, 4)


def test_documents_without_words_and_copies(spark):
    """Many rows without words, many copies of one text and near copies around one hub."""
    base = [f"w{i}" for i in range(60)]
    data = [(i, None if i % 2 else " \n") for i in range(400)] + [(1000 + i, " ".join(base)) for i in range(300)] + [(2000 + i, " ".join([*base, f"x{i}"])) for i in range(300)]
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).toPandas()
    assert len(got) == 1000 and (got[got.doc_id < 1000].component_id == got[got.doc_id < 1000].doc_id).all()
    assert set(got[got.doc_id >= 1000].component_id) == {1000} and got.kept.sum() == 401
    assert isinstance(got, pd.DataFrame)
