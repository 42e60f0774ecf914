"""One-pass matching against plain tests of each term, literals of patterns, samples with repeated keys, mitigation scores."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from incidentry import dictionaries as D
from incidentry.functions.matcher import TermIndex, required_literals
from incidentry.operators import features as X
from incidentry.operators import ingest as I


def test_terms_in_any_place(spark):
    rng = random.Random(1)
    terms = ["ab", "abc", "bc", "c a", "aa", "b-b", "é", "ca", "a.b", "cab ca", "x"]
    texts = ["".join(rng.choice("abc é-.") for _ in range(rng.randrange(0, 14))) for _ in range(400)] + [None, "", "aaaa", "abcab"]
    index = TermIndex(terms, words=["ab", "c", "é"])
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").withColumn("f", index.found(F.col("t")))
    got = d.select("id", *[index.holds(F.col("f"), t).alias(f"h{k}") for k, t in enumerate(terms)], index.count(F.col("f"), [*terms, "ab"]).alias("n"), index.count(F.col("f"), ["ab", "c", "é"], whole=True).alias("w"), index.holds(F.col("f"), "zz_none", "x").alias("none")).collect()
    for r in got:
        t = texts[r["id"]] or ""
        assert [r[f"h{k}"] for k in range(len(terms))] == [x in t for x in terms]
        assert r["n"] == sum(x in t for x in terms) + ("ab" in t) and not r["none"]
        assert r["w"] == len({"ab", "c", "é"} & set(re.findall(r"\w+", t)))


@pytest.mark.parametrize(
    ("pattern", "want"),
    [(r"\btracking of location\b", ("tracking of location",)), (r"(cookie|beacon)s?", ("beacon", "cookie")), (r"abc|abd", None), (r"[a-z]+ing", ("ing",)), (r"x?yy", None), (r"(?i)GPS data", ("gps data",)), (r"a|bcd", None), (r"(unclosed", None), (r"(opt)?in data", ("in data",))],
)
def test_required_literals(pattern, want):
    found = required_literals(pattern)
    if want is None or found is None:
        assert found is None or all(len(x) >= 3 for x in found)
        assert want is None
    else:
        assert set(found) == set(want) or all(any(x in w for x in found) for w in want)


@settings(max_examples=300, deadline=None)
@given(st.text("ab|()?*+[]. c", max_size=12), st.text("abc .", max_size=20))
def test_literals_are_in_every_match(pattern, text):
    try:
        compiled = re.compile(pattern)
    except re.error:
        return
    found = required_literals(pattern)
    if found and compiled.search(text):
        assert any(x in text for x in found)


def test_features_of_a_full_dictionary(spark):
    """All slugs against plain substring tests and expressions, one by one."""
    rng = random.Random(2)
    bits = [t for _, ts, _ in D.ONTOLOGY for t in ts] + ["tracking of location", "data of broker", "dark new patterns", "words", "x"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 6))) for _ in range(150)]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.product_features(F.col("t")).alias("f")).collect()
    for r in d:
        assert r["f"] == [s for s, ts, p in D.ONTOLOGY if any(t in r["t"] for t in ts) or (p and re.search(p, r["t"]))]
    assert sum(len(ts) for _, ts, _ in D.ONTOLOGY) >= 170


def test_sample_of_repeated_keys(spark):
    """One label, one repeated key: the target is met; equal rows too, and rows of several labels."""
    for distinct in (5000, 1):
        d = spark.range(5000).select(F.lit("a").alias("label"), F.lit(7).alias("key"), (F.col("id") % distinct).alias("v"))
        got = I.stratified_sample(d, "label", "key", 100)
        assert got.count() == 100 and got.distinct().count() == min(distinct, 100)
    d = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("big")).when(F.col("id") % 300 == 0, F.lit("rare")).alias("label"), (F.col("id") % 40).alias("key"), F.create_map(F.lit("m"), "id").alias("m"))
    n = {r["label"]: r["count"] for r in I.stratified_sample(d, "label", "key", 300).groupBy("label").count().collect()}
    assert n == {"big": 200, "rare": 10, None: 99}
    assert I.stratified_sample(d.limit(0), "label", "key", 300).count() == 0


def test_mitigation_scores(spark):
    d = spark.createDataFrame([(1, ["always_on_listening", "location_tracking"]), (2, ["tracking_pixel"]), (3, [])], "doc_id int, product_features array<string>")
    got = {r["mitigation"]: r for r in X.mitigations(d).where("doc_id = 1").collect()}
    assert got["local_processing"]["effectiveness"] == 0.9 and got["local_processing"]["is_primary"]
    # Primary for one risk, secondary for the other: the mean of 0.85 and the default 0.5, and only the first risk is addressed.
    assert got["data_minimization"]["effectiveness"] == 0.675 and got["data_minimization"]["risks"] == "location_tracking"
    assert got["user_consent_granular"]["effectiveness"] == 0.725 and got["user_consent_granular"]["risks"] == "always_on_listening,location_tracking"
    rec = X.recommendations(d).collect()
    assert {r["combined"] for r in rec if r["mitigation"] == "encryption_at_rest"} == {0.5} and all(r["alone"] for r in rec if r["mitigation"])
    assert not X.mitigations(d).where("doc_id = 3").count()
