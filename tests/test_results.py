"""Saved results, training data, rule items, arms and dictionaries."""

import json

import numpy as np
from pyspark.sql import functions as F

from conftest import rows
from incidentry import dictionaries as D
from incidentry.operators import arms as A
from incidentry.operators import dataset as T
from incidentry.operators import evaluation as E
from incidentry.operators import features as X
from incidentry.operators import heuristics as H
from incidentry.operators import ingest as I
from incidentry.operators import ml as M
from incidentry.sources import dictionaries as S
from incidentry.sources import jsonl, sinks


def planted(spark, n=400):
    rows = [(i, i % 2, i // 2 % 2, str(i % 2 * (i // 2 % 2))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, kw_privacy int, kw_security int, y string")


def test_bundle_round_trip(spark, tmp_path):
    d = planted(spark)
    train, test = T.split_dataset(d, "y", "id")
    assert train.count() + test.count() == 400 and test.where("y = '1'").count() == 20
    fitted = M.fit_classifier(train, ["kw_privacy", "kw_security"], "y", "tree", depth=3)
    metrics = M.evaluate_fitted(fitted, test, "y")
    assert metrics["accuracy"] == 1.0 and metrics["leaves"] >= 3 and metrics["depth"] == 2
    sinks.save_bundle(fitted, str(tmp_path / "m"), train, metrics, {"depth": 3})
    loaded, about = sinks.load_bundle(spark, str(tmp_path / "m"))
    assert about["metrics"] == metrics and about["config"] == {"depth": "3"} and about["fingerprint"] == sinks.fingerprint(train.repartition(3))
    report = M.evaluate_models({"tree": loaded}, test, "y", F.lit("0"))
    assert report.where("runner = 'tree' and label = 'accuracy' and f1 = 1").count() == 1
    ranked = H.rank_models(spark.createDataFrame([("a", None, 0.5), ("b", 0.7, 0.1), ("c", None, None)], "n string, f double, acc double"), "n", "f", "acc")
    assert [r["name"] for r in ranked.orderBy("place").collect()] == ["b", "a", "c"]


def test_sentiment_models(spark):
    d = planted(spark).withColumn("score", F.when((F.col("kw_privacy") == 1) | (F.col("kw_security") == 1), -0.5).otherwise(0.3))
    cols = ["kw_privacy", "kw_security"]
    got = M.sentiment_model(d, cols, "score", "id")
    assert {r["feature"]: r["direction"] for r in got["directions"].collect()} == {c: "risk" for c in cols} and got["metrics"]["tree_accuracy"] == 1.0
    assert M.sentiment_model(d, cols, "score", "id", True)["directions"].where("direction = 'protective'").count() == 2
    assert M.sentiment_model(d.limit(3), cols, "score", "id")["status"] == "skipped: fewer than four rows"
    assert M.sentiment_model(d.where("kw_privacy = 1"), cols, "score", "id")["status"] == "skipped: one class"
    assert M.sentiment_model(d.where("id in (1, 3, 5, 7, 4)"), cols, "score", "id")["status"] == "skipped: a class of one row"


def test_cascade_and_items(spark, tmp_path):
    d = planted(spark).withColumn("insecurity", F.col("y").cast("int")).withColumn("intrusion", F.lit(0))
    trees = M.cascade(d, ["kw_privacy", "kw_security"], ["insecurity", "intrusion"])
    sinks.save_cascade(trees, d, str(tmp_path / "c"))
    q = spark.read.parquet(str(tmp_path / "c/questions"))
    assert {r["question"] for r in q.where("question is not null").collect()} == {"Does this involve privacy?", "Does this involve security?"}
    assert q.where("feature is null and weight = 1.0").count() == 1 and q.where("feature is null").count() >= 2
    assert spark.read.parquet(str(tmp_path / "c/checklist")).where("harms = array('insecurity')").count() == 2
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "c/status")).collect()} == {("insecurity", "fitted"), ("intrusion", "single class")}
    items = H.extract([H.rule_list_items(spark, [("a = 1", 0.9, 50), ("else", 0.1, 50)]), H.edge_items(spark, [("a", "b", 0.3)]), H.taxonomy_items(spark).limit(5)], 3).collect()
    assert [r["text"] for r in items] == ["IF a = 1 THEN P=0.9000", "a -> b", "ELSE THEN P=0.1000"] and len({r["provenance"] for r in items}) == 1
    sinks.save_items(H.edge_items(spark, [("a", "b", 0.3)]), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 1


def test_logs(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id int, p string, correct boolean")
    sinks.save_judgments(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j.metrics")).first()["accuracy"] == 0.5
    for run in ("r1", "r2"):
        sinks.append_trial(spark.createDataFrame([(1, "x", 0.5), (2, "x", 0.7)], "iteration long, approach string, accuracy double"), str(tmp_path / "t"), run)
    assert {(r["run_id"], r["trials"], r["best"]) for r in sinks.trial_summary(spark, str(tmp_path / "t")).collect()} == {("r1", 2, 0.7), ("r2", 2, 0.7)}
    m = sinks.long_metrics(spark.createDataFrame([("a", 0.5, 1.0)], "arm string, f1 double, emr double"), "arm", ["f1", "emr"], "r1", {"k": "5"})
    sinks.save_comparison(m, str(tmp_path / "cmp"))
    assert {(r["metric"], r["value"]) for r in spark.read.parquet(str(tmp_path / "cmp")).collect()} == {("f1", 0.5), ("emr", 1.0)}
    assert sinks.materialise_features(d, str(tmp_path / "f"), True) == 2 and spark.read.json(str(tmp_path / "f-latest")).count() == 2


def test_dictionaries_from_files(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"zeta": ["Big Word", "b"], "alpha": ["c"], "none": []}))
    assert S.as_groups(S.scan_terms(spark, str(tmp_path / "k.json"))) == {"zeta": ("big word", "b"), "alpha": ("c",)}
    (tmp_path / "o.json").write_text(json.dumps({"web_cam": {"synonyms": ["WebCam"], "patterns": ["cam(era)?s", "(broken"]}, "plain": {"synonyms": ["p q"]}}))
    got = S.as_ontology(S.scan_ontology(spark, str(tmp_path / "o.json")))
    assert got == (("web_cam", ("webcam",), "(?:cam(era)?s)"), ("plain", ("p q",), None))
    t = spark.createDataFrame([("two cameras",), ("p q webcam",), ("x",)], "t string").select(X.product_features(F.col("t"), got).alias("f"))
    assert [r["f"] for r in t.collect()] == [["web_cam"], ["web_cam", "plain"], []]
    (tmp_path / "w.json").write_text(json.dumps({"a": 0.9, "new": 0.1}))
    w = S.scan_weights(spark, str(tmp_path / "w.json"), spark.createDataFrame([("a", 0.2), ("b", 0.3)], "category string, weight double"))
    assert S.as_weights(w) == {"a": 0.9, "b": 0.3, "new": 0.1}
    assert jsonl.scan_rule_set(spark, str(tmp_path), "none", "1.0").count() == 0
    (tmp_path / "set.v1.0.json").write_text(json.dumps({"name": "set", "version": "1.0", "rules": ["one"]}))
    assert jsonl.scan_rule_set(spark, str(tmp_path), "set", "1.0").count() == 1
    assert len(D.ONTOLOGY) == 60 and len(D.MITIGATIONS) == 25 and len(D.PAIRS) == 10 and len(D.CAUSAL) == 9 and len(D.JURISDICTIONS) == 10


def test_json_line_scans(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"a": 1, "description": "xyz"}\nbroken\n\n{"b": 2}\n')
    assert sorted(jsonl.scan_features(spark, str(tmp_path / "f.jsonl")).columns) == ["a", "b", "description"]
    assert jsonl.row_count(spark, str(tmp_path / "f.jsonl")) == 3
    assert sorted(r["description_length"] for r in jsonl.scan_gold(spark, str(tmp_path / "f.jsonl"), "description string").collect()) == [0, 3]


def test_encoding_agrees_between_frames(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "id int, c string"), spark.createDataFrame([(3, "z")], "id int, c string")
    train, gold = T.encode_together(a, b, ["c"])
    assert {len(r["c_hot"]) for r in train.union(gold).collect()} == {3} and train.count() == 2 and gold.count() == 1


def test_leaks(spark):
    d = spark.createDataFrame([(1, "mail a@b.cc", "ok"), (2, "fine", None)], "id int, t string, secret string")
    assert {(r["field"], r["rows"]) for r in I.leaks(d, ("secret",)).collect()} == {("secret", 2), ("t", 1)}
    assert I.leaks(I.scrub(d, ("secret",)), ("secret",)).count() == 0


def test_stratified_sample_is_by_hash(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 3 == 0, "some").otherwise("many").alias("l"))
    got = {r["l"]: r["n"] for r in I.stratified_sample(d, "l", "id", 300).groupBy("l").agg(F.count("*").alias("n")).collect()}
    assert got == {"rare": 10, "some": 98, "many": 196} or sum(got.values()) in range(298, 306)
    assert rows(I.stratified_sample(d.repartition(7), "l", "id", 300).toPandas()) == rows(I.stratified_sample(d, "l", "id", 300).toPandas())


def test_split_is_worked_out_once(spark):
    """Rows are hashed in two passes and joined in one; what reads the parts reads written rows.  A key's rows do not fall on both sides."""
    passes = spark.sparkContext.accumulator(0)

    def seen(it):
        for t in it:
            passes.add(len(t))
            yield t

    d = spark.range(4000).selectExpr("id % 3000 AS k", "string(id % 5 = 0) AS y", "id AS v").mapInPandas(seen, "k long, y string, v long")
    train, test = T.split_dataset(d, "y", "k")
    made = passes.value
    for _ in range(2):
        assert train.count() and test.count() == 800
    assert passes.value == made <= 4 * 4000
    assert not any(x in f._jdf.queryExecution().optimizedPlan().toString() for f in (train, test) for x in ("md5", "Anti", "MapInPandas"))
    held = {r["k"] for r in test.collect()}
    assert {r["v"] for r in train.collect()} == {v for v in range(4000) if v % 3000 not in held}


def test_bootstrap_of_distinct_values(spark):
    """Every value occurs once: the interval has the width that the standard error gives."""
    d = spark.range(400).select(F.col("id").cast("double").alias("v"))
    r = E.bootstrap_interval(d, "v", 300).first()
    assert r["low"] < r["mean"] == 199.5 < r["high"] and 17 < r["high"] - r["low"] < 29


def test_bootstrap_against_plain_draws(spark):
    """Continuous values, a value of a third of the rows, 0.0 and -0.0, nulls, and any partitioning."""
    plain = {0.5: 700, 0.0: 3} | {i / 7 + 0.01: 1 + i % 2 for i in range(900)}
    listed = [(v,) for v, c in plain.items() for _ in range(c)] + [(-0.0,), (None,), (None,)]
    d = spark.createDataFrame(listed, "v double")
    plain[0.0] += 1
    w = {v: E.bootstrap_weights(v, c, 150, 7) for v, c in plain.items()}
    means = [sum(w[v][r] * v for v in plain) / sum(w[v][r] for v in plain) for r in range(150)]
    for some in (d, d.repartition(9)):
        r = E.bootstrap_interval(some, "v", 150).first()
        assert r["n"] == len(listed) - 2 and abs(r["mean"] - sum(v * c for v, c in plain.items()) / r["n"]) < 1e-9
        assert abs(r["low"] - np.quantile(means, 0.025)) < 1e-9 and abs(r["high"] - np.quantile(means, 0.975)) < 1e-9
    assert "Generate" not in E.bootstrap_interval(d, "v")._jdf.queryExecution().toString()
    assert abs(E.bootstrap_weights(3.0, 10**9, 2000, 1).std() / 10**4.5 - 1) < 0.1


def test_judgment_fallback(spark):
    d = spark.createDataFrame([("a stolen laptop",), ("gps data",), ("calm",), (None,)], "t string")
    assert [r["x"] for r in d.select(A.fallback_label(F.col("t"), ("location", "insecurity")).alias("x")).collect()] == ["insecurity", "location", "location", "location"]


def test_causal_clause(spark):
    """The last of several words in a clause ends the cause; the clause before a full stop is another."""
    d = spark.createDataFrame([("weak rules led to trouble that led to a breach. it led to nothing",)], "t string")
    assert d.select(X.causal_phrases(F.col("t"))["causes"].alias("c")).first()["c"] == ["weak rules led to trouble that"]
