"""Known answers and edge cases of the operators."""

import itertools
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from incidentry.functions.text import canonical_date, truncate_words
from incidentry.operators import evaluation as E
from incidentry.operators import features as X
from incidentry.operators import inference as N
from incidentry.operators import ingest as I
from incidentry.operators import labeling as L
from incidentry.operators import ml as M
from incidentry.sources import jsonl
from incidentry.streaming import jobs

SETS = "truth array<string>, pred array<string>"


def test_keyword_score_counts_substrings_and_words(spark):
    t = spark.createDataFrame([("a data breach was seen",), ("breaches",), ("",), (None,)], "description string")
    got = [r["s"] for r in L.with_category_scores(t, F.col("description"), {"x": ("data breach", "breach")}).select(F.col("scores")[0]["score"].alias("s")).collect()]
    assert got == [2 + 2 + 0.5 * 3, 2.0, 0.0, 0.0]


def test_ties_go_to_the_first_category(spark):
    t = spark.createDataFrame([("alpha beta",)], "description string")
    s = L.with_category_scores(t, F.col("description"), {"b": ("beta",), "a": ("alpha",)})
    assert s.select(L.best_category().alias("x")).first()["x"] == "b"


def test_stem_needs_a_boundary(spark):
    t = spark.createDataFrame([(1, "aggregation of dark patterns", None, None, None), (2, "a dark pattern", None, None, None)], "doc_id long, description string, harm_summary string, raw_body string, raw_title string")
    got = {r["doc_id"]: r["parents"] for r in L.weak_labels(t).collect()}
    assert got == {1: [], 2: ["invasion"]}


def test_multi_label_known_answers(spark):
    d = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a"], ["b"]), (["a", "b"], ["a"]), ([], [])], SETS)
    r = E.multi_label(d, "truth", "pred").first()
    assert abs(r["jaccard"] - (1 + 0 + 0.5 + 0) / 4) < 1e-12 and r["emr"] == 0.5 and abs(r["hamming"] - 3 / 8) < 1e-12
    assert abs(r["micro_f1"] - 2 * 3 / 9) < 1e-12
    empty = E.multi_label(d.limit(0), "truth", "pred").first()
    assert empty["emr"] == 1.0 and empty["jaccard"] == 0.0


def test_ranking_known_answers(spark):
    d = spark.createDataFrame([(["a", "b"], ["a", "c", "b"])], SETS)
    r = E.ranking(d, "truth", "pred", 3).first()
    assert abs(r["ndcg"] - 0.919720) < 1e-5 and abs(r["map"] - 0.833333) < 1e-5 and r["mrr"] == 1.0
    assert E.ranking(spark.createDataFrame([([], ["a"])], SETS), "truth", "pred").first()["ndcg"] == 0.0


def test_ordinal_known_answers(spark):
    f = lambda pairs: E.ordinal(spark.createDataFrame(pairs, "t int, p int"), "t", "p").first()
    same = f([(1, 1), (2, 2), (3, 3)])
    assert abs(same["qwk"] - 1) < 1e-12 and abs(same["spearman"] - 1) < 1e-12 and abs(same["kendall"] - 1) < 1e-12
    back = f([(1, 3), (2, 2), (3, 1)])
    assert abs(back["qwk"] + 1) < 1e-12 and abs(back["kendall"] + 1) < 1e-12
    flat = f([(1, 1), (1, 1)])
    assert flat["qwk"] == 1.0 and flat["spearman"] == 0.0
    mixed = f([(1, 1), (2, 3), (3, 3), (1, 2)])
    assert abs(mixed["kappa"] - 3 / 11) < 1e-12 and abs(mixed["lwk"] - 1 / 2) < 1e-12
    assert flat["lwk"] == flat["kappa"] == 1.0
    # The distance is the place among the values: 1 and 5 are neighbours when no value lies between.
    assert f([(1, 5), (5, 1)])["qwk"] == f([(1, 2), (2, 1)])["qwk"]


def test_signed_rank_by_all_sign_patterns(spark):
    vals = {"x": [5, 3, 9, 4, 7, 2, None, 8], "y": [4, 5, 5, 4, 1, 3, 6, 2], "z": [4, 5, 5, 4, 1, 3, 6, 2]}
    data = [(i, g, v) for g, vs in vals.items() for i, v in enumerate(vs)]
    got = {(r.a, r.b): r for r in E.signed_rank(spark.createDataFrame(data, "k int, g string, v int"), "k", "g", "v").collect()}
    d = [x - y for x, y in zip(vals["x"], vals["y"]) if x is not None and x != y]
    order = sorted(map(abs, d))
    rank = {s: sum(i for i, o in enumerate(order, 1) if o == s) / order.count(s) for s in order}
    w = sum(rank[abs(v)] for v in d if v > 0)
    sums = [sum(rank[abs(v)] for v, on in zip(d, signs) if on) for signs in itertools.product((0, 1), repeat=len(d))]
    p = min(1, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums))
    r = got["x", "y"]
    assert (r.n, r.w) == (len(d), w) and abs(r.p - p) < 1e-12 and abs(r.alpha - 0.05 / 3) < 1e-12
    same = got["y", "z"]
    assert (same.n, same.w, same.z, same.p, same.significant) == (0, 0.0, None, None, False)


def test_signed_rank_of_many_pairs_is_normal(spark):
    data = [(i, g, i % 7 if g == "a" else (i * 3) % 5) for i in range(200) for g in "ab"]
    r = E.signed_rank(spark.createDataFrame(data, "k int, g string, v int"), "k", "g", "v").first()
    assert r.n > E.EXACT_PAIRS and abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 1e-12
    assert E.signed_rank(spark.createDataFrame([], "k int, g string, v int"), "k", "g", "v").count() == 0


def test_calibration_bin_edge(spark):
    d = spark.createDataFrame([(1, 0.3), (0, 0.29), (1, 1.0), (0, -2.0)], "y int, p double")
    r = E.calibration(d, "y", "p").first()
    assert abs(r["ece"] - (0.7 + 0.29) / 4) < 1e-12 and r["n"] == 4


def test_bootstrap_brackets_the_mean(spark):
    d = spark.range(2000).select((F.col("id") % 10).cast("double").alias("v"))
    r = E.bootstrap_interval(d, "v").first()
    assert r["low"] < 4.5 < r["high"] and r["high"] - r["low"] < 0.6 and r["mean"] == 4.5
    assert E.bootstrap_interval(d.limit(0), "v").first()["high"] == 0.0


def test_dates(spark):
    cases = {"09/01/2025": "2025-09-01", "2025-9-1": "2025-09-01", "2025-09-01T10:11:12Z": "2025-09-01", "9999-99-99": "9999-99-99", "abcd-ef-gh": "abcd-ef-gh", "soon": None, "": None, None: None, "#1695000000": "2023-09-18", "1695000000": None, "13/45/2025": None}
    d = spark.createDataFrame([(k,) for k in cases], "v string").select("v", canonical_date(F.col("v")).alias("d"))
    assert {r["v"]: r["d"] for r in d.collect()} == cases


def test_truncate(spark):
    d = spark.createDataFrame([("one two three",), ("short",)], "t string").select(truncate_words(F.col("t"), 9).alias("x"))
    assert [r["x"] for r in d.collect()] == ["one two...", "short"] or [r["x"] for r in d.collect()] == ["one...", "short"]


def test_scrub(spark):
    d = spark.createDataFrame([(1, "mail me@x.org", [["a", "b@c.de"]], 5551234567), (2, "see @user@host.io", [["x"]], 1), (3, "call (713) 555-8702", None, 2), (4, "id 1234567890", [["y"]], 3)], "id int, t string, n array<array<string>>, num long")
    got = {r["id"]: r for r in I.scrub(d).collect()}
    assert [got[i]["t"] for i in (1, 2, 3)] == [None] * 3 and got[4]["t"] == "id 1234567890"
    assert got[1]["n"] is None and got[2]["n"] == [["x"]] and got[1]["num"] == 5551234567
    assert "num" not in I.scrub(d, ("num",)).columns


def test_dedup_append(spark):
    b = spark.createDataFrame([(1, "a", "k"), (2, "a", "k"), (3, "b", "k"), (4, None, "k"), (5, "a", None), (6, "a", None)], "o int, s string, k string")
    index = spark.createDataFrame([("b", "k")], "source string, key string")
    got = I.dedup_append(b, index, "s", "o", "k")
    assert sorted(r["o"] for r in got.collect()) == [1, 4, 5, 6]
    assert I.dedup_append(b.limit(0), None, "s", "o").count() == 0


def test_select_rules_is_pure_and_ranked(spark):
    rules = X.rules_frame(spark)
    d = spark.createDataFrame([(1, "gdpr case at a hospital", None, None, "en"), (2, None, "ZZ", None, None)], "doc_id long, description string, jurisdiction string, sector string, language string")
    once = X.select_rules(X.detect_context(d), rules, 3).collect()
    again = X.select_rules(X.detect_context(d), rules, 3).collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, again))
    assert [r["rule_id"] for r in sorted((r for r in once if r["doc_id"] == 1), key=lambda r: r["rank"])][0] == "r01"
    assert all(r["score"] > 0 for r in once)


def test_composite(spark):
    d = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (0.0, 1.0)], "a double, b double")
    got = [r["c"] for r in d.select(X.composite([F.col("a"), F.col("b")], (1.0, 1.0)).alias("c")).collect()]
    assert abs(got[0] - 0.5) < 1e-5 and got[1] is None and got[2] < 0.01
    assert d.select(X.composite([F.col("a")], (0.0,)).alias("c")).first()["c"] == 0.0


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n   \nnot json\n[1]\n{"a": 2, "b": "x"}\n')
    assert jsonl.scan_jsonl(spark, str(p)).count() == 2
    assert sorted(r["a"] for r in jsonl.scan_jsonl(spark, str(p), "a int, b string").collect()) == [1, 2]
    d = jsonl.scan_jsonl(spark, str(p), "a int, b string")
    assert jsonl.write_jsonl(d, str(tmp_path / "out")) == 2
    jsonl.write_parquet(jsonl.scan_jsonl(spark, str(p)), str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).dtypes == [("record", "string")]
    (tmp_path / "r.json").write_text(json.dumps({"name": "n", "version": "1", "rules": ["plain", {"rule": "obj", "countries": ["UK"], "priority": 2}]}))
    got = {r["text"]: r for r in jsonl.scan_rules(spark, str(tmp_path / "r.json")).collect()}
    assert got["plain"]["priority"] == 1.0 and got["obj"]["jurisdictions"] == ["UK"] and got["obj"]["priority"] == 2.0


def test_tree_recovers_a_planted_rule(spark):
    d = spark.range(800).select("id", (F.col("id") % 2).cast("int").alias("a"), ((F.col("id") / 2).cast("int") % 2).alias("b"), F.rand(1).alias("c")).withColumn("y", (F.col("a") * F.col("b")).cast("string"))
    f = M.fit_classifier(d, ["a", "b", "c"], "y", "tree", depth=3)
    assert f.predict(d).where("predicted != y").count() == 0
    got = M.tree_rules(f, d, "y").collect()
    assert abs(sum(r["support"] for r in got) - 1) < 1e-9 and all(r["precision"] == 1.0 for r in got)


def test_chow_liu_finds_a_chain(spark):
    h = lambda salt, share: (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(100)) < share).cast("int")
    d = spark.range(4000).withColumn("x", h(1, 50)).withColumn("y", F.when(h(2, 90) == 1, F.col("x")).otherwise(1 - F.col("x"))).withColumn("z", F.when(h(3, 90) == 1, F.col("y")).otherwise(1 - F.col("y")))
    edges = M.chow_liu(d, ["x", "y", "z"], "x")
    assert [(a, b) for a, b, _ in edges] == [("x", "y"), ("y", "z")]
    p = M.bayes_tree_predict(d, edges, "x", "id").join(d, "id")
    assert p.where("predicted = x").count() > 3400


def test_nonnegative_weights(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 7).alias("c")).withColumn("y", 2 * F.col("a") + 0.5 * F.col("b"))
    w, r2 = M.nonnegative_weights(d, ["a", "b", "c"], "y")
    assert w == {"a": 2.0, "b": 0.5, "c": 0.0} and abs(r2 - 1) < 1e-9
    w, _ = M.nonnegative_weights(d.withColumn("y", -F.col("a")), ["a"], "y")
    assert w == {"a": 0.0}


def test_rule_list_orders_by_evidence(spark):
    d = spark.range(900).select((F.col("id") % 3 == 0).cast("int").alias("a"), (F.col("id") % 2).cast("int").alias("b")).withColumn("y", F.col("a"))
    rules = M.rule_list(d, ["a", "b"], "y")
    assert rules[0][0] == "a = 1" and rules[0][1] > 0.99 and rules[-1][0] == "else" and rules[-1][1] < 0.01


def test_impute(spark):
    d = spark.createDataFrame([(1.0, None), (float("inf"), None), (3.0, None), (None, None), (float("nan"), None)], "a double, b double")
    got = [(r["a"], r["b"]) for r in M.impute(d, ["a", "b"]).collect()]
    assert all(math.isfinite(a) and b == 0.0 for a, b in got)


def test_exact_quantiles(spark, monkeypatch):
    """A coarse sketch needs several rounds; the result is exact all the same, with ties, infinities and few rows."""
    monkeypatch.setattr(M, "SKETCH", 5)
    for values in ([float(i * i % 97) for i in range(300)], [7.0] * 90 + [float(i) for i in range(10)], [float("-inf"), 0.0, 4.0, float("inf")], [3.0]):
        d = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double").coalesce(1)
        ordered = sorted(values)
        for share, q in zip([0.3, 0.5, 1.0], M.exact_quantiles(d, F.col("x"), [0.3, 0.5, 1.0]), strict=True):
            place = share * (len(ordered) - 1)
            part, low, high = place - int(place), ordered[int(place)], ordered[math.ceil(place)]
            assert q == (low if low == high else (1 - part) * low + part * high)
    assert M.exact_quantiles(d.where("false"), F.col("x"), [0.5]) == [None]


def test_batch_infer_loads_once_a_task(spark):
    d = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string")
    got = N.batch_infer(d, "t", lambda: lambda ts: [str(len(t or "")) for t in ts])
    assert {r["id"]: r["answer"] for r in got.collect()} == {1: "2", 2: "0"}
    assert d.columns == ["id", "t"]


def test_stream_dedup_equals_batch(spark, tmp_path):
    rows = [(i, "s", str(i % 4)) for i in range(20)]
    d = spark.createDataFrame(rows, "o int, s string, k string")
    for part in range(3):
        d.where(F.col("o") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.dedup_ingest(s, str(tmp_path / "i"), str(tmp_path / "o"), str(tmp_path / "c"), "s", "o", "k").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o"))
    assert sorted(r["key"] for r in got.collect()) == ["0", "1", "2", "3"]


def test_stream_dedup_reads_its_own_buckets(spark, tmp_path):
    """Three runs over one checkpoint: a run starts where the last one ended, and opens the index files of its own keys only."""
    ins, idx, out, log, counts = (str(tmp_path / x) for x in ("in", "i", "o", "c", "n"))
    schema = "o int, s string, k string"
    batches = [[(i, "s", str(i)) for i in range(200)], [(200, "s", "7"), (201, "s", "new"), (202, "s", "new"), (203, None, "7")], [(300, None, "7"), (301, "s", None), (302, "t", "7")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(ins)
        jobs.dedup_ingest(spark.readStream.schema(schema).parquet(ins), idx, out, log, "s", "o", "k", counts, buckets=32).awaitTermination()
    got = {(r["o"], r["s"], r["k"]) for r in spark.read.parquet(out).collect()}
    assert got == {*batches[0], (201, "s", "new"), (203, None, "7"), (301, "s", None), (302, "t", "7")}
    n = {r["batch"]: (r["processed"], r["written"], r["skipped"]) for r in spark.read.parquet(counts).collect()}
    assert n == {0: (200, 200, 0), 1: (4, 2, 2), 2: (3, 2, 1)}
    # The plan of one bucket's keys lists a thirty-second of the index, and nothing of later batches.
    scan = jobs.seen_keys(spark, idx, 1, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "bucket" in scan.split("PartitionFilters")[1]
    assert 0 < jobs.seen_keys(spark, idx, 1, [3]).count() < 30 and jobs.seen_keys(spark, idx, 0, list(range(32))).count() == 0
    assert jobs.seen_keys(spark, idx, 3, list(range(32))).count() == 204


def test_stream_dedup_runs_a_lost_batch_again(spark, tmp_path):
    """A batch that ended after its rows and before its commit gives the same rows when it is run again."""
    ins, idx, out, log = (str(tmp_path / x) for x in ("in", "i", "o", "c"))
    schema = "o int, s string, k string"
    for rows in ([(1, "s", "a"), (2, "s", "b")], [(3, "s", "b"), (4, "s", "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(ins)
        jobs.dedup_ingest(spark.readStream.schema(schema).parquet(ins), idx, out, log, "s", "o", "k").awaitTermination()
    before = sorted(map(tuple, spark.read.parquet(out).collect()))
    for f in ("1", ".1.crc"):
        if os.path.exists(f"{log}/commits/{f}"):
            os.unlink(f"{log}/commits/{f}")
    jobs.dedup_ingest(spark.readStream.schema(schema).parquet(ins), idx, out, log, "s", "o", "k").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == before and len(before) == 3


def test_stream_windows(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 01:00:00", "b")], "t string, g string").withColumn("t", F.to_timestamp("t"))
    d.write.parquet(str(tmp_path / "in"))
    s = jobs.windowed_counts(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "t", "g", "10 minutes", "5 minutes")
    s.writeStream.outputMode("append").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("win").where("g = 'a'").first()["n"] == 2


def test_quantiles_share_their_rounds(spark):
    """Twelve quantiles of values over many orders of magnitude take as many jobs as one, and few."""
    values = sorted([(-1.0) ** i * 1.37 ** (i % 700) / 7 for i in range(2000)] + [0.0, -0.0, 5e-324, 1.7e308, float("inf")])
    d = spark.createDataFrame([(v,) for v in values], "x double")
    shares, group = [i / 11 for i in range(12)], "quantiles"
    spark.sparkContext.setJobGroup(group, group)
    got = M.exact_quantiles(d, F.col("x"), shares)
    jobs_run = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for share, q in zip(shares, got, strict=True):
        place = share * (len(values) - 1)
        part, low, high = place - int(place), values[int(place)], values[math.ceil(place)]
        assert q == (low if low == high else (1 - part) * low + part * high)
    assert jobs_run <= 8


def test_batch_infer_sees_few_texts_at_once(spark):
    """Texts reach the function in lists of at most ``BATCH``, and all are answered, in whatever batches Arrow brings them."""
    d = spark.range(1000, numPartitions=1).selectExpr("id", "string(id) as t")
    got = N.batch_infer(d, "t", lambda: lambda ts: [f"{t}|{len(ts)}" for t in ts]).collect()
    assert len(got) == 1000
    assert all(r["answer"].split("|")[0] == r["t"] and int(r["answer"].split("|")[1]) <= 256 for r in got)


def test_shapley_does_not_multiply_rows(spark):
    """Orders stand side by side: no window, and as many rows meet the model as there are; a key's rows give their mean."""
    d = spark.range(60).selectExpr("id", "double(id % 7) as a", "double(id % 4) as b", "string(id % 7 > id % 4) as y")
    f = M.fit_classifier(d, ["a", "b"], "y", "tree", depth=2)
    one = M.sampled_shapley(d, f, "id", 3)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Generate") == 1
    of = lambda x: {(r["id"], r["feature"]): r["contribution"] for r in x.collect()}
    parts, twice = of(one), of(M.sampled_shapley(d.unionAll(d), f, "id", 3))
    assert parts.keys() == twice.keys() and all(abs(parts[k] - twice[k]) < 1e-9 for k in parts)


@pytest.mark.parametrize(("kind", "params"), [("tree", {"depth": 3, "leaf": 400}), ("tree", {"depth": 3, "leaf": 1600}), ("tree", {"depth": 4}), ("additive", {"rounds": 3})])
def test_trees_fit_equal_rows_once(spark, monkeypatch, kind, params):
    """What iterates are counted rows or, where too many differ, parts of bounded size; the model is the same."""
    given, fit = [], M.Pipeline.fit
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, data: given.append((data.count(), data.rdd.getNumPartitions())) or fit(self, data))
    d = spark.range(3000).selectExpr("id", "if(id % 7 = 0, null, id % 7) as a", "double(id % 4) as b", "if(id % 28 = 3, null, string(id % 7 > id % 4 or id % 11 = 0)) as y")
    said = lambda: [tuple(r) for r in M.fit_classifier(d, ["a", "b"], "y", kind, **params).predict(d.fillna(0)).orderBy("id").select("predicted", F.round("probability", 9)).collect()]
    counted = said()
    monkeypatch.setattr(M, "COUNTED", 0)
    monkeypatch.setattr(M, "PART_VALUES", 1000)
    assert said() == counted
    assert given[0][0] <= 56 and given[1][0] == 2892 and given[1][1] >= 8
