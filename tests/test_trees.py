"""Trees that grow together against trees grown one by one in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from incidentry.operators import heuristics as H
from incidentry.operators import trees as T
from incidentry.sources import sinks

COLS = ["a", "b", "c"]
SCHEMA = "k int, a double, b double, c double, t1 int, t2 int, t3 int"


def _rows(n=400):
    r = random.Random(7)
    out = []
    for k in range(n):
        a, b, c = r.gauss(0, 1), float(r.randrange(3)), r.random()
        out.append((k, a, b, c, int((a > 0.3) != (b > 1)), int(c + r.random() > 1), 0))
    return out + [(n + i, None, float("nan"), 0.25, 1, None, 0) for i in range(40)]  # nulls, NaN and repeated rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


def _num(v):
    return 0.0 if v is None or v != v else v


def _plain(rows, edges, target, least, depth):
    """{node: (rows, positive rows)} of one tree."""
    nodes = {}

    def pure(part):
        n, p = len(part), sum(r[target] or 0 for r in part)
        return (p * p + (n - p) ** 2) / n if n else 0.0

    def down(part, node, level):
        nodes[node] = (len(part), sum(r[target] or 0 for r in part))
        best = None
        for f in range(3):
            for e in edges[f]:
                low, high = [r for r in part if _num(r[1 + f]) <= e], [r for r in part if _num(r[1 + f]) > e]
                if level < depth and len(low) >= least and len(high) >= least:
                    gain = pure(low) + pure(high) - pure(part)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, low, high)
        if best:
            down(best[1], 2 * node, level + 1)
            down(best[2], 2 * node + 1, level + 1)

    down(rows, 1, 0)
    return nodes


@pytest.mark.parametrize("depth", [0, 1, 3, 5])
def test_cascade_equals_plain_trees(frame, depth):
    trees = T.fit_cascade(frame, COLS, ["t1", "t2", "t3"], depth, bins=8)
    rows = [tuple(r) for r in frame.collect()]
    for i, t in enumerate(("t1", "t2", "t3")):
        assert {k: (x.n, x.pos) for k, x in trees.nodes[t].items()} == _plain(rows, trees.edges, 4 + i, 5, depth)
    assert list(trees.nodes["t3"]) == [1]


def test_scores_support_and_export(spark, frame, tmp_path):
    held = F.col("k") % 4 == 1
    trees = T.fit_cascade(frame, COLS, ["t1", "t2", "t3"], 4, held=held, bins=8)
    said = frame.where(held).select(F.coalesce("t1", F.lit(0)).alias("y"), (trees.probability("t1") > 0.5).cast("int").alias("p")).collect()
    tp, wrong = sum(r["y"] and r["p"] for r in said), sum(r["y"] != r["p"] for r in said)
    m = T.scores(trees, "t1")
    assert m["accuracy"] == pytest.approx(1 - wrong / len(said)) and m["f1"] == pytest.approx(2 * tp / (2 * tp + wrong))
    assert m["f1"] > 0.8  # a planted rule of two features
    # A cut tree says what a tree grown to that depth says.
    small = T.fit_cascade(frame, COLS, ["t1"], 2, held=held, bins=8)
    assert T.scores(trees, "t1", 2) == T.scores(small, "t1")
    got = {(r["tree"], r["node"]): (r["n"], r["positive"]) for r in T.node_support(frame, trees, {"t1": "t1", "t2": "t2"}).collect()}
    assert got == {(t, k): (x.n + x.held, x.pos + x.held_pos) for t in ("t1", "t2") for k, x in trees.nodes[t].items()}
    for r in T.node_table(trees, spark).where("tree = 't1'").collect():
        path = r["path"].replace("a ", "coalesce(nanvl(a, null), 0) ").replace("b ", "coalesce(nanvl(b, null), 0) ")
        assert frame.where(~held).where(path).count() == r["n"] == round(r["support"] * frame.where(~held).count())
    sinks.save_trees(trees, spark, str(tmp_path / "c"))
    status = {r["category"]: r["status"] for r in spark.read.parquet(str(tmp_path / "c/metrics")).collect()}
    assert status == {"t1": "fitted", "t2": "fitted", "t3": "single class"}
    total = {r["metric"]: r["value"] for r in spark.read.parquet(str(tmp_path / "c/aggregate")).collect()}
    assert total["n_classifiers"] == 3 and total["n_successful"] == 2 and total["mean_f1"] == pytest.approx(sum(T.scores(trees, t)["f1"] for t in trees.nodes) / 3)
    parts = spark.read.parquet(str(tmp_path / "c/importances")).groupBy("category").agg(F.sum("importance").alias("s")).collect()
    assert {r["category"] for r in parts} == {"t1", "t2"} and all(abs(r["s"] - 1) < 1e-9 for r in parts)
    asked = spark.read.parquet(str(tmp_path / "c/questions"))
    assert asked.where("category = 't1' and weight is not null").count() == len(trees.leaves("t1"))
    assert H.checklist(asked).where("array_contains(harms, 't1')").count() >= 2


def test_no_rows_and_constant_features(spark, frame):
    none = T.fit_cascade(frame.limit(0), COLS, ["t1"])
    assert none.nodes["t1"] == {1: T.Node(0, 0, 0, 0)} and T.scores(none, "t1")["f1"] == 0
    flat = T.fit_cascade(frame.withColumns({c: F.lit(1.0) for c in COLS}), COLS, ["t1"])
    assert list(flat.nodes["t1"]) == [1]


def test_tuning_order_and_folds(frame):
    got = T.tune_trees(frame, COLS, "t1", F.col("k"), folds=3, bins=8)
    assert len(got) == 18 and [(-round(f, 9), -round(a, 9)) for _, f, a in got] == sorted((-round(f, 9), -round(a, 9)) for _, f, a in got)
    assert got[0][1] > 0.8 and got[0][0]["depth"] != 1
    alone = [x for x in T.tune_trees(frame, COLS, "t1", F.col("k"), depths=(3,), leaves=(5,), balanced=(True,), folds=3, bins=8)]
    same = next(x for x in got if x[0] == {"depth": 3, "leaf": 5, "balanced": True})
    assert alone[0] == same
    # One class has fewer rows than two a fold: one fold is held out.
    assert len(T.tune_trees(frame, COLS, "t3", F.col("k"), folds=3, bins=8)) == 18
