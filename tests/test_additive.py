"""Additive models with pair terms against plain Python, on planted signals and odd rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from incidentry.operators import additive as A
from incidentry.operators import heuristics as H

COLS = ["a", "b", "c", "d"]
SCHEMA = "k int, a double, b double, c double, d double, y string"


def _rows(n=1500):
    r = random.Random(3)
    out = []
    for k in range(n):
        a, b, c, d = (r.random() for _ in range(4))
        y = "x" if c > 0.75 else ("p" if (a > 0.5) != (b > 0.5) else "q")
        out.append((k, a, b, c, d, y))
    out += [(n + i, None, float("nan"), 0.1, 0.1, "q") for i in range(30)]
    return out + [(2 * n, 0.1, 0.1, 0.1, 0.1, None)]  # no label: takes no part


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


EDGES = [[0.25, 0.5, 0.75]] * 4


@pytest.fixture(scope="module")
def model(frame):
    return A.fit_additive(frame, COLS, "y", A.Setting(rounds=5, rate=1.0), pairs=1, edges=EDGES)


def test_planted_pair_is_found(frame, model):
    plain = A.fit_additive(frame, COLS, "y", A.Setting(rounds=5, rate=1.0), edges=EDGES)
    right = lambda m: m.predict(frame.where("y is not null")).agg(F.avg((F.col("y") == F.col("predicted")).cast("int"))).first()[0]
    assert model.terms[4:] == [("a", "b")]
    assert model.labels == ["p", "q", "x"]
    assert right(model) > 0.95 > 0.75 > right(plain)
    assert {t for t, _ in model.importances()[:2]} == {"c", "a x b"}


def _plain_fit(rows, rounds, rate):
    """The features' own rounds in plain Python: (intercepts, sums of scores by label, feature and bin) before centring."""
    num = lambda v: 0.0 if v is None or v != v else v
    data = [([sum(e < num(v) for e in EDGES[0]) for v in r[1:5]], "pqx".index(r[5])) for r in rows if r[5]]
    base = [math.log((1 + sum(y == k for _, y in data)) / (len(data) + 3)) for k in range(3)]
    s = [[[0.0] * 4 for _ in range(4)] for _ in range(3)]
    for _ in range(rounds):
        g, h, ps = ([[[0.0] * 4 for _ in range(4)] for _ in range(3)] for _ in range(2)), None, []
        g, h = g
        for bins, y in data:
            e = [math.exp(base[k] + sum(s[k][t][b] for t, b in enumerate(bins))) for k in range(3)]
            p = [x / sum(e) for x in e]
            ps.append(p)
            for k in range(3):
                for t, b in enumerate(bins):
                    g[k][t][b] += (y == k) - p[k]
                    h[k][t][b] += p[k] * (1 - p[k])
        d = [[[2 / 3 * x / (z + 1) for x, z in zip(gt, ht, strict=True)] for gt, ht in zip(g[k], h[k], strict=True)] for k in range(3)]
        bent = 0.0
        for (bins, _), p in zip(data, ps, strict=True):
            v = [sum(d[k][t][b] for t, b in enumerate(bins)) for k in range(3)]
            bent += sum(q * x * x for q, x in zip(p, v, strict=True)) - sum(q * x for q, x in zip(p, v, strict=True)) ** 2
        far = rate * sum(g[k][t][b] * d[k][t][b] for k in range(3) for t in range(4) for b in range(4)) / bent
        s = [[[x + far * z for x, z in zip(st, dt, strict=True)] for st, dt in zip(s[k], d[k], strict=True)] for k in range(3)]
    return base, s


def test_rounds_equal_plain_python(frame):
    got = A.fit_additive(frame, COLS, "y", A.Setting(rounds=3, rate=0.5), edges=EDGES)
    base, s = _plain_fit(_rows(), 3, 0.5)
    for k in range(3):
        for bins in ([0, 0, 0, 0], [3, 2, 1, 0], [1, 1, 3, 2]):
            want = base[k] + sum(s[k][t][b] for t, b in enumerate(bins))
            assert got.intercept[k] + sum(got.scores[t][k][b] for t, b in enumerate(bins)) == pytest.approx(want, abs=1e-9)


def test_saved_model_is_the_same(spark, frame, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    back = A.load(spark, str(tmp_path / "m"))
    assert back == model
    key = lambda m: sorted(map(tuple, m.predict(frame).select("k", "predicted", "probability").collect()))
    assert key(back) == key(model)


def test_shapes_and_items(spark, model):
    shapes = model.shapes(spark)
    assert shapes.where("term = 'a'").count() == 3 * 4
    assert shapes.where("term = 'a x b'").count() == 3 * 16
    centred = shapes.groupBy("term", "label").agg(F.sum(F.col("score") * F.col("weight")).alias("s")).agg(F.max(F.abs("s"))).first()[0]
    assert centred < 1e-6
    items = H.term_items(spark, model, top=2).collect()
    assert [r["kind"] for r in items] == ["term", "term"] and {r["text"].split(" (")[0] for r in items} == {"Term: c", "Term: a x b"}


def test_columns_that_say_the_same_do_not_overshoot(spark, frame):
    twice = frame.where("y in ('p', 'q') and a is not null").select("k", "a", *[F.col("a").alias(f"a{i}") for i in range(6)], F.when(F.col("a") > 0.5, "1").otherwise("0").alias("y"))
    one = A.fit_additive(twice, ["a"], "y", A.Setting(rounds=3, rate=1.0), edges=[[0.5]])
    seven = A.fit_additive(twice, ["a", *[f"a{i}" for i in range(6)]], "y", A.Setting(rounds=3, rate=1.0), edges=[[0.5]] * 7)
    p = lambda m: m.predict(twice).agg(F.avg("probability")).first()[0]
    assert p(seven) == pytest.approx(p(one), abs=1e-9)


def test_odd_frames(spark, frame):
    with pytest.raises(ValueError):
        A.fit_additive(frame.where("k < 0"), COLS, "y")
    one = A.fit_additive(frame.where("y = 'x'"), COLS, "y", pairs=2, edges=EDGES)
    assert [tuple(r) for r in one.predict(frame).select("predicted", "probability").distinct().collect()] == [("x", 1.0)]
    none = A.fit_additive(frame, COLS, "y", A.Setting(rounds=0), edges=EDGES)
    assert {r[0] for r in none.predict(frame).select("predicted").distinct().collect()} == {"q" if none.intercept[1] >= none.intercept[0] else "p"}


def test_leaves_bound_the_steps(frame):
    got = A.fit_additive(frame, COLS, "y", A.Setting(rounds=1, rate=1.0, leaves=2), edges=EDGES)
    assert all(len({round(x, 9) for x in s}) <= 2 for t in got.scores for s in t)


def test_tuning(spark, frame):
    d = frame.where("y is not null").select("k", *COLS, (F.col("y") == "x").cast("int").alias("t"))
    best = A.tune_additive(d, COLS, "t", F.col("k"), rates=(0.5, 1.0), leaves=(2,), rounds=4, bins=8)
    assert len(best) == 2 and best[0][1] > 0.9 and [b[1] for b in best] == sorted((b[1] for b in best), reverse=True)
    few = A.tune_additive(d.where("t = 0 or k < 30"), COLS, "t", F.col("k"), rates=(0.5,), leaves=(2,), rounds=1, bins=8)
    assert len(few) == 1  # the rarer class is too small for folds: one fifth is held out


def test_prediction_bins_a_row_once(spark):
    """Each column of each term is binned at one place of the plan, whatever the labels."""
    d = spark.range(60).selectExpr("double(id % 7) as a", "double(id % 5) as b", "string(id % 3) as y")
    m = A.fit_additive(d, ["a", "b"], "y", A.Setting(rounds=1), 1)
    out = m.predict(d)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("filter(") <= sum(map(len, m.terms))
    want = d.withColumn("p", m.probabilities()).selectExpr("array_max(p) as p").collect()
    assert [r["probability"] for r in out.collect()] == [r["p"] for r in want]
