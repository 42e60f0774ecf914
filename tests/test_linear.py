"""Sparse logistic models of many settings against Spark's own, one by one."""

import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from incidentry.operators import linear as N

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    r, out = random.Random(11), []
    for k in range(800):
        a, b = r.gauss(0, 2), float(r.randrange(3))
        out.append((k, a, b, 1.5, int(a - 0.8 * b + r.gauss(0, 1.5) > 0.7)))
    return spark.createDataFrame(out, "k int, a double, b double, c double, y int").cache()


@pytest.mark.parametrize("balanced", [False, True])
def test_equals_spark(frame, balanced):
    cells = frame.select(F.array(*COLS).alias("bins"), "y", F.lit(1).alias("c"), F.lit(False).alias("held"), F.explode(F.array(F.lit("weak"), F.lit("strong"))).alias("model"))
    got = N.fit_many(cells, 3, {"weak": N.Strength(2.0, balanced), "strong": N.Strength(0.02, balanced)})
    n, p = frame.count(), frame.agg(F.sum("y")).first()[0]
    w = F.when(F.col("y") == 1, n / (2 * p)).otherwise(n / (2 * (n - p))) if balanced else F.lit(1.0)
    # Features are scaled by their deviation over rows; Spark would scale by that over weighted rows.
    sd = frame.agg(*[F.stddev_pop(c) for c in COLS[:2]]).first()
    scaled = frame.withColumns({"w": w, "a": F.col("a") / sd[0], "b": F.col("b") / sd[1]})
    data = VectorAssembler(inputCols=COLS[:2], outputCol="x").transform(scaled)
    for m, c in (("weak", 2.0), ("strong", 0.02)):
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", elasticNetParam=1.0, regParam=1 / (c * n), standardization=False, maxIter=500, tol=1e-10).fit(data)
        assert got[m].tolist() == pytest.approx([model.intercept, *(x / s for x, s in zip(model.coefficients.toArray(), sd, strict=True)), 0.0], abs=1e-3)


def test_tuning_and_odd_frames(frame):
    best = N.tune_linear(frame, COLS, "y", F.col("k"))
    p = frame.agg(F.avg("y")).first()[0]
    assert len(best) == 8 and best[0][1] >= best[-1][1] > 2 * p / (1 + p)  # what saying 1 always would score
    one = N.tune_linear(frame.where("y = 1"), COLS, "y", F.col("k"), strengths=(1.0,), balanced=(True,))
    assert one[0][1:] == (1.0, 1.0)
    none = N.tune_linear(frame.where("k < 0"), COLS, "y", F.col("k"), strengths=(1.0,), balanced=(False,))
    assert none[0][1:] == (0.0, 0.0)
