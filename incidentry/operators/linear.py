"""Sparse logistic models of many settings and folds at once: one aggregate a Newton round.

A round sums each model's gradient and curvature over counted rows; the driver solves the
penalised quadratic by coordinate descent.  A model's sums are (features + 1) squared numbers,
whatever the rows; a frame of d features takes d squared / 2 sums in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.steps import written
from .additive import dealt, folds_of, held_scores
from .trees import value

#: Rows whose label is sure still count so much for the curvature.
LEAST_CURVATURE = 1e-5


@dataclass(frozen=True)
class Strength:
    """``c`` weighs the loss against the sizes of the weights on the scaled features; ``balanced`` gives both classes the same weight."""

    c: float = 1.0
    balanced: bool = False


def fit_many(cells: DataFrame, d: int, settings: dict[str, Strength], rounds: int = 15) -> dict[str, np.ndarray]:
    """{model: intercept and weights on the raw scale} over (model, held, y 0 or 1, bins array of d features, c), held rows apart.

    Minimises c times the log loss plus the sum of weight times standard deviation.  A feature
    that does not vary has weight 0.  Models that have settled sit out later rounds.  A model
    without rows has zeros.
    """
    rows = cells.where(~F.col("held"))
    each = [s for i in range(d) for s in (F.expr(f"sum(c * bins[{i}])").alias(f"s{i}"), F.expr(f"sum(c * bins[{i}] * bins[{i}])").alias(f"q{i}"))]
    spread, count = {}, {}
    for r in rows.groupBy("model").agg(F.sum("c").alias("n"), F.expr("sum(c * y)").alias("p"), *each).collect():  # a row a model
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        spread[r["model"]] = np.sqrt(np.maximum(np.array([r[f"q{i}"] for i in range(d)]) / r["n"] - mean**2, 0))
        count[r["model"]] = (r["n"], r["p"])
    theta, live = {m: np.zeros(d + 1) for m in settings}, sorted(spread)
    about = {}
    for m in live:
        n, p = count[m]
        even = settings[m].balanced and 0 < p < n
        about[m] = (n / (2 * (n - p)), n / (2 * p)) if even else (1.0, 1.0)
    x = ["1D", *[f"bins[{i}]" for i in range(d)]]
    sums = [F.expr(f"sum(g * {a})").alias(f"g{i}") for i, a in enumerate(x)]
    sums += [F.expr(f"sum(h * {x[i]} * {x[j]})").alias(f"h{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)]
    for _ in range(rounds):
        if not live:
            break
        scored = _scored(rows, {m: theta[m] for m in live}, about)
        scored = scored.select("model", "bins", F.expr("c * w * (y - p)").alias("g"), F.expr(f"c * w * greatest(p * (1 - p), {LEAST_CURVATURE}D)").alias("h"))
        still = []
        for r in scored.groupBy("model").agg(*sums).collect():  # a row a model
            m = r["model"]
            g, h = np.array([r[f"g{i}"] for i in range(d + 1)]), np.zeros((d + 1, d + 1))
            for i in range(d + 1):
                for j in range(i, d + 1):
                    h[i, j] = h[j, i] = r[f"h{i}_{j}"]
            new = _descend(theta[m], g, h, np.concatenate([[0.0], spread[m]]) / settings[m].c)
            if np.abs(new - theta[m]).max() > 1e-7:
                still.append(m)
            theta[m] = new
        live = sorted(still)
    return theta


def _descend(theta: np.ndarray, g: np.ndarray, h: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Where the quadratic of gradient ``g`` and curvature ``h`` around ``theta`` plus ``cost`` times the sizes is least."""
    new, pull = theta.copy(), g.copy()  # pull: the gradient at ``new``
    for _ in range(1000):
        far = 0.0
        for i in range(len(new)):
            # A feature without variance has no cost and no curvature of its own beside the intercept.
            if h[i, i] <= 0 or (i and cost[i] <= 0):
                continue
            at = h[i, i] * new[i] + pull[i]
            to = np.sign(at) * max(abs(at) - cost[i], 0.0) / h[i, i]
            if to != new[i]:
                far = max(far, abs(to - new[i]))
                pull -= h[:, i] * (to - new[i])
                new[i] = to
        if far < 1e-10:
            break
    return new


def _scored(rows: DataFrame, theta: dict[str, np.ndarray], about: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows with the probability ``p`` of class 1 and the weight ``w`` of their class; the models are a broadcast row each."""
    told = [(m, t.tolist(), *(about or {}).get(m, (1.0, 1.0))) for m, t in theta.items()]
    models = F.broadcast(rows.sparkSession.createDataFrame(told, "model string, t array<double>, w0 double, w1 double"))
    d = len(next(iter(theta.values()))) - 1
    eta = " + ".join(["t[0]", *[f"t[{i + 1}] * bins[{i}]" for i in range(d)]])
    return rows.join(models, "model").select("model", "y", "bins", "c", F.expr(f"1 / (1 + exp(-({eta})))").alias("p"), F.expr("if(y = 1, w1, w0)").alias("w"))


def tune_linear(df: DataFrame, columns: list[str], label: str, key: Column, strengths=(0.25, 0.5, 1.0, 2.0), balanced=(False, True), folds: int = 5) -> list[tuple[dict, float, float]]:
    """(setting, F1, accuracy) of a grid of sparse logistic models for a 0/1 label, best first; all settings and folds share the jobs of each round."""
    rows, used = folds_of(df, F.col(label), key, folds)
    cells = rows.select(F.array(*[value(c) for c in columns]).alias("bins"), "y", "fold")
    cells = written(cells.groupBy("bins", "y", "fold").agg(F.count(F.lit(1)).alias("c")))
    grid = [{"c": c, "balanced": b} for c in strengths for b in balanced]
    each = written(dealt(cells, used, len(grid)))
    theta = fit_many(each, len(columns), {f"{f}|{i}": Strength(**s) for f in used for i, s in enumerate(grid)})
    said = _scored(each.where("held"), theta).withColumn("said", (F.col("p") > 0.5).cast("int"))
    return held_scores(said, grid, used)
