"""Additive models of binned features with pair terms: boosting by one histogram of residuals a round.

A model adds, for each label, one score a bin of each feature and one a cell of each chosen
pair; probabilities are the softmax of the sums.  A round sums gradients and curvatures for
every bin of every term in one aggregate; each term proposes its Newton step and a second sum,
of the curvature along all steps together, gives the length that suits them jointly, so
features that say the same do not overshoot.  Many models (folds, settings) take the same
rounds in the same jobs.  Equal binned rows are one counted row, sums combine map-side, and
what reaches the driver is a row for each bin of each model.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.steps import written
from .ingest import fold
from .trees import bin_edges, binned

#: Added to every curvature, so bins of few rows move little.
RIDGE = 1.0
#: A pair's table has at most so many bins a side.
PAIR_BINS = 8


#: Sums ``p`` of the labels to probabilities; the mean and mean square of steps ``d`` under probabilities ``p``.
SOFTMAX = "transform(transform(p, s -> exp(s - array_max(p))), e -> e / aggregate(p, 0D, (a, s) -> a + exp(s - array_max(p))))"
MEAN = "aggregate(zip_with(p, d, (x, z) -> x * z), 0D, (a, x) -> a + x)"
MEAN_SQUARE = "aggregate(zip_with(p, d, (x, z) -> x * z * z), 0D, (a, x) -> a + x)"


@dataclass(frozen=True)
class Setting:
    """``rate`` is the share of the best common step that a round goes; ``leaves`` bounds the different values of a term's step."""

    rounds: int = 12
    rate: float = 0.5
    leaves: int | None = None


@dataclass
class Additive:
    """``scores[t][k][b]``: what bin b of term t adds to label k; ``weights[t][b]`` its training rows.  A term has one or two columns."""

    labels: list[str]
    intercept: list[float]
    terms: list[tuple[str, ...]]
    edges: list[list[list[float]]]
    scores: list[list[list[float]]]
    weights: list[list[float]]

    def cell(self, t: int) -> Column:
        """The bin of term ``t`` that a row falls into; a pair's bins count through its second column first."""
        at = binned(list(self.terms[t]), self.edges[t])
        return at[0] if len(self.terms[t]) == 1 else at[0] * (len(self.edges[t][1]) + 1) + at[1]

    def probabilities(self) -> Column:
        cells = [self.cell(t) + 1 for t in range(len(self.terms))]
        sums = [sum((F.element_at(F.lit(self.scores[t][k]), c) for t, c in enumerate(cells)), F.lit(self.intercept[k])) for k in range(len(self.labels))]
        each = F.transform(F.array(*sums), lambda s: F.exp(s - F.array_max(F.array(*sums))))
        return F.transform(each, lambda e: e / F.aggregate(each, F.lit(0.0), lambda a, x: a + x))

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``predicted``, the first of the likeliest labels, and its ``probability``; missing features count as 0."""
        aligned = df.withColumns({c: F.lit(0.0) for t in self.terms for c in t if c not in df.columns})
        # Bins, sums and probabilities are columns one after the other, so each is worked out once a row.
        at = aligned.withColumn("_bins", F.array(*[self.cell(t) + 1 for t in range(len(self.terms))]))
        add = lambda k: sum((F.element_at(F.lit(self.scores[t][k]), F.col("_bins")[t]) for t in range(len(self.terms))), F.lit(self.intercept[k]))
        at = at.withColumn("_sums", F.array(*[add(k) for k in range(len(self.labels))]))
        at = at.withColumn("_exp", F.transform("_sums", lambda s: F.exp(s - F.array_max("_sums"))))
        at = at.withColumn("_p", F.transform("_exp", lambda e: e / F.aggregate("_exp", F.lit(0.0), lambda a, x: a + x)))
        said = F.array_position("_p", F.array_max("_p")).cast("int")
        return at.select(*df.columns, F.element_at(F.lit(self.labels), said).alias("predicted"), F.array_max("_p").alias("probability"))

    def importances(self) -> list[tuple[str, float]]:
        """(term, mean size of its score over training rows and labels), greatest first."""
        mean = lambda t: float((np.abs(np.array(self.scores[t])).mean(axis=0) * self.weights[t]).sum() / max(1.0, sum(self.weights[t])))
        return sorted(((" x ".join(c), mean(t)) for t, c in enumerate(self.terms)), key=lambda x: (-x[1], x[0]))

    def shapes(self, spark: SparkSession) -> DataFrame:
        """(term, label, bin, low, high, low2, high2, score, weight): a row for each bin of each term; bins hold their high end, null is no bound."""
        rows = []
        for t, columns in enumerate(self.terms):
            ends = [[None, *es, None] for es in self.edges[t]]
            wide = len(ends[1]) - 1 if len(ends) == 2 else 1
            for k, label in enumerate(self.labels):
                for b, s in enumerate(self.scores[t][k]):
                    i, j = divmod(b, wide)
                    second = (ends[1][j], ends[1][j + 1]) if len(ends) == 2 else (None, None)
                    rows.append((" x ".join(columns), label, b, ends[0][i], ends[0][i + 1], *second, float(s), float(self.weights[t][b])))
        return spark.createDataFrame(rows, "term string, label string, bin int, low double, high double, low2 double, high2 double, score double, weight double")

    def save(self, spark: SparkSession, path: str) -> None:
        """One row for each term, and one without columns for the labels and intercepts."""
        rows = [(-1, [], [], [self.intercept], [], self.labels)]
        rows += [(t, list(c), self.edges[t], self.scores[t], self.weights[t], []) for t, c in enumerate(self.terms)]
        spark.createDataFrame(rows, "place int, columns array<string>, edges array<array<double>>, scores array<array<double>>, weights array<double>, labels array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Additive:
    """What ``Additive.save`` wrote."""
    head, *terms = spark.read.parquet(path).orderBy("place").collect()  # a row a term
    return Additive(list(head["labels"]), list(head["scores"][0]), [tuple(r["columns"]) for r in terms], [[list(e) for e in r["edges"]] for r in terms], [[list(s) for s in r["scores"]] for r in terms], [list(r["weights"]) for r in terms])


def _segments(g: np.ndarray, h: np.ndarray, leaves: int | None) -> np.ndarray:
    """The Newton step of one term and label, constant on at most ``leaves`` runs of bins, split where the gain is greatest."""
    cuts = [0, len(g)]
    if leaves is None:
        cuts = list(range(len(g) + 1))
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + RIDGE)
    while leaves is not None and len(cuts) <= leaves:
        best = max(((gain(a, m) + gain(m, b) - gain(a, b), -m) for a, b in zip(cuts, cuts[1:], strict=False) for m in range(a + 1, b)), default=None)
        if best is None or best[0] <= 1e-12:
            break
        cuts = sorted([*cuts, -best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


class _Boost:
    """Models over the same counted cells (model, held, y, bins, c) with bins of ``sizes``, and what their rounds have added so far."""

    def __init__(self, cells: DataFrame, sizes: list[int], k: int, settings: dict[str, Setting]):
        self.cells, self.sizes, self.k, self.settings = cells, sizes, k, settings
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        n = {m: np.ones(k) for m in settings}
        for r in cells.where(~F.col("held")).groupBy("model", "y").agg(F.sum("c").alias("n")).collect():  # a row a model and label
            n[r["model"]][r["y"]] += r["n"]
        self.intercept = {m: np.log(v / v.sum()) for m, v in n.items()}
        self.scores = {m: np.zeros((k, self.start[-1])) for m in settings}
        self.weights = {m: np.zeros(self.start[-1]) for m in settings}

    def told(self, parts: dict[str, np.ndarray], name: str) -> DataFrame:
        """The models as a table: a row each, of the size of its parameters, whatever the rows of the data."""
        rows = [(m, self.intercept[m].tolist(), p.tolist()) for m, p in parts.items()]
        return F.broadcast(self.cells.sparkSession.createDataFrame(rows, f"model string, intercept array<double>, {name} array<array<double>>"))

    def totals(self, name: str, start: str = "0D") -> Column:
        """What a row's bins add up to in the model table's column ``name``, for each label."""
        return F.expr("array(" + ", ".join(" + ".join([f"{start}[{k}]" if start != "0D" else start, *[f"{name}[{k}][bins[{t}] + {self.start[t]}]" for t in range(len(self.sizes))]]) for k in range(self.k)) + ")")

    def scored(self, only: list[str], held: bool = False) -> DataFrame:
        """Rows with the probabilities ``p`` of their labels."""
        rows = self.cells.where(F.col("held") if held else ~F.col("held")).join(self.told({m: self.scores[m] for m in only}, "scores"), "model")
        return rows.select("model", "y", "bins", "c", self.totals("scores", "intercept").alias("p")).withColumn("p", F.expr(SOFTMAX))

    def rounds(self) -> None:
        for i in range(max((s.rounds for s in self.settings.values()), default=0)):
            self.one_round([m for m, s in self.settings.items() if i < s.rounds])

    def one_round(self, live: list[str]) -> None:
        rows = self.scored(live)
        sums = [s for k in range(self.k) for s in residual_sums(k)]
        bars = rows.select("model", "y", "c", "p", F.posexplode("bins").alias("t", "b")).groupBy("model", "t", "b").agg(F.sum("c").alias("n"), *sums).collect()
        g, h = ({m: np.zeros_like(self.scores[m]) for m in live} for _ in range(2))
        for r in bars:
            at = self.start[r["t"]] + r["b"]
            self.weights[r["model"]][at] = r["n"]
            g[r["model"]][:, at] = [r[f"g{k}"] for k in range(self.k)]
            h[r["model"]][:, at] = [r[f"h{k}"] for k in range(self.k)]
        step, damp = {}, (self.k - 1) / self.k
        for m in live:
            step[m] = np.zeros_like(g[m])
            for a, b in zip(self.start, self.start[1:], strict=False):
                for k in range(self.k):
                    step[m][k, a:b] = damp * _segments(g[m][k, a:b], h[m][k, a:b], self.settings[m].leaves)
        along = rows.join(self.told(step, "step"), "model").select("model", "c", "p", self.totals("step").alias("d"))
        bent = along.groupBy("model").agg(F.expr(f"sum(c * ({MEAN_SQUARE} - power({MEAN}, 2)))").alias("v")).collect()
        for r in bent:
            m = r["model"]
            if r["v"] > 1e-12:
                self.scores[m] += self.settings[m].rate * (g[m] * step[m]).sum() / r["v"] * step[m]


def residual_sums(k: int) -> list[Column]:
    """Sums of the gradient and the curvature of label ``k``."""
    return [F.expr(f"sum(c * (if(y = {k}, 1D, 0D) - p[{k}]))").alias(f"g{k}"), F.expr(f"sum(c * p[{k}] * (1 - p[{k}]))").alias(f"h{k}")]


def _chosen(edges: list[float]) -> list[int]:
    """Which edges of a feature bound its bins in a pair: at most ``PAIR_BINS`` - 1, evenly."""
    n = min(len(edges), PAIR_BINS - 1)
    return [(i + 1) * (len(edges) + 1) // (n + 1) - 1 for i in range(n)]


def _coarse(edges: list[float]) -> list[int]:
    """The pair bin of each bin."""
    return [sum(b > j for j in _chosen(edges)) for b in range(len(edges) + 1)]


def pair_statistics(rows: DataFrame, edges: list[list[float]], labels: int) -> DataFrame:
    """(a, b, statistic) of each pair of features over scored rows (y, bins, c, p): the fall of loss that the pair's residuals promise beyond those of its two features.

    The fall of a table is the sum of squared gradients over curvatures of its cells.  A row
    gives one key a pair, summed map-side: the cost is rows times pairs, the tables are
    ``PAIR_BINS`` squared a pair.
    """
    to = [F.array(*[F.lit(x) for x in _coarse(es)]) for es in edges]
    at = [F.element_at(to[f], F.col("bins")[f] + 1) for f in range(len(edges))]
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), at[a].alias("i"), at[b].alias("j")) for a, b in combinations(range(len(edges)), 2)])
    sums = [s for k in range(labels) for s in residual_sums(k)]
    cells = rows.select("y", "c", "p", F.explode(each).alias("x")).groupBy("x.a", "x.b", "x.i", "x.j").agg(*sums)
    add = [F.sum(f"{s}{k}").alias(f"{s}{k}") for k in range(labels) for s in "gh"]
    fall = lambda sign: (sum(F.pow(f"g{k}", F.lit(2)) / (F.col(f"h{k}") + RIDGE) for k in range(labels)) * sign).alias("v")
    parts = [cells.select("a", "b", fall(1)), *[cells.groupBy("a", "b", s).agg(*add).select("a", "b", fall(-1)) for s in "ij"]]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("a", "b").agg(F.sum("v").alias("statistic"))


def _cells(df: DataFrame, columns: list[str], edges: list[list[float]], label: Column, labels: list[str], *more: Column) -> DataFrame:
    y = F.array_position(F.lit(labels), label).cast("int") - 1
    keys = df.select(binned(columns, edges).alias("bins"), y.alias("y"), *more).where("y >= 0")
    return keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("c"))


def _with_pairs(bins: Column, pairs: list[tuple[int, int]], edges: list[list[float]]) -> Column:
    to = {f: F.array(*[F.lit(x) for x in _coarse(edges[f])]) for p in pairs for f in p}
    at = lambda f: F.element_at(to[f], bins[f] + 1)
    return F.concat(bins, F.array(*[at(a) * (len(_chosen(edges[b])) + 1) + at(b) for a, b in pairs])) if pairs else bins


def fit_additive(df: DataFrame, columns: list[str], label: str, setting: Setting = Setting(), pairs: int = 0, bins: int = 32, edges: list[list[float]] | None = None) -> Additive:
    """An additive model of any number of labels; with ``pairs``, that many pair terms join after the features' own rounds, and all terms go on for as many rounds again.

    Rows whose label is null take no part; null and NaN features are 0.  ``edges`` replaces
    quantile bins.  Equal statistics of pairs go by the order of the columns.  A frame
    without labelled rows is a ValueError.
    """
    y = F.col(label).cast("string")
    labels = sorted(r[0] for r in df.select(y).where(y.isNotNull()).distinct().collect())  # a row a label
    if not labels:
        raise ValueError("no labelled rows")
    edges = edges or bin_edges(df, columns, bins)
    cells = written(_cells(df, columns, edges, y, labels).withColumns({"model": F.lit("m"), "held": F.lit(False)}))
    boost = _Boost(cells, [len(e) + 1 for e in edges], len(labels), {"m": setting})
    boost.rounds()
    chosen: list[tuple[int, int]] = []
    if pairs and len(columns) > 1:
        found = pair_statistics(boost.scored(["m"]), edges, len(labels)).where("statistic > 0")
        chosen = [(r["a"], r["b"]) for r in found.orderBy(F.desc("statistic"), "a", "b").limit(pairs).collect()]
        wide = [(len(_chosen(edges[a])) + 1) * (len(_chosen(edges[b])) + 1) for a, b in chosen]
        more = _Boost(written(cells.withColumn("bins", _with_pairs(F.col("bins"), chosen, edges))), [*boost.sizes, *wide], len(labels), {"m": setting})
        more.intercept = boost.intercept
        more.scores["m"][:, : boost.start[-1]] = boost.scores["m"]
        more.rounds()
        boost = more
    if not setting.rounds:
        boost.one_round(["m"])
        boost.scores["m"][:] = 0.0
    intercept, scores, weights = boost.intercept["m"].copy(), [], []
    for a, b in zip(boost.start, boost.start[1:], strict=False):
        w, s = boost.weights["m"][a:b], boost.scores["m"][:, a:b]
        mean = (s * w).sum(axis=1) / max(1.0, w.sum())
        intercept += mean
        # A bin that no training row fell into adds nothing.
        scores.append(np.where(w > 0, s - mean[:, None], 0.0).tolist())
        weights.append(w.tolist())
    kept = lambda f: [edges[f][j] for j in _chosen(edges[f])]
    terms = [(c,) for c in columns] + [(columns[a], columns[b]) for a, b in chosen]
    return Additive(labels, intercept.tolist(), terms, [[e] for e in edges] + [[kept(a), kept(b)] for a, b in chosen], scores, weights)


def folds_of(df: DataFrame, label: Column, key: Column, folds: int) -> tuple[DataFrame, list[int]]:
    """``df`` with the row's ``y`` (0 or 1) and ``fold``, a hash of label and key, and the folds to hold out: all if the rarer class has two rows a fold, else one."""
    y = F.coalesce(label.cast("int"), F.lit(0))
    out = df.withColumns({"y": y, "fold": fold(F.concat_ws("|", y.cast("string"), key.cast("string")), folds, "t").cast("int")})
    n = {r["y"]: r["n"] for r in out.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    return out, list(range(folds)) if min(n.get(0, 0), n.get(1, 0)) >= 2 * folds else [0]


def dealt(cells: DataFrame, used: list[int], settings: int) -> DataFrame:
    """Cells (y, bins, fold, c) once for each fold to hold out and each setting: (model, held, y, bins, c); ``model`` is ``fold|setting``."""
    each = F.array(*[F.struct(F.lit(f"{f}|{i}").alias("model"), F.lit(f).alias("out")) for f in used for i in range(settings)])
    return cells.withColumn("x", F.explode(each)).select("x.model", (F.col("fold") == F.col("x.out")).alias("held"), "y", "bins", "c")


def held_scores(said: DataFrame, settings: list[dict], used: list[int]) -> list[tuple[dict, float, float]]:
    """(setting, F1, accuracy), mean over the folds, best first, of held-out rows (model, y, said, c); equal ones keep their order."""
    n = {(r["model"], r["y"], r["said"]): r["n"] for r in said.groupBy("model", "y", "said").agg(F.sum("c").alias("n")).collect()}  # four rows a model
    over = lambda a, b: a / b if b else 0.0

    def one(m: str) -> tuple[float, float]:
        tn, fp, fn, tp = (n.get((m, y, s), 0) for y in (0, 1) for s in (0, 1))
        return over(2 * tp, 2 * tp + fp + fn), over(tp + tn, tn + fp + fn + tp)

    out = []
    for i, s in enumerate(settings):
        f1s, right = zip(*[one(f"{f}|{i}") for f in used], strict=True)
        out.append((s, sum(f1s) / len(used), sum(right) / len(used)))
    return sorted(out, key=lambda x: (-round(x[1], 9), -round(x[2], 9)))


def tune_additive(df: DataFrame, columns: list[str], label: str, key: Column, rates=(0.25, 0.5), leaves=(2, 3, 4), rounds: int = 12, folds: int = 5, bins: int = 32) -> list[tuple[dict, float, float]]:
    """(setting, F1, accuracy) of a grid of additive models for a 0/1 label, best first; all settings and folds share the jobs of each round."""
    edges = bin_edges(df, columns, bins)
    rows, used = folds_of(df, F.col(label), key, folds)
    cells = written(_cells(rows, columns, edges, F.col("y").cast("string"), ["0", "1"], F.col("fold")))
    grid = [{"rate": r, "leaves": n} for r in rates for n in leaves]
    boost = _Boost(written(dealt(cells, used, len(grid))), [len(e) + 1 for e in edges], 2, {f"{f}|{i}": Setting(rounds, s["rate"], s["leaves"]) for f in used for i, s in enumerate(grid)})
    boost.rounds()
    said = boost.scored(list(boost.settings), held=True).withColumn("said", (F.element_at("p", 2) > F.element_at("p", 1)).cast("int"))
    return held_scores(said, grid, used)
