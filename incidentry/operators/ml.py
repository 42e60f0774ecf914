"""Interpretable models as Spark jobs, and their rules as tables.

Fits are pyspark.ml or plain aggregates.  What comes to the driver is a model: tree nodes,
a matrix of the size of the features, or counts of feature pairs; never rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.steps import scratch, written
from .evaluation import classification_report
from .ingest import fold


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def split(df: DataFrame, key: str, test_share: int = 20) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: the same rows for every run and partitioning."""
    f = fold(F.col(key), 100)
    return df.where(f >= test_share), df.where(f < test_share)


#: Parts of equal width that a round cuts each open range of values into.
SKETCH = 2_000


def exact_quantiles(df: DataFrame, column: Column, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a column, between two values as ``percentile`` does; nulls and NaN take no part, None of no rows.

    Selection by counts: a round counts the rows of each part of the values, with its least
    and greatest value, and the parts that hold a rank are cut again until they hold one
    value.  All shares take the same rounds.  Parts of the first round are powers of two, so
    every later one narrows its range ``SKETCH`` times, however the values lie.  A round is
    one scan with map-side combination; a row a part reaches the driver.
    """
    v = F.col("v")
    values = df.select(column.cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v))
    count = lambda part: sorted(values.groupBy(part.alias("part")).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).where("part is not null").collect())
    power = F.floor(F.least(F.lit(2000.0), F.log2(F.abs(v)))) + 3000
    parts = count(F.when(v == 0, F.lit(0).cast("long")).when(v > 0, power).otherwise(-power))
    n = sum(p["n"] for p in parts)
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    known: dict[int, float] = {}
    # Ranks that are open, by the range (rows before it, least and greatest value) that holds them.
    ranges = {(0, None, None): {r for p in places for r in (int(p), min(int(p) + 1, n - 1))}}
    groups = [parts]
    while ranges:
        narrower: dict[tuple, set[int]] = {}
        for ((before, _, _), ranks), cut in zip(ranges.items(), groups, strict=True):
            ends = np.cumsum([before, *[p["n"] for p in cut]])
            for r in ranks:
                i = int(np.searchsorted(ends, r, "right")) - 1
                if cut[i]["low"] == cut[i]["high"]:
                    known[r] = cut[i]["low"]
                else:
                    narrower.setdefault((int(ends[i]), cut[i]["low"], cut[i]["high"]), set()).add(r)
        ranges = dict(sorted(narrower.items()))
        if ranges:
            inside = lambda low, high: F.least(F.lit(SKETCH - 1), F.floor((v - low) / (F.lit(high) - low) * SKETCH))
            cases = [F.when(v.between(low, high), i * SKETCH + inside(low, high)) for i, (_, low, high) in enumerate(ranges)]
            groups = [[] for _ in ranges]
            for p in count(F.coalesce(*cases)):
                groups[p["part"] // SKETCH].append(p)

    def between(place: float) -> float:
        part, low, high = place - int(place), known[int(place)], known[min(int(place) + 1, n - 1)]
        return low if not part or low == high else (1 - part) * low + part * high

    return [between(p) for p in places]


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinities and nulls of numeric columns become the median, or 0 where all values are null."""
    finite = {c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double")) for c in columns}
    medians = {c: exact_quantiles(df, e, [0.5])[0] for c, e in finite.items()}
    return df.withColumns({c: F.coalesce(F.nanvl(e, F.lit(None)), F.lit(medians[c] if medians[c] is not None else 0.0)) for c, e in finite.items()})


def binarise(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 where a value is above its column's median."""
    medians = {c: exact_quantiles(df, F.col(c), [0.5])[0] for c in columns}
    return df.withColumns({c: (F.col(c) > F.lit(medians[c]).cast("double")).cast("int") for c in columns})


def quantile_bins(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """Add ``bin``: place among the distinct exact quantile edges; null where there are fewer than three edges or six values."""
    edges = sorted({e for e in exact_quantiles(df, F.col(column), [i / bins for i in range(bins + 1)]) if e is not None})
    if len(edges) < 3 or df.select(column).where(F.col(column).isNotNull()).distinct().limit(6).count() < 6:
        return df.withColumn("bin", F.lit(None).cast("int"))
    inner = F.array(*[F.lit(e) for e in edges[1:-1]])
    return df.withColumn("bin", F.size(F.filter(inner, lambda e: F.col(column) > e)))


@dataclass
class Fitted:
    """A fitted pipeline, its features and label names."""

    model: PipelineModel
    columns: list[str]
    labels: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``predicted`` and ``probability`` of the predicted label; missing features count as 0."""
        aligned = df.withColumns({c: F.lit(0.0) for c in self.columns if c not in df.columns})
        names = F.array(*[F.lit(x) for x in self.labels])
        out = self.model.transform(aligned)
        return out.select(*df.columns, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"), F.array_max(vector_to_array("probability")).alias("probability"))


#: Different rows that a tree takes as counted ones at most: of up to so many Spark finds bins without a sample.
COUNTED = 10_000
#: Values that a part of an iterated frame should hold.
PART_VALUES = 2_000_000


def _counted(frame: DataFrame) -> DataFrame | None:
    """Equal rows as one with their number ``_n``; None if more than ``COUNTED`` differ."""
    about = frame.agg(F.approx_count_distinct(F.xxhash64(*frame.columns))).first()[0]
    # The estimate is for not shuffling rows that hardly repeat; the count decides.
    cells = written(frame.groupBy(*frame.columns).agg(F.count(F.lit(1)).cast("double").alias("_n"))) if about <= 2 * COUNTED else None
    return cells if cells is not None and cells.count() <= COUNTED else None


def _spread(frame: DataFrame) -> DataFrame:
    """``frame`` in parts of bounded size: files that are read together, compressed, are much larger as cached rows."""
    parts = -(-frame.count() * len(frame.columns) // PART_VALUES)
    return frame.repartition(parts) if parts > frame.rdd.getNumPartitions() else frame


def fit_classifier(train: DataFrame, columns: list[str], label: str, kind: str = "tree", **params) -> Fitted:
    """kind: tree, linear (L1), additive (boosted stumps, two labels), network.

    Trees and boosted stumps fit equal rows once, weighed by their number, where few differ;
    all else iterates over parts whose size is bounded.
    """
    # Iterations read a written frame of features and labels, not the texts that they come from.
    train = written(train.select(F.col(label).alias("_label"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]))
    counted = _counted(train) if kind in ("tree", "additive") else None
    train = train if counted is None else counted
    index = StringIndexer(inputCol="_label", outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc").fit(train)
    data = index.transform(train).select("_y", *columns, *(["_n"] if counted is not None else []))
    data = data if counted is not None else _spread(data)
    stages = [VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")]
    common = {"featuresCol": "features", "labelCol": "_y"} | ({"weightCol": "_n"} if counted is not None else {})
    if kind == "tree":
        depth, leaf = params.get("depth", 5), params.get("leaf", 1)
        if counted is not None and leaf > 1:
            # Instances are counted rows here, so the least rows of a leaf are a share of the weight, half a row less to be sure.
            n = data.agg(F.sum("_n")).first()[0] or 0.0
            depth, share = (depth, (leaf - 0.5) / n) if 2 * leaf <= n else (0, 0.0)
            common, leaf = common | {"minWeightFractionPerNode": share}, 1
        stages.append(DecisionTreeClassifier(**common, maxDepth=depth, minInstancesPerNode=leaf, seed=0))
    elif kind == "linear":
        stages += [StandardScaler(inputCol="features", outputCol="scaled"), LogisticRegression(featuresCol="scaled", labelCol="_y", elasticNetParam=1.0, regParam=params.get("penalty", 0.001), maxIter=params.get("rounds", 50))]
    elif kind == "additive":
        stages.append(GBTClassifier(**common, maxDepth=1, maxIter=params.get("rounds", 20), seed=0))
    elif kind == "network":
        stages.append(MultilayerPerceptronClassifier(**common, layers=[len(columns), params.get("hidden", 16), len(index.labels)], maxIter=params.get("rounds", 30), seed=0))
    else:
        raise ValueError(kind)
    inner = Pipeline(stages=stages).fit(data)
    if kind in ("linear", "network"):
        # A training summary holds the session, which no task can take along; a model read back has none.
        path = scratch(train.sparkSession)
        inner.save(path)
        inner = PipelineModel.load(path)
    return Fitted(inner, columns, list(index.labels))


def tree_nodes(fitted: Fitted) -> list[dict]:
    """(id, parent, predicate, leaf) of a fitted tree, in preorder; predicates are SQL over the feature columns."""
    root = fitted.model.stages[-1]._java_obj.rootNode()
    out: list[dict] = []

    def walk(node, parent: int | None, predicate: str) -> None:
        me = len(out)
        inner = node.subtreeDepth() > 0
        out.append({"id": me, "parent": parent, "predicate": predicate, "leaf": not inner, "label": fitted.labels[int(node.prediction())]})
        if inner:
            c, t = fitted.columns[node.split().featureIndex()], node.split().threshold()
            walk(node.leftChild(), me, f"{c} <= {t!r}")
            walk(node.rightChild(), me, f"{c} > {t!r}")

    walk(root, None, "true")
    return out


def tree_rules(fitted: Fitted, train: DataFrame, label: str) -> DataFrame:
    """(rule, label, support, precision) of each leaf: share of rows, and share of the predicted label among them, from one aggregate."""
    nodes = tree_nodes(fitted)

    def path(n: dict) -> list[str]:
        return ([] if n["parent"] is None else path(nodes[n["parent"]])) + ([n["predicate"]] if n["parent"] is not None else [])

    leaves = [(" AND ".join(path(n)) or "true", n["label"]) for n in nodes if n["leaf"]]
    rule = F.array(*[F.when(F.expr(r), F.struct(F.lit(r).alias("rule"), F.lit(y).alias("label"))) for r, y in leaves])
    hit = train.select(F.array_compact(rule)[0].alias("x"), F.col(label).cast("string").alias("y")).where("x is not null")
    n = F.sum(F.count(F.lit(1))).over(Window.partitionBy(F.lit(0)))
    return hit.groupBy("x.rule", "x.label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("x.label")).cast("double")).alias("precision"), n.alias("total")).select("rule", "label", (F.col("n") / F.col("total")).alias("support"), "precision")


def coefficients(fitted: Fitted) -> list[tuple[str, float]]:
    """(feature, weight on the raw scale) of a two-label linear model."""
    scaler, lr = fitted.model.stages[-2], fitted.model.stages[-1]
    return [(c, float(w) / s if s else 0.0) for c, w, s in zip(fitted.columns, lr.coefficients.toArray(), scaler.std.toArray(), strict=True)]


def directionality(weights: list[tuple[str, float]], df: DataFrame) -> DataFrame:
    """(feature, weight, odds_ratio, direction), strongest first; weights up to 1e-6 are left out."""
    rows = [(f, float(w)) for f, w in weights if abs(w) > 1e-6]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double").select("feature", "weight", F.exp("weight").alias("odds_ratio"), F.when(F.col("weight") > 0, "risk").otherwise("protective").alias("direction")).orderBy(F.desc(F.abs("weight")), "feature")


def linear_rules(df: DataFrame, weights: list[tuple[str, float]], positive: Column) -> DataFrame:
    """Pseudo-rules ``feature > median`` (or <= for negative weights) with support, precision and lift: one pass for all features after their medians."""
    some = [(f, w) for f, w in weights if abs(w) >= 1e-9]
    medians = {f: exact_quantiles(df, F.col(f), [0.5])[0] or 0.0 for f, _ in some}
    base = df.withColumn("_y", positive.cast("int"))
    aggs = [F.avg("_y").alias("_rate")]
    for f, w in some:
        on = (F.col(f) > medians[f]) if w > 0 else (F.col(f) <= medians[f])
        aggs += [F.avg(on.cast("int")).alias(f"s_{f}"), F.avg(F.when(on, F.col("_y"))).alias(f"p_{f}")]
    wide = base.agg(*aggs)
    each = [F.struct(F.lit(f).alias("feature"), F.lit(">" if w > 0 else "<=").alias("side"), F.lit(float(medians[f])).alias("median"), F.col(f"s_{f}").alias("support"), F.coalesce(f"p_{f}", F.lit(0.0)).alias("precision"), F.when(F.col("_rate") > 0, F.coalesce(f"p_{f}", F.lit(0.0)) / F.col("_rate")).alias("lift"), F.lit(float(w)).alias("weight")) for f, w in some]
    return wide.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def mutual_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, mi) in nats for each pair of discrete columns: one pass explodes pairs, counts combine map-side."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs])
    cells = df.select(F.explode(each).alias("e")).groupBy("e.a", "e.b", "e.x", "e.y").agg(F.count(F.lit(1)).alias("n"))
    xs = cells.groupBy("a", "b", "x").agg(F.sum("n").alias("nx"))
    ys = cells.groupBy("a", "b", "y").agg(F.sum("n").alias("ny"))
    ns = cells.groupBy("a", "b").agg(F.sum("n").alias("t"))
    null_safe = lambda l, r, k: (F.col(f"{l}.a") == F.col(f"{r}.a")) & (F.col(f"{l}.b") == F.col(f"{r}.b")) & F.col(f"{l}.{k}").eqNullSafe(F.col(f"{r}.{k}"))
    j = cells.alias("c").join(xs.alias("x"), null_safe("c", "x", "x")).join(ys.alias("y"), null_safe("c", "y", "y")).join(ns.alias("n"), (F.col("c.a") == F.col("n.a")) & (F.col("c.b") == F.col("n.b")))
    return j.groupBy("c.a", "c.b").agg(F.sum(F.col("c.n") / F.col("t") * F.log(F.col("c.n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


def chow_liu(df: DataFrame, columns: list[str], root: str) -> list[tuple[str, str, float]]:
    """Edges (parent, child, mi) of the best tree over the columns, directed away from ``root``; only pair scores reach the driver."""
    scores = sorted(((float(r["mi"]), r["a"], r["b"]) for r in mutual_information(df, columns).collect()), reverse=True)
    group = {c: c for c in columns}

    def top(c: str) -> str:
        while group[c] != c:
            c = group[c]
        return c

    near: dict[str, list] = {c: [] for c in columns}
    for mi, a, b in scores:
        if top(a) != top(b):
            group[top(a)] = top(b)
            near[a].append((b, mi))
            near[b].append((a, mi))
    edges, seen, queue = [], {root}, [root]
    for c in queue:
        for d, mi in sorted(near[c]):
            if d not in seen:
                seen.add(d)
                queue.append(d)
                edges.append((c, d, mi))
    return edges


def bayes_tree_predict(df: DataFrame, edges: list[tuple[str, str, float]], target: str, key: str) -> DataFrame:
    """(key, predicted): the likeliest value of ``target`` given its neighbours in the tree, with add-one tables."""
    near = [b if a == target else a for a, b, _ in edges if target in (a, b)]
    values = df.groupBy(F.col(target).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    score = F.log("_n")
    out = df.select(key, *near).join(F.broadcast(values), F.lit(True))
    for c in near:
        table = df.groupBy(F.col(target).alias("_tv"), F.col(c).alias("_cv")).agg(F.count(F.lit(1)).alias(f"_k_{c}"))
        out = out.join(F.broadcast(table), (F.col("_v") == F.col("_tv")) & (F.col(c) == F.col("_cv")), "left").drop("_tv", "_cv")
        score = score + F.log((F.coalesce(f"_k_{c}", F.lit(0)) + 1) / (F.col("_n") + 2))
    return out.withColumn("_s", score).groupBy(key).agg(F.max_by("_v", F.struct("_s", F.col("_v"))).alias("predicted"))


def rule_list(df: DataFrame, columns: list[str], label: str, length: int = 6, least: int = 10) -> list[tuple[str, float, int]]:
    """Ordered rules (antecedent, P(label = 1), rows) over 0/1 features: greedy by the Beta(1, 1) posterior's distance from the rest.

    Each step is one aggregate over the rows that no earlier rule covers, for all single
    features and pairs at once.
    """
    candidates = [f"{c} = 1" for c in columns] + [f"{a} = 1 AND {b} = 1" for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rest, rules = df.select(*columns, F.col(label).cast("int").alias("_y")), []
    for _ in range(length):
        aggs = [F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p")]
        for i, c in enumerate(candidates):
            aggs += [F.count_if(F.expr(c)).alias(f"n{i}"), F.sum(F.when(F.expr(c), F.col("_y"))).alias(f"p{i}")]
        r = rest.agg(*aggs).first()
        if not r["n"]:
            break
        mean = (r["p"] + 1) / (r["n"] + 2)
        best = max(((abs((r[f"p{i}"] or 0) + 1 - mean * (r[f"n{i}"] + 2)) / (r[f"n{i}"] + 2) ** 0.5, -i) for i in range(len(candidates)) if r[f"n{i}"] >= least), default=None)
        if not best or best[0] < 1.0:
            break
        i = -best[1]
        rules.append((candidates[i], ((r[f"p{i}"] or 0) + 1) / (r[f"n{i}"] + 2), int(r[f"n{i}"])))
        rest = rest.where(~F.coalesce(F.expr(candidates[i]), F.lit(False)))
    r = rest.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("p")).first()
    return [*rules, ("else", (r["p"] + 1) / (r["n"] + 2), int(r["n"]))]


def nonnegative_weights(df: DataFrame, columns: list[str], target: str) -> tuple[dict[str, float], float]:
    """Least squares with weights >= 0 and no intercept, and R squared: the Gram matrix by one aggregate, the active set on it."""
    d = len(columns)
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    y = F.col(target).cast("double")
    sums = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)] + [F.sum(x[i] * y).alias(f"b{i}") for i in range(d)]
    r = df.where(y.isNotNull()).agg(*sums, F.sum(y * y).alias("yy"), F.sum(y).alias("sy"), F.count(F.lit(1)).alias("n")).first()
    gram, b = np.zeros((d, d)), np.array([r[f"b{i}"] or 0.0 for i in range(d)])
    for i in range(d):
        for j in range(i, d):
            gram[i, j] = gram[j, i] = r[f"g{i}_{j}"] or 0.0
    w, active = np.zeros(d), np.zeros(d, bool)
    for _ in range(10 * d):
        pull = np.where(active, -np.inf, b - gram @ w)
        if pull.max(initial=-np.inf) <= 1e-9 * max(1.0, np.abs(b).max(initial=0)):
            break
        active[int(pull.argmax())] = True
        while True:
            s = np.zeros(d)
            s[active] = np.linalg.lstsq(gram[np.ix_(active, active)], b[active], rcond=None)[0]
            if (s[active] > 0).all():
                w = s
                break
            low = active & (s <= 0)
            step = np.min(w[low] / np.maximum(w[low] - s[low], 1e-300))
            w = w + step * (s - w)
            active &= w > 1e-12
            w[~active] = 0
    rss = (r["yy"] or 0) - 2 * w @ b + w @ gram @ w
    tss = (r["yy"] or 0) - (r["sy"] or 0) ** 2 / max(1, r["n"])
    return {c: round(float(v), 3) for c, v in zip(columns, w, strict=True)}, float(1 - rss / tss) if tss else 0.0


def reconstruction_error(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Add ``error``: mean squared distance of the scaled features from their projection on k principal components."""
    v = assemble(df, columns)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(v).transform(v)
    pca = PCA(k=k, inputCol="scaled", outputCol="reduced").fit(scaled)
    # Components are orthonormal: the error is what the projection leaves of the squared length.
    square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x * x)
    return pca.transform(scaled).select(*df.columns, (F.greatest(square("scaled") - square("reduced"), F.lit(0.0)) / len(columns)).alias("error"))


def cascade(train: DataFrame, columns: list[str], targets: list[str], depth: int = 3) -> dict[str, Fitted | str]:
    """One small tree for each 0/1 target over one written frame; a target with one class is named instead of fitted."""
    kept = written(train.select(*columns, *targets))
    counts = kept.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(t).cast("int")).alias(t) for t in targets]).first()
    leaf = max(5, counts["n"] // 100)
    return {t: fit_classifier(kept, columns, t, "tree", depth=depth, leaf=leaf) if 0 < (counts[t] or 0) < counts["n"] else "single class" for t in targets}


def contributions(df: DataFrame, weights: list[tuple[str, float]], key: str) -> DataFrame:
    """(key, feature, contribution) of a linear model: weight times the distance from the mean."""
    means = df.agg(*[F.avg(f).alias(f"_m_{f}") for f, _ in weights])
    each = F.array(*[F.struct(F.lit(f).alias("feature"), ((F.col(f) - F.col(f"_m_{f}")) * w).alias("contribution")) for f, w in weights])
    return df.join(F.broadcast(means), F.lit(True)).select(key, F.explode(each).alias("x")).select(key, "x.*")


def evaluate_fitted(fitted: Fitted, test: DataFrame, label: str) -> dict[str, float]:
    """Accuracy and macro precision, recall and F1 on test rows, and of a tree its depth and leaves."""
    report = {r["label"]: r for r in classification_report(fitted.predict(test), label, "predicted").collect()}  # one row a label
    macro = report["macro avg"]
    out = {"accuracy": report["accuracy"]["f1"], "macro_precision": macro["precision"], "macro_recall": macro["recall"], "macro_f1": macro["f1"]}
    last = fitted.model.stages[-1]
    if hasattr(last, "depth"):
        out |= {"depth": float(last.depth), "leaves": float((last.numNodes + 1) // 2)}
    return {k: float(v) if v is not None else 0.0 for k, v in out.items()}


def importances(fitted: Fitted) -> list[tuple[str, float]]:
    """(feature, importance) of a tree or boosted model, greatest first."""
    w = fitted.model.stages[-1].featureImportances.toArray()
    return sorted(((c, float(x)) for c, x in zip(fitted.columns, w, strict=True)), key=lambda x: (-x[1], x[0]))


def sentiment_model(df: DataFrame, columns: list[str], score: str, key: str, positive: bool = False) -> dict:
    """Root causes of negative scores, or with ``positive`` what goes with positive ones.

    A linear model's directions and the rules of a tree of depth 3, learnt on 75 % of the
    rows.  Fewer than four rows, one class, or a class of fewer than two rows give
    ``{"status": ...}`` alone.
    """
    s = F.coalesce(F.col(score), F.lit(0.0))
    d = written(df.select(key, *columns, ((s > 0) if positive else (s < 0)).cast("int").cast("string").alias("_target")))
    n = {r["_target"]: r["n"] for r in d.groupBy("_target").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if sum(n.values()) < 4:
        return {"status": "skipped: fewer than four rows"}
    if len(n) < 2:
        return {"status": "skipped: one class"}
    if min(n.values()) < 2:
        return {"status": "skipped: a class of one row"}
    train, test = split(d, key, 25)
    if train.select("_target").distinct().count() < 2:
        train = d
    linear, tree = fit_classifier(train, columns, "_target", "linear"), fit_classifier(train, columns, "_target", "tree", depth=3)
    kind = F.when(~F.col("feature").startswith("pf_"), F.lit(None).cast("string")).when(F.col("weight") > 0, "protective" if positive else "risk_marker").otherwise("risk_marker" if positive else "protective")
    return {
        "status": "fitted",
        "directions": directionality(coefficients(linear), d).withColumn("kind", kind),
        "rules": tree_rules(tree, train, "_target"),
        "metrics": {f"linear_{k}": v for k, v in evaluate_fitted(linear, test, "_target").items()} | {f"tree_{k}": v for k, v in evaluate_fitted(tree, test, "_target").items()},
    }


def evaluate_models(runners: dict[str, Fitted], df: DataFrame, label: str, heuristic: Column | None = None) -> DataFrame:
    """(runner, label, precision, recall, f1, support) of saved models, and of a heuristic label, on one dataset."""
    reports = [classification_report(m.predict(df), label, "predicted").select(F.lit(name).alias("runner"), "*") for name, m in sorted(runners.items())]
    if heuristic is not None:
        reports.append(classification_report(df.withColumn("_h", heuristic), label, "_h").select(F.lit("heuristic").alias("runner"), "*"))
    return reduce(lambda a, b: a.unionByName(b), reports)


def sampled_shapley(df: DataFrame, fitted: Fitted, key: str, permutations: int = 8, seed: int = 5) -> DataFrame:
    """(key, feature, contribution) for any fitted model, by sampled permutations.

    A row walks from the features' means to its own values, one feature a step in a random
    order; a step's change of the probability of the last label is the feature's part.  Parts
    add up to the distance from the mean row; rows that share a key give their mean.  Orders
    that set out alike share a probability, and all of a row's stand beside each other: rows
    are not multiplied, and one sum a feature and key is shuffled.
    """
    cols, d = fitted.columns, len(fitted.columns)
    rng = np.random.default_rng(seed)
    orders = [rng.permutation(d).tolist() for _ in range(permutations)]
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in cols])
    out = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).join(F.broadcast(means), F.lit(True))
    # Which features have their own value, after each step of each order.
    known = dict.fromkeys(frozenset(o[:s]) for o in orders for s in range(d + 1))
    *before, last = fitted.model.stages
    for i, own in enumerate(known):
        names = {"features": f"_features{i}", "scaled": f"_scaled{i}"}
        for stage in before:
            at = {stage.outputCol: names[stage.getOutputCol()]}
            at |= {stage.inputCols: [c if j in own else f"_m_{c}" for j, c in enumerate(cols)]} if isinstance(stage, VectorAssembler) else {stage.inputCol: names[stage.getInputCol()]}
            out = stage.copy(at).transform(out)
        at = {last.featuresCol: names[last.getFeaturesCol()], last.probabilityCol: f"_probability{i}", last.rawPredictionCol: "", last.predictionCol: ""}
        out = last.copy(at).transform(out)
        known[own] = F.element_at(vector_to_array(f"_probability{i}"), -1)
    out = out.select(key, *[p.alias(f"_p{i}") for i, p in enumerate(known.values())])
    known = {own: F.col(f"_p{i}") for i, own in enumerate(known)}
    step = lambda o, c: known[frozenset(o[: o.index(c) + 1])] - known[frozenset(o[: o.index(c)])]
    parts = [F.avg(reduce(lambda a, b: a + b, [step(o, c) for o in orders]) / permutations).alias(f"_part{c}") for c in range(d)]
    each = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(f"_part{c}").alias("contribution")) for c, name in enumerate(cols)])
    return out.groupBy(key).agg(*parts).select(key, F.explode(each).alias("x")).select(key, "x.*")
