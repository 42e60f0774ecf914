"""Many decision trees grown at once, level by level, from class counts.

One aggregate a level counts the classes of all open nodes of all trees: rows of one target
for each tree, or one held-out fold for each tree.  Held-out rows walk along without a say in
the splits, so every node knows how many of them reach it, and a tree of depth d is the top of
a deeper one: metrics of all depths come from the counts of the nodes, with no second pass.
What reaches the driver is the model, a row for each open node.

A third of all rows may share their features: equal rows are one counted row before a tree is
grown, and class counts combine map-side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.steps import written
from .ingest import fold

#: Rank error of bin edges is one in so many rows; a column with fewer different values has exact ones.
SKETCH = 10_000
#: Deepest level of a tree without a depth of its own.
DEEPEST = 30
#: Gains up to this are rounding errors.
LEAST_GAIN = 1e-9


@dataclass
class Node:
    """Rows and positive rows, held-out rows and positive ones, and the split of an inner node."""

    n: int
    pos: int
    held: int
    held_pos: int
    feature: int | None = None
    bin: int | None = None
    gain: float = 0.0


@dataclass
class Trees:
    """Nodes of each tree by number: 1 is the root, node k has the children 2k (at most the threshold) and 2k + 1."""

    columns: list[str]
    edges: list[list[float]]
    nodes: dict[str, dict[int, Node]] = field(default_factory=dict)
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)

    def share(self, tree: str, node: int) -> float:
        """Share of positive training rows at a node, by the tree's class weights."""
        x, (w0, w1) = self.nodes[tree][node], self.weights[tree]
        total = w0 * (x.n - x.pos) + w1 * x.pos
        return w1 * x.pos / total if total else 0.0

    def is_leaf(self, tree: str, node: int, depth: int | None = None) -> bool:
        return self.nodes[tree][node].feature is None or (depth is not None and node.bit_length() > depth)

    def leaves(self, tree: str, depth: int | None = None) -> list[int]:
        """Numbers of the leaves of a tree cut at ``depth``."""
        out, open_ = [], [1]
        while open_:
            k = open_.pop()
            if self.is_leaf(tree, k, depth):
                out.append(k)
            else:
                open_ += [2 * k + 1, 2 * k]
        return out

    def predicate(self, tree: str, node: int) -> str | None:
        """What leads from a node's parent to it, as SQL over the features; None of a root."""
        if node == 1:
            return None
        up = self.nodes[tree][node // 2]
        return f"{self.columns[up.feature]} {'>' if node % 2 else '<='} {self.edges[up.feature][up.bin]!r}"

    def path(self, tree: str, node: int) -> str:
        steps = []
        while node > 1:
            steps.append(self.predicate(tree, node))
            node //= 2
        return " AND ".join(reversed(steps)) or "true"

    def walk(self, tree: str, at_leaf, node: int = 1) -> Column:
        """``at_leaf(number)`` of the leaf that a row reaches, as an expression."""
        x = self.nodes[tree][node]
        if x.feature is None:
            return at_leaf(node)
        low = value(self.columns[x.feature]) <= F.lit(self.edges[x.feature][x.bin])
        return F.when(low, self.walk(tree, at_leaf, 2 * node)).otherwise(self.walk(tree, at_leaf, 2 * node + 1))

    def probability(self, tree: str) -> Column:
        return self.walk(tree, lambda k: F.lit(self.share(tree, k)))


def value(column: str) -> Column:
    """A feature as a number: nulls and NaN are 0."""
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(None)), F.lit(0.0))


def bin_edges(df: DataFrame, columns: list[str], bins: int = 32) -> list[list[float]]:
    """Where each column may be split: quantiles of all columns by one aggregate."""
    shares = [i / bins for i in range(bins)]
    found = df.agg(*[F.percentile_approx(value(c), shares, SKETCH).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    return [sorted(set(found[i] or [])) for i in range(len(columns))]


def binned(columns: list[str], edges: list[list[float]]) -> Column:
    """Each feature's bin: how many of its edges are below it."""
    place = lambda c, es: F.size(F.filter(F.array(*[F.lit(e) for e in es]).cast("array<double>"), lambda e: e < value(c)))
    return F.array(*[place(c, es) for c, es in zip(columns, edges, strict=True)])


def _level(state: DataFrame, about: DataFrame) -> list:
    """Counts and the best split of every open node; ``split`` is null where none gains."""
    by, part = ["tree", "node"], Window.partitionBy("tree", "node", "f")
    shown, positive = ~F.col("held"), F.col("y") == 1
    sums = {"n": shown, "p": shown & positive, "h": F.col("held"), "q": F.col("held") & positive}
    bars = state.select(*by, "held", "y", "c", F.posexplode("bins").alias("f", "b"))
    bars = bars.groupBy(*by, "f", "b").agg(*[F.sum(F.when(on, F.col("c")).otherwise(0)).alias(k) for k, on in sums.items()])
    upto = part.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = bars.select(*by, "f", "b", *[F.sum(k).over(upto).alias(k) for k in sums], *[F.sum(k).over(part).alias(f"all_{k}") for k in sums])
    sides = sides.join(F.broadcast(about), "tree")  # a row a tree

    def purity(n: Column, p: Column) -> Column:
        one, none = F.col("w1") * p, F.col("w0") * (n - p)
        return F.try_divide(one * one + none * none, one + none)

    n, p, all_n, all_p = (F.col(k) for k in ("n", "p", "all_n", "all_p"))
    gain = purity(n, p) + purity(all_n - n, all_p - p) - purity(all_n, all_p)
    fits = (n >= F.col("least")) & (all_n - n >= F.col("least"))
    scored = sides.withColumn("gain", F.when(fits, gain)).withColumn("gain", F.when(F.col("gain") > LEAST_GAIN, F.col("gain")))
    split = F.when(F.col("gain").isNotNull(), F.struct("gain", (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), *sums))
    return scored.groupBy(*by).agg(*[F.first(f"all_{k}").alias(f"all_{k}") for k in sums], F.max(split).alias("split")).collect()


def grow(cells: DataFrame, columns: list[str], edges: list[list[float]], settings: dict[str, tuple[int, float, float]], depth: int | None = None) -> Trees:
    """Trees over counted rows ``cells``: (tree, held, y 0 or 1, bins, c).

    ``settings``: least rows of a leaf and the weights of classes 0 and 1, for each tree.  The
    best split has the greatest fall of weighted Gini impurity, then the first feature, then
    the lowest threshold.  A tree without rows has an empty root.  One job a level.
    """
    spark = cells.sparkSession
    trees = Trees(columns, edges, {t: {1: Node(0, 0, 0, 0)} for t in settings}, {t: (w0, w1) for t, (_, w0, w1) in settings.items()})
    about = spark.createDataFrame([(t, least, float(w0), float(w1)) for t, (least, w0, w1) in settings.items()], "tree string, least long, w0 double, w1 double")
    state = cells.withColumn("node", F.lit(1).cast("long"))
    deepest = DEEPEST if depth is None else min(depth, DEEPEST)
    for level in range(max(1, deepest)):
        splits = []
        for r in _level(state, about):
            node = Node(r["all_n"], r["all_p"], r["all_h"], r["all_q"])
            trees.nodes[r["tree"]][r["node"]] = node
            s = r["split"]
            if s is None or not deepest:
                continue
            node.feature, node.bin, node.gain = -s["f"], -s["b"], s["gain"]
            low, high = Node(s["n"], s["p"], s["h"], s["q"]), Node(node.n - s["n"], node.pos - s["p"], node.held - s["h"], node.held_pos - s["q"])
            trees.nodes[r["tree"]] |= {2 * r["node"]: low, 2 * r["node"] + 1: high}
            mixed = lambda x: 0 < x.pos < x.n and x.n >= 2 * settings[r["tree"]][0]  # noqa: B023, E731
            if mixed(low) or mixed(high):
                splits.append((r["tree"], r["node"], node.feature, node.bin, mixed(low), mixed(high)))
        if not splits:
            break
        # The model so far: a row for each node that was just split.
        told = spark.createDataFrame(splits, "tree string, node long, f int, b int, low boolean, high boolean")
        above = F.element_at("bins", F.col("f") + 1) > F.col("b")
        state = state.join(F.broadcast(told), ["tree", "node"]).where(F.when(above, F.col("high")).otherwise(F.col("low")))
        state = state.select("tree", "held", "y", "bins", "c", (F.col("node") * 2 + above.cast("long")).alias("node"))
        if level % 4 == 3:
            state = written(state)
    return trees


def fit_cascade(df: DataFrame, columns: list[str], targets: list[str], depth: int = 3, held: Column | None = None, bins: int = 32) -> Trees:
    """One tree for each 0/1 target, leaves of at least 5 rows and 1 % of the training rows; null targets count as 0.

    ``held`` marks the rows for the metrics.  A target with one class has a root alone.
    """
    edges = bin_edges(df, columns, bins)
    held = F.coalesce(held, F.lit(False)) if held is not None else F.lit(False)
    ys = F.array(*[F.coalesce(F.col(t).cast("int"), F.lit(0)) for t in targets])
    cells = written(df.select(binned(columns, edges).alias("bins"), ys.alias("ys"), held.alias("held")).groupBy("bins", "ys", "held").agg(F.count(F.lit(1)).alias("c")))
    n = cells.agg(F.sum(F.when(~F.col("held"), F.col("c")))).first()[0] or 0
    each = cells.select("held", "bins", "c", F.posexplode("ys").alias("t", "y"))
    names = F.array(*[F.lit(t) for t in targets])
    each = each.groupBy(F.element_at(names, F.col("t") + 1).alias("tree"), "held", "y", "bins").agg(F.sum("c").alias("c"))
    return grow(written(each), columns, edges, {t: (max(5, n // 100), 1.0, 1.0) for t in targets}, depth)


def scores(trees: Trees, tree: str, depth: int | None = None) -> dict[str, float]:
    """Accuracy, precision, recall and F1 of class 1 on the held-out rows, from the counts of the leaves; 0 where undefined."""
    tp = fp = fn = right = n = 0
    for k in trees.leaves(tree, depth):
        x, said = trees.nodes[tree][k], trees.share(tree, k) > 0.5
        tp, fp, fn = tp + said * x.held_pos, fp + said * (x.held - x.held_pos), fn + (not said) * x.held_pos
        right, n = right + (x.held_pos if said else x.held - x.held_pos), n + x.held
    over = lambda a, b: a / b if b else 0.0
    return {"accuracy": over(right, n), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "f1": over(2 * tp, 2 * tp + fp + fn)}


def gains(trees: Trees, tree: str) -> dict[str, float]:
    """Importance of each feature that a tree asks for: its share of the tree's fall of impurity."""
    out: dict[str, float] = {}
    for x in trees.nodes[tree].values():
        if x.feature is not None:
            out[trees.columns[x.feature]] = out.get(trees.columns[x.feature], 0.0) + x.gain
    total = sum(out.values())
    return {f: g / total for f, g in out.items()}


def cascade_report(trees: Trees) -> tuple[list[tuple], dict[str, float]]:
    """Rows (category, status, accuracy, precision, recall, f1) and the aggregate over all categories."""
    rows = []
    for t in sorted(trees.nodes):
        root, m = trees.nodes[t][1], scores(trees, t)
        rows.append((t, "fitted" if 0 < root.pos < root.n else "single class", m["accuracy"], m["precision"], m["recall"], m["f1"]))
    mean = lambda i: sum(r[i] for r in rows) / len(rows) if rows else 0.0
    return rows, {"mean_f1": mean(5), "mean_accuracy": mean(2), "n_classifiers": float(len(rows)), "n_successful": float(sum(r[5] > 0 for r in rows))}


def node_table(trees: Trees, spark) -> DataFrame:
    """(tree, node, parent, depth, feature, predicate, path, n, positive, support, weight, held, leaf) of every node; support is the share of the tree's rows."""
    rows = []
    for t, nodes in sorted(trees.nodes.items()):
        for k, x in sorted(nodes.items()):
            feature = None if x.feature is None else trees.columns[x.feature]
            rows.append((t, k, k // 2 or None, k.bit_length() - 1, feature, trees.predicate(t, k), trees.path(t, k), x.n, x.pos, x.n / nodes[1].n if nodes[1].n else 0.0, trees.share(t, k), x.held, x.feature is None))
    return spark.createDataFrame(rows, "tree string, node long, parent long, depth int, feature string, predicate string, path string, n long, positive long, support double, weight double, held long, leaf boolean")


def node_support(df: DataFrame, trees: Trees, labels: dict[str, str]) -> DataFrame:
    """(tree, node, n, positive): rows of any frame at every node of all trees, by one pass.

    A row gives the nodes on its path through each tree; counts combine map-side.  ``labels``
    names each tree's 0/1 column.  Nodes that no row reaches have no row.
    """
    way = lambda k: F.array(*[F.lit(k >> i).cast("long") for i in reversed(range(k.bit_length()))])
    paths = F.array(*[F.struct(F.lit(t).alias("tree"), F.coalesce(F.col(y).cast("long"), F.lit(0)).alias("y"), trees.walk(t, way).alias("way")) for t, y in sorted(labels.items())])
    hit = df.select(F.explode(paths).alias("x")).groupBy("x.tree", "x.way").agg(F.count(F.lit(1)).alias("n"), F.sum("x.y").alias("y"))
    return hit.select("tree", F.explode("way").alias("node"), "n", "y").groupBy("tree", "node").agg(F.sum("n").alias("n"), F.sum("y").alias("positive"))


def tune_trees(df: DataFrame, columns: list[str], label: str, key: Column, depths=(3, 5, None), leaves=(1, 5, 10), balanced=(False, True), folds: int = 5, bins: int = 32) -> list[tuple[dict, float, float]]:
    """(setting, F1, accuracy) of a grid of trees for a 0/1 label, best first: by F1, then accuracy, then the shallower tree.

    Folds are hashes of label and key when the rarer class has two rows a fold, else one fifth
    is held out.  All folds, leaf sizes and class weights grow together; depths share one
    growth, as the top of a tree is the tree of less depth.
    """
    edges = bin_edges(df, columns, bins)
    y = F.coalesce(F.col(label).cast("int"), F.lit(0))
    rows = df.select(binned(columns, edges).alias("bins"), y.alias("y"), fold(F.concat_ws("|", y.cast("string"), key.cast("string")), folds, "t").cast("int").alias("fold"))
    cells = written(rows.groupBy("bins", "y", "fold").agg(F.count(F.lit(1)).alias("c")))
    count = {(r["fold"], r["y"]): r["n"] for r in cells.groupBy("fold", "y").agg(F.sum("c").alias("n")).collect()}  # two rows a fold
    total = [sum(n for (_, k), n in count.items() if k == side) for side in (0, 1)]
    used = range(folds) if min(total) >= 2 * folds else range(1)
    grid, settings = [(leaf, even) for leaf in leaves for even in balanced], {}
    for f in used:
        seen = [total[s] - count.get((f, s), 0) for s in (0, 1)]
        for i, (leaf, even) in enumerate(grid):
            w = [sum(seen) / (2 * s) if even and s else 1.0 for s in seen]
            settings[f"{f}|{i}"] = (leaf, *w)
    names = F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(int(t.split("|")[0])).alias("out")) for t in settings])
    each = cells.withColumn("x", F.explode(names)).select("x.tree", (F.col("fold") == F.col("x.out")).alias("held"), "y", "bins", "c")
    deepest = None if None in depths else max(depths)
    trees = grow(each, columns, edges, settings, deepest)
    out = []
    for d in depths:
        for i, (leaf, even) in enumerate(grid):
            m = [scores(trees, f"{f}|{i}", d) for f in used]
            out.append(({"depth": d, "leaf": leaf, "balanced": even}, sum(x["f1"] for x in m) / len(m), sum(x["accuracy"] for x in m) / len(m)))
    return sorted(out, key=lambda x: (-round(x[1], 9), -round(x[2], 9), DEEPEST + 1 if x[0]["depth"] is None else x[0]["depth"], -x[0]["leaf"], x[0]["balanced"]))

