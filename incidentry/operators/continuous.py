"""Rank statistics of continuous values: ranks, Spearman's rho, Kendall's tau-b and Cliff's delta without pairs of rows.

Values are counted first, then dealt to ranges of bounded size.  What lies in earlier ranges
is a prefix sum over the small table of ranges; what lies in the same range is worked out
inside it.  So no window and no task holds all values, and nothing is squared but a range
or the number of ranges.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.steps import written

#: Counted values that a range should hold, and ranges at most: their grid has the square of that many cells.
RANGE_ROWS, RANGES = 50_000, 2_000


def ranges_for(rows: int) -> int:
    return max(1, min(RANGES, math.ceil(rows / RANGE_ROWS)))


def running(counted: DataFrame, group: str, value: str, n: str) -> DataFrame:
    """Add ``upto``: the sum of ``n`` over the group's values up to and with this one.  ``counted`` has a row for each group and value."""
    placed = written(counted.repartitionByRange(ranges_for(counted.count()), group, value).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.sum(n).alias("_rows"))
    earlier = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_g", "_r", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = F.sum(n).over(Window.partitionBy(group, "_range").orderBy(value))
    out = placed.withColumn("_inside", inside).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return out.select(*counted.columns, (F.col("_before") + F.col("_inside")).alias("upto"))


def melted(df: DataFrame, columns: list[str], *others: str) -> DataFrame:
    """(column, v, others) of the values that are there."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select(F.explode(each).alias("_x"), *others).select("_x.*", *others).where(F.col("v").isNotNull() & ~F.isnan("v"))


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v, n, rank) of the different values of all columns in one pass; ties share their mean rank."""
    counted = written(melted(df, columns).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")))
    return running(counted, "column", "v", "n").select("column", "v", "n", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))


#: Values of all columns whose ranks are broadcast at most, and columns that share an aggregate.
FEW, WIDE = 10_000, 16


def spearman(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, n, rho) of each column with ``target`` over the rows that have both; 0 where either does not vary.

    Pairs of values are not counted: a row takes its column's rank along, by a broadcast where
    the values are few, and one aggregate by target sums the ranks of all such columns.  Ranks
    of the target then are prefix sums inside ranges and over the small table of ranges.
    """
    names = [f"c{i}" for i in range(len(columns))]
    rows = df.select(F.col(target).cast("double").alias("_t"), *[F.col(c).cast("double").alias(name) for c, name in zip(columns, names, strict=True)])
    rows = written(rows.where(F.col("_t").isNotNull() & ~F.isnan("_t")))
    counted = written(melted(rows, names).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")))
    total = counted.groupBy(F.col("column").alias("_c")).agg(F.sum("n").alias("rows"))
    # Ranks less their mean, so that sums of squares stay exact for longer.
    x = F.col("upto") - (F.col("n") - 1) / 2.0 - (F.col("rows") + 1) / 2.0
    ranks = written(running(counted, "column", "v", "n").join(F.broadcast(total), F.col("column") == F.col("_c")).select("column", "v", "n", x.alias("x")))
    sizes = {r["column"]: r["count"] for r in ranks.groupBy("column").count().collect()}  # a row a column
    few, upto = [], 0
    for c in sorted(sizes, key=lambda c: (sizes[c], c)):
        upto += sizes[c]
        if upto <= FEW:
            few.append(c)
    blocks = [few[i : i + WIDE] for i in range(0, len(few), WIDE)] + [[c] for c in sizes if c not in few]
    parts = [_range_sums(_by_target(rows, ranks, cs, cs[0] in few), cs) for cs in blocks] or [df.sparkSession.createDataFrame([], RANGE_SUMS)]
    parts = reduce(DataFrame.unionAll, parts)
    each = Window.partitionBy("column")
    earlier = each.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A range's mean rank, less that of all rows.
    parts = parts.withColumn("y", F.coalesce(F.sum("m").over(earlier), F.lit(0)) + (F.col("m") + 1) / 2.0 - (F.sum("m").over(each) + 1) / 2.0)
    y = parts.groupBy(F.col("column").alias("_c")).agg(F.sum(F.col("y") * F.col("s") + F.col("ys")).alias("xy"), F.sum(F.col("y") * F.col("y") * F.col("m") + F.col("yy")).alias("yy"))
    s = ranks.groupBy("column").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("xx")).join(F.broadcast(y), F.col("column") == F.col("_c"))
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.substring("column", 2, 9).cast("int") + 1)
    return s.select(named.alias("column"), "n", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0).alias("rho"))


def _by_target(rows: DataFrame, ranks: DataFrame, columns: list[str], few: bool) -> DataFrame:
    """(_t, and for each column i: m{i} rows, s{i} the sum of their ranks)."""
    out, sums = rows.select("_t", *columns), []
    for i, c in enumerate(columns):
        one = ranks.where(F.col("column") == c).select(F.col("v").alias("_v"), F.col("x").alias(f"_x{i}"))
        out = out.join(F.broadcast(one) if few else one, F.col(c) == F.col("_v"), "left" if few else "inner").drop("_v", c)
        sums += [F.count(f"_x{i}").alias(f"m{i}"), F.coalesce(F.sum(f"_x{i}"), F.lit(0.0)).alias(f"s{i}")]
    return written(out.groupBy("_t").agg(*sums))


#: Of a column in a range: its rows, the sum of x, and the sums of y x and y y, where y are ranks of the target less their mean in the range.
RANGE_SUMS = "_range int, column string, m long, s double, ys double, yy double"


def _range_sums(sides: DataFrame, columns: list[str]) -> DataFrame:
    placed = sides.repartitionByRange(ranges_for(sides.count()), "_t").withColumn("_range", F.spark_partition_id())

    def add(batches):
        t = pd.concat([*batches, pd.DataFrame()])
        if not len(t):
            return
        t = t.sort_values("_t")
        for i, c in enumerate(columns):
            m, s = t[f"m{i}"].to_numpy(), t[f"s{i}"].to_numpy()
            y = np.cumsum(m) - (m - 1) / 2.0 - (m.sum() + 1) / 2.0
            yield pd.DataFrame({"_range": t["_range"].iloc[:1], "column": c, "m": m.sum(), "s": s.sum(), "ys": (y * s).sum(), "yy": (y * y * m).sum()})

    return placed.mapInPandas(add, RANGE_SUMS)


def _pieces(cells: DataFrame, by: str, name: str) -> DataFrame:
    """Add ``name``: the number, in the order of ``by``, of a piece of bounded size or of a single value with more cells than that."""
    k = ranges_for(cells.count())
    placed = written(cells.repartitionByRange(k, by).withColumn("_range", F.spark_partition_id().cast("long")))
    sizes = placed.groupBy("_range", by).agg(F.count(F.lit(1)).alias("_cells")).where(F.col("_cells") > RANGE_ROWS)
    # A range has a few such values at most; their number over all ranges is under the number of cells / RANGE_ROWS.
    hot = sizes.groupBy(F.col("_range").alias("_r")).agg(F.array_sort(F.collect_list(by)).alias("_hot"))
    joined = placed.join(F.broadcast(hot), F.col("_range") == F.col("_r"), "left")
    inside = F.size(F.filter("_hot", lambda h: h < F.col(by))) * 2 + F.array_contains("_hot", F.col(by)).cast("int")
    return joined.select(*cells.columns, (F.col("_range") * (1 << 20) + F.coalesce(inside, F.lit(0))).alias(name))


#: Rows that are compared all with all before merging starts.
BASE = 64


def discordant(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Weight of the pairs of which one is greater in x and smaller in y: a merge sort by y over rows in the order of x that counts as it merges."""
    order = np.lexsort((y, x))
    rows = -(-len(y) // BASE)
    # Filled up with rows of no weight that are greater than all.
    fill = rows * BASE - len(y)
    y = np.concatenate((y[order].astype(float), np.full(fill, np.inf))).reshape(rows, BASE)
    n = np.concatenate((n[order].astype(float), np.zeros(fill))).reshape(rows, BASE)
    total = sum(float(((y[:, :-s] > y[:, s:]) * n[:, :-s] * n[:, s:]).sum()) for s in range(1, BASE))
    by = np.argsort(y, axis=1, kind="stable")
    y, n = np.take_along_axis(y, by, 1).ravel(), np.take_along_axis(n, by, 1).ravel()
    width = BASE
    while width < len(y):
        for a in range(0, len(y) - width, 2 * width):
            m, b = a + width, min(a + 2 * width, len(y))
            # For each row on the right, the rows on the left that are greater in y.
            upto = np.concatenate(([0.0], np.cumsum(n[a:m])))
            at = np.searchsorted(y[a:m], y[m:b], "right")
            total += float(((upto[-1] - upto[at]) * n[m:b]).sum())
            merged = np.argsort(y[a:b], kind="stable")
            y[a:b], n[a:b] = y[a:b][merged], n[a:b][merged]
        width *= 2
    return total


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, concordant, discordant, ties_x, ties_y, tau): Kendall's tau-b over the rows that have both values; 0 where either does not vary.

    Equal pairs of values are counted first.  Discordant pairs whose rows lie in one piece of
    x are counted in it; of the others, those in one piece of y in that piece, by the pieces of
    x; the rest is a prefix sum over the grid of pieces.  A value with many cells is a piece
    of its own: its cells are tied with each other there, so they are not gathered.
    """
    fit = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    cells = written(fit.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    cells = written(_pieces(_pieces(cells, "x", "px"), "y", "py"))

    def within(piece: str, first: str, second: str) -> DataFrame:
        several = cells.groupBy(F.col(piece).alias("_p")).agg(F.min(first).alias("_a"), F.max(first).alias("_b"), F.min(second).alias("_c"), F.max(second).alias("_d"))
        several = several.where((F.col("_a") < F.col("_b")) & (F.col("_c") < F.col("_d"))).select("_p")

        def count(t: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"d": [discordant(t[first].to_numpy(), t[second].to_numpy(), t["n"].to_numpy())]})

        return cells.join(several, F.col(piece) == F.col("_p"), "left_semi").groupBy(piece).applyInPandas(count, "d double")

    grid = cells.groupBy("px", "py").agg(F.sum("n").cast("double").alias("n"))
    # Rows of later pieces of y in the same piece of x, then their sum over earlier pieces of x.
    later = Window.partitionBy("px").orderBy(F.desc("py")).rowsBetween(Window.unboundedPreceding, -1)
    # At most RANGES pieces either way, and those of single values: the grid is bounded, whatever the rows.
    pieces = lambda c: grid.select(c).distinct()
    dense = pieces("px").crossJoin(F.broadcast(pieces("py"))).join(grid, ["px", "py"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    dense = dense.withColumn("_above", F.coalesce(F.sum("n").over(later), F.lit(0.0)))
    earlier = Window.partitionBy("py").orderBy("px").rowsBetween(Window.unboundedPreceding, -1)
    crossing = dense.withColumn("_before", F.coalesce(F.sum("_above").over(earlier), F.lit(0.0))).agg(F.coalesce(F.sum(F.col("n") * F.col("_before")), F.lit(0.0)).alias("d"))
    d = within("px", "x", "y").unionByName(within("py", "px", "y")).unionByName(crossing).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("discordant"))
    two = lambda c: F.coalesce(F.sum(c * (c - 1) / 2.0), F.lit(0.0))
    ties = lambda by, name: cells.groupBy(*by).agg(F.sum("n").cast("double").alias("m")).agg(two(F.col("m")).alias(name))
    one = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).crossJoin(d).crossJoin(ties(["x"], "ties_x")).crossJoin(ties(["y"], "ties_y")).crossJoin(ties(["x", "y"], "ties_xy"))
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    concordant = pairs - F.col("ties_x") - F.col("ties_y") + F.col("ties_xy") - F.col("discordant")
    open_x, open_y = pairs - F.col("ties_x"), pairs - F.col("ties_y")
    tau = F.when((open_x > 0) & (open_y > 0), (concordant - F.col("discordant")) / F.sqrt(open_x) / F.sqrt(open_y)).otherwise(0.0)
    return one.select("n", concordant.alias("concordant"), "discordant", "ties_x", "ties_y", tau.alias("tau"))


def dominance(df: DataFrame, group: str, value: str) -> DataFrame:
    """(a, b, delta, mean_diff) for each pair of groups a < b: Cliff's delta and the difference of the means.

    Counted values of all groups are dealt to ranges of values; a range knows how many rows
    of each group lie before it and sums a matrix of groups by groups.  The groups are few;
    rows without group or value take no part.
    """
    fit = df.select(F.col(group).alias("g"), F.col(value).alias("v")).where(F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    counted = written(fit.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")))
    sizes = written(counted.groupBy("g").agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")))
    placed = written(counted.repartitionByRange(ranges_for(counted.count()), "v").withColumn("_range", F.spark_partition_id()))
    held = placed.groupBy("_range", "g").agg(F.sum("c").alias("c"))
    # Rows of each group in earlier ranges: a row for each range and group.
    every = placed.select("_range").distinct().crossJoin(F.broadcast(sizes.select("g", "n"))).join(held, ["_range", "g"], "left")
    earlier = Window.partitionBy("g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = every.select(F.col("_range").alias("_of"), "g", "n", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    kind = dict(counted.dtypes)["g"]

    def compare(rows: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        base = base.sort_values("g").reset_index(drop=True)
        if not len(rows):
            return pd.DataFrame({"a": base["g"][:0], "b": base["g"][:0], "d": []})
        place = {g: i for i, g in enumerate(base["g"])}
        values, at = np.unique(rows["v"].to_numpy(), return_inverse=True)
        c = np.zeros((len(values), len(base)))
        c[at, rows["g"].map(place).to_numpy()] = rows["c"].to_numpy()
        # Rows of b below a value less those above it: twice those up to it, less the equal ones, less all.
        balance = 2 * (np.cumsum(c, axis=0) + base["before"].to_numpy()) - c - base["n"].to_numpy()
        d = c.T @ balance
        i, j = np.triu_indices(len(base), 1)
        return pd.DataFrame({"a": base["g"].to_numpy()[i], "b": base["g"].to_numpy()[j], "d": d[i, j]})

    parts = placed.groupBy("_range").cogroup(before.groupBy("_of")).applyInPandas(compare, f"a {kind}, b {kind}, d double")
    total = parts.groupBy("a", "b").agg(F.sum("d").alias("d"))
    side = lambda c: sizes.select(F.col("g").alias(c), F.col("n").alias(f"n_{c}"), F.col("mean").alias(f"m_{c}"))
    joined = total.join(F.broadcast(side("a")), "a").join(F.broadcast(side("b")), "b")
    return joined.select("a", "b", (F.col("d") / F.col("n_a") / F.col("n_b")).alias("delta"), (F.col("m_a") - F.col("m_b")).alias("mean_diff"))
