"""Multi-label, ranking, ordinal and calibration statistics as distributed aggregates.

Row parts are array expressions, global parts hash aggregates with partial sums.  Rank
statistics work on the contingency table of values (its size is the number of different
values squared), never on pairs of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.steps import written
from .continuous import dominance as cliffs_delta  # noqa: F401

#: The number of differences up to which the signed-rank distribution is exact.
EXACT_PAIRS = 25


def multi_label(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: n, jaccard, instance_f1, micro_f1, macro_f1, hamming, emr of two label-set columns.

    Two empty sets have Jaccard and F1 0.  Classes are the union of all labels.  Without rows
    everything is 0 but emr, which is 1.
    """
    t, p = F.array_distinct(truth), F.array_distinct(pred)
    both, union = F.size(F.array_intersect(t, p)), F.size(F.array_union(t, p))
    sizes = F.size(t) + F.size(p)
    rows = df.select(t.alias("t"), p.alias("p"), both.alias("both"), union.alias("u"), sizes.alias("s"))
    total = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("u") > 0, F.col("both") / F.col("u")).otherwise(0.0)).alias("jaccard"),
        F.avg(F.when(F.col("s") > 0, 2.0 * F.col("both") / F.col("s")).otherwise(0.0)).alias("instance_f1"),
        F.avg((F.col("both") == F.col("u")).cast("double")).alias("emr"),
        F.sum(F.col("u") - F.col("both")).alias("off"),
        F.sum("both").alias("tp"),
        F.sum("s").alias("sizes"),
    )
    marks = rows.select(F.explode(F.array_union("t", "p")).alias("label"), "t", "p")
    per_class = marks.groupBy("label").agg(F.sum((F.array_contains("t", F.col("label")) & F.array_contains("p", F.col("label"))).cast("int")).alias("tp"), F.sum(F.array_contains("t", F.col("label")).cast("int") + F.array_contains("p", F.col("label")).cast("int")).alias("s"))
    classes = per_class.agg(F.count(F.lit(1)).alias("c"), F.avg(2.0 * F.col("tp") / F.col("s")).alias("macro"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return total.crossJoin(F.broadcast(classes)).select(
        "n",
        zero(F.col("jaccard")).alias("jaccard"),
        zero(F.col("instance_f1")).alias("instance_f1"),
        zero(F.when(F.col("sizes") > 0, 2.0 * F.col("tp") / F.col("sizes"))).alias("micro_f1"),
        zero(F.col("macro")).alias("macro_f1"),
        zero(F.when(F.col("c") > 0, F.col("off") / (F.col("n") * F.col("c")))).alias("hamming"),
        F.coalesce("emr", F.lit(1.0)).alias("emr"),
    )


def ranking(df: DataFrame, truth: str, pred: str, k: int = 5) -> DataFrame:
    """One row: n, ndcg, map, mrr at ``k`` with binary relevance; an empty truth scores 0.

    The reciprocal rank looks at the whole list.  Each list is one row and one expression.
    """
    t, p = F.col(truth), F.col(pred)
    m = F.least(F.size(t), F.lit(k))
    top = F.slice(p, 1, k)
    state = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("dcg"), F.lit(0).alias("hits"), F.lit(0.0).alias("ap"))

    def step(a: Column, x: Column) -> Column:
        hit = F.array_contains(t, x)
        i, hits = a["i"] + 1, a["hits"] + hit.cast("int")
        return F.struct(i.alias("i"), (a["dcg"] + F.when(hit, 1.0 / F.log2(i + F.lit(1.0))).otherwise(0.0)).alias("dcg"), hits.alias("hits"), (a["ap"] + F.when(hit, hits / i).otherwise(0.0)).alias("ap"))

    done = F.aggregate(top, state, step)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + F.lit(1.0)))
    first = F.array_min(F.filter(F.transform(p, lambda x, i: F.when(F.array_contains(t, x), i + 1)), lambda i: i.isNotNull()))
    some = F.size(t) > 0
    rows = df.select(F.when(some, done["dcg"] / ideal).otherwise(0.0).alias("ndcg"), F.when(some, done["ap"] / m).otherwise(0.0).alias("map"), F.when(some, F.coalesce(1.0 / first, F.lit(0.0))).otherwise(0.0).alias("mrr"))
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("ndcg", "map", "mrr")])


def ordinal(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: n, qwk, lwk, kappa, spearman, kendall, accuracy of two ordinal columns.

    The quadratic (qwk) and linear (lwk) weights use the places of the values among all values
    of both raters; kappa is unweighted.  An undefined kappa is 1 if the raters agree
    everywhere, else 0; undefined correlations are 0.
    """
    cells = written(df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n")))
    values = cells.select(F.col("t").alias("v")).union(cells.select("p")).distinct()
    place = values.select("v", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("v")) - 1).alias("i"))
    rank_of = lambda side: cells.groupBy(F.col(side).alias("v")).agg(F.sum("n").alias("m")).select("v", "m", (F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("v")) - (F.col("m") - 1) / 2.0).alias("r"))
    t, p = rank_of("t"), rank_of("p")
    c = (
        cells.join(F.broadcast(place.select(F.col("v").alias("t"), F.col("i").alias("ti"))), "t")
        .join(F.broadcast(place.select(F.col("v").alias("p"), F.col("i").alias("pi"))), "p")
        .join(F.broadcast(t.select(F.col("v").alias("t"), F.col("m").alias("tm"), F.col("r").alias("tr"))), "t")
        .join(F.broadcast(p.select(F.col("v").alias("p"), F.col("m").alias("pm"), F.col("r").alias("pr"))), "p")
    )
    one = c.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("ti") - F.col("pi")) * (F.col("ti") - F.col("pi"))).alias("seen"),
        F.sum(F.col("n") * F.abs(F.col("ti") - F.col("pi"))).alias("seen_l"),
        F.sum((F.col("t") == F.col("p")).cast("int") * F.col("n")).alias("same"),
        F.sum(F.col("n") * F.col("tr") * F.col("pr")).alias("xy"),
        F.sum(F.col("n") * F.col("tr")).alias("x"),
        F.sum(F.col("n") * F.col("pr")).alias("y"),
        F.sum(F.col("n") * F.col("tr") * F.col("tr")).alias("xx"),
        F.sum(F.col("n") * F.col("pr") * F.col("pr")).alias("yy"),
    )
    # All values squared at most, whatever the rows.
    index_of = lambda f: f.join(F.broadcast(place), "v")
    ti, pi = index_of(t).select(F.col("m").alias("a"), F.col("i").alias("ai")), index_of(p).select(F.col("m").alias("b"), F.col("i").alias("bi"))
    both, gap = F.col("a") * F.col("b"), F.col("ai") - F.col("bi")
    chance = ti.crossJoin(F.broadcast(pi)).agg(F.sum(both * gap * gap).alias("chance"), F.sum(both * F.abs(gap)).alias("chance_l"), F.sum(both * (gap != 0).cast("int")).alias("chance_n"))
    l, r = cells.alias("l"), F.broadcast(cells).alias("r")
    sign = F.signum((F.col("l.t") - F.col("r.t")).cast("double")) * F.signum((F.col("l.p") - F.col("r.p")).cast("double"))
    pairs = l.crossJoin(r).agg(F.sum(sign * F.col("l.n") * F.col("r.n")).alias("s"))
    ties = t.agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("tt")).crossJoin(p.agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("pt")))
    f = one.crossJoin(chance).crossJoin(pairs).crossJoin(ties)
    n = F.col("n")
    var = (n * F.col("xx") - F.col("x") * F.col("x")) * (n * F.col("yy") - F.col("y") * F.col("y"))
    kappa = lambda seen, by_chance: F.when(by_chance > 0, 1 - seen * n / by_chance).otherwise(F.when(F.col("same") == n, 1.0).otherwise(0.0))
    open_t, open_p = n * (n - 1) - F.col("tt"), n * (n - 1) - F.col("pt")
    return f.select(
        n.cast("long").alias("n"),
        kappa(F.col("seen"), F.col("chance")).alias("qwk"),
        kappa(F.col("seen_l"), F.col("chance_l")).alias("lwk"),
        kappa(n - F.col("same"), F.col("chance_n")).alias("kappa"),
        F.when(var > 0, (n * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(var)).otherwise(0.0).alias("spearman"),
        F.when((open_t > 0) & (open_p > 0), F.col("s") / F.sqrt(open_t.cast("double") * open_p)).otherwise(0.0).alias("kendall"),
        (F.col("same") / n).alias("accuracy"),
    )


def calibration(df: DataFrame, label: str, prob: str, bins: int = 10) -> DataFrame:
    """One row: n, ece, brier, mean_risk_pct.  Probabilities are clipped to [0, 1]; bin edges are i / bins, the last bin closed."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(prob)))
    b = sum(((F.col("p") >= F.lit(i / bins)).cast("int") for i in range(1, bins)), F.lit(0))
    rows = df.select(F.col(label).cast("double").alias("y"), p.alias("p")).select("y", "p", b.alias("b"))
    per_bin = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("p").alias("p"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("se"))
    n = F.sum("n")
    return per_bin.agg(n.alias("n"), F.coalesce(F.sum(F.abs(F.col("y") - F.col("p"))) / n, F.lit(1.0)).alias("ece"), (F.sum("se") / n).alias("brier"), (F.sum("p") / n * 100).alias("mean_risk_pct"))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Long frame (label, precision, recall, f1, support) with rows accuracy, macro avg and weighted avg; 0 where undefined."""
    cells = df.groupBy(F.coalesce(F.col(truth).cast("string"), F.lit("unknown")).alias("t"), F.coalesce(F.col(pred).cast("string"), F.lit("unknown")).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    per = sides.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("said"), F.sum("tp").alias("tp"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    per = per.select("label", safe(F.col("tp"), F.col("said")).alias("precision"), safe(F.col("tp"), F.col("support")).alias("recall"), safe(2.0 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support", "tp")
    total = F.sum("support")
    mean = lambda c: F.avg(c).alias(c)
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / total).alias(c)
    macro = per.agg(*[mean(c) for c in ("precision", "recall", "f1")], total.alias("support")).select(F.lit("macro avg").alias("label"), "precision", "recall", "f1", "support")
    heavy = per.agg(*[weighted(c) for c in ("precision", "recall", "f1")], total.alias("support")).select(F.lit("weighted avg").alias("label"), "precision", "recall", "f1", "support")
    acc = per.agg((F.sum("tp") / total).alias("a"), total.alias("support")).select(F.lit("accuracy").alias("label"), F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), "support")
    return per.drop("tp").union(acc).union(macro).union(heavy)


def experiment_summary(df: DataFrame, value: str, dims: list[str]) -> DataFrame:
    """n, mean, population deviation, min, max by each dimension, by all of them, and overall: one pass of grouping sets."""
    v = F.col(value)
    sets = [[F.col(d)] for d in dims] + [[F.col(d) for d in dims], []]
    return df.groupingSets(sets, *dims).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def bootstrap_weights(value: float, count: int, replicates: int, seed: int) -> np.ndarray:
    """How often each replicate draws a value that ``count`` rows have: exact Poisson draws, the same wherever they are made."""
    bits = int(np.float64(value + 0.0).view(np.uint64))  # -0.0 is 0.0
    return np.random.Generator(np.random.Philox(key=[seed, bits])).poisson(count, replicates)


def bootstrap_interval(df: DataFrame, value: str, replicates: int = 200, level: float = 0.95, seed: int = 7) -> DataFrame:
    """One row (n, mean, low, high): percentile interval of the mean by a Poisson bootstrap; zeros without values, nulls take no part.

    Equal values are counted first, so a value of a third of the rows is one row.  A task adds
    the weights of all its values to one array of replicates and gives a row a replicate at its
    end: nothing is multiplied by the replicates but the number of tasks.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))

    def replicate(batches):
        # The last place holds the rows themselves, unweighted.
        weight, total = np.zeros(replicates + 1), np.zeros(replicates + 1)
        for batch in batches:
            for v, c in zip(batch["v"].to_numpy(), batch["c"].to_numpy(), strict=True):
                w = np.append(bootstrap_weights(v, c, replicates, seed), c)
                weight += w
                total += w * v
        yield pd.DataFrame({"rep": np.arange(replicates + 1), "w": weight, "s": total})

    sums = counted.mapInPandas(replicate, "rep int, w double, s double").groupBy("rep").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    mean, whole, cut = F.col("s") / F.greatest(F.col("w"), F.lit(1.0)), F.col("rep") == replicates, (1 - level) / 2
    one = sums.agg(F.max(F.when(whole, F.col("w"))).alias("n"), F.max(F.when(whole, mean)).alias("mean"), F.percentile(F.when(~whole, mean), F.array(F.lit(cut), F.lit(1 - cut))).alias("q"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return one.select(zero(F.col("n")).cast("long").alias("n"), zero(F.col("mean")).alias("mean"), zero(F.col("q")[0]).alias("low"), zero(F.col("q")[1]).alias("high"))


def signed_rank(df: DataFrame, key: str, group: str, value: str, level: float = 0.05) -> DataFrame:
    """(a, b, n, w, z, p, alpha, significant) for each pair of groups, paired by key.

    Repeated values of a key in a group are averaged; rows with a null key, group or value and
    zero differences take no part.  w sums the ranks (ties share their mean) of keys where a is
    above b; z is its normal score without continuity correction; p is two-sided, exact up to EXACT_PAIRS differences and
    normal beyond.  alpha is the level over the number of pairs (Bonferroni).  Where all
    differences are zero, n and w are 0, z and p null and significant false.
    """
    cells = df.where(F.col(key).isNotNull() & F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(group).alias("g")).agg(F.avg(value).alias("v"))
    # Groups meet per key in one array: no self-join, and a key's array is as long as the groups are many.
    pair = F.flatten(F.transform("gs", lambda x: F.transform(F.filter("gs", lambda y: x["g"] < y["g"]), lambda y: F.struct(x["g"].alias("a"), y["g"].alias("b"), (x["v"] - y["v"]).alias("d")))))
    diffs = cells.groupBy("k").agg(F.collect_list(F.struct("g", "v")).alias("gs")).select(F.explode(pair).alias("x")).select("x.*")
    sizes = diffs.groupBy("a", "b", F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("d") > 0).cast("int")).alias("up"))
    upto = Window.partitionBy("a", "b").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    used = F.when(F.col("size") > 0, F.col("m")).otherwise(0)
    ranked = sizes.withColumn("m", used).withColumn("r", F.sum("m").over(upto) - (F.col("m") - 1) / 2.0)
    sums = ranked.groupBy("a", "b").agg(
        F.sum("m").alias("n"),
        F.sum(F.col("r") * F.when(F.col("m") > 0, F.col("up")).otherwise(0)).alias("w"),
        F.sum(F.col("m").cast("double") * F.col("m") * F.col("m") - F.col("m")).alias("ties"),
        # Only pairs of few differences keep their ranks: at most EXACT_PAIRS entries are read.
        F.collect_list(F.when((F.col("m") > 0) & (F.col("r") + (F.col("m") - 1) / 2.0 <= EXACT_PAIRS), F.struct("r", "m"))).alias("ranks"),
    )
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.when(var > 0, (F.col("w") - n * (n + 1) / 4) / F.sqrt(var))
    out = sums.withColumn("z", z).withColumn("p", _signed_rank_p("n", "w", "z", F.flatten(F.transform("ranks", lambda x: F.array_repeat(x["r"], x["m"].cast("int"))))))
    alpha = out.agg((F.lit(level) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("alpha"))
    return out.crossJoin(F.broadcast(alpha)).select("a", "b", "n", "w", "z", "p", "alpha", F.coalesce(F.col("p") < F.col("alpha"), F.lit(False)).alias("significant"))


def _signed_rank_p(n, w, z, ranks) -> Column:
    few = EXACT_PAIRS

    @F.pandas_udf("double")
    def p_value(n: pd.Series, w: pd.Series, z: pd.Series, ranks: pd.Series) -> pd.Series:
        def one(n, w, z, ranks):
            if n == 0:
                return None
            if n > few:
                return math.erfc(abs(z) / math.sqrt(2))
            # Sums of doubled ranks over all sign patterns.
            ways = {0: 1}
            for r in (round(2 * x) for x in ranks):
                ways = {s: ways.get(s, 0) + ways.get(s - r, 0) for s in set(ways) | {s + r for s in ways}}
            total, at = sum(ways.values()), round(2 * w)
            tail = min(sum(c for s, c in ways.items() if s <= at), sum(c for s, c in ways.items() if s >= at))
            return min(1.0, 2 * tail / total)

        return pd.Series([one(*r) for r in zip(n, w, z, ranks, strict=True)], dtype="float64")

    return p_value(n, w, z, ranks)


def confidence(alpha: Column, beta: Column) -> Column:
    """Beta(1, 1) posterior mean damped by the number of trials, four decimals; 0 without trials."""
    n = alpha + beta
    return F.when(n > 0, F.bround((alpha + 1) / (n + 2) * (1 - F.exp(-n / 10.0)), 4)).otherwise(F.lit(0.0))
