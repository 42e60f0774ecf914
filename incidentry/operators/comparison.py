"""Comparing approaches: truth extraction, predictions as a long frame, rankings of approaches and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import dictionaries as D
from ..functions.text import contains_any, string_array


def canonical_label(label: Column) -> Column:
    """Without the ``harm_`` prefix; null for the abstention ``unknown``."""
    return F.nullif(F.regexp_replace(label, "^harm_", ""), F.lit("unknown"))


def expected_harms(lists: list[Column], single: Column) -> Column:
    """The first list that is present, even if empty, else the single label; blanks and prefixes removed."""
    found = F.coalesce(*lists, F.when(single.isNotNull(), F.array(single)), F.array().cast("array<string>"))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, "^harm_", ""))), lambda x: x != "")


def best_correct(predictions: DataFrame, key: str, name: str, correct: str, confidence: str, order: str) -> DataFrame:
    """(key, best): the right approach with the highest confidence, the first on ties; null if none is right."""
    return predictions.groupBy(key).agg(F.max_by(F.when(F.col(correct), F.col(name)), F.when(F.col(correct), F.struct(F.col(confidence), -F.col(order)))).alias("best"))


def approach_accuracy(predictions: DataFrame, name: str, correct: str) -> DataFrame:
    """(approach, correct, total, accuracy, place): four decimals, best first, equal ones by name."""
    a = predictions.groupBy(F.col(name).alias("approach")).agg(F.count_if(correct).alias("correct"), F.count(F.lit(1)).alias("total"))
    a = a.withColumn("accuracy", F.bround(F.col("correct") / F.col("total"), 4))
    return a.withColumn("place", F.row_number().over(Window.orderBy(F.desc("accuracy"), "approach")))


def micro_scores(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: cases, precision, recall, f1 from summed counts; cases without truth are skipped."""
    both = F.size(F.array_intersect(truth, pred))
    s = df.where(F.size(truth) > 0).agg(F.count(F.lit(1)).alias("cases"), F.sum(both).alias("tp"), F.sum(F.size(F.array_except(pred, truth))).alias("fp"), F.sum(F.size(F.array_except(truth, pred))).alias("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return s.select("cases", safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), safe(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def extremes(report: DataFrame, group: str, label: str, score: str, k: int = 3) -> DataFrame:
    """The k strongest and k weakest labels of each group, equal ones by name."""
    up, down = Window.partitionBy(group).orderBy(F.desc(score), label), Window.partitionBy(group).orderBy(score, label)
    r = report.withColumn("strong", F.row_number().over(up)).withColumn("weak", F.row_number().over(down))
    return r.where((F.col("strong") <= k) | (F.col("weak") <= k)).select(group, label, score, "strong", "weak")


def metric_drift(emitted: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """Metrics whose values differ by more than the tolerance, or that one side lacks."""
    e, r = emitted.select("metric", F.col("value").alias("emitted")), reference.select("metric", F.col("value").alias("expected"))
    d = e.join(r, "metric", "full")
    return d.where(F.coalesce(F.abs(F.col("emitted") - F.col("expected")) > tolerance, F.lit(True)))


def bootstrap_labels(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(contains_any(t, ws), F.lit(n)) for n, ws in D.BOOTSTRAP]))
    return F.when(F.size(found) > 0, found).otherwise(string_array([D.GENERAL]))


def annotate_scores(scores: Column, threshold: float) -> Column:
    """Struct (categories over the threshold, sorted; the highest score or 0) of a map of scores."""
    over = F.array_sort(F.map_keys(F.map_filter(scores, lambda k, v: v > threshold)))
    return F.struct(over.alias("harm_categories"), F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0)).alias("harm_score"))


def dimension_scores(df: DataFrame, key: str, dimensions=D.DIMENSIONS) -> DataFrame:
    """(key, dimension, score): the maximum over a dimension's features that the frame has, 0 without any; one projection, no shuffle."""
    names = sorted(set(dimensions.values()))
    best = lambda d: F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)) for f, x in dimensions.items() if x == d and f in df.columns])
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), best(d).alias("score")) for d in names])).alias("x")).select(key, "x.*")


def explain_composite(dims: dict[str, Column], weights: dict[str, float]) -> Column:
    """Text of the dimensions by score times weight, highest first, equal ones by name."""
    parts = F.array(*[F.struct((-c * weights[n]).alias("neg"), F.lit(n).alias("name"), c.alias("score")) for n, c in dims.items()])
    return F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat(p["name"], F.lit("="), F.format_number(p["score"], 2))), "; ")
