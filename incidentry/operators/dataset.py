"""Building training data: feature inference, targets, encoding, splits and samples."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..sources.steps import written
from .ingest import stratified_sample

#: Types of columns that count as numeric.
NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")
#: Outcomes that must not be features of a cause.
OUTCOMES = ("penalty", "individuals", "harm_score", "harm_severity", "harm_category")


def root_cause_columns(df: DataFrame) -> list[str]:
    """Numeric pf_, rc_ and kw_ columns and f_has_description, without outcomes; sorted."""
    fits = lambda c: c.startswith(("pf_", "rc_", "kw_")) or c == "f_has_description"
    return sorted(c for c, t in df.dtypes if t in NUMERIC and fits(c) and not any(o in c for o in OUTCOMES))


def with_target(df: DataFrame, target: str, limit: int | None = None) -> DataFrame:
    """Rows that have a target; ``limit`` is for quick evaluations."""
    some = df.where(F.col(target).isNotNull())
    return some if limit is None else some.limit(limit)


def sentiment_targets(score: Column) -> dict[str, Column]:
    """0/1 targets of the sentiment models: negative and positive scores; null is neither."""
    return {"negative": (F.coalesce(score, F.lit(0.0)) < 0).cast("int"), "positive": (F.coalesce(score, F.lit(0.0)) > 0).cast("int")}


def target_matrix(fields: list[Column], categories=D.CASCADE) -> dict[str, Column]:
    """A 0/1 target for each category, from the first of the label lists that is not empty."""
    found = F.coalesce(*[F.when(F.size(f) > 0, f) for f in fields], F.array().cast("array<string>"))
    return {c: F.array_contains(found, c).cast("int") for c in categories}


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n, rare): rows of each class, null as ``unknown``; rare: fewer than two."""
    n = F.count(F.lit(1))
    return df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias("label")).agg(n.alias("n"), (n < 2).alias("rare"))


def may_stratify(df: DataFrame, label: str, most: int = 10) -> bool:
    """Whether a split keeps the classes' shares: at most ``most`` classes and none rare."""
    return _stratifies(df, label, most)[0]


def _stratifies(df: DataFrame, label: str, most: int = 10) -> tuple[bool, int]:
    """``may_stratify`` and the number of rows, from one pass."""
    r = class_counts(df, label).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("rare"), F.lit(False)).alias("rare"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    return 0 < r["n"] <= most and not r["rare"], r["rows"]


def split_dataset(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the unique ``key``: the same rows for every run and partitioning.

    Where classes are few and none is rare, each gives its share of the test rows (one at
    least); else all rows are dealt alike.  Training rows are written, since fits, prints
    and reports read them again.
    """
    stratifies, n = _stratifies(df, label)
    if stratifies:
        test = stratified_sample(df, label, key, round(n * test_share), 1, seed)
    else:
        test = df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1000)) < int(1000 * test_share))
    return written(df.join(test.select(key), key, "left_anti")), test


def encode_together(train: DataFrame, gold: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """One-hot vectors ``<column>_hot`` of categorical columns, with the same places in both frames.

    The frames are joined up with a flag, categories are learnt on all rows (null is
    ``<NA>``), and the rows are taken apart again.
    """
    both = train.withColumn("_is_golden", F.lit(0)).unionByName(gold.withColumn("_is_golden", F.lit(1)), allowMissingColumns=True)
    both = both.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in columns})
    indexed = StringIndexer(inputCols=columns, outputCols=[f"{c}_at" for c in columns], stringOrderType="alphabetAsc").fit(both).transform(both)
    hot = OneHotEncoder(inputCols=[f"{c}_at" for c in columns], outputCols=[f"{c}_hot" for c in columns], dropLast=False).fit(indexed).transform(indexed)
    hot = hot.drop(*[f"{c}_at" for c in columns])
    return hot.where("_is_golden = 0").drop("_is_golden"), hot.where("_is_golden = 1").drop("_is_golden")


def head_sample(df: DataFrame, key: str, n: int = 150) -> DataFrame:
    """The first rows by key; the limit is the operator's."""
    return df.orderBy(key).limit(n)


def remainder(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows whose key a sample has not taken."""
    return df.join(taken.select(key), key, "left_anti")


def head_and_stratified(df: DataFrame, label: str, key: str, head: int = 150, target: int = 1000) -> DataFrame:
    """The first rows by key and a stratified sample of the others."""
    first = head_sample(df, key, head)
    return first.unionByName(stratified_sample(remainder(df, first, key), label, key, target))


def bernoulli_sample(df: DataFrame, target: int, seed: int = 7) -> DataFrame:
    """About ``target`` rows: each is kept with probability target / rows, clamped to [0.1, 0.9]; then cut at the target."""
    n = df.count()
    p = min(0.9, max(0.1, target / n)) if n else 0.9
    return df.sample(False, p, seed).limit(target)
