"""Validation, scrubbing, incremental dedup, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dictionaries import SENTIMENTS, SEVERITIES, SOURCES
from ..sources.steps import written

#: Fixed values of P13: an e-mail address in its common form; handles and phone numbers.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
HANDLE = r"@[A-Za-z0-9_]+@[A-Za-z0-9.-]+"
PHONE = r"(?<![0-9])(\+?1[-. ]?)?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9])"

#: Labels of a sample that are broadcast at most, and digits of a hash that rounds of counting look at.
LABELS, DIGITS = 1000, (3, 6, 12, 48)


def violations(sources=SOURCES, columns=None) -> Column:
    """Names of the rules a record breaks, in fixed order.

    Source, type, id and raw are required; penalties are not negative, sentiments in [-1, 1],
    harm scores (single and in a map) in [0, 1], sentiment labels and severities in their
    sets.  ``columns``: those the records have, if not all of these.
    """
    has = lambda c: columns is None or c in columns
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    rules = {
        "source": lambda c: ~F.coalesce(c.isin(*sources), F.lit(False)),
        "type": lambda c: ~some("type"),
        "id": lambda c: ~some("id"),
        "raw": lambda c: ~some("raw"),
        "penalty_amount": lambda c: c < 0,
        "sentiment_score": lambda c: ~c.between(-1, 1),
        "sentiment_label": lambda c: ~c.isin(*SENTIMENTS),
        "harm_severity": lambda c: ~c.isin(*SEVERITIES),
        "harm_score": lambda c: ~c.between(0, 1),
        "harm_category_scores": lambda c: F.exists(F.map_values(c), lambda v: ~v.between(0, 1)),
    }
    return F.array_compact(F.array(*[F.when(broken(F.col(c)), F.lit(c)) for c, broken in rules.items() if has(c)]))


def quarantine(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid with ``violations``)."""
    checked = records.withColumn("violations", violations(columns=records.columns))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def has_pii(value: Column) -> Column:
    return value.rlike(EMAIL) | value.rlike(HANDLE) | value.rlike(PHONE)


def scrub(df: DataFrame, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """Drop forbidden columns; null every string or nested value that holds an e-mail, handle or phone number.  Numbers never match."""
    kept = [(c, t) for c, t in df.dtypes if c not in forbidden]
    text = lambda c, t: F.col(c) if t == "string" else F.to_json(c)
    nested = ("array", "struct", "map", "variant")
    return df.select(*[F.when(~F.coalesce(has_pii(text(c, t)), F.lit(False)), F.col(c)).alias(c) if t == "string" or t.startswith(nested) else F.col(c) for c, t in kept])


def leaks(df: DataFrame, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """(field, rows): forbidden columns that are there, and columns in which rows still hold an e-mail, handle or phone number; no row if clean."""
    text = {c: F.col(c) if t == "string" else F.to_json(c) for c, t in df.dtypes if t == "string" or t.startswith(("array", "struct", "map", "variant"))}
    n = F.count(F.lit(1))
    found = [F.struct(F.lit(c).alias("field"), n.alias("rows")) for c in df.columns if c in forbidden]
    found += [F.struct(F.lit(c).alias("field"), F.count_if(F.coalesce(has_pii(e), F.lit(False))).alias("rows")) for c, e in text.items() if c not in forbidden]
    listed = F.array(*found) if found else F.array().cast("array<struct<field:string,rows:long>>")
    return df.agg(listed.alias("x")).select(F.explode("x").alias("x")).select("x.*").where("rows > 0")


def record_key(df: DataFrame, key: str | None = None) -> Column:
    """The key column, or the SHA-256 of the record's JSON with sorted columns."""
    whole = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    return F.coalesce(F.col(key).cast("string"), whole) if key else whole


def dedup_append(batch: DataFrame, index: DataFrame | None, source: str, order: str, key: str | None = None) -> DataFrame:
    """Rows of a batch that are new: the first of each (source, key) inside the batch, and not in ``index`` (source, key).

    Firsts are picked by an aggregate with map-side combination rather than a window, so a
    key that fills a third of the batch moves one row a task.
    """
    keyed = batch.withColumn("_key", record_key(batch, key))
    first = keyed.groupBy(F.col(source).alias("_s"), F.col("_key").alias("_k")).agg(F.min(order).alias("_first"))
    if index is not None:
        known = index.select(F.col("source").alias("_is"), F.col("key").alias("_ik"))
        first = first.join(known, F.col("_s").eqNullSafe(F.col("_is")) & (F.col("_k") == F.col("_ik")), "left_anti")
    same = F.col(source).eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k")) & (F.col(order) == F.col("_first"))
    return keyed.join(first, same).select(*batch.columns, F.col("_key").alias("key"))


def _ends(counts: DataFrame) -> DataFrame:
    """(_l, _p, _take, _same): the prefix at which the first ``_take`` rows of each label end, and how many of its ``_same`` rows are among them; of ``counts`` (_l, _p, _same, _take)."""
    upto = F.sum("_same").over(Window.partitionBy("_l").orderBy("_p"))
    cut = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_same") < F.col("_take")))
    return written(cut.select("_l", "_p", (F.col("_take") - F.col("_upto") + F.col("_same")).alias("_take"), "_same"))


def _few(ends: DataFrame) -> DataFrame:
    return F.broadcast(ends) if ends.limit(LABELS + 1).count() <= LABELS else ends


def first_of_each(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """(_l, _p, _take, _same): where the first rows of each label by ``_s`` end, from where they end by the first digits.

    ``rows``: stored (_l, _s), ``_s`` a string of 48 hex digits.  Rows whose ``_s`` starts with
    less than ``_p`` are among the first, and ``_take`` of the ``_same`` rows that start with
    it.  Each round counts the rows under a label's open prefix by longer prefixes, so no
    label is sorted.
    """
    for digits in DIGITS[1:]:
        if not ends.where("_take < _same").limit(1).count():
            break
        under = rows.join(_few(ends), "_l").where(F.substring("_s", 1, F.length("_p")) == F.col("_p"))
        ends = _ends(under.groupBy("_l", F.substring("_s", 1, digits).alias("_p")).agg(F.count(F.lit(1)).alias("_same"), F.first("_take").alias("_take")))
    return ends


def stratified_sample(df: DataFrame, label: str, key: str, target: int, floor: int = 10, seed: str = "s") -> DataFrame:
    """min(n, max(floor, round(n / N * target))) rows of each label, the first by a hash of seed, label and key.

    Rows that repeat a key follow each other by a hash of all their columns; of rows that
    are equal in all of them any may be taken.  Null labels are ``unknown``.  ``df`` is read
    twice: for counts by the first digits of the hash, and for the rows up to where those end,
    which are written.
    """
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    name = F.coalesce(F.col(label).cast("string"), F.lit("unknown"))
    place = F.concat(F.md5(F.concat_ws("|", F.lit(seed), "_l", F.col(key).cast("string"))), F.lpad(F.hex(F.xxhash64(*plain)), 16, "0"))
    marked = df.withColumn("_l", name).withColumn("_s", place)
    digits = F.substring("_s", 1, DIGITS[0])
    counts = written(marked.groupBy("_l", digits.alias("_p")).agg(F.count(F.lit(1)).alias("_same")))
    total = counts.agg(F.coalesce(F.sum("_same"), F.lit(0))).first()[0]
    counts = counts.withColumn("_n", F.sum("_same").over(Window.partitionBy("_l")))
    want = F.least("_n", F.greatest(F.lit(floor), F.bround(F.col("_n") / F.lit(total) * target).cast("long")))
    ends = _ends(counts.withColumn("_take", want).where("_take > 0"))
    rows = written(marked.join(_few(ends), "_l").where(digits <= F.col("_p")).select(*df.columns, "_l", "_s"))
    at = F.substring("_s", 1, F.length("_p"))
    near = rows.join(_few(first_of_each(rows, ends)), "_l").where(at <= F.col("_p"))
    last = (at == F.col("_p")) & (F.col("_take") < F.col("_same"))
    ranked = near.where(last).withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy("_s"))).where(F.col("_r") <= F.col("_take"))
    return near.where(~last).select(*df.columns).union(ranked.select(*df.columns))


def without_gold(train: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    """Training rows whose key, as a string, is not in the gold set; all of them if either side has no key."""
    if key not in train.columns or key not in gold.columns:
        return train
    return train.join(gold.select(F.col(key).cast("string").alias("_k")).distinct(), F.col(key).cast("string") == F.col("_k"), "left_anti")


def small_rows(df: DataFrame, most: int = 5000) -> DataFrame:
    """Rows whose JSON has at most ``most`` characters."""
    return df.where(F.length(F.to_json(F.struct(*df.columns))) <= most)


def fold(key: Column, parts: int, seed: str = "f") -> Column:
    """A fold number from a hash of the key: the same for every run and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"))), 1, 6), 16, 10).cast("long") % parts
