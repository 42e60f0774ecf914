"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in hashed order; a second pass over the queue
follows where its target needs repeats.  A queue entry's virtual finish time is the
cumulative words of its source up to and including it, divided by the source's target.
All entries are ordered by finish time over ranges of it, and the mix is cut where its
words reach the total budget.

Both running sums are two-level: words per (source, hash range) and per finish-time range
are pre-aggregated, the small tables of ranges are summed with a window, and rows are
summed inside their range only, so no source and no range of times meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, stored, table

#: Fixed values of the contract.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Rows that one range of a running sum should hold.
RANGE_ROWS = 5_000


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that are not white space; null: 0."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): ``share`` of all words dealt by weight.

    Sources by code point, null last, take the weights in turn.  A target stops at ``most``
    times its source's words; the excess goes to the others by weight.  In the order of
    cap / weight a source is full exactly if the level that the remaining words give the
    remaining weights lies above its own cap / weight, so one ordered pass settles all.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    n = len(weights)
    by_turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % n + 1).cast("int"))
    s = sizes.withColumn("_w", by_turn).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    seq = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, everything = seq.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_left", F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_weight", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_level", F.col("_left") / F.col("_weight"))
    # The first source that is not full sets the level for itself and all after it.
    s = s.withColumn("_open", F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct(F.row_number().over(seq).alias("k"), F.col("_level").alias("v"))))
    s = s.withColumn("_rank", F.row_number().over(seq)).withColumn("_first", F.min("_open").over(everything))
    full = F.col("_first").isNull() | (F.col("_rank") < F.col("_first.k"))
    return s.select("source", "source_size", F.when(full, F.col("_cap")).otherwise(F.col("_first.v") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 17) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``copies`` (times the mix takes the document, 0 to ``most``) to every row.

    Null text has size 0 and is never taken; a source without words has target 0.  Null
    sources are one source.  Rows that repeat id, source and text are told apart by nothing: they
    stand next to each other in their queue and are taken or left together.  The order is a
    hash of id, source, text and ``seed``, so reruns agree.  An empty table gives an empty mix.
    Other columns pass through; added columns replace columns of their names.
    """
    added = ("size", "source_size", "target", "copies")
    keep = [c for c in docs.columns if c not in added]
    rows = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("_row"),
        F.col(source_col).alias("source"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))).alias("_h"),
        word_count(F.col(text_col)).alias("size"),
    )
    queue = stored(rows.groupBy("source", "_h").agg(F.sum("size").alias("_size")), "queue")
    sizes = stored(source_targets(queue.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, most), "targets")
    times = stored(finish_times(queue, sizes, most), "times")
    taken = stored(cut(times, sizes.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("_budget"))), "taken")
    same_source = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    out = rows.alias("r").join(taken.alias("t"), F.col("r._h") == F.col("t._h"), "left")
    # Sources are many only if rows are: Spark's own size check decides about a broadcast here.
    return out.select("r._row", "r.source", "r.size", "t._copies").alias("r").join(sizes.alias("s"), same_source("r", "s"), "left").select(
        "r._row.*", "r.size", "s.source_size", "s.target", F.coalesce("r._copies", F.lit(0)).cast("long").alias("copies")
    )


def finish_times(queue: DataFrame, sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, _h, _size, _pass, _v): the virtual finish time of each queue entry in each pass."""
    n = queue.count()
    digits = 1
    while n / 16**digits > RANGE_ROWS and digits < 12:
        digits += 1
    ranged = queue.where(F.col("_size") > 0).withColumn("_b", F.substring("_h", 1, digits))
    offsets = ranged.groupBy("source", "_b").agg(F.sum("_size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).select(F.col("source").alias("_s"), F.col("_b").alias("_ob"), "_before")
    inside = Window.partitionBy("source", "_b").orderBy("_h")
    sums = ranged.withColumn("_sum", F.sum("_size").over(inside)).join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_ob")))
    sums = sums.join(sizes.select(F.col("source").alias("_ts"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_ts"))).where(F.col("target") > 0)
    passes = sums.select("source", "_h", "_size", "source_size", "target", (F.col("_before") + F.col("_sum")).alias("_done"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_pass"))
    v = (F.col("_done") + F.col("_pass") * F.col("source_size")).cast("double") / F.col("target")
    return passes.select("source", "_h", "_size", "_pass", v.alias("_v"))


def cut(times: DataFrame, budget: DataFrame) -> DataFrame:
    """(_h, _copies): entries in the order of finish time, while the words before an entry stay under the budget."""
    n = max(1, times.count() // RANGE_ROWS)
    ranged = times.withColumn("_r", F.floor(F.col("_v") * n))
    ranges = ranged.groupBy("_r").agg(F.sum("_size").alias("_words"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).crossJoin(F.broadcast(budget))
    # Ranges that end under the budget are taken whole, those that start beyond it not at all: only the one between is summed.
    ranges = ranges.where(F.col("_before") < F.col("_budget")).select("_r", "_before", "_budget", (F.col("_before") + F.col("_words") <= F.col("_budget")).alias("_whole"))
    joined = ranged.join(ranges, "_r")
    inside = Window.partitionBy("_r").orderBy("_v", "_h", "_pass").rowsBetween(Window.unboundedPreceding, -1)
    partly = joined.where(~F.col("_whole")).withColumn("_sum", F.coalesce(F.sum("_size").over(inside), F.lit(0))).where(F.col("_before") + F.col("_sum") < F.col("_budget"))
    return joined.where("_whole").select("_h").union(partly.select("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_copies"))


def op2_mixing(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         (2 * source_size)::DOUBLE AS cap FROM s0
), s2 AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight
  FROM s1
), s3 AS (
  SELECT min(k) AS k FROM s2 WHERE remaining / weight * w < cap
), t AS (
  SELECT s2.source, s2.source_size, CASE WHEN s3.k IS NULL OR s2.k < s3.k THEN s2.cap ELSE (SELECT remaining / weight FROM s2 x WHERE x.k = s3.k) * s2.w END AS target
  FROM s2, s3
), q AS (
  SELECT d.source, d.h, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS done
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE d.size > 0 AND t.target > 0
), e AS (
  SELECT h, size, p, (done + p * source_size)::DOUBLE / target AS v FROM q, (VALUES (0), (1)) AS passes(p)
), c AS (
  SELECT h, coalesce(sum(size) OVER (ORDER BY v, h, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e
), k AS (
  SELECT h, count(*) AS copies FROM c WHERE before < (SELECT sum(target) FROM t) GROUP BY h
)
SELECT d.doc_id, d.size, t.source_size, t.target, (d.size * coalesce(k.copies, 0))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON d.h = k.h
"""
