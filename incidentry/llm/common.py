"""Small helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the contracts: white space, and the separators of alphanumeric words.
SPACE = "[\\x20\\x09-\\x0D]"
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
#: A stored table is broadcast up to this many rows and bytes of text.
SMALL_ROWS, SMALL_BYTES = 200_000, 32 << 20
#: A key is hot if it has more than one in so many of all rows; so there are never more hot keys than this.
HOT_SHARE = 10_000
#: Spark's switch that drops the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does the same wherever no other capital stands."""
    other_capital = "[^\\x00-\\x7F&&[\\p{Lu}\\p{Lt}\\p{Nl}\\p{So}]]"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).when(~c.rlike(other_capital), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster has none that all
    can see, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back: lineage ends here, and lost executors cost no recomputation.

    The table replaces the shuffle files of its query, so Spark drops those when it is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        # Select, so that the query is planned under the switch.
        df.select("*").write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether a stored table may be broadcast: its rows and the bytes of all its values are counted."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(8)) for c in df.columns])
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return row["n"] <= SMALL_ROWS and row["b"] <= SMALL_BYTES


def if_small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is small."""
    return F.broadcast(df) if is_small(df) else df


def join_hot(rows: DataFrame, counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``counted`` (keys, ``_n``: rows of the key, other columns), without a task for a hot key.

    Keys with more than one in ``HOT_SHARE`` of ``total`` rows, so at most ``HOT_SHARE`` keys,
    are broadcast; their rows are spread over all tasks of the one shuffle that joins the rest.
    Keys are longs without nulls.
    """
    value = [c for c in counted.columns if c not in (*keys, "_n")]
    hot = counted.where(F.col("_n") * HOT_SHARE > total).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.struct(*value).alias("_hot"))
    # One row more whose value is null, so that it counts as no hot key: the plan is the same with hot keys and without.
    hot = hot.union(rows.sparkSession.range(1).select(*[F.lit(None if c == "_hot" else 0).cast(t).alias(c) for c, t in hot.dtypes]))
    cold = counted.where(F.col("_n") * HOT_SHARE <= total).select(*[F.col(k).alias(f"_cold_{k}") for k in keys], F.struct(*value).alias("_cold"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_hot_{k}") for k in keys])
    marked = rows.join(F.broadcast(hot), same, "left")
    spread = F.xxhash64(*rows.columns)
    at = [F.when(F.col("_hot").isNull(), F.col(k)).otherwise(spread).alias(f"_at_{k}") for k in keys]
    marked = marked.select(*rows.columns, "_hot", F.col("_hot").isNotNull().alias("_is_hot"), *at)
    same = reduce(lambda a, b: a & b, [F.col(f"_at_{k}") == F.col(f"_cold_{k}") for k in keys])
    joined = marked.join(cold, same, "left").select(*rows.columns, F.when(F.col("_is_hot"), F.col("_hot")).otherwise(F.col("_cold")).alias("_value"))
    return joined.where(F.col("_value").isNotNull()).select(*rows.columns, "_value.*")


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and text bytes of a table, in one scan."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def blocks_for(n_bytes: int, block_bytes: int) -> int:
    return max(1, math.ceil(n_bytes / block_bytes))
