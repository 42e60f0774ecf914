"""Incremental forms: dedup ingest, enrichment and running confidence on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluation import confidence
from ..operators.features import build_features
from ..operators.ingest import dedup_append, record_key
from ..operators.labeling import label_records
from ..sources.steps import written


#: Columns of an index of seen keys; batch and bucket are folders.
INDEX = "source string, key string, batch long, bucket int"


def key_bucket(source: Column, key: Column, buckets: int) -> Column:
    """The bucket of the index that holds (source, key); the same for every run and partitioning."""
    return F.pmod(F.xxhash64(source, key), F.lit(buckets)).cast("int")


def seen_keys(spark: SparkSession, index_path: str, before: int, touched: list[int]) -> DataFrame:
    """(source, key) of earlier batches in the buckets ``touched``: other buckets' files are not opened."""
    index = spark.read.schema(INDEX).parquet(index_path)
    return index.where(F.col("bucket").isin(touched) & (F.col("batch") < before)).select("source", "key")


def dedup_ingest(stream: DataFrame, index_path: str, out_path: str, checkpoint: str, source: str, order: str, key: str | None = None, counts_path: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Append rows with unseen (source, key) to ``out_path`` and their keys to ``index_path``.

    The index is laid out by bucket of the key, so a batch reads the buckets that its own keys
    fall into and no others.  Each micro-batch writes under its batch number and looks at
    earlier numbers only, so a batch that is run again after a failure overwrites itself with
    the same rows instead of adding or losing any.  ``counts_path`` gets processed, written and
    skipped rows of each batch.  An index keeps its number of buckets for life.
    """
    spark = stream.sparkSession
    # An empty index, so that the first batch reads it like any other.
    spark.createDataFrame([], INDEX).write.mode("append").partitionBy("batch", "bucket").parquet(index_path)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        keyed = written(batch.withColumn("_bucket", key_bucket(F.col(source).cast("string"), record_key(batch, key), buckets)))
        per = {r["_bucket"]: r["n"] for r in keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a bucket
        rows = keyed.drop("_bucket")
        dedup_append(rows, seen_keys(session, index_path, number, sorted(per)), source, order, key).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        new = session.read.parquet(f"{out_path}/batch={number}").select(F.col(source).cast("string").alias("source"), "key")
        new = new.withColumn("bucket", key_bucket(F.col("source"), F.col("key"), buckets))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{index_path}/batch={number}")
        if counts_path:
            done, kept = sum(per.values()), new.count()
            session.createDataFrame([(done, kept, done - kept)], "processed long, written long, skipped long").write.mode("overwrite").parquet(f"{counts_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enrich(stream: DataFrame) -> DataFrame:
    """Labels and features of arriving records: the columns of the batch operators, one record at a time, without state."""
    labelled = label_records(stream)
    return build_features(labelled)


def dedup_within_watermark(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """Bounded state: repeats are dropped while their first row is within ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def running_confidence(stream: DataFrame, group: str, success: str) -> DataFrame:
    """Confidence of each group from all its trials so far (update or complete mode)."""
    return stream.groupBy(group).agg(F.sum(success).alias("a"), F.sum(1 - F.col(success)).alias("b")).select(group, confidence(F.col("a"), F.col("b")).alias("confidence"))


def windowed_counts(stream: DataFrame, time: str, group: str, width: str, delay: str) -> DataFrame:
    """Counts of each group in event-time windows; rows later than ``delay`` are left out."""
    w = stream.withWatermark(time, delay).groupBy(F.window(time, width), group).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), group, "n")
