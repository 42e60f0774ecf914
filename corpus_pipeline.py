"""Clean a corpus: reject toxic documents, drop repeated lines, keep one of each group of near copies, drop benchmark passages' documents, mix the sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
result as Parquet to the shared folder and reads it back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.llm import decontamination, line_dedup, mixing, near_dedup, toxicity
from incidentry.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity model, learnt from the labelled ones, predicts toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).where(F.col("predicted") == 0).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that other documents hold too, but in the smallest doc_id; texts and sizes change, rows stay."""
    out = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more)."""
    out = near_dedup.near_duplicates(docs.select(*COLUMNS), shingle=5, percent=80)
    return out.where("kept").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    out = decontamination.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return out.where(~F.col("contaminated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the number of times each is taken; those that the mix leaves out go."""
    out = mixing.mix(docs.select(*COLUMNS)).where(F.col("copies") > 0)
    return out.select(*COLUMNS, "size", "copies", F.col("target").alias("source_target"))


STAGES = [("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", decontaminate), ("mixing", mix_sources)]

#: The toxicity model has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
