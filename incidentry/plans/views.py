"""The incident and gold views: the driver's documents turned into incident records, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dictionaries import PARENT_OF, PHRASES, SOURCES

HARMS = ("surveillance", "insecurity", "disclosure", "intrusion", "aggregation", "exposure", "regulatory_violation")
INDIVIDUALS = ("0", None, "1000", "12,000", "3", "-5")
USERS = ("250", None, "0", "17")
SENTIMENT_LABELS = ("positive", None, "negative", "mixed", "neutral")
SEVERITY = ("low", "severe", None, "critical")
DATES = ("09/01/2025", "2025-9-1", "2025-09-01T10:11:12Z", "#1695000000", "9999-99-99", "soon", None)


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index % len(values) + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident record for every document."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(
        i.alias("doc_id"),
        i.cast("string").alias("id"),
        F.when(i % 97 == 0, F.lit("unknown feed")).otherwise(_pick(SOURCES, i)).alias("source"),
        F.lit("incident").alias("type"),
        F.when(i % 53 != 0, F.concat(_pick(PHRASES, i), F.lit(". "), F.col("text"))).alias("description"),
        F.when(i % 11 != 0, _pick(PHRASES, i * 7 + 3)).alias("harm_summary"),
        _pick(INDIVIDUALS, i).alias("individuals_affected"),
        _pick(USERS, i).alias("num_users"),
        F.when(i % 89 == 0, F.lit(-1.0)).otherwise((i % 7 * 1000).cast("double")).alias("penalty_amount"),
        F.when(i % 101 == 0, F.lit(1.5)).otherwise(((i * 37) % 201 - 100) / F.lit(100.0)).alias("sentiment_score"),
        _pick(DATES, i).alias("incident_date"),
        F.when(i % 3 == 0, F.lit("EU")).when(i % 3 == 1, F.lit("UK")).alias("jurisdiction"),
        F.when(i % 3 == 1, F.lit("finance")).when(i % 3 == 2, F.lit("health")).alias("sector"),
        F.when(i % 3 != 2, F.lit("en")).alias("language"),
        F.when(i % 5 != 0, _pick(PHRASES, i * 5 + 1)).alias("raw_title"),
        F.when(i % 5 != 1, _pick(PHRASES, i * 11 + 2)).alias("raw_body"),
        F.when(i % 31 != 0, F.lit("{}")).alias("raw"),
        _pick(SENTIMENT_LABELS, i).alias("sentiment_label"),
        _pick(SEVERITY, i).alias("harm_severity"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled incidents: harms, ranking, score and review flags."""
    i = F.col("doc_id")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality", "toxic")
    harms = F.when(i % 4 == 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(_pick(HARMS, i), _pick(HARMS, i * 3 + 1))))
    g = incidents(spark, sf_dir).join(labels, i == F.col("_id")).drop("_id")
    return g.select("*", harms.alias("harms"), (i % 5 + 1).alias("harm_score"), (F.col("quality") == 1).alias("reviewed"), (F.col("toxic") == 1).alias("needs_review"), (i % 6 == 0).alias("manually_edited"))


def _sql(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(_sql(v) for v in values) + "]"


def _sql_pick(values, index: str) -> str:
    return f"{sql_list(values)}[({index}) % {len(values)} + 1]"


def sql_values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(_sql(v) if isinstance(v, str) or v is None else str(v) for v in r) + ")" for r in rows)


INCIDENTS = f"""incidents AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN doc_id % 97 = 0 THEN 'unknown feed' ELSE {_sql_pick(SOURCES, "doc_id")} END AS source, 'incident' AS type,
    CASE WHEN doc_id % 53 <> 0 THEN {_sql_pick(PHRASES, "doc_id")} || '. ' || text END AS description,
    CASE WHEN doc_id % 11 <> 0 THEN {_sql_pick(PHRASES, "doc_id * 7 + 3")} END AS harm_summary,
    {_sql_pick(INDIVIDUALS, "doc_id")} AS individuals_affected, {_sql_pick(USERS, "doc_id")} AS num_users,
    CASE WHEN doc_id % 89 = 0 THEN -1.0::DOUBLE ELSE (doc_id % 7 * 1000)::DOUBLE END AS penalty_amount,
    CASE WHEN doc_id % 101 = 0 THEN 1.5::DOUBLE ELSE ((doc_id * 37) % 201 - 100)::DOUBLE / 100.0::DOUBLE END AS sentiment_score,
    {_sql_pick(DATES, "doc_id")} AS incident_date,
    CASE doc_id % 3 WHEN 0 THEN 'EU' WHEN 1 THEN 'UK' END AS jurisdiction,
    CASE doc_id % 3 WHEN 1 THEN 'finance' WHEN 2 THEN 'health' END AS sector,
    CASE WHEN doc_id % 3 <> 2 THEN 'en' END AS language,
    CASE WHEN doc_id % 5 <> 0 THEN {_sql_pick(PHRASES, "doc_id * 5 + 1")} END AS raw_title,
    CASE WHEN doc_id % 5 <> 1 THEN {_sql_pick(PHRASES, "doc_id * 11 + 2")} END AS raw_body,
    CASE WHEN doc_id % 31 <> 0 THEN '{{}}' END AS raw, {_sql_pick(SENTIMENT_LABELS, "doc_id")} AS sentiment_label, {_sql_pick(SEVERITY, "doc_id")} AS harm_severity
  FROM documents
)"""
GOLD = f"""{INCIDENTS}, gold AS (
  SELECT i.*, quality, toxic,
    CASE WHEN i.doc_id % 4 = 3 THEN []::VARCHAR[] WHEN {_sql_pick(HARMS, "i.doc_id")} = {_sql_pick(HARMS, "i.doc_id * 3 + 1")} THEN [{_sql_pick(HARMS, "i.doc_id")}]
      ELSE [{_sql_pick(HARMS, "i.doc_id")}, {_sql_pick(HARMS, "i.doc_id * 3 + 1")}] END AS harms,
    i.doc_id % 5 + 1 AS harm_score, quality = 1 AS reviewed, toxic = 1 AS needs_review, i.doc_id % 6 = 0 AS manually_edited
  FROM incidents i JOIN labels l ON i.doc_id = l.doc_id
)"""
PARENTS = f"parents(subtype, parent) AS ({sql_values(PARENT_OF.items())})"
