"""Tolerant JSON-lines sources and sinks, rule sets and JDBC frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None, limit: int | None = None) -> DataFrame:
    """Lines that hold a JSON object, parsed; blank and malformed lines are skipped.

    Without a schema the lines come as one VARIANT column ``record``.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.try_parse_json("value").alias("record"), "value").where(F.col("record").isNotNull() & F.trim("value").startswith("{"))
    out = parsed.select("record") if schema is None else parsed.select(F.from_json("value", schema).alias("r")).select("r.*")
    return out.limit(limit) if limit is not None else out


def merge_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows of sources with different columns; missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write JSON lines and return the rows written, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return int(seen.get["n"])


def write_parquet(df: DataFrame, path: str) -> None:
    """Write Parquet; VARIANT columns, which have no fixed type, become JSON text."""
    cols = [F.to_json(c).alias(c) if t == "variant" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").parquet(path)


def scan_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule sets ``{name, version, rules: [string or object]}`` as one row a rule; plain strings become the text."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    head = raw.select(F.try_variant_get("v", "$.name", "string").alias("set"), F.try_variant_get("v", "$.version", "string").alias("version"), F.explode(F.try_variant_get("v", "$.rules", "array<variant>")).alias("r"))
    text = F.coalesce(F.try_variant_get("r", "$.text", "string"), F.try_variant_get("r", "$.rule", "string"), F.try_variant_get("r", "$", "string"))
    listed = lambda *names: F.coalesce(*[F.try_variant_get("r", f"$.{n}", "array<string>") for n in names], F.array().cast("array<string>"))
    return head.select("set", "version", text.alias("text"), listed("jurisdictions", "countries").alias("jurisdictions"), listed("sectors").alias("sectors"), listed("languages").alias("languages"), listed("tags").alias("tags"), F.coalesce(F.try_variant_get("r", "$.priority", "double"), F.lit(1.0)).alias("priority"))


def scan_rule_set(spark: SparkSession, folder: str, name: str, version: str) -> DataFrame:
    """The rules of ``<name>.v<version>.json`` in a folder; no rules where there is no such file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.v{version}.json")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    none = "set string, version string, text string, jurisdictions array<string>, sectors array<string>, languages array<string>, tags array<string>, priority double"
    return scan_rules(spark, path.toString()) if there else spark.createDataFrame([], none)


def scan_features(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as a wide frame over the union of all keys; malformed lines are skipped."""
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def scan_gold(spark: SparkSession, path: str, schema: StructType | str, limit: int | None = None) -> DataFrame:
    """Gold cases with the length of their description, 0 without one."""
    return scan_jsonl(spark, path, schema, limit).withColumn("description_length", F.length(F.coalesce("description", F.lit(""))))


def row_count(spark: SparkSession, path: str) -> int:
    """Lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def scan_jdbc(spark: SparkSession, url: str, query: str, options: dict[str, str] | None = None) -> DataFrame:
    """A query over JDBC; give partitionColumn and bounds in ``options`` to read in parallel."""
    return spark.read.format("jdbc").options(url=url, query=query, **(options or {})).load()
