"""Dictionaries as data: keyword categories, keyword groups, the product ontology and category weights.

A dictionary file is JSON and is read by Spark, so any file system will do.  What comes back
is a table of dimension size, and the plain structure that operators take as an argument.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, value) of the members of one JSON object, in the order of the file; ``value`` is JSON text."""
    text = spark.read.text(path, wholetext=True)
    names = text.select(F.posexplode(F.json_object_keys("value")).alias("ord", "name"))
    values = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))
    return names.join(values, "name")


def scan_terms(spark: SparkSession, path: str) -> DataFrame:
    """(dict, ord, pos, term) of a file ``{group: [terms]}``, terms in lower case; S10 and the keyword categories."""
    e = _entries(spark, path).select("ord", "name", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "term"))
    return e.select(F.col("name").alias("dict"), "ord", "pos", F.lower("term").alias("term"))


def as_groups(terms: DataFrame) -> dict[str, tuple[str, ...]]:
    """A table of ``scan_terms`` as the argument of operators.  Dictionaries are small: they come to the driver."""
    rows = terms.groupBy("ord", "dict").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t")).orderBy("ord").collect()
    return {r["dict"]: tuple(x["term"] for x in r["t"]) for r in rows}


def scan_ontology(spark: SparkSession, path: str) -> DataFrame:
    """(slug, ord, kind, pos, term) of a file ``{slug: {synonyms: [...], patterns|regexes|regex: [...]}}``; kind is term or pattern."""
    shape = "synonyms array<string>, patterns array<string>, regexes array<string>, regex array<string>"
    e = _entries(spark, path).select("ord", F.col("name").alias("slug"), F.from_json("value", shape).alias("v"))
    lists = F.array(F.struct(F.lit("term").alias("kind"), F.transform("v.synonyms", F.lower).alias("values")), F.struct(F.lit("pattern").alias("kind"), F.coalesce("v.patterns", "v.regexes", "v.regex").alias("values")))
    x = e.select("ord", "slug", F.explode(lists).alias("x"))
    return x.select("slug", "ord", "x.kind", F.posexplode("x.values").alias("pos", "term"))


def as_ontology(table: DataFrame) -> tuple[tuple[str, tuple[str, ...], str | None], ...]:
    """A table of ``scan_ontology`` as the argument of operators; patterns that are no regular expressions are left out."""

    def valid(p: str) -> bool:
        try:
            re.compile(p)
        except re.error:
            return False
        return True

    rows = table.groupBy("ord", "slug").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "term"))).alias("t")).orderBy("ord").collect()
    out = []
    for r in rows:
        patterns = [x["term"] for x in r["t"] if x["kind"] == "pattern" and valid(x["term"])]
        out.append((r["slug"], tuple(x["term"] for x in r["t"] if x["kind"] == "term"), "|".join(f"(?:{p})" for p in patterns) or None))
    return tuple(out)


def overlay_weights(defaults: DataFrame, calibrated: DataFrame) -> DataFrame:
    """(category, weight): calibrated weights over the defaults; S8."""
    d, c = defaults.select("category", F.col("weight").alias("_d")), calibrated.select("category", F.col("weight").alias("_c"))
    return d.join(c, "category", "full").select("category", F.coalesce("_c", "_d").cast("double").alias("weight"))


def scan_weights(spark: SparkSession, path: str, defaults: DataFrame) -> DataFrame:
    """Weights of a file ``{category: weight}`` over the defaults."""
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("category", "weight"))
    return overlay_weights(defaults, found)


def as_weights(table: DataFrame) -> dict[str, float]:
    """A table of weights, of the size of the categories, as the argument of operators."""
    return {r["category"]: r["weight"] for r in table.collect()}
