"""Keyword labelling, weak supervision, framework evaluators and fallback classifiers.

Every operator is a set of Column expressions over the record: no shuffle, and each text is
read once for all terms (``functions.matcher``).  Word overlaps of a category collapse to
one intersection for each multiplicity, so the plan stays small with many keywords.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions.matcher import TermIndex, let
from ..functions.text import assemble, string_array


def category_score(index: TermIndex, found: Column, keywords) -> Column:
    """2 for each keyword that is a substring, 0.5 for each word of the text shared with each keyword."""
    shared = [w for k in keywords for w in set(re.findall(r"\w+", k))]
    return index.count(found, keywords) * 2.0 + index.count(found, shared, whole=True) * 0.5


def with_category_scores(records: DataFrame, text: Column, categories=D.CATEGORIES) -> DataFrame:
    """Add ``text_lc`` and ``scores``: an array of (score, ord, category), ord negative in dictionary order.  Null text scores 0."""
    keywords = [k for ks in categories.values() for k in ks]
    index = TermIndex(keywords, words=[w for k in keywords for w in re.findall(r"\w+", k)])
    base = records.withColumn("text_lc", F.lower(F.coalesce(text, F.lit("")))).withColumn("_found", index.found(F.col("text_lc")))
    each = [F.struct(category_score(index, F.col("_found"), ks).alias("score"), F.lit(-i).alias("ord"), F.lit(c).alias("category")) for i, (c, ks) in enumerate(categories.items())]
    return base.withColumn("scores", F.array(*each)).drop("_found")


def best_category(threshold: float = D.THRESHOLD) -> Column:
    """The best category of ``scores``; ties to the first listed, under the threshold ``unknown``."""
    top = F.array_max("scores")
    return F.when(top["score"] < threshold, F.lit("unknown")).otherwise(top["category"])


def labeler_text() -> Column:
    return assemble(F.col("description"), F.col("raw_title"), F.col("raw_body"))


def label_records(records: DataFrame, threshold: float = D.THRESHOLD) -> DataFrame:
    """Add ``harm_category`` and ``harm_score_kw``."""
    scored = with_category_scores(records, labeler_text())
    return scored.select(*records.columns, best_category(threshold).alias("harm_category"), F.array_max("scores")["score"].alias("harm_score_kw"))


def label_missing(records: DataFrame, overwrite: bool = False, threshold: float = D.THRESHOLD) -> DataFrame:
    """Label records that have no ``harm_category`` yet, or all with ``overwrite``: running it again changes nothing."""
    old = F.col("harm_category") if "harm_category" in records.columns else F.lit(None).cast("string")
    bare = records.withColumn("_old", old).drop("harm_category", "harm_score_kw")
    new = label_records(bare, threshold).drop("harm_score_kw")
    return new.withColumn("harm_category", F.when(F.lit(overwrite) | F.col("_old").isNull(), F.col("harm_category")).otherwise(F.col("_old"))).drop("_old")


def parent_of(label: Column, parents=D.PARENT_OF) -> Column:
    """The parent category; labels that have none stay."""
    m = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv])
    return F.coalesce(F.try_element_at(m, label), label)


def offline_arm(records: DataFrame) -> DataFrame:
    """Add ``ranking`` (parents by best score, then name) and ``predicted_score`` 1 to 5 of the deterministic keyword arm."""
    scored = with_category_scores(records, F.col("description"))
    found = F.transform(F.filter("scores", lambda s: s["score"] >= D.THRESHOLD), lambda s: F.struct((-s["score"]).alias("neg"), parent_of(s["category"]).alias("parent")))
    # Sorted by (-score, parent); the first of each parent is its best.
    ranked = F.array_distinct(F.transform(F.array_sort(found), lambda s: s["parent"]))
    top = F.array_max("scores")["score"]
    ladder = F.when(top >= 6, 5).when(top >= 4, 4).when(top >= 2, 3).when(top >= 1, 2).otherwise(1)
    return scored.select(*records.columns, ranked.alias("ranking_pred"), ladder.cast("long").alias("predicted_score"))


def weak_labels(records: DataFrame) -> DataFrame:
    """Add distress terms, sensitivity level with its first five terms, mismatch flag and parents in their fixed order."""
    text = assemble(F.col("description"), F.col("harm_summary"), F.col("raw_body"), F.col("raw_title"))
    index = TermIndex([t for _, ts in D.SENSITIVITY for t in ts], [D.DISTRESS, D.MISMATCH, *[p for _, p in D.PARENT_PATTERNS]])
    base = records.withColumn("_t", F.lower(text)).withColumn("_found", index.found(F.col("_t")))
    found, t, none = F.col("_found"), F.col("_t"), F.array().cast("array<string>")
    distress = F.when(index.holds(found, *index.required[D.DISTRESS]), F.array_sort(F.array_distinct(F.regexp_extract_all("_t", F.lit(D.DISTRESS), 1)))).otherwise(none)
    terms = F.coalesce(*[F.when(index.holds(found, *ts), F.slice(index.listed(found, ts), 1, 5)) for _, ts in D.SENSITIVITY], none)
    parents = F.array_compact(F.array(*[F.when(index.matches(found, t, p), F.lit(n)) for n, p in D.PARENT_PATTERNS]))
    return base.select(
        *records.columns,
        distress.alias("distress"),
        index.first(found, D.SENSITIVITY).alias("sensitivity"),
        terms.alias("sensitive_terms"),
        index.matches(found, t, D.MISMATCH).alias("contextual_mismatch"),
        parents.alias("parents"),
    )


def framework_predictions(records: DataFrame) -> DataFrame:
    """Long frame (doc_id, framework, harm, severity, confidence) of the three rule frameworks."""
    breach, much = ("breach", "exposure", "unauthorized", "leak"), ("excessive", "unnecessary")
    index = TermIndex([*breach, *much, *[w for _, ws in D.SOLOVE_WORDS for w in ws], *[w for ws in D.PRINCIPLES for w in ws]])
    base = records.select("doc_id", index.found(F.lower(F.coalesce("description", F.lit("")))).alias("_found"))
    found = F.col("_found")
    severe, excess = index.holds(found, *breach), index.holds(found, *much)
    a = F.struct(
        F.lit("A").alias("framework"),
        F.when(excess, F.lit("aggregation")).when(severe, F.lit("insecurity")).otherwise(F.lit("regulatory_violation")).alias("harm"),
        F.when(severe, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
        F.when(excess, F.lit(0.7)).when(severe, F.lit(0.8)).otherwise(F.lit(0.6)).alias("confidence"),
    )
    top = F.array_max(F.array(*[F.struct(index.count(found, ws).alias("n"), F.lit(-i).alias("o"), F.lit(h).alias("h")) for i, (h, ws) in enumerate(D.SOLOVE_WORDS)]))
    b = F.struct(
        F.lit("B").alias("framework"),
        F.when(top["n"] > 0, top["h"]).otherwise(F.lit("regulatory_violation")).alias("harm"),
        F.when(top["n"] >= 3, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
        F.when(top["n"] >= 3, F.lit(0.9)).when(top["n"] >= 2, F.lit(0.7)).otherwise(F.lit(0.5)).alias("confidence"),
    )
    n = sum((index.holds(found, *p).cast("int") for p in D.PRINCIPLES), F.lit(0))
    c = F.struct(
        F.lit("C").alias("framework"),
        F.when(n > 0, F.lit("regulatory_violation")).otherwise(F.lit("data_handling")).alias("harm"),
        F.when(n >= 3, F.lit("critical")).when(n >= 2, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
        F.when(n >= 3, F.lit(0.85)).when(n >= 2, F.lit(0.75)).otherwise(F.lit(0.6)).alias("confidence"),
    )
    return base.select("doc_id", F.explode(F.array(a, b, c)).alias("x")).select("doc_id", "x.*")


def relevance(text: Column) -> Column:
    """Struct (is_relevant, confidence, harms) of the offline classifier; harms are a sorted set."""
    rungs = [(s.replace("_", " "), s) for s in D.SUBTYPE_PARENT] + list(D.FALLBACK)
    index = TermIndex([*D.RELEVANCE, *[w for w, _ in rungs]])

    def judged(found: Column) -> Column:
        yes = index.holds(found, *D.RELEVANCE)
        harms = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(index.holds(found, w), F.lit(label)) for w, label in rungs]))))
        return F.struct(yes.alias("is_relevant"), F.when(yes, F.lit(0.5)).otherwise(F.lit(0.3)).alias("confidence"), harms.alias("harms"))

    return let(index.found(F.lower(F.coalesce(text, F.lit("")))), judged)


def parse_label(answer: Column, labels) -> Column:
    """A label from a free-text answer: its first line reduced to [a-z0-9_ -]; equal, else the first label that it begins or holds."""
    line = F.trim(F.regexp_replace(F.lower(F.split_part(F.coalesce(answer, F.lit("")), F.lit("\n"), F.lit(1))), "[^a-z0-9_ -]", ""))
    known = string_array(labels)
    return F.when(F.array_contains(known, line), line).otherwise(F.try_element_at(F.filter(known, lambda x: F.contains(line, x)), F.lit(1)))
