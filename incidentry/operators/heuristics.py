"""Models as readable rules: items of one shape, their ranking, questions and prompt blocks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import dictionaries as D
from .additive import Additive
from .ml import Fitted, importances, tree_nodes

ITEM = "model_type string, kind string, text string, support double, precision double, lift double, weight double"


def tree_items(rules: DataFrame) -> DataFrame:
    """Items of the leaves that ``tree_rules`` gives."""
    text = F.concat(F.lit("IF "), F.col("rule"), F.lit(" THEN "), F.col("label"))
    return _items(rules, "decision_tree", "rule", text, support="support", precision="precision")


def linear_items(rules: DataFrame) -> DataFrame:
    """Items of the pseudo-rules that ``linear_rules`` gives."""
    text = F.concat(F.lit("IF "), F.col("feature"), F.lit(" "), F.col("side"), F.lit(" "), F.format_number("median", 4), F.lit(" THEN positive"))
    return _items(rules, "sparse_linear", "rule", text, support="support", precision="precision", lift="lift", weight="weight")


def _items(df: DataFrame, model: str, kind: str, text: Column, **figures: str) -> DataFrame:
    value = lambda c: (F.col(figures[c]) if c in figures else F.lit(None)).cast("double").alias(c)
    return df.select(F.lit(model).alias("model_type"), F.lit(kind).alias("kind"), text.alias("text"), *[value(c) for c in ("support", "precision", "lift", "weight")])


def rule_list_items(spark: SparkSession, rules: list[tuple[str, float, int]]) -> DataFrame:
    """Items of an ordered rule list (antecedent, probability, rows)."""
    total = max(1, sum(n for _, _, n in rules))
    return spark.createDataFrame([("rule_list", "rule", f"{'ELSE' if a == 'else' else 'IF ' + a} THEN P={p:.4f}", n / total, float(p), None, None) for a, p, n in rules], ITEM)


def edge_items(spark: SparkSession, edges: list[tuple[str, str, float]]) -> DataFrame:
    """Items of a Bayes tree's edges."""
    return spark.createDataFrame([("bayes_net", "edge", f"{a} -> {b}", None, None, None, float(w)) for a, b, w in edges], ITEM)


def term_items(spark: SparkSession, fitted: Fitted | Additive, top: int = 15) -> DataFrame:
    """Items of an additive model's terms, pairs too, by importance, without those that count nothing."""
    found = fitted.importances() if isinstance(fitted, Additive) else importances(fitted)
    terms = [(w, c) for c, w in found if w > 0][:top]
    return spark.createDataFrame([("additive", "term", f"Term: {c} (importance={w:.4f})", None, None, None, w) for w, c in terms], ITEM)


def taxonomy_items(spark: SparkSession) -> DataFrame:
    """One item for each sensitive term and each distress term; definitions, so their precision is 1."""
    rows = [("harm_taxonomy", "pattern", f"IF text contains '{t}' THEN sensitivity={level.upper()}", None, 1.0, None, None) for level, terms in D.SENSITIVITY for t in terms]
    distress = re.sub(r"\\b|[()]", "", D.DISTRESS).split("|")
    return spark.createDataFrame(rows + [("harm_taxonomy", "pattern", f"IF text contains '{t}' THEN harm=DISTRESS", None, 1.0, None, None) for t in distress], ITEM)


def extract(items: list[DataFrame], top: int = 20, version: str = "v1") -> DataFrame:
    """The ``top`` items of all models by support times precision, else by the weight's size, equal ones by text.

    Adds ``score``, ``place``, ``version`` and ``provenance``: 16 hex digits of the SHA-256 of
    the sorted texts.
    """
    score = F.coalesce(F.col("support") * F.col("precision"), F.abs("weight"), F.lit(0.0))
    best = reduce(lambda a, b: a.unionByName(b), items).withColumn("score", score).orderBy(F.desc("score"), "text").limit(top)
    # At most ``top`` rows from here on.
    whole = Window.partitionBy(F.lit(1))
    texts = F.array_join(F.array_sort(F.collect_list("text").over(whole)), "\n")
    return best.select("*", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "text")).alias("place"), F.lit(version).alias("version"), F.substring(F.sha2(texts, 256), 1, 16).alias("provenance"))


def question(feature: Column) -> Column:
    """The yes/no question of a feature: a fixed one, else made from its name."""
    known = F.create_map(*[F.lit(x) for kv in D.QUESTIONS.items() for x in kv])
    clean = F.replace(F.replace(F.replace(feature, F.lit("kw_"), F.lit("")), F.lit("f_"), F.lit("")), F.lit("_"), F.lit(" "))
    return F.coalesce(F.try_element_at(known, feature), F.concat(F.lit("Does this involve "), clean, F.lit("?")))


def cascade_questions(trees: dict[str, Fitted | str], train: DataFrame) -> DataFrame:
    """(category, node, parent, feature, question, path, weight) of all trees.

    Inner nodes ask, leaves have as weight the share of positive rows that reach them: one
    aggregate over the training rows for all trees.
    """
    spark, rows, shares = train.sparkSession, [], []
    for category, fitted in sorted(trees.items()):
        if isinstance(fitted, str):
            continue
        nodes = tree_nodes(fitted)
        split = {n["parent"]: n["predicate"].split(" ")[0] for n in nodes if n["parent"] is not None}
        for n in nodes:
            path, at = [], n
            while at["parent"] is not None:
                path.append(at["predicate"])
                at = nodes[at["parent"]]
            rule = " AND ".join(reversed(path)) or "true"
            rows.append((category, n["id"], n["parent"], split.get(n["id"]), rule))
            if n["leaf"]:
                shares.append(F.avg(F.when(F.expr(rule), F.col(category).cast("double"))).alias(f"{category}|{n['id']}"))
    table = spark.createDataFrame(rows, "category string, node int, parent int, feature string, path string")
    if not shares:
        return table.select("category", "node", "parent", "feature", question(F.col("feature")).alias("question"), "path", F.lit(None).cast("double").alias("weight"))
    wide = train.agg(*shares).first().asDict()
    weights = spark.createDataFrame([(*k.split("|"), v) for k, v in wide.items()], "category string, node string, weight double").withColumn("node", F.col("node").cast("int"))
    return table.join(weights, ["category", "node"], "left").select("category", "node", "parent", "feature", F.when(F.col("feature").isNotNull(), question(F.col("feature"))).alias("question"), "path", "weight")


def tree_questions(nodes: DataFrame) -> DataFrame:
    """``cascade_questions`` of trees that grew together: from ``trees.node_table``, which knows the weights already."""
    asks = F.when(F.col("feature").isNotNull(), question(F.col("feature")))
    return nodes.select(F.col("tree").alias("category"), "node", "parent", "feature", asks.alias("question"), "path", F.when(F.col("leaf"), F.col("weight")).alias("weight"))


def checklist(questions: DataFrame) -> DataFrame:
    """(question, harms, n): each question with the sorted categories that ask it, most first."""
    asked = questions.where(F.col("question").isNotNull()).select("question", "category").distinct()
    return asked.groupBy("question").agg(F.array_sort(F.collect_list("category")).alias("harms"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "question")


def rank_models(scores: DataFrame, name: str, macro_f1: str, accuracy: str) -> DataFrame:
    """(name, score, place): macro F1, else accuracy, else 0; best first, equal ones by name.  A row is a model."""
    s = scores.select(F.col(name).alias("name"), F.coalesce(macro_f1, accuracy, F.lit(0.0)).alias("score"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "name")))


def rule_line(text: Column, source: Column, jurisdictions: Column) -> Column:
    """A rule with what is known about it."""
    about = F.concat_ws("; ", F.concat(F.lit("source: "), source), F.when(F.size(jurisdictions) > 0, F.concat(F.lit("jurisdictions: "), F.array_join(jurisdictions, ", "))))
    return F.concat(text, F.when(about != "", F.concat(F.lit(" ["), about, F.lit("]"))).otherwise(F.lit("")))


def rule_blocks(selected: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, block): numbered lines of the rules selected for each record, best first.

    A block is as long as ``select_rules`` allows; lines join on the small table of rules.
    """
    lines = rules.select("rule_id", rule_line(F.col("text"), F.col("source"), F.col("jurisdictions")).alias("line"))
    ranked = selected.join(lines, "rule_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("x"))
    return ranked.select("doc_id", F.array_join(F.transform("x", lambda r: F.concat(r["rank"].cast("string"), F.lit(". "), r["line"])), "\n").alias("block"))
