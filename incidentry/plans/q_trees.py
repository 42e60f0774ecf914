"""Queries of trees that grow together: the cascade over all categories, node support and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dictionaries as D
from ..operators import heuristics as H
from ..operators import labeling as L
from ..operators import trees as T
from ..operators.ingest import fold
from ..sources.steps import written
from .q_features import FEATURES, _KW
from .q_labeling import _LABEL_TEXT, _scored
from .q_ml import FLAGS, _frame
from .views import INCIDENTS, sql_list

TARGETS = list(D.CATEGORIES)


def _cascade(spark, sf):
    """(rows with flags and a 0/1 column a category, their trees); one row in five is held out by its hash."""
    over = lambda c: F.exists("scores", lambda s: (s["category"] == c) & (s["score"] >= 1)).cast("int").alias(c)
    d = L.with_category_scores(_frame(spark, sf), L.labeler_text())
    d = written(d.select("doc_id", *FLAGS, *[over(c) for c in TARGETS]))
    return d, T.fit_cascade(d, list(FLAGS), TARGETS, held=fold(F.col("doc_id"), 100) < 20)


def m6_cascade_checklist(spark, sf):
    """Questions of all category trees and the categories that ask them."""
    asked = H.tree_questions(T.node_table(_cascade(spark, sf)[1], spark)).where("feature is not null").select("feature", "category").distinct()
    return asked.groupBy("feature").agg(F.concat_ws(",", F.array_sort(F.collect_list("category"))).alias("categories"), F.count(F.lit(1)).alias("n"))


def m6_cascade_nodes(spark, sf):
    """Every node of all category trees with its rows, support and share of positive rows."""
    n = T.node_table(_cascade(spark, sf)[1], spark)
    return n.select("tree", "node", "parent", "feature", "n", "positive", F.round("support", 6).alias("support"), F.round("weight", 6).alias("weight"), "held", "leaf")


def m6_cascade_metrics(spark, sf):
    """Metrics of each category's tree on the held-out rows, and their aggregate."""
    rows, total = T.cascade_report(_cascade(spark, sf)[1])
    rows.append(("all", f"{total['n_successful']:.0f} of {total['n_classifiers']:.0f}", total["mean_accuracy"], None, None, total["mean_f1"]))
    d = spark.createDataFrame(rows, "category string, status string, accuracy double, precision double, recall double, f1 double")
    return d.select("category", "status", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def m6_importances(spark, sf):
    trees = _cascade(spark, sf)[1]
    rows = [(t, f, g) for t in sorted(trees.nodes) for f, g in T.gains(trees, t).items()]
    return spark.createDataFrame(rows, "category string, feature string, importance double").withColumn("importance", F.round("importance", 6))


def r10_node_support(spark, sf):
    """All rows, held-out ones too, at every node on their paths through all trees."""
    d, trees = _cascade(spark, sf)
    return T.node_support(d, trees, {t: t for t in TARGETS})


def m13_tuning(spark, sf):
    """All 18 settings of a tree by cross-validation over five folds, best first."""
    d = written(_frame(spark, sf).select("doc_id", "danger", *FLAGS))
    best = T.tune_trees(d, list(FLAGS), "danger", F.col("doc_id"))
    rows = [(i, p["depth"], p["leaf"], p["balanced"], f1, acc) for i, (p, f1, acc) in enumerate(best, 1)]
    return spark.createDataFrame(rows, "place int, depth int, leaf int, balanced boolean, f1 double, accuracy double").select("place", "depth", "leaf", "balanced", F.round("f1", 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"))


# SQL: levels are unrolled.  s1 holds counted rows (tree, node, held, y, x, c), about the settings of each tree.


def _purity(n: str, p: str) -> str:
    one, none = f"(w1 * ({p}))", f"(w0 * (({n}) - ({p})))"
    return f"(({one} * {one} + {none} * {none}) / nullif({one} + {none}, 0))"


def _grown(levels: int) -> str:
    count = lambda on: f"coalesce(sum(c) FILTER ({on}), 0)::DOUBLE"
    parts, nodes = [], [f"SELECT tree, 1 AS node, 0 AS lvl, {count('NOT held')} AS n, {count('NOT held AND y = 1')} AS p, {count('held')} AS h, {count('held AND y = 1')} AS q FROM s1 GROUP BY tree"]
    for i in range(1, levels + 1):
        sides = {"n": "NOT held", "p": "NOT held AND y = 1", "h": "held", "q": "held AND y = 1"}
        sums = ", ".join(f"{count(on)} AS all_{k}, {count(on + ' AND x[f] = 0')} AS {k}" for k, on in sides.items())
        gain = f"{_purity('n', 'p')} + {_purity('all_n - n', 'all_p - p')} - {_purity('all_n', 'all_p')}"
        parts.append(f"""b{i} AS MATERIALIZED (SELECT tree, node, f, {sums} FROM s{i}, (SELECT unnest(range(1, {len(FLAGS) + 1})) AS f) GROUP BY tree, node, f),
t{i} AS MATERIALIZED (SELECT *, {gain} AS gain FROM b{i} JOIN about USING (tree) WHERE n >= least AND all_n - n >= least AND {gain} > 1e-9 QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {gain} DESC, f) = 1),
s{i + 1} AS MATERIALIZED (SELECT s.tree, s.node * 2 + x[t.f] AS node, held, y, x, c FROM s{i} s JOIN t{i} t ON s.tree = t.tree AND s.node = t.node)""")
        nodes += [f"SELECT tree, node * 2, {i}, n, p, h, q FROM t{i}", f"SELECT tree, node * 2 + 1, {i}, all_n - n, all_p - p, all_h - h, all_q - q FROM t{i}"]
    splits = " UNION ALL ".join(f"SELECT tree, node, f, gain FROM t{i}" for i in range(1, levels + 1))
    return ", ".join(parts) + f""", splits AS ({splits}), bare AS ({" UNION ALL ".join(nodes)}),
nodes AS (SELECT a.*, s.f, s.gain, coalesce(w1 * p / nullif(w0 * (n - p) + w1 * p, 0), 0) AS share FROM bare a JOIN about USING (tree) LEFT JOIN splits s ON a.tree = s.tree AND a.node = s.node)"""


_FLAGS_SQL = f"{FEATURES}, fk AS (SELECT doc_id, {_KW}, risky FROM fr)"
_X = "[" + ", ".join(FLAGS) + "]"
_NAMES = sql_list(FLAGS)


def _fold_sql(key: str, parts: int, seed: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}), 1, 6))::BIGINT % {parts}"


_CASCADE_SQL = f"""WITH {INCIDENTS}, {_FLAGS_SQL}, {_scored(_LABEL_TEXT, "incidents")},
s1 AS MATERIALIZED (SELECT category AS tree, 1 AS node, {_fold_sql("sc.doc_id", 100, "f")} < 20 AS held, CASE WHEN score >= 1 THEN 1 ELSE 0 END AS y, {_X} AS x, count(*) AS c FROM sc JOIN fk ON sc.doc_id = fk.doc_id GROUP BY ALL),
about AS (SELECT tree, greatest(5, floor(sum(c) FILTER (NOT held) / 100)) AS least, 1.0::DOUBLE AS w0, 1.0::DOUBLE AS w1 FROM s1 GROUP BY tree), {_grown(3)}"""
_SCORES = """coalesce(sum(CASE WHEN share > 0.5 THEN q ELSE h - q END) / nullif(sum(h), 0), 0) AS accuracy,
coalesce(sum(CASE WHEN share > 0.5 THEN q END) / nullif(sum(CASE WHEN share > 0.5 THEN h END), 0), 0) AS precision,
coalesce(sum(CASE WHEN share > 0.5 THEN q END) / nullif(sum(q), 0), 0) AS recall,
coalesce(2 * sum(CASE WHEN share > 0.5 THEN q END) / nullif(sum(CASE WHEN share > 0.5 THEN h ELSE 0 END) + sum(q), 0), 0) AS f1"""
_TUNE_SQL = f"""WITH {INCIDENTS}, {_FLAGS_SQL},
d AS (SELECT doc_id, CASE WHEN risky > 0 OR kw_biometric > 0 THEN 1 ELSE 0 END AS y, {_X} AS x FROM fk),
cells AS MATERIALIZED (SELECT y, x, {_fold_sql("y || '|' || doc_id", 5, "t")} AS fold, count(*) AS c FROM d GROUP BY ALL),
few AS (SELECT least(sum(c) FILTER (y = 1), sum(c) FILTER (y = 0)) < 10 AS few FROM cells),
grid AS (SELECT o.fold AS out, leaf, even, o.fold || '|' || leaf || '|' || even AS tree FROM (SELECT unnest(range(5)) AS fold) o, (SELECT unnest([1, 5, 10]) AS leaf), (SELECT unnest([false, true]) AS even), few WHERE NOT coalesce(few, true) OR o.fold = 0),
s1 AS MATERIALIZED (SELECT tree, 1 AS node, fold = out AS held, y, x, sum(c) AS c FROM cells, grid GROUP BY ALL),
about AS (SELECT tree, leaf AS least, CASE WHEN even THEN coalesce(n::DOUBLE / nullif(2 * n0, 0), 1) ELSE 1 END::DOUBLE AS w0, CASE WHEN even THEN coalesce(n::DOUBLE / nullif(2 * n1, 0), 1) ELSE 1 END::DOUBLE AS w1
  FROM grid JOIN (SELECT tree, sum(c) FILTER (NOT held) AS n, sum(c) FILTER (NOT held AND y = 0) AS n0, sum(c) FILTER (NOT held AND y = 1) AS n1 FROM s1 GROUP BY tree) USING (tree)), {_grown(len(FLAGS))},
cut AS (SELECT tree, depth, {_SCORES} FROM nodes, (SELECT unnest([3, 5, {T.DEEPEST + 1}]) AS depth) WHERE lvl <= depth AND (f IS NULL OR lvl = depth) GROUP BY tree, depth),
m AS (SELECT depth, leaf, even, avg(f1) AS f1, avg(accuracy) AS accuracy FROM cut JOIN grid USING (tree) GROUP BY ALL)
SELECT (row_number() OVER (ORDER BY round(f1, 9) DESC, round(accuracy, 9) DESC, depth, leaf DESC, even))::INTEGER AS place, CASE WHEN depth <= {T.DEEPEST} THEN depth END::INTEGER AS depth, leaf::INTEGER AS leaf, even AS balanced, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM m"""

QUERIES = {f.__name__: f for f in (m6_cascade_checklist, m6_cascade_nodes, m6_cascade_metrics, m6_importances, r10_node_support, m13_tuning)}
ORACLE_SQL = {
    "m6_cascade_checklist": f"{_CASCADE_SQL} SELECT feature, string_agg(tree, ',' ORDER BY tree) AS categories, count(*) AS n FROM (SELECT DISTINCT {_NAMES}[f] AS feature, tree FROM nodes WHERE f IS NOT NULL) GROUP BY feature",
    "m6_cascade_nodes": f"""{_CASCADE_SQL} SELECT tree, node::BIGINT AS node, nullif(node // 2, 0)::BIGINT AS parent, {_NAMES}[f] AS feature, n::BIGINT AS n, p::BIGINT AS positive, round(n / max(n) OVER (PARTITION BY tree), 6) AS support, round(share, 6) AS weight, h::BIGINT AS held, f IS NULL AS leaf FROM nodes""",
    "m6_cascade_metrics": f"""{_CASCADE_SQL}, each AS (SELECT tree AS category, {_SCORES} FROM nodes WHERE f IS NULL GROUP BY tree),
kind AS (SELECT tree AS category, CASE WHEN p > 0 AND p < n THEN 'fitted' ELSE 'single class' END AS status FROM nodes WHERE node = 1)
SELECT category, status, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM each JOIN kind USING (category)
UNION ALL SELECT 'all', count(*) FILTER (f1 > 0) || ' of ' || count(*), round(avg(accuracy), 6), NULL, NULL, round(avg(f1), 6) FROM each""",
    "m6_importances": f"{_CASCADE_SQL} SELECT tree AS category, {_NAMES}[f] AS feature, round(sum(gain) / any_value(total), 6) AS importance FROM (SELECT *, sum(gain) OVER (PARTITION BY tree) AS total FROM nodes WHERE f IS NOT NULL) GROUP BY tree, f",
    "r10_node_support": f"{_CASCADE_SQL} SELECT tree, node::BIGINT AS node, (n + h)::BIGINT AS n, (p + q)::BIGINT AS positive FROM nodes WHERE n + h > 0",
    "m13_tuning": _TUNE_SQL,
}
