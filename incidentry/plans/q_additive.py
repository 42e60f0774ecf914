"""Queries of the additive model with pair terms: line items whose quantity times price is low, middle or high."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from ..operators import additive as A
from ..operators import heuristics as H
from ..operators import linear as N
from .q_ml import FLAGS, _features
from .views import sql_list, table

COLUMNS = ["quantity", "tax", "price"]
EDGES = [[float(e) for e in range(5, 50, 5)], [0.015, 0.045], [float(e) for e in range(10000, 100000, 10000)]]
LABELS = ("high", "low", "middle")
#: Rounds of the features alone, and as many with the pair terms.
ROUNDS = 3


def _prices(spark, sf):
    """Quantity and price decide the label together: neither alone does."""
    quantity, price = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    label = F.when(quantity * price > 1200000, "high").when(quantity * price > 400000, "middle").otherwise("low")
    t = table(spark, sf, "lineitem")
    return t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), quantity.alias("quantity"), F.col("l_tax").cast("double").alias("tax"), price.alias("price"), label.alias("label"))


def _model(spark, sf, pairs=2):
    return A.fit_additive(_prices(spark, sf), COLUMNS, "label", A.Setting(rounds=ROUNDS), pairs, edges=EDGES)


def m4_additive_shapes(spark, sf):
    """The score of every bin of every term, pairs too, for each label."""
    return _model(spark, sf).shapes(spark).select("term", "label", "bin", "low", "high", "low2", "high2", F.round("score", 6).alias("score"), F.col("weight").cast("long").alias("weight"))


def m4_additive_labels(spark, sf):
    """Each line item's likeliest label."""
    return _model(spark, sf).predict(_prices(spark, sf)).select("k", "label", "predicted", F.round("probability", 6).alias("probability"))


def l5_additive_terms(spark, sf):
    """The terms as rule items, most important first."""
    return H.term_items(spark, _model(spark, sf)).select("model_type", "kind", F.regexp_replace("text", r" \(.*", "").alias("term"), F.round("weight", 6).alias("weight"))


def m13_tuning_additive(spark, sf):
    """All six settings of an additive model by cross-validation, best first."""
    best = A.tune_additive(_features(spark, sf).select("doc_id", "danger", *FLAGS), list(FLAGS), "danger", F.col("doc_id"))
    rows = [(i, s["rate"], s["leaves"], f1, acc) for i, (s, f1, acc) in enumerate(best, 1)]
    return spark.createDataFrame(rows, "place int, rate double, leaves int, f1 double, accuracy double").select("place", "rate", "leaves", F.round("f1", 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"))


def m13_tuning_linear(spark, sf):
    """All eight settings of a sparse logistic model by cross-validation, best first."""
    best = N.tune_linear(_features(spark, sf).select("doc_id", "danger", *FLAGS), list(FLAGS), "danger", F.col("doc_id"))
    rows = [(i, s["c"], s["balanced"], f1, acc) for i, (s, f1, acc) in enumerate(best, 1)]
    return spark.createDataFrame(rows, "place int, c double, balanced boolean, f1 double, accuracy double").select("place", "c", "balanced", F.round("f1", 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"))


# SQL: rounds are unrolled.  cells are counted rows (id, y, c), bins their terms (id, t, b), s{i} the sums (id, k, s) after i rounds.


def _bin_sql(column: str, edges: list[float]) -> str:
    return "(" + " + ".join(f"CASE WHEN {column} > {e!r} THEN 1 ELSE 0 END" for e in edges) + ")"


def _round_sql(i: int, bins: str) -> str:
    k = len(LABELS)
    return f"""p{i} AS MATERIALIZED (SELECT id, k, s, exp(s) / sum(exp(s)) OVER (PARTITION BY id) AS p FROM s{i}),
d{i} AS MATERIALIZED (SELECT t, b, k, g, {(k - 1) / k!r}::DOUBLE * g / (h + 1) AS d FROM (SELECT t, b, k, sum(c * (CASE WHEN y = k THEN 1 ELSE 0 END - p)) AS g, sum(c * p * (1 - p)) AS h FROM p{i} JOIN cells USING (id) JOIN {bins} USING (id) GROUP BY t, b, k)),
v{i} AS MATERIALIZED (SELECT id, k, sum(d) AS v FROM {bins} JOIN d{i} USING (t, b) GROUP BY id, k),
a{i} AS MATERIALIZED (SELECT 0.5::DOUBLE * (SELECT sum(g * d) FROM d{i}) / (SELECT sum(c * q) FROM (SELECT id, sum(p * v * v) - sum(p * v) * sum(p * v) AS q FROM p{i} JOIN v{i} USING (id, k) GROUP BY id) JOIN cells USING (id)) AS a),
s{i + 1} AS MATERIALIZED (SELECT id, k, s + a * v AS s FROM p{i} JOIN v{i} USING (id, k), a{i})"""


def _fall_sql(by: str, sign: int) -> str:
    return f"SELECT a, b, {sign} * sum(g * g / (h + 1)) AS v FROM (SELECT a, b, {by}, k, sum(g) AS g, sum(h) AS h FROM pc GROUP BY a, b, {by}, k) GROUP BY a, b"


@cache
def _model_sql() -> str:
    at = {c: _bin_sql(c, es) for c, es in zip(COLUMNS, EDGES, strict=True)}
    small = ", ".join(f"({f}, {b}, {x})" for f, es in enumerate(EDGES) for b, x in enumerate(A._coarse(es)))
    ends = ", ".join(f"({f}, {x}, {(es[j] if x < len(A._chosen(es)) else 'NULL')})" for f, es in enumerate(EDGES) for x, j in enumerate([*A._chosen(es), 0]))
    fine = ", ".join(f"({f}, {x}, {e})" for f, es in enumerate(EDGES) for x, e in enumerate([*map(repr, es), "NULL"]))
    wide = ", ".join(f"({f}, '{c}', {len(A._chosen(es)) + 1})" for f, (c, es) in enumerate(zip(COLUMNS, EDGES, strict=True)))
    every = " UNION ALL ".join([f"SELECT id, {f} AS t, b{f} AS b FROM cells" for f in range(3)])
    total = " UNION ALL ".join(f"SELECT t, b, k, a * d AS s FROM d{i}, a{i}" for i in range(2 * ROUNDS))
    return f"""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS line, l_quantity::DOUBLE AS quantity, l_tax::DOUBLE AS tax, l_extendedprice::DOUBLE AS price,
  CASE WHEN l_quantity::DOUBLE * l_extendedprice::DOUBLE > 1200000 THEN 'high' WHEN l_quantity::DOUBLE * l_extendedprice::DOUBLE > 400000 THEN 'middle' ELSE 'low' END AS label FROM lineitem),
rb AS (SELECT line, label, list_position({sql_list(LABELS)}, label) - 1 AS y, {at["quantity"]} AS b0, {at["tax"]} AS b1, {at["price"]} AS b2 FROM r),
cells AS MATERIALIZED (SELECT row_number() OVER (ORDER BY b0, b1, b2, y) AS id, * FROM (SELECT b0, b1, b2, y, count(*) AS c FROM rb GROUP BY ALL)),
small(f, fine, b) AS (VALUES {small}), ends(f, b, e) AS (VALUES {ends}), fine(f, b, e) AS (VALUES {fine}), wide(f, name, n) AS (VALUES {wide}),
bins AS MATERIALIZED ({every}),
i0 AS (SELECT k, ln((1 + coalesce(sum(c) FILTER (y = k), 0)) / (sum(c) + {len(LABELS)})::DOUBLE) AS s FROM cells, (SELECT unnest(range({len(LABELS)})) AS k) GROUP BY k),
s0 AS (SELECT id, k, s FROM cells, i0),
{", ".join(_round_sql(i, "bins") for i in range(ROUNDS))},
q AS (SELECT id, k, exp(s) / sum(exp(s)) OVER (PARTITION BY id) AS p FROM s{ROUNDS}),
place AS (SELECT id, t AS f, small.b FROM bins JOIN small ON f = t AND fine = bins.b),
pc AS MATERIALIZED (SELECT x.f AS a, z.f AS b, x.b AS i, z.b AS j, k, sum(c * (CASE WHEN y = k THEN 1 ELSE 0 END - p)) AS g, sum(c * p * (1 - p)) AS h
  FROM place x JOIN place z ON x.id = z.id AND x.f < z.f JOIN q ON q.id = x.id JOIN cells ON cells.id = x.id GROUP BY ALL),
chosen AS MATERIALIZED (SELECT a, b, 2 + row_number() OVER (ORDER BY v DESC, a, b) AS t FROM (SELECT a, b, sum(v) AS v FROM ({_fall_sql("i, j", 1)} UNION ALL {_fall_sql("i", -1)} UNION ALL {_fall_sql("j", -1)}) GROUP BY a, b) WHERE v > 0 ORDER BY v DESC, a, b LIMIT 2),
allbins AS MATERIALIZED (SELECT * FROM bins UNION ALL SELECT x.id, t, x.b * n + z.b FROM chosen JOIN place x ON x.f = a JOIN place z ON z.f = chosen.b AND z.id = x.id JOIN wide w ON w.f = chosen.b),
{", ".join(_round_sql(i, "allbins") for i in range(ROUNDS, 2 * ROUNDS))},
w AS (SELECT t, b, sum(c) AS n FROM allbins JOIN cells USING (id) GROUP BY t, b),
raw AS (SELECT t, b, k, n, sum(s) AS s FROM ({total}) JOIN w USING (t, b) GROUP BY ALL),
shape AS (SELECT t, b, k, n, s - sum(s * n) OVER (PARTITION BY t, k) / sum(n) OVER (PARTITION BY t, k) AS s FROM raw),
names AS (SELECT f AS t, name, f AS f1, NULL AS f2, 1 AS n2, fn.n AS n1 FROM wide JOIN (SELECT f, count(*) AS n FROM fine GROUP BY f) fn USING (f)
  UNION ALL SELECT t, x.name || ' x ' || z.name, a, chosen.b, z.n, x.n FROM chosen JOIN wide x ON x.f = a JOIN wide z ON z.f = chosen.b)"""


_K = sql_list(LABELS)
QUERIES = {f.__name__: f for f in (m4_additive_shapes, m4_additive_labels, l5_additive_terms, m13_tuning_additive, m13_tuning_linear)}
ORACLE_SQL = {
    "m4_additive_shapes": f"""{_model_sql()},
spots AS (SELECT t, name, f1, f2, n2, unnest(range(n1 * n2)) AS b FROM names),
edge AS (SELECT t, name, b, CASE WHEN f2 IS NULL THEN b ELSE b // n2 END AS i, b % n2 AS j, f1, f2 FROM spots),
near AS (SELECT f, b, e, lag(e) OVER (PARTITION BY f ORDER BY b) AS low, 1 AS one FROM fine UNION ALL SELECT f, b, e, lag(e) OVER (PARTITION BY f ORDER BY b), 2 FROM ends)
SELECT name AS term, {_K}[kk + 1] AS label, edge.b::INTEGER AS bin, x.low::DOUBLE AS low, x.e::DOUBLE AS high, z.low::DOUBLE AS low2, z.e::DOUBLE AS high2, round(coalesce(s, 0), 6) AS score, coalesce(shape.n, 0)::BIGINT AS weight
FROM edge CROSS JOIN (SELECT unnest(range({len(LABELS)})) AS kk) JOIN near x ON x.f = f1 AND x.b = i AND x.one = CASE WHEN f2 IS NULL THEN 1 ELSE 2 END LEFT JOIN near z ON z.f = f2 AND z.b = j AND z.one = 2
LEFT JOIN shape ON shape.t = edge.t AND shape.b = edge.b AND k = kk""",
    "m4_additive_labels": f"""{_model_sql()},
last AS (SELECT id, arg_max(k, s) AS k, max(exp(s)) / sum(exp(s)) AS p FROM s{2 * ROUNDS} GROUP BY id)
SELECT line AS k, label, {_K}[last.k + 1] AS predicted, round(p, 6) AS probability FROM rb JOIN cells USING (b0, b1, b2, y) JOIN last USING (id)""",
    "l5_additive_terms": f"""{_model_sql()}
SELECT 'additive' AS model_type, 'term' AS kind, 'Term: ' || name AS term, round(sum(abs(s) * shape.n) / {len(LABELS)} / any_value(total), 6) AS weight
FROM shape JOIN names USING (t), (SELECT sum(c) AS total FROM cells) GROUP BY name HAVING sum(abs(s) * shape.n) > 0""",
}
