"""Queries of models and inference; SQL where a result has an SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dictionaries as D
from ..operators import features as X
from ..operators import inference as N
from ..operators import labeling as L
from ..operators import ml as M
from ..sources.steps import written
from .q_features import FEATURES, _any
from .q_labeling import _LABELED
from .views import INCIDENTS, incidents, sql_list, table

FLAGS = ("kw_privacy", "kw_video_surveillance", "kw_biometric", "kw_location", "kw_monetary_penalty", "kw_reg_enforcement")


def _frame(spark, sf):
    f = X.build_features(incidents(spark, sf))
    return f.withColumn("bad", (F.col("sentiment_score") < 0).cast("int").cast("string")).withColumn("danger", ((F.col("rc_risky") > 0) | (F.col("kw_biometric") > 0)).cast("int"))


def _features(spark, sf):
    """The frame without its texts, written: what iterates or counts twice reads flags, not texts."""
    f = _frame(spark, sf)
    kinds = ("kw_", "pf_", "rc_", "f_", "pair_")
    return written(f.select("doc_id", "sentiment_score", "bad", "danger", *[c for c in f.columns if c.startswith(kinds)]))


def _lines(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], F.col("l_returnflag").alias("flag"))


def m2_tree_rules(spark, sf):
    """Leaves of a tree for the risky incidents, with true support and precision."""
    d = _features(spark, sf).withColumn("y", F.col("danger").cast("string"))
    train, _ = M.split(d, "doc_id")
    cols = X.feature_columns(d, ("kw_", "rc_net"))
    return M.tree_rules(M.fit_classifier(train, cols, "y", "tree", depth=3), train, "y")


def m3_linear_directions(spark, sf):
    d = _frame(spark, sf).withColumn("y", F.col("danger").cast("string"))
    fitted = M.fit_classifier(d, list(FLAGS), "y", "linear")
    return M.directionality(M.coefficients(fitted), d)


def m4_additive_predictions(spark, sf):
    d = _lines(spark, sf).withColumn("y", (F.col("l_extendedprice") > 30000).cast("string"))
    train, test = M.split(d, "k")
    return M.fit_classifier(train, ["l_quantity", "l_discount", "l_tax"], "y", "additive", rounds=5).predict(test).select("k", "y", "predicted", "probability")


def m5_rule_list(spark, sf):
    d = _features(spark, sf)
    return spark.createDataFrame(M.rule_list(d, list(FLAGS), "danger", 4), "antecedent string, probability double, n long")


def m7_mutual_information(spark, sf):
    return M.mutual_information(_features(spark, sf), list(FLAGS)).select("a", "b", F.round("mi", 6).alias("mi"))


_KW = ", ".join(f"CASE WHEN {_any('t', ts)} THEN 1 ELSE 0 END AS kw_{g}" for g, ts in D.KEYWORD_GROUPS.items())
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM k" for i, a in enumerate(FLAGS) for b in FLAGS[i + 1 :])
_MI_SQL = f"""WITH {INCIDENTS}, {FEATURES}, k AS (SELECT {_KW} FROM fr), p AS ({_PAIRS}), c AS (SELECT a, b, x, y, count(*)::DOUBLE AS n FROM p GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY a, b, x) AS nx, sum(n) OVER (PARTITION BY a, b, y) AS ny, sum(n) OVER (PARTITION BY a, b) AS t FROM c)
SELECT a, b, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM m GROUP BY a, b"""


def m7_bayes_tree(spark, sf):
    d = _features(spark, sf)
    edges = M.chow_liu(d, [*FLAGS, "danger"], "danger")
    return M.bayes_tree_predict(d, edges, "danger", "doc_id")


def m10_calibrated_weights(spark, sf):
    d = _frame(spark, sf).withColumn("target", 2.0 * F.col("kw_privacy") + 0.5 * F.col("kw_biometric") - F.col("kw_location"))
    w, r2 = M.nonnegative_weights(d, list(FLAGS), "target")
    return spark.createDataFrame([(c, v, r2) for c, v in w.items()], "feature string, weight double, r2 double")


def m11_network(spark, sf):
    d = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).cast("string").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]).where("e0 is not null")
    return M.fit_classifier(d, [f"e{i}" for i in range(64)], "y", "network", hidden=100, rounds=30).predict(d).select("vec_id", "y", "predicted", "probability")


def m12_reconstruction(spark, sf):
    d = _lines(spark, sf)
    return M.reconstruction_error(d, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2).select("k", F.round("error", 6).alias("error"))


def m17_contributions(spark, sf):
    return M.contributions(_lines(spark, sf), [("l_quantity", 0.5), ("l_discount", -2.0)], "k").select("k", "feature", F.round("contribution", 6).alias("contribution"))


_CONTRIB_SQL = """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d FROM lineitem), m AS (SELECT avg(q) AS q, avg(d) AS d FROM l)
SELECT k, 'l_quantity' AS feature, round((l.q - m.q) * 0.5::DOUBLE, 6) AS contribution FROM l, m UNION ALL SELECT k, 'l_discount', round((l.d - m.d) * -2.0::DOUBLE, 6) FROM l, m"""


def r7_linear_rules(spark, sf):
    d = _lines(spark, sf)
    r = M.linear_rules(d, [("l_quantity", 1.2), ("l_discount", -0.4), ("l_tax", 0.0)], F.col("flag") == "R")
    return r.select("feature", "side", *[F.round(c, 6).alias(c) for c in ("median", "support", "precision", "lift")], "weight")


_RULES = """WITH l AS (SELECT l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), m AS (SELECT median(q) AS q, median(d) AS d, avg(y) AS r FROM l)
SELECT 'l_quantity' AS feature, '>' AS side, round(any_value(m.q), 6) AS median, round(avg(CASE WHEN l.q > m.q THEN 1 ELSE 0 END), 6) AS support, round(avg(y) FILTER (l.q > m.q), 6) AS precision, round(avg(y) FILTER (l.q > m.q) / any_value(m.r), 6) AS lift, 1.2::DOUBLE AS weight FROM l, m
UNION ALL SELECT 'l_discount', '<=', round(any_value(m.d), 6), round(avg(CASE WHEN l.d <= m.d THEN 1 ELSE 0 END), 6), round(avg(y) FILTER (l.d <= m.d), 6), round(avg(y) FILTER (l.d <= m.d) / any_value(m.r), 6), -0.4::DOUBLE FROM l, m"""


def ff11_binarise(spark, sf):
    return M.binarise(_lines(spark, sf), ["l_quantity", "l_tax"]).select("k", "l_quantity", "l_tax")


_BIN_SQL = "WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity::DOUBLE AS q, l_tax::DOUBLE AS t FROM lineitem), m AS (SELECT median(q) AS q, median(t) AS t FROM l) SELECT k, CASE WHEN l.q > m.q THEN 1 ELSE 0 END AS l_quantity, CASE WHEN l.t > m.t THEN 1 ELSE 0 END AS l_tax FROM l, m"


def ff12_quantile_bins(spark, sf):
    return M.quantile_bins(_lines(spark, sf).select("k", "l_extendedprice"), "l_extendedprice").select("k", "bin")


_QBIN_SQL = """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_extendedprice::DOUBLE AS v FROM lineitem), e AS (SELECT list_distinct(quantile_cont(v, [0.2, 0.4, 0.6, 0.8])) AS e FROM l)
SELECT k, len(list_filter(e, lambda x: v > x))::INTEGER AS bin FROM l, e"""

#: Labels that answers may name.
ALLOWED = ("en", "fr", "src0", "src4", "src7")


def fd3_json_answers(spark, sf):
    """Answers of a model, made from each document's language, source, size and text."""
    kind, size = F.col("n_chars") % 4, F.col("n_chars").cast("string")
    fenced = F.concat(F.lit('```json\n{"relevant": true, "harms": ["'), "lang", F.lit('", "other"], "confidence": '), size, F.lit("e-3}\n```"))
    inline = F.concat(F.lit('I say {"relevant": false, "confidence": '), size, F.lit("e-4} here"))
    bare = F.concat(F.lit('{"harms": ["'), F.coalesce("source", F.lit("none")), F.lit('"]}'))
    answer = F.when(kind == 0, fenced).when(kind == 1, inline).when(kind == 2, bare).otherwise(F.translate("text", "{}", ""))
    d = table(spark, sf, "documents").select("doc_id", N.json_answer(answer, ALLOWED).alias("x"))
    return d.select("doc_id", "x.relevant", F.concat_ws(",", "x.harms").alias("harms"), "x.confidence")


_JSON_SQL = f"""WITH d AS (SELECT doc_id, coalesce(n_chars % 4, 3) AS kind, n_chars, CASE n_chars % 4 WHEN 0 THEN lang WHEN 2 THEN coalesce(source, 'none') END AS harm FROM documents)
SELECT doc_id, kind = 0 AS relevant, CASE WHEN list_contains({sql_list(ALLOWED)}, harm) THEN harm ELSE '' END AS harms,
CASE kind WHEN 0 THEN least(1.0::DOUBLE, n_chars::DOUBLE / 1000) WHEN 1 THEN least(1.0::DOUBLE, n_chars::DOUBLE / 10000) ELSE 0 END::DOUBLE AS confidence FROM d"""


def z1_batch_inference(spark, sf):
    """A deterministic function in the place of a model, called in batches: the first three words of each text."""
    d = table(spark, sf, "documents").select("doc_id", "text")

    def load():
        return lambda texts: [" ".join((t or "").split(" ")[:3]) for t in texts]

    return N.batch_infer(d, "text", load).select("doc_id", "answer")


def ff9_label_projection(spark, sf):
    """Labels and spans that name each document's language and source; every fourth size has none."""
    source = F.coalesce("source", F.lit("none"))
    labels = F.when(F.col("n_chars") % 4 != 0, F.array(F.concat(F.lit("harm_"), "lang"), F.concat(F.lit("rc_"), source), F.concat(F.lit("harm_"), source)))
    d = table(spark, sf, "documents").select("doc_id", labels.alias("labels"), F.array(F.concat(F.lit("pf_"), source), F.lit("city")).alias("spans"))
    p = N.project_labels(d, "labels", "spans")
    j = lambda c: F.concat_ws(",", c).alias(c)
    return p.select("doc_id", j("harm_categories"), j("root_cause_features"), j("product_features"))


_PROJ_SQL = """WITH d AS (SELECT doc_id, lang, coalesce(source, 'none') AS s, coalesce(n_chars % 4, 0) <> 0 AS labelled FROM documents)
SELECT doc_id, CASE WHEN labelled THEN array_to_string(list_sort(list_distinct([lang, s])), ',') ELSE '' END AS harm_categories,
CASE WHEN labelled THEN 'pf_' || s || ',rc_' || s ELSE '' END AS root_cause_features, CASE WHEN labelled THEN s ELSE '' END AS product_features FROM d"""


def z3_label_cascade(spark, sf):
    l = L.label_records(incidents(spark, sf))
    x = l.select("doc_id", N.label_cascade(F.when(F.col("doc_id") % 5 == 0, F.lit("surveillance")), F.col("harm_category"), F.when(F.col("doc_id") % 2 == 0, F.lit("insecurity"))).alias("x"))
    return x.groupBy("x.source").agg(F.count(F.lit(1)).alias("n"))


def _rule_list_sql(length: int, least: int = 10) -> str:
    """Steps are unrolled: r{i} are the counted rows that no rule before covers, b{i} the best rule of step i, if any."""
    pairs = [(i, i) for i in range(len(FLAGS))] + [(i, j) for i in range(len(FLAGS)) for j in range(i + 1, len(FLAGS))]
    name = lambda i, j: f"{FLAGS[i]} = 1" + (f" AND {FLAGS[j]} = 1" if i != j else "")
    rules = ", ".join(f"({n}, {i + 1}, {j + 1}, '{name(i, j)}')" for n, (i, j) in enumerate(pairs))
    parts = []
    for s in range(length):
        parts.append(f"""t{s} AS (SELECT sum(c) AS n, sum(c * y) AS p FROM r{s}),
b{s} AS MATERIALIZED (SELECT q.*, abs(q.p + 1 - (t{s}.p + 1)::DOUBLE / (t{s}.n + 2) * (q.n + 2)) / sqrt(q.n + 2) AS far FROM t{s},
  (SELECT i, a, b, name, sum(c) AS n, sum(c * y) AS p FROM r{s}, rules WHERE x[a] = 1 AND x[b] = 1 GROUP BY ALL) q WHERE q.n >= {least} QUALIFY row_number() OVER (ORDER BY far DESC, i) = 1),
g{s} AS MATERIALIZED (SELECT * FROM b{s} WHERE far >= 1),
r{s + 1} AS MATERIALIZED (SELECT * FROM r{s} WHERE NOT EXISTS (SELECT 1 FROM g{s} WHERE x[a] = 1 AND x[b] = 1))""")
    told = " UNION ALL ".join(f"SELECT name AS antecedent, (p + 1)::DOUBLE / (n + 2) AS probability, n::BIGINT AS n FROM g{s}" for s in range(length))
    return f"""WITH {INCIDENTS}, {FEATURES}, k AS (SELECT {_KW}, risky FROM fr), rules(i, a, b, name) AS (VALUES {rules}),
r0 AS MATERIALIZED (SELECT [{", ".join(FLAGS)}] AS x, CASE WHEN risky > 0 OR kw_biometric > 0 THEN 1 ELSE 0 END AS y, count(*) AS c FROM k GROUP BY ALL), {", ".join(parts)}
{told} UNION ALL SELECT 'else', (coalesce(sum(c * y), 0) + 1)::DOUBLE / (coalesce(sum(c), 0) + 2), coalesce(sum(c), 0)::BIGINT FROM r{length}"""


_CASCADE_SQL = f"""{_LABELED} SELECT CASE WHEN doc_id % 5 = 0 THEN 'extracted' WHEN harm_category <> 'unknown' THEN 'heuristic' WHEN doc_id % 2 = 0 THEN 'model' ELSE 'none' END AS source, count(*) AS n FROM lab GROUP BY 1"""

QUERIES = {f.__name__: f for f in (m2_tree_rules, m3_linear_directions, m4_additive_predictions, m5_rule_list, m7_mutual_information, m7_bayes_tree, m10_calibrated_weights, m11_network, m12_reconstruction, m17_contributions, r7_linear_rules, ff11_binarise, ff12_quantile_bins, fd3_json_answers, z1_batch_inference, ff9_label_projection, z3_label_cascade)}
ORACLE_SQL = {
    "m5_rule_list": _rule_list_sql(4),
    "z3_label_cascade": _CASCADE_SQL,
    "m7_mutual_information": _MI_SQL,
    "m17_contributions": _CONTRIB_SQL,
    "r7_linear_rules": _RULES,
    "ff11_binarise": _BIN_SQL,
    "ff12_quantile_bins": _QBIN_SQL,
    "fd3_json_answers": _JSON_SQL,
    "z1_batch_inference": "SELECT doc_id, array_to_string(string_split(coalesce(text, ''), ' ')[1:3], ' ') AS answer FROM documents",
    "ff9_label_projection": _PROJ_SQL,
}
