"""Queries and SQL of comparing approaches and of further label and score operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dictionaries as D
from ..operators import comparison as C
from ..operators import evaluation as E
from ..operators import features as X
from ..operators import ingest as I
from ..operators import labeling as L
from .q_features import FEATURES, _any
from .q_labeling import ARM, _frameworks_cte
from .views import GOLD, INCIDENTS, gold, incidents, sql_list, table


def _framework_truth(spark, sf):
    g = gold(spark, sf).where(F.size("harms") > 0)
    p = L.framework_predictions(g).join(g.select("doc_id", "harms"), "doc_id")
    return p.select("doc_id", "framework", "confidence", F.array_contains("harms", F.col("harm")).alias("ok"), F.ascii("framework").alias("o"))


_FT = f"WITH {GOLD}, {_frameworks_cte('gold')}, ft2 AS (SELECT fw.doc_id, framework, confidence, list_contains(harms, harm) AS ok FROM fw JOIN gold USING (doc_id) WHERE len(harms) > 0)"


def j16_best_correct(spark, sf):
    return C.best_correct(_framework_truth(spark, sf), "doc_id", "framework", "ok", "confidence", "o")


def a19_approach_accuracy(spark, sf):
    return C.approach_accuracy(_framework_truth(spark, sf), "framework", "ok")


def a17_micro_scores(spark, sf):
    g = L.offline_arm(gold(spark, sf))
    t = g.select(F.array_distinct(F.transform("harms", lambda h: L.parent_of(h))).alias("t"), F.col("ranking_pred").alias("p"))
    return C.micro_scores(t, "t", "p").select("cases", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_MICRO = f"""WITH {GOLD}, {ARM}, tr AS (SELECT doc_id, list(DISTINCT coalesce(p.parent, h)) AS t FROM (SELECT doc_id, unnest(harms) AS h FROM gold) LEFT JOIN parents p ON p.subtype = h GROUP BY doc_id),
x AS (SELECT t, CASE WHEN ranking_pred = '' THEN []::VARCHAR[] ELSE string_split(ranking_pred, ',') END AS p FROM tr JOIN arm USING (doc_id)),
s AS (SELECT count(*) AS cases, sum(len(list_intersect(t, p)))::DOUBLE AS tp, sum(len(t))::DOUBLE AS nt, sum(len(p))::DOUBLE AS np FROM x)
SELECT cases, round(tp / np, 6) AS precision, round(tp / nt, 6) AS recall, round(2 * tp / (nt + np), 6) AS f1 FROM s"""


def w5_extremes(spark, sf):
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 3).cast("string").alias("runner"), "event_type").agg(F.round(F.avg("value"), 4).alias("score"))
    return C.extremes(e, "runner", "event_type", "score", 2)


_EXTREMES = """WITH e AS (SELECT CAST(user_id % 3 AS VARCHAR) AS runner, event_type, round(avg(value), 4) AS score FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY runner ORDER BY score DESC, event_type)::INTEGER AS strong, row_number() OVER (PARTITION BY runner ORDER BY score, event_type)::INTEGER AS weak FROM e)
SELECT * FROM r WHERE strong <= 2 OR weak <= 2"""


def j14_metric_drift(spark, sf):
    """Daily means of even users against those of all users, beyond a tolerance."""
    e = table(spark, sf, "events").select(F.to_date("ts").cast("string").alias("metric"), "value", "user_id")
    mean = lambda d: d.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("value"))
    return C.metric_drift(mean(e.where("user_id % 2 = 0")), mean(e), 5.0)


_DRIFT = """WITH a AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS metric, round(avg(value), 4) AS e FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS metric, round(avg(value), 4) AS x FROM events GROUP BY 1)
SELECT coalesce(a.metric, b.metric) AS metric, a.e AS emitted, b.x AS expected FROM a FULL JOIN b ON a.metric = b.metric WHERE coalesce(abs(a.e - b.x) > 5, true)"""


def fs15_bootstrap_labels(spark, sf):
    return incidents(spark, sf).select("doc_id", F.concat_ws(",", C.bootstrap_labels(F.col("description"))).alias("labels"))


_BOOT = f"""WITH {INCIDENTS}, t AS (SELECT doc_id, lower(coalesce(description, '')) AS t FROM incidents)
SELECT doc_id, coalesce(nullif(concat_ws(',', {", ".join(f"CASE WHEN {_any('t', ws)} THEN '{n}' END" for n, ws in D.BOOTSTRAP)}), ''), '{D.GENERAL}') AS labels FROM t"""


def fs16_annotate_scores(spark, sf):
    i = F.col("doc_id")
    m = F.create_map(F.lit("a"), i % 10 / F.lit(10.0), F.lit("b"), i % 7 / F.lit(10.0), F.lit("c"), i % 3 / F.lit(10.0))
    d = table(spark, sf, "documents").select("doc_id", C.annotate_scores(F.when(i % 9 != 0, m), 0.4).alias("x"))
    return d.select("doc_id", F.concat_ws(",", "x.harm_categories").alias("harm_categories"), F.round("x.harm_score", 6).alias("harm_score"))


_ANNOTATE = """WITH m AS (SELECT doc_id, (doc_id % 10)::DOUBLE / 10.0::DOUBLE AS a, (doc_id % 7)::DOUBLE / 10.0::DOUBLE AS b, (doc_id % 3)::DOUBLE / 10.0::DOUBLE AS c FROM documents)
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat_ws(',', CASE WHEN a > 0.4::DOUBLE THEN 'a' END, CASE WHEN b > 0.4::DOUBLE THEN 'b' END, CASE WHEN c > 0.4::DOUBLE THEN 'c' END) END AS harm_categories,
  CASE WHEN doc_id % 9 = 0 THEN 0.0::DOUBLE ELSE round(greatest(a, b, c), 6) END AS harm_score FROM m"""


def a23_dimension_scores(spark, sf):
    return C.dimension_scores(X.build_features(incidents(spark, sf)), "doc_id")


_HELD = {f: d for f, d in D.DIMENSIONS.items() if f == "penalty_amount" or f == "sentiment_score" or f[3:] in D.KEYWORD_GROUPS}
_BEST = lambda d: ", ".join(f"coalesce({f}::DOUBLE, 0)" if f in ("penalty_amount", "sentiment_score") else f"CASE WHEN {_any('t', D.KEYWORD_GROUPS[f[3:]])} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for f, x in _HELD.items() if x == d)
_DIMENSIONS = f"WITH {INCIDENTS}, {FEATURES} " + " UNION ALL ".join(f"SELECT doc_id, '{d}' AS dimension, greatest(0.0::DOUBLE{', ' if _BEST(d) else ''}{_BEST(d)}) AS score FROM fr" for d in sorted(set(D.DIMENSIONS.values())))


def p18_expected_harms(spark, sf):
    i = F.col("doc_id")
    g = gold(spark, sf).select("doc_id", C.expected_harms([F.when(i % 2 == 0, F.array(F.lit("harm_x"), F.lit(" "))), F.when(i % 3 == 0, F.col("harms"))], F.when(i % 5 != 0, F.lit("harm_solo"))).alias("e"))
    return g.select("doc_id", F.concat_ws(",", "e").alias("expected"))


_EXPECTED = f"""WITH {GOLD} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x' WHEN doc_id % 3 = 0 THEN array_to_string(harms, ',') WHEN doc_id % 5 <> 0 THEN 'solo' ELSE '' END AS expected FROM gold"""


def p17_canonical_label(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.element_at(F.array(*[F.lit(x) for x in ("harm_leak", "unknown", "leak", "harm_unknown")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("l"))
    return d.select("doc_id", F.coalesce(C.canonical_label(F.col("l")), F.lit("none")).alias("label"))


def fd5_record_hash(spark, sf):
    d = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.select("doc_id", I.record_key(d).alias("key"))


_HASH = """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') AS key FROM labels"""


def fs14_explain_composite(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", C.explain_composite({"a": i % 4 / F.lit(4.0), "b": i % 5 / F.lit(5.0)}, {"a": 1.0, "b": 1.3}).alias("why"))


_EXPLAIN = """WITH d AS (SELECT doc_id, (doc_id % 4)::DOUBLE / 4.0::DOUBLE AS a, (doc_id % 5)::DOUBLE / 5.0::DOUBLE AS b FROM documents)
SELECT doc_id, CASE WHEN a * 1.0::DOUBLE >= b * 1.3::DOUBLE THEN 'a=' || printf('%.2f', a) || '; b=' || printf('%.2f', b) ELSE 'b=' || printf('%.2f', b) || '; a=' || printf('%.2f', a) END AS why FROM d"""


def a32_vocabulary(spark, sf):
    return gold(spark, sf).select(F.explode("harms").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) < 2).alias("rare"))


def a28_confidence(spark, sf):
    p = _framework_truth(spark, sf).groupBy("framework").agg(F.count_if("ok").alias("a"), F.count_if(~F.col("ok")).alias("b"))
    return p.select("framework", E.confidence(F.col("a"), F.col("b")).alias("confidence"))


QUERIES = {f.__name__: f for f in (j16_best_correct, a19_approach_accuracy, a17_micro_scores, w5_extremes, j14_metric_drift, fs15_bootstrap_labels, fs16_annotate_scores, a23_dimension_scores, p18_expected_harms, p17_canonical_label, fd5_record_hash, fs14_explain_composite, a32_vocabulary, a28_confidence)}
ORACLE_SQL = {
    "j16_best_correct": _FT + " SELECT doc_id, (SELECT framework FROM ft2 y WHERE y.doc_id = x.doc_id AND ok ORDER BY confidence DESC, framework LIMIT 1) AS best FROM (SELECT DISTINCT doc_id FROM ft2) x",
    "a19_approach_accuracy": _FT + ", a AS (SELECT framework AS approach, count(*) FILTER (ok) AS correct, count(*) AS total, round_even(count(*) FILTER (ok)::DOUBLE / count(*), 4) AS accuracy FROM ft2 GROUP BY 1) SELECT *, row_number() OVER (ORDER BY accuracy DESC, approach)::INTEGER AS place FROM a",
    "a17_micro_scores": _MICRO,
    "w5_extremes": _EXTREMES,
    "j14_metric_drift": _DRIFT,
    "fs15_bootstrap_labels": _BOOT,
    "fs16_annotate_scores": _ANNOTATE,
    "a23_dimension_scores": _DIMENSIONS,
    "p18_expected_harms": _EXPECTED,
    "p17_canonical_label": f"SELECT doc_id, {sql_list(('leak', 'none', 'leak', 'none'))}[doc_id % 4 + 1] AS label FROM documents",
    "fd5_record_hash": _HASH,
    "fs14_explain_composite": _EXPLAIN,
    "a32_vocabulary": f"WITH {GOLD} SELECT h AS label, count(*) AS n, count(*) < 2 AS rare FROM (SELECT unnest(harms) AS h FROM gold) GROUP BY h",
    "a28_confidence": _FT + " SELECT framework, round_even((a + 1)::DOUBLE / (a + b + 2) * (1 - exp(-(a + b) / 10.0::DOUBLE)), 4) AS confidence FROM (SELECT framework, count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS b FROM ft2 GROUP BY 1)",
}
