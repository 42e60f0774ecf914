"""Queries and SQL of evaluation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import continuous as R
from ..operators import evaluation as E
from ..operators import labeling as L
from .q_labeling import ARM
from .views import GOLD, gold, table


def _arm(spark, sf):
    a = L.offline_arm(gold(spark, sf))
    return a.select("doc_id", F.array_distinct(F.transform("harms", lambda h: L.parent_of(h))).alias("truth"), F.col("ranking_pred").alias("pred"), F.col("harm_score").cast("long").alias("harm_score"), "predicted_score")


def _round(df, *keep):
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_ARM_SQL = f"""WITH {GOLD}, {ARM},
tr AS (SELECT doc_id, list(DISTINCT coalesce(p.parent, h)) AS truth FROM (SELECT doc_id, unnest(harms) AS h FROM gold) LEFT JOIN parents p ON p.subtype = h GROUP BY doc_id),
x AS (SELECT g.doc_id, coalesce(tr.truth, []::VARCHAR[]) AS t, CASE WHEN a.ranking_pred = '' THEN []::VARCHAR[] ELSE string_split(a.ranking_pred, ',') END AS p, g.harm_score::BIGINT AS s, a.predicted_score AS q FROM gold g JOIN arm a USING (doc_id) LEFT JOIN tr USING (doc_id))"""


def a6_multi_label(spark, sf):
    return _round(E.multi_label(_arm(spark, sf), "truth", "pred"))


_MULTI_SQL = _ARM_SQL + """, m AS (SELECT *, len(list_intersect(t, p)) AS b, len(list_distinct(list_concat(t, p))) AS u, len(t) + len(p) AS z FROM x),
l AS (SELECT label, count(*) FILTER (list_contains(t, label) AND list_contains(p, label)) AS tp, sum((CASE WHEN list_contains(t, label) THEN 1 ELSE 0 END) + (CASE WHEN list_contains(p, label) THEN 1 ELSE 0 END)) AS z
  FROM (SELECT t, p, unnest(list_distinct(list_concat(t, p))) AS label FROM x) GROUP BY label)
SELECT count(*) AS n, round(avg(CASE WHEN u > 0 THEN b::DOUBLE / u ELSE 0 END), 6) AS jaccard, round(avg(CASE WHEN z > 0 THEN 2.0::DOUBLE * b / z ELSE 0 END), 6) AS instance_f1, round(2.0::DOUBLE * sum(b) / sum(z), 6) AS micro_f1,
  round((SELECT avg(2.0::DOUBLE * tp / z) FROM l), 6) AS macro_f1, round(sum(u - b)::DOUBLE / (count(*) * (SELECT count(*) FROM l)), 6) AS hamming, round(avg(CASE WHEN b = u THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS emr FROM m"""


def a8_ranking(spark, sf):
    return _round(E.ranking(_arm(spark, sf), "truth", "pred", 5))


_RANK_SQL = _ARM_SQL + """, h AS (SELECT doc_id, t, i, CASE WHEN list_contains(t, p[i]) THEN 1 ELSE 0 END AS hit FROM (SELECT doc_id, t, p, unnest(range(1, len(p) + 1)) AS i FROM x)),
c AS (SELECT *, sum(hit) OVER (PARTITION BY doc_id ORDER BY i) AS hits FROM h),
r AS (SELECT doc_id, sum(CASE WHEN i <= 5 THEN hit / log2(i + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 5 AND hit = 1 THEN hits::DOUBLE / i ELSE 0 END) AS ap, min(CASE WHEN hit = 1 THEN i END) AS first FROM c GROUP BY doc_id),
k AS (SELECT x.doc_id, least(len(x.t), 5) AS m, coalesce(r.dcg, 0) AS dcg, coalesce(r.ap, 0) AS ap, r.first, (SELECT sum(1 / log2(j + 1)) FROM range(1, least(len(x.t), 5) + 1) v(j)) AS ideal FROM x LEFT JOIN r USING (doc_id))
SELECT count(*) AS n, round(avg(CASE WHEN m > 0 THEN dcg / ideal ELSE 0 END), 6) AS ndcg, round(avg(CASE WHEN m > 0 THEN ap / m ELSE 0 END), 6) AS map, round(avg(CASE WHEN m > 0 AND first IS NOT NULL THEN 1.0::DOUBLE / first ELSE 0 END), 6) AS mrr FROM k"""


def a9_ordinal(spark, sf):
    return _round(E.ordinal(_arm(spark, sf), "harm_score", "predicted_score"))


_ORDINAL_SQL = _ARM_SQL + """, v AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT s AS v FROM x UNION SELECT DISTINCT q FROM x)),
y AS (SELECT x.s, x.q, a.i AS si, b.i AS qi FROM x JOIN v a ON a.v = x.s JOIN v b ON b.v = x.q),
n AS (SELECT count(*)::DOUBLE AS n FROM y),
kappa AS (SELECT 1 - (SELECT sum((si - qi) ** 2) FROM y) * (SELECT n FROM n) / (SELECT sum((a.si - b.qi) ** 2) FROM y a, y b) AS qwk,
  1 - (SELECT sum(abs(si - qi)) FROM y) * (SELECT n FROM n) / (SELECT sum(abs(a.si - b.qi)) FROM y a, y b) AS lwk,
  1 - (SELECT count(*) FILTER (si <> qi) FROM y) * (SELECT n FROM n) / (SELECT count(*) FILTER (a.si <> b.qi) FROM y a, y b) AS kappa),
rk AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0::DOUBLE AS b FROM y),
kd AS (SELECT sum(sign(a.s - b.s) * sign(a.q - b.q))::DOUBLE AS c, sum(CASE WHEN a.s <> b.s THEN 1 ELSE 0 END)::DOUBLE AS t, sum(CASE WHEN a.q <> b.q THEN 1 ELSE 0 END)::DOUBLE AS p FROM y a, y b)
SELECT (SELECT count(*) FROM y) AS n, round((SELECT qwk FROM kappa), 6) AS qwk, round((SELECT lwk FROM kappa), 6) AS lwk, round((SELECT kappa FROM kappa), 6) AS kappa, round((SELECT corr(a, b) FROM rk), 6) AS spearman, round((SELECT c / sqrt(t * p) FROM kd), 6) AS kendall, round((SELECT avg(CASE WHEN s = q THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM y), 6) AS accuracy"""


def _probs(spark, sf):
    return table(spark, sf, "labels").select("doc_id", "quality", ((F.col("doc_id") * 37) % 101 / F.lit(100.0)).alias("prob"))


def a13_calibration(spark, sf):
    return _round(E.calibration(_probs(spark, sf), "quality", "prob"))


_EDGES = " + ".join(f"(CASE WHEN p >= {i / 10!r}::DOUBLE THEN 1 ELSE 0 END)" for i in range(1, 10))
_ECE_SQL = f"""WITH r AS (SELECT quality::DOUBLE AS y, (doc_id * 37 % 101)::DOUBLE / 100.0::DOUBLE AS p FROM labels), b AS (SELECT y, p, {_EDGES} AS b FROM r),
g AS (SELECT b, count(*) AS n, sum(y) AS y, sum(p) AS p, sum((p - y) ** 2) AS se FROM b GROUP BY b)
SELECT sum(n)::BIGINT AS n, round(sum(abs(y - p)) / sum(n), 6) AS ece, round(sum(se) / sum(n), 6) AS brier, round(sum(p) / sum(n) * 100, 6) AS mean_risk_pct FROM g"""


def a16_classification_report(spark, sf):
    d = table(spark, sf, "labels").select(F.concat(F.lit("c"), (F.col("doc_id") % 4).cast("string")).alias("t"), F.when(F.col("doc_id") % 17 != 0, F.concat(F.lit("c"), (F.col("doc_id") * 7 % 5).cast("string"))).alias("p"))
    return _round(E.classification_report(d, "t", "p"))


_REPORT_SQL = """WITH r AS (SELECT 'c' || (doc_id % 4) AS t, coalesce(CASE WHEN doc_id % 17 <> 0 THEN 'c' || (doc_id * 7 % 5) END, 'unknown') AS p FROM labels),
l AS (SELECT t AS label FROM r UNION SELECT p FROM r),
c AS (SELECT label, (SELECT count(*) FROM r WHERE t = label) AS support, (SELECT count(*) FROM r WHERE p = label) AS said, (SELECT count(*) FROM r WHERE p = label AND t = label) AS tp FROM l),
m AS (SELECT label, CASE WHEN said > 0 THEN tp::DOUBLE / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall, 2.0::DOUBLE * tp / (said + support) AS f1, support, tp FROM c),
o AS (SELECT label, precision, recall, f1, support::BIGINT AS support FROM m
UNION ALL SELECT 'accuracy', sum(tp)::DOUBLE / sum(support), sum(tp)::DOUBLE / sum(support), sum(tp)::DOUBLE / sum(support), sum(support)::BIGINT FROM m
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM m)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM o"""


def a20_experiment_summary(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 3).cast("string").alias("arm"), "value")
    s = E.experiment_summary(e, "value", ["event_type", "arm"])
    return s.select("event_type", "arm", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "lo", "hi")])


_SUMMARY_SQL = """SELECT event_type, arm, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS lo, round(max(value), 4) AS hi
FROM (SELECT event_type, CAST(user_id % 3 AS VARCHAR) AS arm, value FROM events) GROUP BY GROUPING SETS ((event_type), (arm), (event_type, arm), ())"""


def a21_bootstrap(spark, sf):
    """Percentile interval of the mean of whole-number values; random weights, so no SQL."""
    return E.bootstrap_interval(table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("q")), "q")


def a21_bootstrap_continuous(spark, sf):
    """Percentile interval of the mean of values that hardly repeat."""
    return E.bootstrap_interval(table(spark, sf, "events"), "value")


def a22_cliffs_delta(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor(F.col("value")).alias("v"))
    return _round(E.cliffs_delta(e, "event_type", "v"))


_DELTA_SQL = """WITH e AS (SELECT event_type AS g, floor(value) AS v, count(*)::DOUBLE AS c FROM events GROUP BY 1, 2), s AS (SELECT g, sum(c) AS n, sum(v * c) / sum(c) AS m FROM e GROUP BY g)
SELECT a.g AS a, b.g AS b, round(sum(a.c * b.c * sign(a.v - b.v)) / (x.n * y.n), 6) AS delta, round(x.m - y.m, 6) AS mean_diff
FROM e a JOIN e b ON a.g < b.g JOIN s x ON x.g = a.g JOIN s y ON y.g = b.g GROUP BY a.g, b.g, x.n, y.n, x.m, y.m"""


def a22_cliffs_continuous(spark, sf):
    """Cliff's delta of the values as they are."""
    return _round(E.cliffs_delta(table(spark, sf, "events"), "event_type", "value"))


_DELTA_ALL_SQL = """WITH s AS (SELECT event_type AS g, count(*)::DOUBLE AS n, avg(value) AS m FROM events GROUP BY 1)
SELECT a.event_type AS a, b.event_type AS b, round(sum(sign(a.value - b.value)) / (x.n * y.n), 6) AS delta, round(x.m - y.m, 6) AS mean_diff
FROM events a JOIN events b ON a.event_type < b.event_type JOIN s x ON x.g = a.event_type JOIN s y ON y.g = b.event_type GROUP BY a.event_type, b.event_type, x.n, y.n, x.m, y.m"""


def a11_kendall(spark, sf):
    """Tau-b of the customers' balance and what they have ordered."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).cast("double").alias("ordered"))
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    return _round(R.kendall(c, "c_acctbal", "ordered"))


_KENDALL_SQL = """WITH o AS (SELECT o_custkey, round(sum(o_totalprice), 2)::DOUBLE AS y FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, c_acctbal::DOUBLE AS x, y FROM customer JOIN o ON c_custkey = o_custkey),
p AS (SELECT count(*)::DOUBLE AS pairs, sum(CASE WHEN sign(a.x - b.x) * sign(a.y - b.y) > 0 THEN 1 ELSE 0 END)::DOUBLE AS c, sum(CASE WHEN sign(a.x - b.x) * sign(a.y - b.y) < 0 THEN 1 ELSE 0 END)::DOUBLE AS d,
  sum(CASE WHEN a.x = b.x THEN 1 ELSE 0 END)::DOUBLE AS tx, sum(CASE WHEN a.y = b.y THEN 1 ELSE 0 END)::DOUBLE AS ty FROM c a JOIN c b ON a.k < b.k)
SELECT (SELECT count(*) FROM c) AS n, c AS concordant, d AS discordant, tx AS ties_x, ty AS ties_y, round((c - d) / sqrt(pairs - tx) / sqrt(pairs - ty), 6) AS tau FROM p"""

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def w8_average_ranks(spark, sf):
    """Ranks of all different values of four measures of the order lines."""
    return R.average_ranks(table(spark, sf, "lineitem"), list(MEASURES))


_AVERAGE_SQL = "WITH m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::DOUBLE AS v FROM lineitem" for c in MEASURES) + """), k AS (SELECT col, v, count(*) AS n FROM m GROUP BY 1, 2)
SELECT col AS column, v, n, (sum(n) OVER (PARTITION BY col ORDER BY v) - (n - 1) / 2.0::DOUBLE)::DOUBLE AS rank FROM k"""


def a10_spearman(spark, sf):
    """Rho of three measures with the price."""
    return _round(R.spearman(table(spark, sf, "lineitem"), [c for c in MEASURES if c != "l_extendedprice"], "l_extendedprice"))


_RHO_SQL = "WITH m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::DOUBLE AS v, l_extendedprice::DOUBLE AS t FROM lineitem" for c in MEASURES if c != "l_extendedprice") + """),
r AS (SELECT col, rank() OVER (PARTITION BY col ORDER BY v) + (count(*) OVER (PARTITION BY col, v) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY col ORDER BY t) + (count(*) OVER (PARTITION BY col, t) - 1) / 2.0::DOUBLE AS y FROM m)
SELECT col AS column, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY col"""


def a22_signed_rank(spark, sf):
    """Whole values of event types, paired by user; p is tested by listing all sign patterns."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.floor(F.col("value")).alias("v"))
    return _round(E.signed_rank(e, "user_id", "event_type", "v").select("a", "b", "n", "w", "z"))


_SIGNED_SQL = """WITH c AS (SELECT user_id AS k, event_type AS g, avg(floor(value)) AS v FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2 HAVING avg(floor(value)) IS NOT NULL),
d AS (SELECT x.g AS a, y.g AS b, x.v - y.v AS d FROM c x JOIN c y ON x.k = y.k AND x.g < y.g),
s AS (SELECT a, b, abs(d) AS size, count(*) AS m, count(*) FILTER (d > 0) AS up FROM d WHERE d <> 0 GROUP BY 1, 2, 3),
r AS (SELECT *, sum(m) OVER (PARTITION BY a, b ORDER BY size) - (m - 1) / 2.0::DOUBLE AS r FROM s),
t AS (SELECT a, b, sum(m)::BIGINT AS n, sum(r * up)::DOUBLE AS w, sum(m::DOUBLE * m * m - m) AS ties FROM r GROUP BY 1, 2)
SELECT p.a, p.b, coalesce(n, 0) AS n, round(coalesce(w, 0), 6) AS w, round((w - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM (SELECT DISTINCT a, b FROM d) p LEFT JOIN t USING (a, b)"""


def w6_running_confidence(spark, sf):
    e = table(spark, sf, "events").withColumn("ok", (F.col("value") > 50).cast("int"))
    day = e.groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.sum("ok").alias("a"), F.sum(1 - F.col("ok")).alias("b"))
    w = Window.partitionBy("event_type").orderBy("day")
    return day.select("event_type", "day", E.confidence(F.sum("a").over(w), F.sum("b").over(w)).alias("confidence"))


_CONF_SQL = """WITH d AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) AS b FROM events GROUP BY 1, 2),
c AS (SELECT event_type, day, sum(a) OVER (PARTITION BY event_type ORDER BY day)::DOUBLE AS a, sum(b) OVER (PARTITION BY event_type ORDER BY day)::DOUBLE AS b FROM d)
SELECT event_type, day, round_even((a + 1) / (a + b + 2) * (1 - exp(-(a + b) / 10.0::DOUBLE)), 4) AS confidence FROM c"""


def w7_budget_routing(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 97).alias("total"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.select("event_id", F.when(F.coalesce(F.sum("total").over(w), F.lit(0)) >= 500, F.lit("fallback")).otherwise(F.lit("primary")).alias("provider"))


_BUDGET_SQL = "SELECT event_id, CASE WHEN coalesce(sum(event_id % 97) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 500 THEN 'fallback' ELSE 'primary' END AS provider FROM events"


def a2_review_stats(spark, sf):
    v, f = F.coalesce("reviewed", F.lit(False)) & ~F.coalesce("needs_review", F.lit(False)), F.coalesce("needs_review", F.lit(False))
    g = gold(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if(v).alias("verified"), F.count_if(f & ~v).alias("flagged"), F.count_if(~v & ~f).alias("unreviewed"), F.count_if("manually_edited").alias("manually_edited"))
    return g.select("*", F.bround(F.col("verified") / F.col("total"), 4).alias("verified_fraction"), (F.col("verified") == F.col("total")).alias("fully_verified"))


_REVIEW_SQL = f"""WITH {GOLD}, v AS (SELECT coalesce(reviewed, false) AND NOT coalesce(needs_review, false) AS v, coalesce(needs_review, false) AS f, manually_edited AS m FROM gold)
SELECT count(*) AS total, count(*) FILTER (v) AS verified, count(*) FILTER (f AND NOT v) AS flagged, count(*) FILTER (NOT v AND NOT f) AS unreviewed, count(*) FILTER (m) AS manually_edited,
  round_even(count(*) FILTER (v)::DOUBLE / count(*), 4) AS verified_fraction, count(*) FILTER (v) = count(*) AS fully_verified FROM v"""


def a29_arm_comparison(spark, sf):
    """Keyword arm against framework B on single labels: accuracies, agreement and who alone is right."""
    g = gold(spark, sf).where(F.size("harms") > 0)
    kw = L.label_records(g).select("doc_id", "harms", "harm_category")
    b = L.framework_predictions(g).where("framework = 'B'").select("doc_id", "harm")
    x = kw.join(b, "doc_id").select(F.array_contains("harms", F.col("harm_category")).alias("a"), F.array_contains("harms", F.col("harm")).alias("b"), (F.col("harm_category") == F.col("harm")).alias("same"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("a").cast("int")), 6).alias("acc_a"), F.round(F.avg(F.col("b").cast("int")), 6).alias("acc_b"), F.round(F.avg(F.col("same").cast("int")), 6).alias("agreement"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))


QUERIES = {f.__name__: f for f in (a6_multi_label, a8_ranking, a9_ordinal, a13_calibration, a16_classification_report, a20_experiment_summary, a21_bootstrap, a21_bootstrap_continuous, a22_cliffs_delta, a22_cliffs_continuous, a11_kendall, w8_average_ranks, a10_spearman, a22_signed_rank, w6_running_confidence, w7_budget_routing, a2_review_stats, a29_arm_comparison)}
ORACLE_SQL = {"a6_multi_label": _MULTI_SQL, "a8_ranking": _RANK_SQL, "a9_ordinal": _ORDINAL_SQL, "a13_calibration": _ECE_SQL, "a16_classification_report": _REPORT_SQL, "a20_experiment_summary": _SUMMARY_SQL, "a22_cliffs_delta": _DELTA_SQL, "a22_cliffs_continuous": _DELTA_ALL_SQL, "a11_kendall": _KENDALL_SQL, "w8_average_ranks": _AVERAGE_SQL, "a10_spearman": _RHO_SQL, "a22_signed_rank": _SIGNED_SQL, "w6_running_confidence": _CONF_SQL, "w7_budget_routing": _BUDGET_SQL, "a2_review_stats": _REVIEW_SQL}
