"""Queries and SQL of labelling, weak supervision and frameworks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dictionaries as D
from ..operators import labeling as L
from .views import GOLD, INCIDENTS, PARENTS, gold, incidents, sql_list, sql_values

_KEYWORDS = sql_values((c, i, k) for i, (c, ks) in enumerate(D.CATEGORIES.items()) for k in ks)
_WORDS = "list_distinct(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+'))"


def _scored(text: str, source: str) -> str:
    return f"""t AS (SELECT doc_id, lower(coalesce({text}, '')) AS t FROM {source}),
tok AS (SELECT doc_id, t, {_WORDS.format("t")} AS w FROM t),
kw(category, ord, k) AS ({_KEYWORDS}),
kws AS (SELECT category, ord, k, {_WORDS.format("k")} AS kw FROM kw),
sc AS (SELECT doc_id, category, ord, sum((CASE WHEN contains(t, k) THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) + 0.5::DOUBLE * len(list_intersect(w, kw))) AS score FROM tok, kws GROUP BY doc_id, category, ord)"""


_LABEL_TEXT = "concat_ws(' ', nullif(description, ''), nullif(raw_title, ''), nullif(raw_body, ''))"
_LABELED = f"""WITH {INCIDENTS}, {_scored(_LABEL_TEXT, "incidents")},
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS r FROM sc),
lab AS (SELECT doc_id, CASE WHEN score < 1.0 THEN 'unknown' ELSE category END AS harm_category, score FROM best WHERE r = 1)"""


def label_incidents(spark, sf):
    return L.label_records(incidents(spark, sf)).select("doc_id", "harm_category", F.col("harm_score_kw").alias("score"))


def a1_label_distribution(spark, sf):
    return L.label_records(incidents(spark, sf)).groupBy(F.coalesce("harm_category", F.lit("unknown")).alias("harm_category")).agg(F.count(F.lit(1)).alias("n"))


def fs3_offline_arm(spark, sf):
    return L.offline_arm(gold(spark, sf)).select("doc_id", F.concat_ws(",", "ranking_pred").alias("ranking_pred"), "predicted_score")


ARM = f"""{_scored("description", "gold")}, {PARENTS},
par AS (SELECT doc_id, coalesce(p.parent, category) AS parent, max(score) AS s FROM sc LEFT JOIN parents p ON p.subtype = category WHERE score >= 1.0 GROUP BY 1, 2),
arm AS (SELECT g.doc_id, coalesce((SELECT string_agg(parent, ',' ORDER BY s DESC, parent) FROM par WHERE par.doc_id = g.doc_id), '') AS ranking_pred,
  (SELECT CASE WHEN max(score) >= 6 THEN 5 WHEN max(score) >= 4 THEN 4 WHEN max(score) >= 2 THEN 3 WHEN max(score) >= 1 THEN 2 ELSE 1 END FROM sc WHERE sc.doc_id = g.doc_id)::BIGINT AS predicted_score FROM gold g)"""


def fs6_weak_labels(spark, sf):
    w = L.weak_labels(incidents(spark, sf))
    j = lambda c: F.concat_ws(",", c).alias(c)
    return w.select("doc_id", j("distress"), "sensitivity", j("sensitive_terms"), "contextual_mismatch", j("parents"))


def _any(col: str, terms) -> str:
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in terms) + ")"


def _re(p: str) -> str:
    return p.replace("'", "''")


def _weak_sql() -> str:
    level = " ".join(f"WHEN {_any('t', ts)} THEN '{n}'" for n, ts in D.SENSITIVITY)
    terms = " ".join(f"WHEN {_any('t', ts)} THEN array_to_string(list_filter({sql_list(ts)}, lambda x: contains(t, x))[1:5], ',')" for _, ts in D.SENSITIVITY)
    parents = ", ".join(f"CASE WHEN regexp_matches(t, '{_re(p)}') THEN '{n}' END" for n, p in D.PARENT_PATTERNS)
    return f"""WITH {INCIDENTS}, t AS (SELECT doc_id, lower(concat_ws(' ', nullif(description, ''), nullif(harm_summary, ''), nullif(raw_body, ''), nullif(raw_title, ''))) AS t FROM incidents)
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '{_re(D.DISTRESS)}'))), ',') AS distress, CASE {level} END AS sensitivity,
  CASE {terms} ELSE '' END AS sensitive_terms, regexp_matches(t, '{_re(D.MISMATCH)}') AS contextual_mismatch, concat_ws(',', {parents}) AS parents FROM t"""


def fs8_frameworks(spark, sf):
    return L.framework_predictions(incidents(spark, sf))


def _frameworks_cte(source: str) -> str:
    t = f"ft AS (SELECT doc_id, lower(coalesce(description, '')) AS t FROM {source})"
    severe, excess = _any("t", ("breach", "exposure", "unauthorized", "leak")), _any("t", ("excessive", "unnecessary"))
    a = f"SELECT doc_id, 'A' AS framework, CASE WHEN {excess} THEN 'aggregation' WHEN {severe} THEN 'insecurity' ELSE 'regulatory_violation' END AS harm, CASE WHEN {severe} THEN 'high' ELSE 'medium' END AS severity, CASE WHEN {excess} THEN 0.7::DOUBLE WHEN {severe} THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM ft"
    rows = sql_values((h, i, w) for i, (h, ws) in enumerate(D.SOLOVE_WORDS) for w in ws)
    b = f"""SELECT doc_id, 'B' AS framework, CASE WHEN n > 0 THEN h ELSE 'regulatory_violation' END AS harm, CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN n >= 3 THEN 0.9::DOUBLE WHEN n >= 2 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence
FROM (SELECT doc_id, h, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS r FROM (SELECT doc_id, h, o, count(*) FILTER (contains(t, w)) AS n FROM ft, ({rows}) v(h, o, w) GROUP BY doc_id, h, o)) WHERE r = 1"""
    n = " + ".join(f"(CASE WHEN {_any('t', p)} THEN 1 ELSE 0 END)" for p in D.PRINCIPLES)
    c = f"SELECT doc_id, 'C' AS framework, CASE WHEN n > 0 THEN 'regulatory_violation' ELSE 'data_handling' END AS harm, CASE WHEN n >= 3 THEN 'critical' WHEN n >= 2 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN n >= 3 THEN 0.85::DOUBLE WHEN n >= 2 THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM (SELECT doc_id, {n} AS n FROM ft)"
    return f"{t}, fw AS ({a} UNION ALL {b} UNION ALL {c})"


def a18_framework_hit_rate(spark, sf):
    g = gold(spark, sf).where(F.size("harms") > 0)
    truth = g.select("doc_id", F.array_distinct(F.transform("harms", lambda h: L.parent_of(h))).alias("truth"))
    p = L.framework_predictions(g).join(truth, "doc_id")
    return p.groupBy("framework").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(F.array_contains("truth", L.parent_of(F.col("harm"))).cast("int")), 4).alias("hit_rate"))


_HIT_SQL = f"""WITH {GOLD}, {PARENTS}, {_frameworks_cte("gold")},
truth AS (SELECT doc_id, list_distinct(list(coalesce(p.parent, h))) AS truth FROM (SELECT doc_id, unnest(harms) AS h FROM gold) LEFT JOIN parents p ON p.subtype = h GROUP BY doc_id)
SELECT framework, count(*) AS n, round_even(avg(CASE WHEN list_contains(truth, coalesce(p.parent, harm)) THEN 1 ELSE 0 END), 4) AS hit_rate
FROM fw JOIN truth USING (doc_id) LEFT JOIN parents p ON p.subtype = harm GROUP BY framework"""


def fs5_relevance(spark, sf):
    i = incidents(spark, sf).select("doc_id", L.relevance(F.col("description")).alias("r"))
    return i.select("doc_id", "r.is_relevant", "r.confidence", F.concat_ws(",", "r.harms").alias("harms"))


RUNGS = sql_values([(s.replace("_", " "), s) for s in D.SUBTYPE_PARENT] + list(D.FALLBACK))


def _relevance_sql() -> str:
    return f"""WITH {INCIDENTS}, t AS (SELECT doc_id, lower(coalesce(description, '')) AS t FROM incidents), v(w, label) AS ({RUNGS}),
h AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS harms FROM (SELECT DISTINCT doc_id, label FROM t, v WHERE contains(t, w)) GROUP BY doc_id)
SELECT t.doc_id, {_any("t", D.RELEVANCE)} AS is_relevant, CASE WHEN {_any("t", D.RELEVANCE)} THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS confidence, coalesce(harms, '') AS harms FROM t LEFT JOIN h USING (doc_id)"""


def fs18_parse_label(spark, sf):
    """Labels of answers in free text that name each record's keyword label."""
    answer = F.concat(F.initcap("harm_category"), F.when(F.col("doc_id") % 2 == 0, F.lit("!\nmore")).otherwise(F.lit(" is the label")))
    d = L.label_records(incidents(spark, sf)).select("doc_id", answer.alias("answer"))
    return d.select("doc_id", L.parse_label(F.col("answer"), D.CATEGORIES).alias("label"))


_PARSE_SQL = f"""{_LABELED}, a AS (SELECT doc_id, upper(harm_category[1]) || substr(harm_category, 2) || CASE WHEN doc_id % 2 = 0 THEN '!' || chr(10) || 'more' ELSE ' is the label' END AS answer FROM lab),
l AS (SELECT doc_id, trim(regexp_replace(lower(split_part(answer, chr(10), 1)), '[^a-z0-9_ -]', '', 'g')) AS line FROM a)
SELECT doc_id, CASE WHEN list_contains({sql_list(D.CATEGORIES)}, line) THEN line ELSE list_filter({sql_list(D.CATEGORIES)}, lambda x: contains(line, x))[1] END AS label FROM l"""

QUERIES = {f.__name__: f for f in (label_incidents, a1_label_distribution, fs3_offline_arm, fs6_weak_labels, fs8_frameworks, a18_framework_hit_rate, fs5_relevance, fs18_parse_label)}
ORACLE_SQL = {
    "label_incidents": _LABELED + " SELECT doc_id, harm_category, score FROM lab",
    "a1_label_distribution": _LABELED + " SELECT harm_category, count(*) AS n FROM lab GROUP BY harm_category",
    "fs3_offline_arm": f"WITH {GOLD}, {ARM} SELECT * FROM arm",
    "fs6_weak_labels": _weak_sql(),
    "fs8_frameworks": f"WITH {INCIDENTS}, {_frameworks_cte('incidents')} SELECT * FROM fw",
    "a18_framework_hit_rate": _HIT_SQL,
    "fs5_relevance": _relevance_sql(),
    "fs18_parse_label": _PARSE_SQL,
}
