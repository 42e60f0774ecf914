"""Queries and SQL of features, scores, rules and mitigations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions.text import canonical_date, truncate_words
from ..operators import features as X
from ..operators import labeling as L
from .q_labeling import RUNGS, _scored
from .views import INCIDENTS, incidents, sql_list, sql_values, table

PLAIN = ("doc_id", "f_individuals_log", "f_has_description", "rc_risky", "rc_protective", "rc_ratio", "rc_net")


def ff_features(spark, sf):
    f = X.build_features(incidents(spark, sf))
    flags = [c for c in f.columns if c.startswith(("kw_", "pair_"))]
    return f.select("doc_id", F.round("f_individuals_log", 6).alias("f_individuals_log"), *PLAIN[2:5], F.round("rc_ratio", 6).alias("rc_ratio"), "rc_net", F.concat_ws(",", "product_features").alias("product_features"), *flags)


def _any(col, terms):
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in terms) + ")"


def _pf(t):
    each = []
    for slug, terms, pattern in D.ONTOLOGY:
        hit = _any(t, terms) + (f" OR regexp_matches({t}, '{pattern}')" if pattern else "")
        each.append(f"CASE WHEN {hit} THEN '{slug}' END")
    return f"list_filter([{', '.join(each)}], lambda x: x IS NOT NULL)"


FEATURES = f"""ft AS (SELECT *, lower(concat_ws(' ', nullif(description, ''), nullif(raw_title, ''), nullif(raw_body, ''))) AS t FROM incidents),
fp AS (SELECT *, {_pf("t")} AS pf FROM ft),
fr AS (SELECT *, len(list_intersect(pf, {sql_list(D.RISKY)}))::INTEGER AS risky, len(list_intersect(pf, {sql_list(D.PROTECTIVE)}))::INTEGER AS protective,
  try_cast(CASE WHEN individuals_affected IS NULL OR individuals_affected = '0' THEN num_users ELSE individuals_affected END AS DOUBLE) AS n FROM fp)"""
_KW = ", ".join(f"CASE WHEN {_any('t', ts)} THEN 1 ELSE 0 END AS kw_{g}" for g, ts in D.KEYWORD_GROUPS.items())
_PAIR = ", ".join(f"CASE WHEN list_contains(pf, '{a}') AND list_contains(pf, '{b}') THEN 1 ELSE 0 END AS pair_{a}__{b}" for a, b in D.PAIRS)
_FEATURES_SQL = f"""WITH {INCIDENTS}, {FEATURES}
SELECT doc_id, round(CASE WHEN n > 0 THEN ln(1 + n) ELSE 0.0::DOUBLE END, 6) AS f_individuals_log, CASE WHEN coalesce(description, '') <> '' THEN 1 ELSE 0 END AS f_has_description,
  risky AS rc_risky, protective AS rc_protective, round(CASE WHEN risky + protective > 0 THEN risky::DOUBLE / (risky + protective) ELSE 0.0::DOUBLE END, 6) AS rc_ratio, risky - protective AS rc_net,
  array_to_string(pf, ',') AS product_features, {_KW}, {_PAIR} FROM fr"""


def ff7_causal_phrases(spark, sf):
    c = incidents(spark, sf).select("doc_id", X.causal_phrases(F.col("description")).alias("c"))
    return c.select("doc_id", F.concat_ws(",", "c.indicators").alias("indicators"), F.concat_ws("|", "c.causes").alias("causes"))


def _causal_sql():
    each = ", ".join(f"list_transform(regexp_extract_all(t, '{p}', 1), lambda c: {{'n': '{n}', 'c': trim(c)}})" for n, p in D.CAUSAL)
    return f"""WITH {INCIDENTS}, t AS (SELECT doc_id, lower(coalesce(description, '')) AS t FROM incidents),
k AS (SELECT doc_id, list_filter(flatten([{each}]), lambda x: length(x.c) > 5 AND length(x.c) < 200) AS k FROM t)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(k, lambda x: x.n))), ',') AS indicators, array_to_string(list_transform(k, lambda x: x.c)[1:10], '|') AS causes FROM k"""


HYBRID = ("model_inversion", "training_data_extraction", "synthetic_media_misuse", "provenance_failure", "gdpr_art_83", "surveillance_overreach", "other")


def _categories():
    pick = lambda i: F.element_at(F.array(*[F.lit(c) for c in HYBRID]), (i % len(HYBRID) + 1).cast("int"))
    d = F.col("doc_id")
    return F.when(d % 10 == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(pick(d), pick(d * 3 + 1), pick(d * 5 + 2))))


_CATS = f"cats AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN []::VARCHAR[] ELSE list_distinct([{', '.join(f'{sql_list(HYBRID)}[({e}) % {len(HYBRID)} + 1]' for e in ('doc_id', 'doc_id * 3 + 1', 'doc_id * 5 + 2'))}]) END AS cats FROM documents)"


def fs11_risk_score(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _categories().alias("cats"), (F.col("doc_id") % 13).alias("kws"))
    s = d.select("doc_id", F.round(X.risk_score(F.col("cats"), F.col("kws")), 6).alias("risk"), F.explode(X.framework_shares(F.col("cats"))).alias("x"))
    return s.select("doc_id", "risk", "x.framework", "x.share")


_HINTS = sql_values((c, h) for c, hs in D.HINTS.items() for h in hs)
_RISK_SQL = f"""WITH {_CATS}, w(c, w) AS ({sql_values((c, f"{x}") for c, x in D.WEIGHTS.items())}), hints(c, h) AS ({_HINTS}),
x AS (SELECT doc_id, unnest(cats) AS c FROM cats),
risk AS (SELECT doc_id, sum(coalesce(CAST(w.w AS DOUBLE), 0.5::DOUBLE)) AS s FROM x LEFT JOIN w USING (c) GROUP BY doc_id),
hit AS (SELECT doc_id, h FROM x JOIN hints USING (c) UNION ALL SELECT doc_id, unnest(CASE WHEN contains(c, 'gdpr') THEN ['GDPR'] WHEN contains(c, 'surveillance') THEN ['Solove', 'Zuboff'] ELSE []::VARCHAR[] END) FROM x WHERE c NOT IN (SELECT c FROM hints)),
f(framework) AS ({sql_values((f,) for f in D.FRAMEWORKS)}),
n AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
s AS (SELECT doc_id, framework, count(*) FILTER (contains(h, framework)) AS k FROM hit, f GROUP BY doc_id, framework)
SELECT c.doc_id, round(least(10.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(risk.s, 0) + least(5.0::DOUBLE, (c.doc_id % 13) * 0.5::DOUBLE))), 6) AS risk, f.framework, coalesce(round_even(s.k * 100.0::DOUBLE / n.n, 1), 0.0::DOUBLE) AS share
FROM cats c CROSS JOIN f LEFT JOIN risk USING (doc_id) LEFT JOIN s ON s.doc_id = c.doc_id AND s.framework = f.framework LEFT JOIN n ON n.doc_id = c.doc_id"""


def fs13_composite(spark, sf):
    d = F.col("doc_id")
    dims = [(d * k % 11) / F.lit(10.0) for k in (1, 3, 7)] + [F.when(d % 29 == 0, F.lit(1.5)).otherwise((d * 9 % 11) / F.lit(10.0))]
    return table(spark, sf, "documents").select("doc_id", F.round(X.composite(dims), 6).alias("composite"))


_DIMS = ["(doc_id % 11)::DOUBLE / 10.0::DOUBLE", "(doc_id * 3 % 11)::DOUBLE / 10.0::DOUBLE", "(doc_id * 7 % 11)::DOUBLE / 10.0::DOUBLE", "CASE WHEN doc_id % 29 = 0 THEN 1.5::DOUBLE ELSE (doc_id * 9 % 11)::DOUBLE / 10.0::DOUBLE END"]
_COMPOSITE_SQL = f"""WITH d AS (SELECT doc_id, {", ".join(f"{e} AS d{i}" for i, e in enumerate(_DIMS))} FROM documents)
SELECT doc_id, CASE WHEN d3 <= 1 THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, exp(({" + ".join(f"ln(d{i} + 1e-6::DOUBLE) * {w}::DOUBLE" for i, w in enumerate(D.DIMENSION_WEIGHTS))}) / {sum(D.DIMENSION_WEIGHTS)}::DOUBLE) - 1e-6::DOUBLE)), 6) END AS composite FROM d"""


def r2_select_rules(spark, sf):
    return X.select_rules(X.detect_context(incidents(spark, sf)), X.rules_frame(spark), 5)


def _ladder(col, ladder):
    return "CASE " + " ".join(f"WHEN {_any(col, ts)} THEN '{n}'" for n, ts in ladder) + " END"


_RULES_SQL = f"""WITH {INCIDENTS}, c AS (SELECT doc_id, coalesce(jurisdiction, {_ladder("lower(coalesce(description, ''))", D.JURISDICTIONS)}) AS j, coalesce(sector, {_ladder("lower(coalesce(description, ''))", D.SECTORS)}) AS s, language AS l FROM incidents),
r(rule_id, j, s, l, p) AS (VALUES {", ".join(f"('{r[0]}', {sql_list(r[2])}::VARCHAR[], {sql_list(r[3])}::VARCHAR[], {sql_list(r[4])}::VARCHAR[], {r[7]}::DOUBLE)" for r in D.RULES)}),
sc AS (SELECT doc_id, rule_id, p + CASE WHEN len(r.j) > 0 AND c.j IS NOT NULL THEN CASE WHEN list_contains(r.j, c.j) THEN 1.5::DOUBLE ELSE -1.0::DOUBLE END ELSE 0 END
  + CASE WHEN len(r.s) > 0 AND c.s IS NOT NULL THEN CASE WHEN list_contains(r.s, c.s) THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END ELSE 0 END
  + CASE WHEN len(r.l) > 0 AND c.l IS NOT NULL AND list_contains(r.l, c.l) THEN 0.5::DOUBLE ELSE 0 END AS score FROM c, r),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rule_id)::INTEGER AS rank FROM sc WHERE score > 0)
SELECT doc_id, rule_id, rank, score FROM k WHERE rank <= 5"""


def a24_mitigations(spark, sf):
    return X.mitigations(X.build_features(incidents(spark, sf)))


_MIT = [(r, m, p, D.EFFECTIVENESS.get(m, 0.5), D.PAIR_EFFECTIVENESS.get((r, m))) for r, pair in D.MITIGATIONS.items() for ms, p in ((pair[0], 1), (pair[1], 0)) for m in ms]
_RISKS = f"""m(risk, m, p, a, c) AS ({sql_values(_MIT)}), rw(risk, weight) AS ({sql_values(D.RISK_WEIGHTS.items())}),
x AS (SELECT doc_id, unnest(list_intersect(pf, {sql_list(D.RISKY)})) AS risk FROM fr)"""
_MIT_SQL = f"""WITH {INCIDENTS}, {FEATURES}, {_RISKS},
y AS (SELECT doc_id, x.risk, m, p, coalesce(c::DOUBLE, CASE p WHEN 1 THEN {D.PRIMARY_EFFECT}::DOUBLE ELSE {D.SECONDARY_EFFECT}::DOUBLE END) AS e, max(p) OVER (PARTITION BY doc_id, m) AS top FROM x JOIN m USING (risk)),
z AS (SELECT doc_id, m AS mitigation, max(p) = 1 AS is_primary, round(avg(e), 6) AS effectiveness, string_agg(DISTINCT risk, ',' ORDER BY risk) FILTER (p = top) AS risks FROM y GROUP BY doc_id, m)
SELECT *, row_number() OVER (PARTITION BY doc_id, is_primary ORDER BY effectiveness DESC, mitigation)::INTEGER AS place FROM z"""


def r11_recommendations(spark, sf):
    """Mitigations of each risky feature with their scores; risks without any keep a row."""
    return X.recommendations(X.build_features(incidents(spark, sf)))


_REC_SQL = f"""WITH {INCIDENTS}, {FEATURES}, {_RISKS}
SELECT doc_id, x.risk, coalesce(weight::DOUBLE, {D.NO_RISK_WEIGHT}::DOUBLE) AS weight, m AS mitigation, p = 1 AS is_primary, a::DOUBLE AS alone, CASE WHEN m IS NOT NULL THEN coalesce(c::DOUBLE, 0.5::DOUBLE) END AS combined, c::DOUBLE AS pair
FROM x LEFT JOIN m USING (risk) LEFT JOIN rw USING (risk)"""


def fd1_canonical_date(spark, sf):
    return incidents(spark, sf).select("doc_id", canonical_date(F.col("incident_date")).alias("incident_date"))


_DATE_SQL = f"""WITH {INCIDENTS}, d AS (SELECT doc_id, incident_date AS v, replace(incident_date, 'Z', '') AS z FROM incidents)
SELECT doc_id, CASE WHEN v IS NULL OR v = '' THEN NULL WHEN v LIKE '#%' THEN strftime(to_timestamp(CAST(substr(v, 2) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%d')
  WHEN length(v) = 10 AND v[5] = '-' AND v[8] = '-' THEN v
  ELSE coalesce(strftime(try_strptime(z, '%m/%d/%Y'), '%Y-%m-%d'), strftime(try_strptime(z, '%Y-%m-%d'), '%Y-%m-%d'), strftime(try_strptime(z, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%d')) END AS incident_date FROM d"""


def fd2_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(truncate_words(F.coalesce("text", F.lit("")), 200), 256).alias("short_sha"))


_TRUNCATE_SQL = "SELECT doc_id, sha256(CASE WHEN length(coalesce(text, '')) <= 200 THEN coalesce(text, '') ELSE regexp_replace(substr(text, 1, 200), ' [^ ]*$', '') || '...' END) AS short_sha FROM documents"


def j15_validated_harms(spark, sf):
    """Fallback labels kept where the keyword score is at least 0.5, and those rejected."""
    s = L.with_category_scores(incidents(spark, sf), F.col("description")).withColumn("p", L.relevance(F.col("description"))["harms"])
    good = F.transform(F.filter("scores", lambda x: x["score"] >= 0.5), lambda x: x["category"])
    return s.select("doc_id", F.concat_ws(",", F.array_sort(F.array_intersect("p", good))).alias("kept"), F.concat_ws(",", F.array_sort(F.array_except("p", good))).alias("rejected"))


_VALIDATED_SQL = f"""WITH {INCIDENTS}, {_scored("description", "incidents")}, v(w, label) AS ({RUNGS}),
p AS (SELECT DISTINCT t.doc_id, label FROM t, v WHERE contains(t, w)),
k AS (SELECT p.doc_id, p.label, coalesce(sc.score, 0) >= 0.5 AS good FROM p LEFT JOIN sc ON sc.doc_id = p.doc_id AND sc.category = p.label)
SELECT i.doc_id, coalesce(string_agg(label, ',' ORDER BY label) FILTER (good), '') AS kept, coalesce(string_agg(label, ',' ORDER BY label) FILTER (NOT good), '') AS rejected
FROM incidents i LEFT JOIN k ON k.doc_id = i.doc_id GROUP BY i.doc_id"""

QUERIES = {f.__name__: f for f in (ff_features, ff7_causal_phrases, fs11_risk_score, fs13_composite, r2_select_rules, a24_mitigations, r11_recommendations, fd1_canonical_date, fd2_truncate, j15_validated_harms)}
ORACLE_SQL = {"ff_features": _FEATURES_SQL, "ff7_causal_phrases": _causal_sql(), "fs11_risk_score": _RISK_SQL, "fs13_composite": _COMPOSITE_SQL, "r2_select_rules": _RULES_SQL, "a24_mitigations": _MIT_SQL, "r11_recommendations": _REC_SQL, "fd1_canonical_date": _DATE_SQL, "fd2_truncate": _TRUNCATE_SQL, "j15_validated_harms": _VALIDATED_SQL}
