"""Queries and SQL of training data, arms, rule items and saved results."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dictionaries as D
from ..operators import arms as A
from ..operators import dataset as T
from ..operators import evaluation as E
from ..operators import features as X
from ..operators import heuristics as H
from ..operators import inference as N
from ..operators import labeling as L
from ..operators import ml as M
from ..sources import dictionaries as S
from ..sources import sinks as K
from ..streaming import jobs
from .q_features import FEATURES, _any, _pf
from ..sources.steps import scratch
from .q_labeling import _LABELED, RUNGS, _scored
from .q_ml import FLAGS, _features, _frame, _lines
from .views import GOLD, INCIDENTS, gold, incidents, sql_list, sql_values, table


def p3_model_text(spark, sf):
    i = incidents(spark, sf)
    return i.select("doc_id", F.sha2(A.model_text(F.col("description"), F.col("harm_summary"), F.col("raw_title")), 256).alias("sha"))


_TEXT_SQL = f"WITH {INCIDENTS} SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), nullif(trim(description, ' '), ''), nullif(trim(harm_summary, ' '), ''), nullif(trim(raw_title, ' '), ''))) AS sha FROM incidents"


def p16_label_missing(spark, sf):
    """Records that are labelled already keep their label."""
    i = incidents(spark, sf).withColumn("harm_category", F.when(F.col("doc_id") % 3 == 0, F.lit("kept")))
    return L.label_missing(i).select("doc_id", "harm_category")


def p19_truth(spark, sf):
    i = F.col("doc_id")
    g = gold(spark, sf).withColumn("causes", F.when(i % 8 == 3, F.array(F.lit("cause"))))
    t = g.select("doc_id", A.truth(F.col("harms"), F.col("causes"), F.when(i % 8 == 7, F.col("source")), F.when(i % 2 == 0, F.array(F.lit("first"))), F.when(i % 5 != 0, F.col("harm_score"))).alias("t"))
    return t.select("doc_id", F.concat_ws(",", "t.labels").alias("labels"), F.concat_ws(",", "t.ranking").alias("ranking"), F.col("t.score").cast("long").alias("score"))


_TRUTH_SQL = f"""WITH {GOLD} SELECT doc_id, CASE WHEN len(harms) > 0 THEN array_to_string(harms, ',') WHEN doc_id % 8 = 3 THEN 'cause' ELSE source END AS labels,
CASE WHEN doc_id % 2 = 0 THEN 'first' WHEN len(harms) > 0 THEN array_to_string(harms, ',') WHEN doc_id % 8 = 7 THEN source ELSE '' END AS ranking, CASE WHEN doc_id % 5 <> 0 THEN harm_score ELSE 0 END::BIGINT AS score FROM gold"""


def a7_multi_hot(spark, sf):
    """Category flags of the keyword scores against those of the gold labels."""
    s = L.with_category_scores(gold(spark, sf), F.col("description"))
    names = list(D.CASCADE)
    over = F.transform(F.filter("scores", lambda x: x["score"] >= 1), lambda x: x["category"])
    hot = lambda c: F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(c, n).cast("int"))
    m = A.multi_hot_metrics(s.select(hot(F.col("harms")).alias("t"), hot(over).alias("p")), "t", "p")
    return m.select("n", F.round("hamming", 6).alias("hamming"), F.round("macro_f1", 6).alias("macro_f1"))


_HOT_SQL = f"""WITH {GOLD}, {_scored("description", "gold")}, c(name) AS ({sql_values((n,) for n in D.CASCADE)}),
x AS (SELECT g.doc_id, c.name, CASE WHEN list_contains(g.harms, c.name) THEN 1 ELSE 0 END AS t, CASE WHEN EXISTS (SELECT 1 FROM sc WHERE sc.doc_id = g.doc_id AND sc.category = c.name AND sc.score >= 1) THEN 1 ELSE 0 END AS p FROM gold g, c),
k AS (SELECT name, count(*) AS n, sum(CASE WHEN t <> p THEN 1 ELSE 0 END) AS off, sum(t * p) AS tp, sum(t + p) AS s FROM x GROUP BY name)
SELECT max(n) AS n, round(sum(off)::DOUBLE / sum(n), 6) AS hamming, round(avg(CASE WHEN s > 0 THEN 2.0::DOUBLE * tp / s ELSE 0 END), 6) AS macro_f1 FROM k"""


def ff6_annotate(spark, sf):
    x = X.annotate(X.build_features(incidents(spark, sf)).drop("causal"), ("harm_summary", "raw_body"))
    return x.select("doc_id", F.concat_ws(",", "product_features").alias("product_features"), F.col("root_cause_features").isNotNull().alias("has_causes"), F.coalesce(F.size("causal.causes"), F.lit(0)).alias("n_causes"))


_ANNOTATE_SQL = f"""WITH {INCIDENTS}, {FEATURES}, u AS (SELECT doc_id, pf AS old, lower(concat_ws(' ', nullif(harm_summary, ''), nullif(raw_body, ''))) AS u FROM fr),
n AS (SELECT doc_id, u, CASE WHEN u <> '' THEN {_pf("u")} ELSE old END AS pf FROM u),
k AS (SELECT doc_id, pf, len(list_filter(flatten([{", ".join(f"regexp_extract_all(u, '{p}', 1)" for _, p in D.CAUSAL)}]), lambda c: length(trim(c)) > 5 AND length(trim(c)) < 200)) AS k FROM n)
SELECT doc_id, array_to_string(pf, ',') AS product_features, len(pf) > 0 AS has_causes, least(k, 10)::INTEGER AS n_causes FROM k"""


def ff15_target_matrix(spark, sf):
    """Positive rows of each category, from the gold labels, else the predicted ones."""
    g = L.label_records(gold(spark, sf))
    m = g.select(*[c.alias(n) for n, c in T.target_matrix([F.col("harms"), F.array("harm_category")]).items()])
    totals = m.agg(*[F.sum(n).alias(n) for n in D.CASCADE])
    return totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("category"), F.col(n).alias("n")) for n in D.CASCADE])).alias("x")).select("x.*")


_MATRIX_SQL = f"""{_LABELED.replace(INCIDENTS, GOLD)}, c(category) AS ({sql_values((n,) for n in D.CASCADE)}), tt AS (SELECT CASE WHEN len(g.harms) > 0 THEN g.harms ELSE [lab.harm_category] END AS tt FROM gold g JOIN lab USING (doc_id))
SELECT category, count(*) FILTER (list_contains(tt, category)) AS n FROM c, tt GROUP BY category"""


def ff16_questions(spark, sf):
    """Questions of the features that incidents have, with the incidents."""
    f = X.build_features(incidents(spark, sf))
    names = [c for c in f.columns if c.startswith("kw_")] + ["f_has_description"]
    found = f.select(F.explode(F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in names]))).alias("feature"))
    n = found.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return n.select("feature", H.question(F.col("feature")).alias("question"), "n")


_QUESTION = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.QUESTIONS.items()) + f" ELSE 'Does this involve ' || replace(replace(replace({c}, 'kw_', ''), 'f_', ''), '_', ' ') || '?' END"
_QUESTIONS_SQL = f"""WITH {INCIDENTS}, {FEATURES}, x AS (SELECT unnest(list_filter([{", ".join(f"CASE WHEN {_any('t', ts)} THEN 'kw_{g}' END" for g, ts in D.KEYWORD_GROUPS.items())}, CASE WHEN coalesce(description, '') <> '' THEN 'f_has_description' END], lambda v: v IS NOT NULL)) AS feature FROM fr)
SELECT feature, {_QUESTION("feature")} AS question, count(*) AS n FROM x GROUP BY feature"""


def u6_head_and_stratified(spark, sf):
    return T.head_and_stratified(incidents(spark, sf).select("doc_id", "source"), "source", "doc_id", 50, 60).select("doc_id", "source")


_HEAD_SQL = f"""WITH {INCIDENTS}, h AS (SELECT doc_id, source FROM incidents ORDER BY doc_id LIMIT 50), rest AS (SELECT doc_id, source FROM incidents WHERE doc_id NOT IN (SELECT doc_id FROM h)),
n AS (SELECT source, count(*) AS n FROM rest GROUP BY 1), w AS (SELECT source, least(n, greatest(10, CAST(round_even(n::DOUBLE / (SELECT count(*) FROM rest) * 60, 0) AS BIGINT))) AS want FROM n),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s|' || source || '|' || doc_id), doc_id) AS r FROM rest)
SELECT * FROM h UNION ALL SELECT doc_id, source FROM r JOIN w USING (source) WHERE r <= want"""


def fs7_taxonomy_items(spark, sf):
    """Taxonomy rules with the incidents that hold their term."""
    items = H.taxonomy_items(spark).select("text", F.regexp_extract("text", "'(.*)'", 1).alias("term")).where(~F.col("term").contains("\\"))
    t = incidents(spark, sf).select(F.lower(F.coalesce("description", F.lit(""))).alias("t"))
    terms = sorted({x for _, ts in D.SENSITIVITY for x in ts} | {x for x in D.DISTRESS[3:-3].split("|") if "\\" not in x})
    hits = t.select(F.explode(F.filter(F.array(*[F.lit(x) for x in terms]), lambda x: F.contains(F.col("t"), x))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return items.join(hits, "term", "left").select("text", F.coalesce("n", F.lit(0)).alias("n"))


_ITEMS = [(f"IF text contains '{t}' THEN sensitivity={lv.upper()}", t) for lv, ts in D.SENSITIVITY for t in ts] + [(f"IF text contains '{t}' THEN harm=DISTRESS", t) for t in D.DISTRESS[3:-3].split("|") if "\\" not in t]
_ITEMS_SQL = f"WITH {INCIDENTS}, tt AS (SELECT lower(coalesce(description, '')) AS t FROM incidents), v(text, term) AS ({sql_values(_ITEMS)}) SELECT text, count(*) FILTER (contains(t, term)) AS n FROM v, tt GROUP BY text, term"


def fs12_hybrid_score(spark, sf):
    s = A.hybrid_score(incidents(spark, sf), "doc_id", "description")
    return s.select("doc_id", F.concat_ws(",", "harms").alias("harms"), F.concat_ws(",", "rejected").alias("rejected"), F.round("score", 6).alias("score"))


_HYBRID_SQL = f"""WITH {INCIDENTS}, {_scored("description", "incidents")}, v(w, label) AS ({RUNGS}), w(label, x) AS ({sql_values((c, f"{x}") for c, x in D.WEIGHTS.items())}),
p AS (SELECT DISTINCT t.doc_id, label FROM t, v WHERE contains(t, w)),
k AS (SELECT p.doc_id, p.label, coalesce(sc.score, 0) >= 0.5 AS good, coalesce(CAST(w.x AS DOUBLE), 0.5::DOUBLE) AS x FROM p LEFT JOIN sc ON sc.doc_id = p.doc_id AND sc.category = p.label LEFT JOIN w ON w.label = p.label)
SELECT i.doc_id, coalesce(string_agg(label, ',' ORDER BY label) FILTER (good), '') AS harms, coalesce(string_agg(label, ',' ORDER BY label) FILTER (NOT good), '') AS rejected, round(least(10.0::DOUBLE, coalesce(sum(x) FILTER (good), 0)) * 10, 6) AS score
FROM incidents i LEFT JOIN k ON k.doc_id = i.doc_id GROUP BY i.doc_id"""

JUDGED = ("insecurity", "surveillance", "location", "health")


def z6_judgments(spark, sf):
    """Judgments by a function in the place of a model, which answers some prompts with a label and others with nothing."""
    d = incidents(spark, sf).select("doc_id", "description", F.element_at(F.array(*[F.lit(x) for x in JUDGED]), (F.col("doc_id") % 4 + 1).cast("int")).alias("truth"))

    def load():
        return lambda prompts: ["Health indeed" if "hospital" in p.lower() else "no idea" for p in prompts]

    return A.judgments(d, "description", "truth", JUDGED, load).select("doc_id", "predicted", "correct")


_JUDGE_SQL = f"""WITH {INCIDENTS}, j AS (SELECT doc_id, lower(coalesce(description, '')) AS t, lower(coalesce(substr(description, 1, 8000), '')) AS asked, {sql_list(JUDGED)}[doc_id % 4 + 1] AS truth FROM incidents),
p AS (SELECT *, CASE WHEN contains(asked, 'hospital') THEN 'health' {" ".join(f"WHEN {_any('t', ws)} THEN '{n}'" for n, ws in D.CHECKS if n in JUDGED)} ELSE '{JUDGED[0]}' END AS predicted FROM j)
SELECT doc_id, predicted, predicted = truth AS correct FROM p"""


def z4_arms(spark, sf):
    """Prompts of all arms and how a function in the place of a model answers them."""
    i = incidents(spark, sf)
    blocks = H.rule_blocks(X.select_rules(X.detect_context(i), X.rules_frame(spark), 3), X.rules_frame(spark))
    cases = L.label_records(i).join(blocks, "doc_id", "left").select("doc_id", "description", "block", "harm_category")

    def load():
        return lambda prompts: ['{"relevant": %s, "harms": ["%s"], "confidence": 0.5}' % (str("Rules:" in p).lower(), "insecurity" if "Deterministic output: insecurity" in p else "none") for p in prompts]

    r = A.run_arms(A.arm_prompts(cases, "doc_id", "description", "block", "harm_category"), ("insecurity",), load)
    return r.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("relevant").alias("relevant"), F.sum(F.size("harms")).alias("harms"))


_ARMS_SQL = _LABELED + f""", m(mode) AS ({sql_values((m,) for m in A.MODES)})
SELECT mode, count(*) AS n, count(*) FILTER (mode = 'rules_static') AS relevant, count(*) FILTER (mode = 'deterministic_first' AND harm_category = 'insecurity') AS harms FROM m, lab GROUP BY mode"""


def ff10_extraction(spark, sf):
    """Labels and spans of extractor answers that are made from the documents."""
    raw = F.concat(F.lit('{"labels": ["'), F.col("lang"), F.lit('", {"label": "'), F.coalesce("source", F.lit("none")), F.lit('", "confidence": 0.25}], "entities": {"size": [{"text": "'), F.col("n_chars").cast("string"), F.lit('", "confidence": 0.5}, "x"]}}'))
    d = table(spark, sf, "documents").select("doc_id", A.extraction_result(F.when(F.col("doc_id") % 9 != 0, raw).otherwise(F.lit("broken"))).alias("x"))
    labels = F.transform("x.text_labels", lambda v: F.concat_ws(":", v["label"], v["confidence"].cast("string")))
    spans = F.transform("x.span_labels", lambda v: F.concat_ws(":", v["label"], v["span"], v["score"].cast("string")))
    return d.select("doc_id", F.concat_ws(",", labels).alias("labels"), F.concat_ws(",", spans).alias("spans"))


_EXTRACT_SQL = """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE lang || ':1.0,' || coalesce(source, 'none') || ':0.25' END AS labels,
CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'size:' || n_chars || ':0.5,size:x:1.0' END AS spans FROM documents"""


def t2_stream_enrichment(spark, sf):
    """Incidents that arrive as files, labelled and featured as a stream; the final table."""
    root = scratch(spark)
    i = incidents(spark, sf)
    i.write.parquet(f"{root}/in")
    out = jobs.enrich(spark.readStream.schema(i.schema).parquet(f"{root}/in")).select("doc_id", "harm_category", "rc_risky")
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


_STREAM_SQL = _LABELED + f", {FEATURES} SELECT lab.doc_id, harm_category, risky AS rc_risky FROM lab JOIN fr ON fr.doc_id = lab.doc_id"


def s8_weights(spark, sf):
    """Default weights under weights calibrated from the sources' share of documents."""
    names = list(D.WEIGHTS)
    d = table(spark, sf, "documents").groupBy((F.col("doc_id") % (len(names) + 2)).alias("k")).agg(F.round(F.avg("n_chars") / 1e6, 6).alias("weight"))
    c = d.where("k % 2 = 0").select(F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), F.col("k").cast("int")), F.concat(F.lit("new_"), F.col("k").cast("string"))).alias("category"), "weight")
    return S.overlay_weights(spark.createDataFrame(list(D.WEIGHTS.items()), "category string, weight double"), c)


_WEIGHTS_SQL = f"""WITH w(category, weight) AS ({sql_values((c, f"{x}") for c, x in D.WEIGHTS.items())}), d AS (SELECT doc_id % {len(D.WEIGHTS) + 2} AS k, round(avg(n_chars) / 1e6::DOUBLE, 6) AS weight FROM documents GROUP BY 1),
c AS (SELECT coalesce({sql_list(D.WEIGHTS)}[k + 1], 'new_' || k) AS category, weight FROM d WHERE k % 2 = 0)
SELECT coalesce(w.category, c.category) AS category, coalesce(c.weight, w.weight::DOUBLE) AS weight FROM w FULL JOIN c ON w.category = c.category"""


def k7_saved_report(spark, sf):
    """A classification report of the keyword labels against the gold labels, saved as a long table and read back."""
    g = L.label_records(gold(spark, sf).where(F.size("harms") > 0)).select(F.col("harms")[0].alias("t"), F.col("harm_category").alias("p"))
    path = f"{scratch(spark)}/report"
    K.save_report(K.long_report(E.classification_report(g, "t", "p"), "keywords"), path)
    return spark.read.parquet(path).where("label not in ('accuracy', 'macro avg', 'weighted avg')").select("runner", "label", "metric", F.round("value", 6).alias("value"))


_SAVED_SQL = f"""{_LABELED.replace(INCIDENTS, GOLD)}, r AS (SELECT g.harms[1] AS t, harm_category AS p FROM gold g JOIN lab USING (doc_id) WHERE len(g.harms) > 0), l AS (SELECT t AS label FROM r UNION SELECT p FROM r),
c AS (SELECT label, (SELECT count(*) FROM r WHERE t = label)::DOUBLE AS support, (SELECT count(*) FROM r WHERE p = label)::DOUBLE AS said, (SELECT count(*) FROM r WHERE p = label AND t = label)::DOUBLE AS tp FROM l)
SELECT 'keywords' AS runner, label, unnest(['precision', 'recall', 'f1', 'support']) AS metric, unnest([round(CASE WHEN said > 0 THEN tp / said ELSE 0 END, 6), round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6), round(2 * tp / (said + support), 6), support]) AS value FROM c"""


def k9_saved_model(spark, sf):
    """A tree saved with its metrics, loaded again and scored: one report with the heuristic beside it, models ranked."""
    d = _lines(spark, sf).withColumn("y", (F.col("l_extendedprice") > 30000).cast("string"))
    train, test = T.split_dataset(d, "y", "k")
    cols, path = ["l_quantity", "l_discount", "l_tax"], f"{scratch(spark)}/bundle"
    fitted = M.fit_classifier(train, cols, "y", "tree", depth=4)
    K.save_bundle(fitted, path, train.select("k", *cols, "y"), M.evaluate_fitted(fitted, test, "y"), {"depth": 4})
    loaded, _ = K.load_bundle(spark, path)
    report = M.evaluate_models({"tree": loaded}, test, "y", (F.col("l_quantity") > 25).cast("string"))
    pick = lambda label: F.max(F.when(F.col("label") == label, F.col("f1")))
    return H.rank_models(report.groupBy("runner").agg(pick("macro avg").alias("macro_f1"), pick("accuracy").alias("accuracy")), "runner", "macro_f1", "accuracy")


def m8_root_causes(spark, sf):
    d = _frame(spark, sf)
    return M.sentiment_model(d, T.root_cause_columns(d), "sentiment_score", "doc_id")["directions"].select("feature", "weight", "odds_ratio", "direction")


def m9_mitigation_effects(spark, sf):
    d = _frame(spark, sf)
    return M.sentiment_model(d, T.root_cause_columns(d), "sentiment_score", "doc_id", positive=True)["directions"]


def r9_heuristics(spark, sf):
    """The best rule items of a tree, a rule list, a Bayes tree and an additive model."""
    d = _features(spark, sf).withColumn("y", F.col("danger").cast("string"))
    tree = M.tree_rules(M.fit_classifier(d, list(FLAGS), "y", "tree", depth=3), d, "y")
    items = [H.tree_items(tree), H.rule_list_items(spark, M.rule_list(d, list(FLAGS), "danger", 4)), H.edge_items(spark, M.chow_liu(d, [*FLAGS, "danger"], "danger"))]
    return H.extract([*items, H.term_items(spark, M.fit_classifier(d, list(FLAGS), "y", "additive", rounds=5))])


def m17_shapley(spark, sf):
    d = _lines(spark, sf).withColumn("y", (F.col("l_extendedprice") > 30000).cast("string"))
    return M.sampled_shapley(d, M.fit_classifier(d, ["l_quantity", "l_discount", "l_tax"], "y", "tree", depth=3), "k", 4)


QUERIES = {f.__name__: f for f in (p3_model_text, p16_label_missing, p19_truth, a7_multi_hot, ff6_annotate, ff15_target_matrix, ff16_questions, u6_head_and_stratified, fs7_taxonomy_items, fs12_hybrid_score, z6_judgments, z4_arms, ff10_extraction, t2_stream_enrichment, s8_weights, k7_saved_report, k9_saved_model, m8_root_causes, m9_mitigation_effects, r9_heuristics, m17_shapley)}
ORACLE_SQL = {
    "p3_model_text": _TEXT_SQL,
    "p16_label_missing": _LABELED + " SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE harm_category END AS harm_category FROM lab",
    "p19_truth": _TRUTH_SQL,
    "a7_multi_hot": _HOT_SQL,
    "ff6_annotate": _ANNOTATE_SQL,
    "ff15_target_matrix": _MATRIX_SQL,
    "ff16_questions": _QUESTIONS_SQL,
    "u6_head_and_stratified": _HEAD_SQL,
    "fs7_taxonomy_items": _ITEMS_SQL,
    "fs12_hybrid_score": _HYBRID_SQL,
    "z6_judgments": _JUDGE_SQL,
    "z4_arms": _ARMS_SQL,
    "ff10_extraction": _EXTRACT_SQL,
    "t2_stream_enrichment": _STREAM_SQL,
    "s8_weights": _WEIGHTS_SQL,
    "k7_saved_report": _SAVED_SQL,
}
