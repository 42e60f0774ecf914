"""Features, scores, rules and mitigations as Column expressions and small broadcast joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import dictionaries as D
from ..functions.matcher import TermIndex, any_of, let
from ..functions.text import assemble, string_array

#: Dictionary-like sides are broadcast only up to this many rows.
BROADCAST_ROWS = 10_000


#: How a causal pattern starts whose cause stands before its words.
CLAUSE = "([^.,;]+)"


def term_index(ontology=D.ONTOLOGY, groups=D.KEYWORD_GROUPS) -> TermIndex:
    """One index of all that features look for."""
    return TermIndex([t for _, ts, _ in ontology for t in ts] + [t for ts in groups.values() for t in ts], [p for _, _, p in ontology if p])


def slugs_found(index: TermIndex, found: Column, text: Column, ontology=D.ONTOLOGY) -> Column:
    """Slugs, in ontology order, of a text whose terms were ``found``; substrings are tried before the regular expression."""
    hit = lambda terms, pattern: any_of([index.holds(found, *terms), *([index.matches(found, text, pattern)] if pattern else [])])
    return F.array_compact(F.array(*[F.when(hit(terms, pattern), F.lit(slug)) for slug, terms, pattern in ontology]))


def product_features(text: Column, ontology=D.ONTOLOGY) -> Column:
    """Slugs found in lower-cased text, in ontology order."""
    index = term_index(ontology, {})
    return let(index.found(text), lambda found: slugs_found(index, found, text, ontology))


def keyword_flags(index: TermIndex, found: Column, groups=D.KEYWORD_GROUPS) -> dict[str, Column]:
    return {f"kw_{g}": index.holds(found, *ts).cast("int") for g, ts in groups.items()}


def individuals(affected: Column, users: Column) -> Column:
    """ln(1 + n) of a positive count; a null or zero count falls back to users; unparsable is 0."""
    n = F.when(affected.isNull() | (affected == "0"), users).otherwise(affected).try_cast("double")
    return F.when(n > 0, F.log1p(n)).otherwise(F.lit(0.0))


def build_features(records: DataFrame, ontology=D.ONTOLOGY, groups=D.KEYWORD_GROUPS) -> DataFrame:
    """Add f_*, kw_*, product_features, pf_*, rc_* and pair_* columns; each text is read once for all terms of both dictionaries."""
    text = F.lower(assemble(F.col("description"), F.col("raw_title"), F.col("raw_body")))
    index = term_index(ontology, groups)
    base = records.withColumn("_t", text).withColumn("_found", index.found(F.col("_t")))
    base = base.withColumn("product_features", slugs_found(index, F.col("_found"), F.col("_t"), ontology))
    pf = F.col("product_features")
    risky, protective = F.size(F.array_intersect(pf, string_array(D.RISKY))), F.size(F.array_intersect(pf, string_array(D.PROTECTIVE)))
    has = lambda s: F.array_contains(pf, s)
    cols = {
        "f_individuals_log": individuals(F.col("individuals_affected"), F.col("num_users")),
        "f_has_description": (F.coalesce("description", F.lit("")) != "").cast("int"),
        **keyword_flags(index, F.col("_found"), groups),
        **{f"pf_{s}": has(s).cast("int") for s, _, _ in ontology},
        "rc_risky": risky,
        "rc_protective": protective,
        "rc_ratio": F.when(risky + protective > 0, risky / F.greatest(risky + protective, F.lit(1))).otherwise(F.lit(0.0)),
        "rc_net": risky - protective,
        **{f"pair_{a}__{b}": (has(a) & has(b)).cast("int") for a, b in D.PAIRS},
    }
    return base.withColumns(cols).drop("_t", "_found")


def annotate(records: DataFrame, fields: tuple[str, ...] = ("description", "harm_summary", "raw_body")) -> DataFrame:
    """Product features again, from other fields: they replace the old ones where those fields hold text.

    Adds ``root_cause_features`` where there are any, and ``causal`` phrases where any are
    found, else null.
    """
    text = F.lower(assemble(*[F.col(f) for f in fields]))
    index = term_index(groups={})
    base = records.withColumn("_t", text).withColumn("_found", index.found(F.col("_t")))
    base = base.withColumn("_pf", slugs_found(index, F.col("_found"), F.col("_t")))
    old = F.col("product_features") if "product_features" in records.columns else F.array().cast("array<string>")
    found = F.when(F.col("_t") != "", F.col("_pf")).otherwise(old)
    causes = causal_phrases(F.col("_t"))
    return base.withColumns({"product_features": found, "root_cause_features": F.when(F.size(found) > 0, found), "causal": F.when(F.size(causes["causes"]) > 0, causes)}).drop("_t", "_found", "_pf")


def causal_phrases(text: Column, patterns=D.CAUSAL, most: int = 10) -> Column:
    """Struct (indicators: sorted set, causes: the first ``most`` in pattern order) of causes of 6 to 199 characters."""
    t = F.lower(F.coalesce(text, F.lit("")))

    def causes(pattern: str) -> Column:
        if not pattern.startswith(CLAUSE):
            return F.regexp_extract_all(t, F.lit(pattern), 1)
        # A pattern that starts with a clause is tried once in each, not at each of its characters.
        tail = pattern[len(CLAUSE) :]
        return F.transform(F.filter(F.split(t, "[.,;]"), lambda c: F.contains(c, F.lit(tail))), lambda c: F.regexp_extract(c, "(?s)^(.+)" + tail, 1))

    def found(name: str, pattern: str) -> Column:
        return F.transform(causes(pattern), lambda c: F.struct(F.lit(name).alias("n"), F.trim(c).alias("c")))

    each = [found(n, p) for n, p in patterns]
    kept = F.filter(F.flatten(F.array(*each)), lambda x: (F.length(x["c"]) > 5) & (F.length(x["c"]) < 200))
    return F.struct(F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["n"]))).alias("indicators"), F.slice(F.transform(kept, lambda x: x["c"]), 1, most).alias("causes"))


def feature_columns(df: DataFrame, prefixes=("kw_", "pf_", "rc_", "f_")) -> list[str]:
    """Numeric columns with a feature prefix, sorted."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return sorted(c for c, t in df.dtypes if t in numeric and c.startswith(tuple(prefixes)))


def risk_score(categories: Column, n_keywords: Column, weights=D.WEIGHTS) -> Column:
    """Sum of category weights and 0.5 a keyword up to 5, clamped to [0, 10]."""
    m = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    total = F.aggregate(categories, F.lit(0.0), lambda a, c: a + F.coalesce(F.try_element_at(m, c), F.lit(D.DEFAULT_WEIGHT)))
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), total + F.least(F.lit(5.0), n_keywords * 0.5)))


def framework_shares(categories: Column) -> Column:
    """Array of (framework, share): hits of each framework among all hints, percent, one decimal."""
    hints = F.create_map(*[x for c, hs in D.HINTS.items() for x in (F.lit(c), string_array(hs))])
    loose = lambda c: F.when(F.contains(c, F.lit("gdpr")), string_array(["GDPR"])).when(F.contains(c, F.lit("surveillance")), string_array(["Solove", "Zuboff"])).otherwise(F.array().cast("array<string>"))
    all_hints = F.flatten(F.transform(categories, lambda c: F.coalesce(F.try_element_at(hints, c), loose(c))))
    n = F.size(all_hints)
    share = lambda f: F.when(n > 0, F.bround(F.size(F.filter(all_hints, lambda h: F.contains(h, F.lit(f)))) * 100.0 / n, 1)).otherwise(F.lit(0.0))
    return F.array(*[F.struct(F.lit(f).alias("framework"), share(f).alias("share")) for f in D.FRAMEWORKS])


def composite(dims: list[Column], weights=D.DIMENSION_WEIGHTS, eps: float = 1e-6) -> Column:
    """Weighted geometric mean of scores in [0, 1]; a score outside gives null (it belongs in quarantine)."""
    total = float(sum(weights))
    if total == 0:
        return F.lit(0.0)
    logs = reduce(lambda a, b: a + b, [F.log(d + F.lit(eps)) * w for d, w in zip(dims, weights, strict=True)])
    fit = reduce(lambda a, b: a & b, [d.between(0, 1) for d in dims])
    return F.when(fit, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(logs / total) - eps)))


def detect_context(records: DataFrame) -> DataFrame:
    """Add ctx_jurisdiction, ctx_sector and ctx_language: metadata first, then the text ladders; language from metadata only."""
    index = TermIndex([t for ladder in (D.JURISDICTIONS, D.SECTORS) for _, ts in ladder for t in ts])
    read = records.withColumn("_found", index.found(F.lower(F.coalesce("description", F.lit("")))))
    said = lambda known, ladder: F.coalesce(known, index.first(F.col("_found"), ladder))
    return read.withColumns({"ctx_jurisdiction": said("jurisdiction", D.JURISDICTIONS), "ctx_sector": said("sector", D.SECTORS), "ctx_language": F.col("language")}).drop("_found")


def rules_frame(spark: SparkSession, rules=D.RULES) -> DataFrame:
    schema = "rule_id string, text string, jurisdictions array<string>, sectors array<string>, languages array<string>, tags array<string>, source string, priority double"
    return spark.createDataFrame([(r[0], r[1], list(r[2]), list(r[3]), list(r[4]), list(r[5]), r[6], r[7]) for r in rules], schema)


def select_rules(records: DataFrame, rules: DataFrame, most: int = 50) -> DataFrame:
    """(doc_id, rule_id, rank, score): the best ``most`` rules of positive score for each record's context.

    Records are reduced to their distinct contexts first, so rules meet contexts, not
    records: the product is bounded by the contexts, and records join its result.
    """
    key = ["ctx_jurisdiction", "ctx_sector", "ctx_language"]
    contexts = records.groupBy(*key).agg(F.min("doc_id").alias("_c"))
    n = rules.count()
    few = F.broadcast(rules) if n <= BROADCAST_ROWS else rules
    boost = lambda listed, value, yes, no: F.when((F.size(listed) > 0) & value.isNotNull(), F.when(F.array_contains(listed, value), F.lit(yes)).otherwise(F.lit(no))).otherwise(F.lit(0.0))
    score = F.col("priority") + boost(F.col("jurisdictions"), F.col(key[0]), 1.5, -1.0) + boost(F.col("sectors"), F.col(key[1]), 1.0, -0.5) + boost(F.col("languages"), F.col(key[2]), 0.5, 0.0)
    ranked = contexts.join(few, F.lit(True)).withColumn("score", score).where(F.col("score") > 0)
    order = Window.partitionBy("_c").orderBy(F.desc("score"), "rule_id")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*[F.col(k).alias(f"_{k}") for k in key], "rule_id", "rank", "score")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    return records.select("doc_id", *key).join(ranked, same).select("doc_id", "rule_id", "rank", "score")


def recommendations(records: DataFrame, table=D.MITIGATIONS, weights=D.RISK_WEIGHTS, alone=D.EFFECTIVENESS, pairs=D.PAIR_EFFECTIVENESS) -> DataFrame:
    """(doc_id, risk, weight, mitigation, is_primary, alone, combined, pair): a row for each mitigation of each risky feature.

    ``alone``: effectiveness of the mitigation by itself, ``combined`` against the risk, 0.5
    where a table has none; ``pair`` is the score of the two without a default.  A risk
    without mitigations has one row with nulls and the default weight.
    """
    known = lambda r, m: pairs.get((r, m))
    entry = lambda r, m, p: F.struct(F.lit(m).alias("m"), F.lit(p).alias("p"), F.lit(alone.get(m, 0.5)).alias("a"), F.lit(known(r, m)).cast("double").alias("c"))
    of = {r: [entry(r, m, p) for ms, p in ((first, True), (second, False)) for m in ms] for r, (first, second) in table.items()}
    lookup = F.create_map(*[x for r, entries in of.items() for x in (F.lit(r), F.array(*entries))])
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    risks = records.select("doc_id", F.explode(F.array_intersect("product_features", string_array(D.RISKY))).alias("risk"))
    x = risks.select("doc_id", "risk", F.coalesce(F.try_element_at(weight, F.col("risk")), F.lit(D.NO_RISK_WEIGHT)).alias("weight"), F.explode_outer(F.try_element_at(lookup, F.col("risk"))).alias("x"))
    combined = F.when(F.col("x.m").isNotNull(), F.coalesce("x.c", F.lit(0.5)))
    return x.select("doc_id", "risk", "weight", F.col("x.m").alias("mitigation"), F.col("x.p").alias("is_primary"), F.col("x.a").alias("alone"), combined.alias("combined"), F.col("x.c").alias("pair"))


def mitigations(records: DataFrame, table=D.MITIGATIONS, pairs=D.PAIR_EFFECTIVENESS) -> DataFrame:
    """(doc_id, mitigation, is_primary, effectiveness, risks, place) for the risky features of each record.

    A mitigation that is primary for one risk is primary.  Effectiveness is the mean over
    the risks that it is listed for, either way, of the pair's score, else of the default;
    ``risks`` are those for which it is listed in its own class; ``place`` orders the
    mitigations of a class by effectiveness, ties by name.
    """
    x = recommendations(records, table, pairs=pairs).where(F.col("mitigation").isNotNull())
    score = F.coalesce("pair", F.when(F.col("is_primary"), D.PRIMARY_EFFECT).otherwise(D.SECONDARY_EFFECT))
    listed = lambda c: F.collect_set(F.when(c, F.col("risk")))
    out = x.groupBy("doc_id", "mitigation").agg(F.max("is_primary").alias("is_primary"), F.round(F.avg(score), 6).alias("effectiveness"), listed(F.col("is_primary")).alias("_p"), listed(~F.col("is_primary")).alias("_s"))
    place = F.row_number().over(Window.partitionBy("doc_id", "is_primary").orderBy(F.desc("effectiveness"), "mitigation"))
    return out.select("doc_id", "mitigation", "is_primary", "effectiveness", F.concat_ws(",", F.array_sort(F.when(F.col("is_primary"), F.col("_p")).otherwise(F.col("_s")))).alias("risks"), place.alias("place"))
