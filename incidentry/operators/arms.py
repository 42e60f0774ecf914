"""Arms of an experiment: truth, prompts, judgments by a plug-in model, and their scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions.text import contains_any, string_array
from .features import framework_shares, risk_score
from .inference import batch_infer, json_answer
from .labeling import parse_label, relevance, with_category_scores

#: The arms; two of them change the prompt.
MODES = ("baseline", "rules_static", "rules_dynamic", "deterministic_first", "llm_first", "rag")

_NONE = "array<string>"


def model_text(*parts: Column) -> Column:
    """Text for a model: the parts that are not blank, trimmed, with a blank line between them."""
    return F.concat_ws("\n\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def truth(harms: Column, root_causes: Column, single: Column, ranking: Column, score: Column) -> Column:
    """Struct (labels, ranking, score): harms, else root causes, else the single label; the ranking falls back to harms, the score to 0."""
    empty = F.array().cast(_NONE)
    one = F.when(single.isNotNull(), F.array(single)).otherwise(empty)
    some = lambda c: F.when(F.size(c) > 0, c)
    labels = F.coalesce(some(harms), some(root_causes), one)
    return F.struct(labels.alias("labels"), F.coalesce(some(ranking), some(harms), one).alias("ranking"), F.coalesce(score, F.lit(0)).alias("score"))


def aligned(truths: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Truths with the predictions of the same key; cases without a prediction keep null."""
    return truths.join(predictions, key, "left")


def multi_hot_metrics(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    """One row: n, hamming, macro_f1 of two columns of equally long 0/1 arrays; a place without positives has F1 0."""
    cells = df.select(F.posexplode(F.arrays_zip(F.col(truth_col).alias("t"), F.col(pred_col).alias("p"))).alias("at", "x")).select("at", "x.t", "x.p")
    per = cells.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("t") != F.col("p")).cast("int")).alias("off"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") + F.col("p")).alias("s"))
    return per.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("off") / F.sum("n"), F.lit(0.0)).alias("hamming"), F.coalesce(F.avg(F.when(F.col("s") > 0, 2.0 * F.col("tp") / F.col("s")).otherwise(0.0)), F.lit(0.0)).alias("macro_f1"))


def output_contract(scores: DataFrame, kind: str, name: str, accuracy: str) -> DataFrame:
    """One row (models, frameworks, ranking): the scored approaches of each kind, and all by accuracy, equal ones by name.

    An approach is a row, so the lists are as long as there are approaches.
    """
    item = F.struct((-F.col(accuracy)).alias("neg"), F.col(name).alias("name"))
    ranked = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["name"])
    return scores.agg(ranked(F.when(F.col(kind) == "model", item)).alias("models"), ranked(F.when(F.col(kind) == "framework", item)).alias("frameworks"), ranked(item).alias("ranking"))


def extraction_result(raw: Column) -> Column:
    """Struct (text_labels, span_labels) of an extractor's JSON.

    ``labels`` holds strings or objects with label and confidence, ``entities`` maps a label
    to strings or objects with text and confidence.  Plain strings have confidence 1; what
    cannot be parsed gives empty lists.
    """
    v = F.try_parse_json(raw)
    listed = F.coalesce(F.try_variant_get(v, "$.labels", "array<variant>"), F.array().cast("array<variant>"))
    number = lambda x, p: F.coalesce(F.try_variant_get(x, f"$.{p}", "double"), F.lit(1.0))
    name = lambda x, p: F.coalesce(F.try_variant_get(x, f"$.{p}", "string"), F.try_variant_get(x, "$", "string"))
    labels = F.transform(listed, lambda x: F.struct(name(x, "label").alias("label"), number(x, "confidence").alias("confidence")))
    entities = F.map_entries(F.coalesce(F.try_variant_get(v, "$.entities", "map<string,array<variant>>"), F.create_map().cast("map<string,array<variant>>")))
    spans = F.flatten(F.transform(entities, lambda e: F.transform(e["value"], lambda x: F.struct(name(x, "text").alias("span"), e["key"].alias("label"), number(x, "confidence").alias("score")))))
    return F.struct(labels.alias("text_labels"), spans.alias("span_labels"))


def label_texts(df: DataFrame, text_col: str, load: Callable[[], Callable[[list], list]] | None) -> DataFrame:
    """Add ``text_labels`` and ``span_labels`` from a plug-in extractor that answers JSON; without one the lists are empty."""
    raw = batch_infer(df, text_col, load, "_raw") if load else df.withColumn("_raw", F.lit(None).cast("string"))
    return raw.withColumn("_x", extraction_result(F.col("_raw"))).select(*df.columns, "_x.text_labels", "_x.span_labels")


def fallback_label(text: Column, labels, checks=D.CHECKS) -> Column:
    """The first check whose label is among ``labels`` and of which a word occurs; else the first label."""
    known = {x.lower(): x for x in labels}
    t = F.lower(F.coalesce(text, F.lit("")))
    rungs = [F.when(contains_any(t, words), F.lit(known[name])) for name, words in checks if name in known]
    return F.coalesce(*rungs, F.lit(labels[0] if labels else None).cast("string"))


def judgments(df: DataFrame, text_col: str, truth_col: str, labels, load: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Add ``prompt``, ``answer``, ``predicted`` and ``correct``: the model's label, else the keyword fallback's.

    Texts are capped at 8000 characters in the prompt, which is a limit of the model's input.
    """
    prompt = F.concat(F.lit("Choose one label of: " + ", ".join(labels) + ".\nText: "), F.substring(F.coalesce(text_col, F.lit("")), 1, 8000), F.lit("\nLabel:"))
    asked = batch_infer(df.withColumn("prompt", prompt), "prompt", load)
    said = F.coalesce(parse_label(F.col("answer"), labels), fallback_label(F.col(text_col), labels))
    return asked.withColumn("predicted", said).withColumn("correct", F.coalesce(F.col("predicted") == F.col(truth_col), F.lit(False)))


def arm_prompts(df: DataFrame, key: str, text_col: str, rules_col: str, deterministic_col: str, modes=MODES) -> DataFrame:
    """(key, mode, prompt): each case once for every arm; arms are a literal list, so there is no join."""
    head = F.lit("Decide if the text is privacy relevant and name its harms as JSON.\n")
    rules = F.concat(F.lit("Rules:\n"), F.coalesce(rules_col, F.lit("")), F.lit("\n"))
    known = F.concat(F.lit("Deterministic output: "), F.coalesce(deterministic_col, F.lit("none")), F.lit("\n"))
    extra = F.when(F.col("mode") == "rules_static", rules).when(F.col("mode") == "deterministic_first", known).otherwise(F.lit(""))
    cases = df.select(key, text_col, rules_col, deterministic_col, F.explode(string_array(modes)).alias("mode"))
    return cases.select(key, "mode", F.concat(head, extra, F.lit("Text: "), F.coalesce(text_col, F.lit(""))).alias("prompt"))


def run_arms(prompts: DataFrame, labels, load: Callable[[], Callable[[list], list]]) -> DataFrame:
    """(…, answer, relevant, harms, confidence): one batched call for the prompts of all arms."""
    return batch_infer(prompts, "prompt", load).withColumn("_x", json_answer(F.col("answer"), labels)).select("*", "_x.relevant", "_x.harms", "_x.confidence").drop("_x")


def hybrid_score(records: DataFrame, key: str, text_col: str, least: float = 0.5, weights=D.WEIGHTS) -> DataFrame:
    """(key, harms, rejected, score, shares): proposed labels validated by keywords, their risk on 0 to 100 and the frameworks' shares.

    The proposer is the offline relevance classifier; validated labels have a keyword score
    of ``least`` or more.
    """
    s = with_category_scores(records.select(key, text_col), F.col(text_col)).withColumn("_p", relevance(F.col(text_col))["harms"])
    good = F.transform(F.filter("scores", lambda x: x["score"] >= least), lambda x: x["category"])
    s = s.select(key, F.array_sort(F.array_intersect("_p", good)).alias("harms"), F.array_sort(F.array_except("_p", good)).alias("rejected"))
    return s.select(key, "harms", "rejected", (risk_score(F.col("harms"), F.lit(0), weights) * 10).alias("score"), framework_shares(F.col("harms")).alias("shares"))
