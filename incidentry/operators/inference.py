"""Plug-in text inference: prompts and answers as Columns, the model call as a batched hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from ..functions.text import string_array

#: Texts that the user's function sees at once.
BATCH = 256


def batch_infer(df: DataFrame, text_col: str, load: Callable[[], Callable[[list], list]], out_col: str = "answer") -> DataFrame:
    """Add ``out_col``: what the user's function says about batches of at most ``BATCH`` texts.  ``load`` runs once a task and returns the function.

    Only the texts go to Python, and only the answers come back.
    """
    most = BATCH

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow as pa

        infer = load()
        for b in batches:
            parts = [pa.array(list(infer(b[i : i + most].to_pylist())), pa.string()) for i in range(0, len(b), most)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # The model may be dear or not repeat itself: its answer is worked out once, whatever refers to it.
    return df.withColumn(out_col, arrow_udf(run, "string").asNondeterministic()(F.col(text_col)))


def prompt(text: Column, labels) -> Column:
    return F.concat(F.lit("Choose one label of: " + ", ".join(labels) + ".\nText: "), F.coalesce(text, F.lit("")), F.lit("\nLabel:"))


def json_answer(answer: Column, labels) -> Column:
    """Struct (relevant, harms, confidence) from model text: a fenced block, else the first { to the last }; defaults where it fails.

    Harms are limited to ``labels``, the confidence to [0, 1].
    """
    fenced = F.nullif(F.regexp_extract(answer, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(answer, "(?s)(\\{.*\\})", 1), F.lit(""))
    got = F.from_json(F.coalesce(fenced, plain), "relevant boolean, harms array<string>, confidence double")
    harms = F.array_intersect(F.coalesce(got["harms"], F.array().cast("array<string>")), string_array(labels))
    return F.struct(F.coalesce(got["relevant"], F.lit(False)).alias("relevant"), harms.alias("harms"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(got["confidence"], F.lit(0.0)))).alias("confidence"))


def project_labels(df: DataFrame, labels: str, spans: str) -> DataFrame:
    """Add harm_categories, root_cause_features and product_features from prefixed labels and spans; nothing where there are no labels."""
    some = F.size(F.coalesce(labels, F.array().cast("array<string>"))) > 0
    of = lambda c, p: F.filter(c, lambda x: x.startswith(p))
    bare = lambda c, p: F.transform(of(c, p), lambda x: F.substring(x, len(p) + 1, 1000))
    sorted_set = lambda c: F.when(some, F.array_sort(F.array_distinct(c)))
    pf = bare(spans, "pf_")
    return df.withColumns({"harm_categories": sorted_set(bare(labels, "harm_")), "root_cause_features": sorted_set(F.concat(of(labels, "rc_"), of(spans, "pf_"))), "product_features": sorted_set(pf)})


def label_cascade(extracted: Column, heuristic: Column, model: Column) -> Column:
    """Struct (label, source): the extracted label, else the heuristic one, else the model's."""
    h, m = F.nullif(heuristic, F.lit("unknown")), F.nullif(model, F.lit("unknown"))
    source = F.when(extracted.isNotNull(), F.lit("extracted")).when(h.isNotNull(), F.lit("heuristic")).when(m.isNotNull(), F.lit("model")).otherwise(F.lit("none"))
    return F.struct(F.coalesce(extracted, h, m, F.lit("unknown")).alias("label"), source.alias("source"))
