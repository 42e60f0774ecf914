"""Text assembly, tokens and small text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def assemble(*parts: Column, sep: str = " ") -> Column:
    """The non-empty parts joined; nulls and empty strings are left out."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def tokens(text: Column) -> Column:
    """Distinct word tokens: letters of any alphabet, digits, underscores."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([\\p{L}\\p{N}_]+)"), 1))


def contains_any(text: Column, terms) -> Column:
    """Substring test; short terms match inside words on purpose."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms], F.lit(False))


def hits(text: Column, terms) -> Column:
    """How many terms the text contains."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms], F.lit(0))


def first_match(text: Column, ladder) -> Column:
    """The name of the first rung of which a term occurs; else null."""
    return F.coalesce(*[F.when(contains_any(text, terms), F.lit(name)) for name, terms in ladder])


def string_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def truncate_words(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters at a word boundary, with an ellipsis."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), " [^ ]*$", ""), F.lit("...")))


def canonical_date(value: Column) -> Column:
    """Dates as YYYY-MM-DD.  ``#n``: epoch seconds; any ten characters with dashes at 5 and 8 pass as they are."""
    trimmed = F.regexp_replace(F.trim(value), "Z", "")
    as_date = lambda fmt: F.date_format(F.try_to_timestamp(trimmed, F.lit(fmt)), "yyyy-MM-dd")
    shaped = (F.length(value) == 10) & (F.substring(value, 5, 1) == "-") & (F.substring(value, 8, 1) == "-")
    return (
        F.when(value.isNull() | (value == ""), F.lit(None).cast("string"))
        .when(value.startswith("#"), F.date_format(F.timestamp_seconds(F.substring(value, 2, 20).try_cast("bigint")), "yyyy-MM-dd"))
        .when(shaped, value)
        .when(trimmed.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), as_date("M/d/yyyy"))
        .when(trimmed.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), as_date("yyyy-M-d"))
        .when(trimmed.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T"), as_date("yyyy-M-d'T'H:m:s"))
    )
