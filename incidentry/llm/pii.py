"""Personal data by bootstrapped contextual extraction.

Seeds are the spans of four base forms.  What stands around a seed gives lexical patterns of
five forms: the two words before it, the one before, the one after, both neighbours, and the
line up to it.  Spark scores the graph of patterns and instances in rounds: a pattern is as
good as the share of trusted identifiers among what stands in its slot (with one doubtful
instance more, so few instances do not make a sure pattern), an identifier as good as the
patterns that hold it (noisy-or).  What stands in the slots of good patterns and looks like
an identifier (an address, or digits with the separators of the base forms between them) is
new personal data; base spans always stay.

One pass over the texts extracts seeds and candidates; the rounds work on pre-aggregated
(pattern, instance) pairs and never see text again.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import stored, table

#: Fixed values of the contract: kinds in the order of listing.
KINDS = ("email", "ip", "card", "phone")
#: A pattern needs this many trusted instances and this score; rounds of scoring.
MIN_SUPPORT, MIN_SCORE, ROUNDS = 3, 0.6, 3
# The look-behind changes no match: a match never starts inside a run of digits that a longer try has refused.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s]*[0-9@][^\s]*")
# Digits with the separators of the base forms between them.
_RUN = re.compile(r"\(?\+?[0-9](?:[ ().-]*[0-9])*")
_DIGITS = re.compile("[0-9]+")
_EDGE = ".,;:!?\"'()[]{}<>|*#$&="


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches.  Each ``@`` is tried once, with all local characters before it, so long runs cost nothing extra."""
    out, floor, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > floor and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = max(floor, at)
        at = t.find("@", max(at + 1, floor))
    return out


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base forms, in the order of listing."""
    out = [(a, 0, b) for a, b in emails(t)] if "@" in t else []
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def key(text: str) -> int:
    """A signed 64-bit number for a pattern or an instance."""
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def contexts(t: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place: form and words in lower case, digits masked."""
    before, after = t[max(0, start - 80) : start].lower().split()[-2:], t[end : end + 40].lower().split()[:1]
    line = t[max(t.rfind("\n", 0, start) + 1, start - 40) : start].strip().lower()
    found = {"2": before if len(before) == 2 else [], "1": before[-1:], "a": after, "n": [*before[-1:], "_", *after] if before and after else [], "l": [line] if line else []}
    return [f"{form} {_DIGITS.sub('0', ' '.join(words))}" for form, words in found.items() if words]


def mention(t: str, start: int, end: int, left: int | None = None) -> dict:
    """A place with its instance and patterns; ``left``: where its context ends, if before it."""
    return {"p": [key(c) for c in contexts(t, start if left is None else left, end)], "i": key(t[start:end]), "b": start, "e": end}


def shape(token: str) -> str | None:
    """What kind of identifier a token may be: ``a`` (address), ``n`` (number), or None."""
    if "@" in token.strip("@"):
        return "a"
    digits = sum("0" <= c <= "9" for c in token)
    return "n" if digits >= 6 and digits * 2 >= len(token) else None


def runs(t: str, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of digits and separators between ``covered`` spans; parts that are glued to other characters are left to the tokens."""
    out, low = [], 0
    for c, d in [*covered, (len(t), len(t))]:
        for m in _RUN.finditer(t, low, max(low, c)):
            a, b = m.span()
            if a and not t[a - 1].isspace() and t[a - 1] not in _EDGE:
                a = t.find(" ", a, b) + 1 or b
            if b < len(t) and not t[b].isspace() and t[b] not in _EDGE:
                b = max(a, t.rfind(" ", a, b))
            while a < b and t[a] in " ).-":
                a += 1
            while b > a and t[b - 1] in " (.-":
                b -= 1
            if a < b and t[a] == "(" and ")" not in t[a:b]:
                a += 1
            if a < b:
                out.append((a, b))
        low = max(low, d)
    return out


def extract(text: str | None) -> tuple[list, list, list]:
    """Base spans, the mentions of seeds and the candidates of one text."""
    t = text or ""
    if not _MARK.search(t):
        return [], [], []
    base = base_spans(t)
    seeds = [{"k": k, **mention(t, a, b)} for a, k, b in base]
    n = 0
    covered = sorted((a, b) for a, _, b in base)
    numbers = [(a, b) for a, b in runs(t, covered) if shape(t[a:b])]
    candidates = [{"s": "n", **mention(t, a, b, a - (t[a - 1 : a] == "("))} for a, b in numbers]
    covered = sorted(covered + numbers)
    for m in _TOKEN.finditer(t):
        a, b = m.span()
        while a < b and t[a] in _EDGE:
            a += 1
        while b > a and t[b - 1] in _EDGE:
            b -= 1
        while n < len(covered) and covered[n][1] <= a:
            n += 1
        if n < len(covered) and covered[n][0] < b:
            continue
        s = shape(t[a:b])
        if s:
            candidates.append({"s": s, **mention(t, a, b)})
    return [{"b": a, "k": k, "e": b} for a, k, b in base], seeds, candidates


def pattern_scores(seeds: DataFrame, candidates: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(p, k, score) of patterns.  ``seeds``: k, p, i.  ``candidates``: p, i.

    All joins are on patterns or instances after pairs are made distinct; a pattern that a
    third of all rows share costs as many rows as it has different instances.
    """
    pairs = stored(seeds.select("p", "i").union(candidates.select("p", "i")).distinct(), "pairs")
    held = stored(pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")), "held")
    known = seeds.select("i", "k").distinct().withColumn("t", F.lit(1.0))
    trusted, scores = known, None
    for _ in range(rounds):
        inside = pairs.join(trusted, "i").groupBy("p", "k").agg(F.sum("t").alias("got")).where(F.col("got") >= min_support)
        scores = stored(inside.join(held, "p").select("p", "k", F.least(F.lit(1.0), F.col("got") / (F.col("n") + 1)).alias("score")), "scores")
        good = scores.where(F.col("score") >= MIN_SCORE)
        fresh = pairs.join(good, "p").groupBy("i", "k").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("score")))))).alias("t"))
        trusted = known.union(fresh.join(known.select("i", "k"), ["i", "k"], "left_anti").select("i", "k", "t"))
    return scores


def find_pii(docs: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """For every row its columns but the text, and ``spans``: sorted structs (begin, kind, end, base).

    Code points, end exclusive.  ``base`` tells the base forms from what patterns found; a
    found span never overlaps a base span or another one, and has the kind of its best pattern
    (ties: the kind listed first).  Null text is empty.  Repeated rows get equal results; an empty table
    gives an empty result.  A column named ``spans`` is replaced.
    """
    keep = [c for c in docs.columns if c not in (text_col, "spans")]
    kinds = "base:array<struct<b:int,k:int,e:int>>,seeds:array<struct<k:int,p:array<long>,i:long,b:int,e:int>>,more:array<struct<s:string,p:array<long>,i:long,b:int,e:int>>"

    @pandas_udf(f"struct<{kinds}>")
    def apply(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(t) for t in texts], columns=["base", "seeds", "more"])

    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row") if keep else F.lit(None).cast("struct<none:int>").alias("_row"), apply(F.col(text_col)).alias("_x"))
    rows = stored(rows.select("_row", "_x.*").withColumn("_n", F.monotonically_increasing_id()), "mentions")
    seeds = rows.select(F.explode("seeds").alias("m")).select("m.k", F.explode("m.p").alias("p"), "m.i")
    more = rows.where(F.size("more") > 0).select("_n", F.explode("more").alias("m")).select("_n", "m.s", "m.i", "m.b", "m.e", F.explode("m.p").alias("p"))
    scores = pattern_scores(seeds, more.select("p", "i")).where(F.col("score") >= min_score)
    shapes = scores.select("p", "k", "score", F.when(F.col("k") == 0, F.lit("a")).otherwise(F.lit("n")).alias("s"))
    # The kind of the best pattern; of equal ones the kind listed first.
    best = more.join(shapes, ["p", "s"]).groupBy("_n", "b", "e").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("x"))
    found = best.groupBy("_n").agg(F.collect_list(F.struct("b", (-F.col("x.k")).alias("k"), "e")).alias("_found"))
    name = lambda x, base: F.struct(x["b"].alias("begin"), x["k"].alias("_k"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1).alias("kind"), x["e"].alias("end"), F.lit(base).alias("base"))
    spans = F.concat(F.transform("base", lambda x: name(x, True)), F.transform(F.coalesce("_found", F.array().cast("array<struct<b:int,k:int,e:int>>")), lambda x: name(x, False)))
    out = rows.select("_n", "_row", "base").join(found, "_n", "left").select("_row", F.array_sort(spans).alias("spans"))
    return out.select(*([F.col("_row.*")] if keep else []), "spans")


def listed(spans, only_base: bool):
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    some = F.filter(spans, lambda x: x["base"]) if only_base else spans
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["end"].cast("string"))), ",")


def op6_pii(spark, sf_dir):
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("spans"), True), 256).alias("base_sha256"), listed(F.col("spans"), False).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_found"))
