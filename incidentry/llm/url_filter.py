"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed into multiword Shift-And masks: one bit for each pattern position,
64 to a word.  All patterns advance together over each canonical URL (host and path), and
a whole batch of URLs advances together, one character a step.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import LOWER, UPPER, table

#: Fixed values of the contract: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The method's own globs for urls that no rule fits: (glob over host and path, verdict).
GLOBS = (
    ("*spam*/*", "block"),
    ("ads.*", "block"),
    ("*/ads/*", "block"),
    ("*.invalid/*", "block"),
)


@dataclass(frozen=True)
class Pattern:
    """A glob (``*``: any run of characters) with what a match means.  ``in_host``: the first star passes no ``/``."""

    glob: str
    rank: tuple
    rule: str | None
    verdict: str
    in_host: bool = False


def patterns(rules=RULES, globs=GLOBS) -> list[Pattern]:
    """Host-and-path rules fit the host and all subdomains: two globs each.  Longest rule first, then longest glob."""
    out = []
    for host, path, verdict in rules:
        name = host + path
        for glob in (f"{name}*", f"*.{name}*"):
            out.append(Pattern(glob, (0, -len(name), -len(host), verdict != "block"), name, verdict, glob.startswith("*.")))
    for glob, verdict in globs:
        out.append(Pattern(glob, (1, -len(glob), 0, verdict != "block"), None, verdict))
    return sorted(out, key=lambda p: p.rank)


def pack(found: list[Pattern]) -> dict:
    """Masks: ``init`` (states active before any character), ``by_char``, ``loops`` (by character, states under a star that passes it), ``final``."""
    literal: list[tuple[int, str]] = []
    first, loops, held, final, bit = [], [], [], [], 0
    for p in found:
        # State k of a pattern: its first k literal characters are read.  A star after them makes the state loop.
        parts = p.glob.split("*")
        first.append(bit)
        for i, part in enumerate(parts):
            if i:
                (held if p.in_host and i == 1 else loops).append(bit)
            for ch in part:
                bit += 1
                literal.append((bit, ch))
        final.append(bit)
        bit += 1
    words = (bit + 63) // 64

    def mask(bits) -> np.ndarray:
        m = np.zeros(words, np.uint64)
        for b in bits:
            m[b // 64] |= np.uint64(1 << (b % 64))
        return m

    chars = sorted({c for _, c in literal} | {"/"})
    by_char = np.zeros((len(chars) + 1, words), np.uint64)
    for i, c in enumerate(chars):
        by_char[i] = mask(b for b, x in literal if x == c)
    passed = np.repeat(mask(loops + held)[None, :], len(chars) + 1, axis=0)
    passed[chars.index("/")] = mask(loops)
    return {"init": mask(first), "loops": passed, "final": final, "chars": {c: i for i, c in enumerate(chars)}, "by_char": by_char}


def run(masks: dict, urls: list[str]) -> np.ndarray:
    """For each url the index of its best (first) matching pattern, or -1.  Empty urls match as empty strings."""
    if not urls:
        return np.zeros(0, np.int64)
    lengths = np.array([len(u) for u in urls])
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    other = len(masks["chars"])
    state = np.repeat(masks["init"][None, :], len(urls), axis=0)
    one, top = np.uint64(1), np.uint64(63)
    # All characters of the batch as class numbers, each url from its start on.
    classes = np.full(sys.maxunicode + 1, other, np.int16)
    for c, i in masks["chars"].items():
        classes[ord(c)] = i
    codes = classes[np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = (np.cumsum(lengths) - lengths)[order]
    for step in range(int(sorted_lengths[0])):
        live = int(np.searchsorted(-sorted_lengths, -step, side="left"))
        code = codes[starts[:live] + step]
        s = state[:live]
        moved = s << one
        moved[:, 1:] |= s[:, :-1] >> top
        state[:live] = (moved & masks["by_char"][code]) | (s & masks["loops"][code])
    best = np.full(len(urls), -1)
    for k in range(len(masks["final"]) - 1, -1, -1):
        b = masks["final"][k]
        best[(state[:, b // 64] >> np.uint64(b % 64)) & one == 1] = k
    out = np.empty(len(urls), np.int64)
    out[order] = best
    return out


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, globs=GLOBS, default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: from there up to ``?``, ``#`` or the end.  A null url or one without ``://`` has
    both empty.  The longest fitting rule decides (then the longer host); without one, the
    longest fitting glob, a block before an allow; without any, ``default``.  Repeated rows
    get equal results, an empty table an empty result.  Other columns pass through; added
    columns replace columns of their names.
    """
    found = patterns(rules, globs)
    masks = pack(found)
    said = [(p.rule, p.verdict) for p in found] + [(None, default)]

    @pandas_udf("struct<rule:string,verdict:string>")
    def decide(urls: pd.Series) -> pd.DataFrame:
        best = run(masks, urls.tolist())
        return pd.DataFrame([said[k] for k in best], columns=["rule", "verdict"])

    keep = [F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    at = F.locate("://", F.col(url_col))
    rest = F.when(at > 0, F.col(url_col).substr(at + 3, F.length(url_col))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    split = pages.select(F.struct(*keep).alias("_row"), host.alias("host"), path.alias("path"))
    return split.withColumn("_said", decide(F.concat("host", "path"))).select("_row.*", "host", "path", "_said.rule", "_said.verdict")


def op4_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), rules(rh, rp, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT p.page_id, p.host, p.path, arg_max(rules.rh || rules.rp, length(rules.rh || rules.rp)) AS rule, arg_max(rules.verdict, length(rules.rh || rules.rp)) AS verdict
  FROM p LEFT JOIN rules ON (p.host = rules.rh OR ends_with(p.host, '.' || rules.rh)) AND starts_with(p.path, rules.rp)
  GROUP BY p.page_id, p.host, p.path
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN host || path LIKE '%spam%/%' OR host || path LIKE 'ads.%' OR host || path LIKE '%/ads/%' OR host || path LIKE '%.invalid/%' THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""
