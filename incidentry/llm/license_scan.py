"""License scans: Aho-Corasick over identifier tags and notice phrases, shunting-yard over licence expressions.

The automaton is small and fixed; it is built once a task and reads every whole text once,
as words joined by single spaces.  Where a text holds an SPDX tag, the expression after it
(``and``, ``or``, ``with``, parentheses) is parsed and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import table

#: Fixed values of the contract: phrase and label.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The method's own notice phrases.
MORE_PHRASES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0",
    "bsd 2 clause": "bsd-2",
    "bsd 3 clause": "bsd-3",
    "isc license": "isc",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: How freely a text under the licence may be reused: 1 freely, 0 not at all.
FREEDOM = {"mit": 1.0, "apache-2": 1.0, "bsd-2": 1.0, "bsd-3": 1.0, "isc": 1.0, "cc0": 1.0, "mpl-2": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl-2": 0.4, "gpl-3": 0.4, "agpl-3": 0.3, "cc-by-nc": 0.2, "proprietary": 0.0}
UNKNOWN = 0.5
#: SPDX identifiers (lower case, without -only, -or-later, +) and labels.
SPDX = {"mit": "mit", "apache-2.0": "apache-2", "bsd-2-clause": "bsd-2", "bsd-3-clause": "bsd-3", "isc": "isc", "cc0-1.0": "cc0", "mpl-2.0": "mpl-2", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "agpl-3.0": "agpl-3", "cc-by-nc-4.0": "cc-by-nc", "cc-by-sa-4.0": "cc-by-sa"}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_EXPRESSION = re.compile(r"spdx-license-identifier:[ \t]*([A-Za-z0-9.+() \t-]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def spaced_words(text: str | None) -> str:
    """Lower-cased (A-Z) alphanumeric words, each with a space before it, and one space at the end."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return f" {b' '.join(words).decode('utf-8', 'surrogatepass')} " if words else ""


def licence_label(name: str) -> str:
    base = re.sub(r"(-only|-or-later|\+)$", "", name.lower())
    return SPDX.get(base, base)


def parse_expression(expression: str) -> list[str]:
    """Reverse Polish form by the shunting-yard algorithm.  Raises ValueError if it is not an expression."""
    out: list[str] = []
    held: list[str] = []
    operand = False
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if token == "(":
            if operand:
                raise ValueError("operator missing")
            held.append(token)
        elif token == ")":
            if not operand:
                raise ValueError("operand missing")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("parenthesis missing")
            held.pop()
        elif low in PRECEDENCE:
            if not operand:
                raise ValueError("operand missing")
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            operand = False
        else:
            if operand:
                break  # an expression ends where prose goes on
            out.append(token)
            operand = True
    if not operand:
        raise ValueError("operand missing")
    while held:
        if held[-1] == "(":
            raise ValueError("parenthesis missing")
        out.append(held.pop())
    return out


def evaluate(rpn: list[str]) -> tuple[set[str], float]:
    """Labels and freedom: the freest choice of ``or``, the least free part of ``and``; ``with`` adds an exception to its licence."""
    stack: list[tuple[set[str], float]] = []
    for token in rpn:
        if token in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left[0], min(1.0, left[1] + 0.1)))
            else:
                stack.append((left[0] | right[0], (max if token == "or" else min)(left[1], right[1])))
        else:
            label = licence_label(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
    return stack[-1]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for base, phrases in ((True, BASE_PHRASES), (False, MORE_PHRASES | {TAG: ""})):
        for phrase, label in phrases.items():
            a.add_word(f" {phrase} ", (len(phrase) + 2, label, base))
    a.make_automaton()
    return a


def scan(a, text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, all labels, score) of one text."""
    s = spaced_words(text)
    starts, base, labels, freedom, tagged = [], set(), set(), [], False
    for end, (length, label, is_base) in a.iter(s):
        if not label:
            tagged = True
            continue
        labels.add(label)
        freedom.append(FREEDOM[label])
        if is_base:
            base.add(label)
            starts.append(end - length + 1)
    if tagged:
        for m in _EXPRESSION.finditer(text):
            try:
                named, free = evaluate(parse_expression(m[1]))
            except ValueError:
                continue
            labels |= named
            freedom.append(free)
    place = lambda at: s.count(" ", 0, at)
    return (
        s.count(" ") - 1 if s else 0,
        len(starts),
        place(min(starts)) if starts else None,
        place(max(starts)) if starts else None,
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        min(freedom) if freedom else 0.0,
    )


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the columns of ``RESULT`` to every row.

    ``n_base`` counts all places of the base phrases, overlapping ones too; ``first_word``
    and ``last_word`` are null without any.  ``score``: the least freedom among what was
    found, 0 without any.  Expressions that do not parse are passed over.  Null text is
    empty; repeated rows get equal results, an empty table an empty result.  Other columns
    pass through; added columns replace columns of their names.
    """
    names = [f.split()[0] for f in RESULT.split(", ")]

    @pandas_udf(f"struct<{', '.join(f.replace(' ', ':') for f in RESULT.split(', '))}>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = automaton()
        kinds = {"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "base_labels": object, "labels": object, "score": "float64"}
        for texts in batches:
            yield pd.DataFrame([scan(a, t) for t in texts], columns=names).astype(kinds)

    keep = F.struct(*[F.col(c) for c in docs.columns if c not in names])
    return docs.select(keep.alias("_row"), apply(F.col(text_col)).alias("_found")).select("_row.*", "_found.*")


def op10_license_scan(spark, sf_dir):
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[f.split()[0] for f in RESULT.split(", ")])
