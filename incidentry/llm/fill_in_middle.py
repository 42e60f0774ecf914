"""Fill-in-the-middle transformation with content-defined chunk memoization.

A rolling hash over the last ``WINDOW`` characters cuts each text into chunks, so texts that
share a passage share the chunks inside it, wherever it stands.  A chunk's boundary summary
says what its neighbours need to know: whether it starts and ends inside a word, and where
words end in it.  Summaries are kept in a bounded cache of the task whose key is the chunk's
content itself, so a hit is verified by comparing content.  Summaries combine from left to
right to the number of tokens of a text, and the running counts locate the chunk, and in it
the character, at which a cut falls.

Tasks return a count and two cuts; the documents are put together and hashed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import table

#: Fixed values of the contract: white space, marks of the parts, and shares in percent.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT, SEED = 50, 80, 42
#: Characters that the rolling hash covers (a power of two), bits that are zero at a cut, and the longest chunk.
WINDOW, CUT_BITS, LONGEST = 32, 9, 1 << 13
#: Characters of a text that are hashed at a time, and of all chunks that a task's cache holds.
PIECE, CACHE_CHARS = 1 << 20, 4 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling(points: np.ndarray) -> np.ndarray:
    """A hash of each position's last ``WINDOW`` characters (fewer at the start): sums of doubling windows, so a few vector steps."""
    h = points * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)  # what leaves the 32 bits is old enough to be forgotten
        span *= 2
    return h


def chunks(text: str) -> list[str]:
    """The text cut where the rolling hash has ``CUT_BITS`` zero bits, and after ``LONGEST`` characters without such a place."""
    out, start = [], 0
    for base in range(0, len(text), PIECE):
        head = min(WINDOW - 1, base)
        h = rolling(code_points(text[base - head : base + PIECE]).copy())[head:]
        for cut in (np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + (base + 1)).tolist():
            while cut - start > LONGEST:
                out.append(text[start : start + LONGEST])
                start += LONGEST
            if cut > start:
                out.append(text[start:cut])
                start = cut
    while start < len(text):
        out.append(text[start : start + LONGEST])
        start += LONGEST
    return out


def summary(chunk: str) -> tuple[bool, bool, np.ndarray]:
    """(starts in a word, ends in a word, ends of words inside: the places after a word's last character where white space follows)."""
    p = code_points(chunk)
    word = ~((p == 0x20) | ((p >= 0x09) & (p <= 0x0D)))
    return bool(word[0]), bool(word[-1]), np.flatnonzero(word[:-1] & ~word[1:]) + 1


class ChunkCache(dict):
    """Chunk content -> summary; emptied when it holds ``CACHE_CHARS`` characters."""

    held = 0

    def __missing__(self, chunk: str) -> tuple[bool, bool, np.ndarray]:
        if self.held >= CACHE_CHARS:
            self.clear()
            self.held = 0
        self.held += len(chunk)
        self[chunk] = found = summary(chunk)
        return found


class Tokens:
    """The tokens of one text: white space and the word after it, or white space at the end."""

    def __init__(self, text: str, cache: ChunkCache):
        self.length = len(text)
        self.starts: list[int] = []
        self.ends: list[np.ndarray] = []
        self.counts: list[int] = []
        at = n = 0
        inside = False
        for chunk in chunks(text):
            first, last, ends = cache[chunk]
            if inside and not first:  # a word of the chunk before ends at the border
                ends = np.concatenate(([0], ends))
            self.starts.append(at)
            self.ends.append(ends)
            self.counts.append(n)
            at, n, inside = at + len(chunk), n + len(ends), last
        self.n_ended = n
        #: The last token ends with the text: a word, or white space after the last word.
        self.n = n + (at > 0)

    def end(self, k: int) -> int:
        """Characters of the first ``k`` tokens."""
        if k <= 0:
            return 0
        if k > self.n_ended:
            return self.length
        i = int(np.searchsorted(self.counts, k, "left")) - 1  # the last chunk before which fewer than k words have ended
        return self.starts[i] + int(self.ends[i][k - self.counts[i] - 1])


def draws(id_col: Column, seed: int = SEED, n: int = 4) -> list[Column]:
    """``n`` numbers of 32 bits from the hash of the seed and an id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def document_cuts(docs: DataFrame, text_col: str, lows: Column, highs: Column) -> DataFrame:
    """``docs`` with ``_cuts`` (n, low, high): tokens of the text, and characters before the smaller and the larger of two draws modulo n + 1."""

    @pandas_udf("struct<n:long,low:long,high:long>")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        cache = ChunkCache()
        for texts, a, b in batches:
            found = []
            for text, x, y in zip(texts, a, b, strict=True):
                t = Tokens(text or "", cache)
                x, y = (0 if pd.isna(v) else int(v) % (t.n + 1) for v in (x, y))
                found.append((t.n, t.end(min(x, y)), t.end(max(x, y))))
            yield pd.DataFrame(found, columns=["n", "low", "high"], dtype="int64")

    return docs.withColumn("_cuts", apply(F.col(text_col), lows, highs))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Add ``n`` (tokens), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output`` to every row.

    Null text is empty.  An empty text, a text that holds a mark and a row without an id
    stay plain, with null lengths of parts.  Draws depend on the id and the seed only, so
    rows with equal ids and texts have equal results.  A text of any length is cut whole:
    it is hashed in pieces, and a chunk has ``LONGEST`` characters at most.  Other columns
    pass through; added columns replace columns of their names.  An empty table gives an
    empty result.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    keep = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[h.alias(f"_h{k}") for k, h in enumerate(draws(F.col(id_col), seed), 1)])
    cut = document_cuts(rows, "_text", F.col("_h1"), F.col("_h2"))
    low, high, text = F.col("_cuts.low"), F.col("_cuts.high"), F.col("_text")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | F.col("_h3").isNull() | (F.col("_h3") % 100 >= fim_percent)
    cut = cut.withColumn("_form", F.when(plain, F.lit("plain")).when(F.col("_h4") % 100 < spm_percent, F.lit("spm")).otherwise(F.lit("psm")))
    prefix, middle, suffix = F.substr(text, F.lit(1), low.cast("int")), F.substr(text, (low + 1).cast("int"), (high - low).cast("int")), F.substr(text, (high + 1).cast("int"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    form = F.col("_form")
    output = F.when(form == "plain", text).when(form == "psm", say(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)).otherwise(say(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    parts = lambda c: F.when(form != "plain", c)
    return cut.select("_row.*", F.col("_cuts.n").alias("n"), form.alias("form"), parts(low).alias("prefix_chars"), parts(high - low).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of.

    The text held no mark, and a mark starts with a character that stands nowhere else in
    it, so the marks of the output are those that were put there.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_fill_in_middle(spark, sf_dir):
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id::VARCHAR) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), e AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h IS NULL OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM e
), g AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM g
"""
