"""Exact token counts of every prefix by dynamic programming over a byte-pair vocabulary.

The tokens of a piece of text are those whose neighbours are all compatible: a pair of
tokens is compatible if merging their bytes by rank never crosses the border between them.
So each prefix of a piece has exactly one last token, the one that is compatible with the
last token of the prefix before it, and its count is that prefix's count and one.  One pass
over the bytes gives the count of every prefix; the last is the piece's own.

A text is split into pieces as the tokenizer does, and pieces add up.  A prefix that ends
inside a piece asks the piece's table, so truncation and budgets need no encoding anew.
Tables of pieces seen before are kept in a bounded cache of the task.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import table

#: Fixed values of byte-level vocabularies: the pattern of pieces, the contractions in it, and the bytes that stand for themselves.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))
#: Characters that no version of Unicode classes in another way than the tokenizer does; other texts are split by its library.
SETTLED = r"\x00-\u052F\u2010-\u2027\u3040-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3"
#: Tables that a task keeps, the longest piece kept, and pairs of tokens kept.
KEPT_PIECES, LONGEST_KEPT, KEPT_PAIRS = 400_000, 64, 2_000_000
LIMIT = 512


def read_vocabulary(path: str) -> tuple[list, list[str]]:
    """(merges, added strings) of a byte-level vocabulary; ValueError for another kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or not plain or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path} is no byte-level vocabulary of plain byte pairs")
    added = [t["content"] for t in spec["added_tokens"]]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take white space or whole words are not supported")
    merges = [m.split(" ") if isinstance(m, str) else list(m) for m in model["merges"]]
    if len({a + b for a, b in merges}) != len(merges):
        raise ValueError("several merges make one token")
    return merges, added


def byte_of() -> dict[str, int]:
    """Character of a vocabulary file -> byte: bytes that do not stand for themselves are numbered from 256."""
    others = [b for b in range(256) if b not in PLAIN_BYTES]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + k): b for k, b in enumerate(others)}


class Pairs(dict):
    """Number of a token << 20 | number of the next -> whether the two may stand side by side."""

    def __init__(self, rule: dict[tuple[int, int], int], left: list[int], right: list[int]):
        self.rule, self.left, self.right = rule, left, right

    def __missing__(self, key: int) -> bool:
        if len(self) >= KEPT_PAIRS:
            self.clear()
        self[key] = found = self.compatible(key >> 20, key & 0xFFFFF)
        return found

    def compatible(self, x: int, y: int) -> bool:
        """Undo the merges of both sides, the latest first, and look at each time whether the two at the border would have merged.

        Numbers grow with rank, so a token is later than its parts.  Of equal merges the
        left one comes first: a merge over the border goes before an equal one on its
        right, and after an equal one on its left.
        """
        x_gone = y_gone = 1 << 30
        while True:
            over = self.rule.get((x, y))
            if over is not None and over < x_gone and over <= y_gone:
                return False
            if x < 256 and y < 256:
                return True
            if x > y:
                x_gone, x = x, self.right[x]
            else:
                y_gone, y = y, self.left[y]


class PrefixCounter(dict):
    """Piece -> its token count; ``table`` has the counts of all prefixes of a piece."""

    def __init__(self, merges: list, added: list[str]):
        to_byte = byte_of()
        number = dict(to_byte)
        rule, left, right = {}, list(range(256)), list(range(256))
        self.trie: dict = {}
        for k, (a, b) in enumerate(merges, 256):
            rule[number[a], number[b]] = number[a + b] = k
            left.append(number[a])
            right.append(number[b])
        for token, k in number.items():
            node = self.trie
            for c in token:
                node = node.setdefault(to_byte[c], {})
            node[-1] = k
        self.pairs = Pairs(rule, left, right)
        self.added = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.pieces, self.unsettled, self.white, self.library = regex.compile(PIECES), regex.compile(f"[^{SETTLED}]"), regex.compile(r"\s+"), None

    def counts(self, raw: bytes) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... bytes."""
        n, trie, pairs = len(raw), self.trie, self.pairs
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for p in range(n):
            node, before, c, q = trie, last[p], count[p] + 1, p
            while q < n:
                node = node.get(raw[q])
                if node is None:
                    break
                q += 1
                t = node.get(-1)
                if t is not None and last[q] < 0 and (p == 0 or pairs[before << 20 | t]):
                    last[q], count[q] = t, c
        return count

    def __missing__(self, piece: str) -> int:
        n = self.counts(piece.encode("utf-8", "surrogatepass"))[-1]
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = n
        return n

    def table(self, piece: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... characters, each taken as a text of its own."""
        raw = piece.encode("utf-8", "surrogatepass")
        counts = self.counts(raw)
        if piece in CONTRACTIONS:  # a part of a contraction is a quote, and letters
            return [*range(1, len(piece)), counts[-1]]
        if len(raw) == len(piece):
            return counts[1:]
        return [counts[k] for k in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)]

    def split(self, text: str) -> list[str]:
        """The pieces of an ordinary text."""
        if not self.unsettled.search(text):
            return self.pieces.findall(text)
        if self.library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.library = ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def segments(self, text: str) -> list[tuple[str, str]]:
        """(ordinary text, added token after it or nothing) in order."""
        if self.added is None:
            return [(text, "")]
        found, start = [], 0
        for m in self.added.finditer(text):
            found.append((text[start : m.start()], m[0]))
            start = m.end()
        return [*found, (text[start:], "")]

    def _spans(self, pieces: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(end, counts of the prefixes that end in the span up to there), in order, of all prefixes of a text of these pieces.

        A prefix that ends in a run of white space has the run up to its end as its last
        piece, whatever the pieces of the text are; so a run is a span of its own, and the
        space before a word belongs to it.
        """
        at = before = run_before = 0
        run = ""
        for piece in pieces:
            m = self.white.match(piece)
            lead = m.end() if m else 0
            if lead:
                run_before = run_before if run else before
                run += piece[:lead]
            if lead < len(piece):
                if run:
                    yield at + lead, [run_before + c for c in self.table(run)]
                    run = ""
                yield at + len(piece), [before + c for c in self.table(piece)[lead:]]
            at += len(piece)
            before += self[piece]
        if run:
            yield at, [run_before + c for c in self.table(run)]

    def every_prefix(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, ... characters of a text, each as the tokenizer gives them for a text of its own."""
        out, done = [[0]], 0
        for body, after in self.segments(text):
            # Prefixes that end inside an added token hold a part of it, which is ordinary text.
            out += [np.asarray(counts, np.int32) + done for _, counts in self._spans(self.split(body + after[:-1]))]
            if after:
                done += sum(map(self.__getitem__, self.split(body))) + 1
                out.append([done])
        return np.concatenate(out).astype(np.int32)

    def measure(self, text: str, limit: int) -> tuple[int, int]:
        """(tokens of the text, characters of the longest prefix that has at most ``limit`` tokens as a text of its own)."""
        best = place = done = 0
        for body, after in self.segments(text):
            pieces = self.split(body)
            counts = list(map(self.__getitem__, pieces))
            n = sum(counts)
            if done <= limit:
                # Prefixes that end inside an added token hold a part of it, which is ordinary text.
                most = limit - done
                best = place + (len(body) if n <= most and not after else self._longest(self.split(body + after[:-1]) if after else pieces, most))
            place += len(body) + len(after)
            done += n + (after != "")
            if after and done <= limit:
                best = place
        return done, best

    def _longest(self, pieces: list[str], most: int) -> int:
        """The same for an ordinary text of these pieces; each has a token at least."""
        before = [0, *accumulate(map(self.__getitem__, pieces[: most + 1]))]
        # Whole pieces fit up to k.  Beyond that only prefixes of the next piece can, and of the run of white space that it stands in.
        j = m = k = bisect_right(before, most) - 1
        while j and self.white.fullmatch(pieces[j - 1]):
            j -= 1
        while m < len(pieces) and self.white.fullmatch(pieces[m]):
            m += 1
        end = start = sum(map(len, pieces[:j]))
        best = start + sum(map(len, pieces[j:k]))
        for to, counts in self._spans(pieces[j : m + 1]):
            fits = [i for i, c in enumerate(counts, 1) if before[j] + c <= most]
            best = max(best, end + fits[-1]) if fits else best
            end = start + to
        return best


def token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``limit_chars`` to every row.

    ``path`` is a byte-level vocabulary as the ``tokenizers`` library reads it; the driver
    reads it and tasks get its merges.  ``n_tokens`` is what the library gives without begin
    and end tokens; strings of added tokens inside a text are such tokens.  ``limit_chars``
    is the length of the longest prefix that has at most ``limit`` tokens.  Null text is
    empty and has none.  Texts of any length are counted whole; repeated rows get equal
    results, an empty table an empty result.  Other columns pass through; added columns
    replace columns of their names.
    """
    added = ("n_bytes", "n_tokens", "limit_chars")

    vocabulary = read_vocabulary(path)

    @pandas_udf("struct<n:long,chars:long>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = PrefixCounter(*vocabulary)
        for texts in batches:
            yield pd.DataFrame([counter.measure(t or "", limit) for t in texts], columns=["n", "chars"], dtype="int64")

    keep = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(text_col).alias("_text")).withColumn("_count", apply(F.col("_text")))
    return rows.select("_row.*", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("_count.n").alias("n_tokens"), F.col("_count.chars").alias("limit_chars"))


def prefix_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Add ``prefix_tokens``: the token counts of the prefixes of 0, 1, ... characters of the text, null for a null text.

    A column to store: ``tokens_of`` and ``chars_within`` answer from it.  It takes four
    bytes a character in memory; edge cases as for ``token_counts``.
    """
    keep = [c for c in docs.columns if c != "prefix_tokens"]
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(text_col).alias("_text"))
    vocabulary = read_vocabulary(path)

    @pandas_udf("array<int>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = PrefixCounter(*vocabulary)
        for texts in batches:
            yield pd.Series([None if t is None else counter.every_prefix(t) for t in texts])

    return rows.select("_row.*", apply(F.col("_text")).alias("prefix_tokens"))


def tokens_of(prefix: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` characters, from a column of ``prefix_tokens``."""
    return F.element_at(prefix, F.least(chars.cast("int"), F.size(prefix) - 1) + 1)


def chars_within(prefix: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from a column of ``prefix_tokens``."""
    fits = F.transform(prefix, lambda c: c <= budget)
    return (F.size(prefix) - F.array_position(F.reverse(fits), True)).cast("long")


def op11_token_counts(spark, sf_dir):
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "limit_chars")
