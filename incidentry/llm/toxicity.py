"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels.

A document is a bag of sentences.  A sentence's probability is logistic in the words it
holds and their beginnings; the document's is one minus the product of the sentences'
complements.  Only the documents' labels are known, so the gradient of the document's
likelihood decides which sentences answer for it.

Learning reads a bounded sample of labelled rows (``max_train`` of each class, by hash) in
one task; scoring reads every whole text in parallel, with a weight vector of fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import table

#: Hashed features; the weights take 4 bytes each, whatever the corpus.
BITS = 19
#: Labelled rows of each class that learning reads at most.
MAX_TRAIN = 2000
#: Lengths of the word beginnings that are features.
PREFIXES = (4, 5, 6)
_SENTENCE = re.compile(rb"[.!?]+(?=\s|$)|\n+")
_STRIP = b".,;:!?\"'()[]|*#%&$-"


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Byte spans of the sentences of a text: parts between ends of sentences or lines that hold a word."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    spans, start = [], 0
    for m in _SENTENCE.finditer(raw):
        if raw[start : m.end()].strip():
            spans.append((start, m.end()))
        start = m.end()
    if raw[start:].strip():
        spans.append((start, len(raw)))
    return spans


class Features(dict):
    """Word (bytes) -> hashed indices of the word and its beginnings, kept for words seen before in this task."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> tuple:
        w = word.strip(_STRIP)
        parts = [b"w" + w] if w else []
        s = w.decode("utf-8", "replace")
        parts += [b"%d" % n + s[:n].encode("utf-8", "replace") for n in PREFIXES if len(s) >= n]
        found = tuple({zlib.crc32(p) & ((1 << BITS) - 1) for p in parts})
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found
        return found


def bag(text: str | None, features: Features) -> list[set[int]]:
    """The distinct features of each sentence."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    out = []
    for a, b in sentences(text):
        got: set[int] = set()
        for w in set(raw[a:b].split()):
            got.update(features[w])
        out.append(got)
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, bags: list[set[int]]) -> np.ndarray:
        """The probability of each sentence."""
        if not bags:
            return np.zeros(0)
        sizes = np.array([len(b) for b in bags])
        flat = np.fromiter((i for b in bags for i in b), np.int64, int(sizes.sum()))
        sums = np.bincount(np.repeat(np.arange(len(bags)), sizes), self.weights[flat], minlength=len(bags)) + self.bias
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))

    def score(self, bags: list[set[int]]) -> float:
        """Noisy-or of the sentences; a text without sentences has the score 0."""
        p = self.sentence_scores(bags)
        return float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def learn(texts: list[str | None], labels: list[int], clean_weight: float = 1.0, rounds: int = 150, rate: float = 1.0, l2: float = 1e-4, min_docs: int = 8) -> Model:
    """Full-batch Adagrad on the noisy-or likelihood of the documents' labels.

    ``clean_weight``: rows of the whole for which one sampled clean row stands, relative to
    a toxic one.  Only features that speak for label 1 are learnt: those of at least
    ``min_docs`` training documents whose share among toxic documents is, two standard
    errors down, twice that among the others.
    """
    features = Features()
    parts, sizes, per_doc = [], [], []
    for t in texts:
        bags = bag(t, features)
        sizes.extend(len(b) for b in bags)
        per_doc.append(len(bags))
        parts.append(np.fromiter((i for b in bags for i in b), np.int32))
    features.clear()
    s = len(sizes)
    y = np.asarray(labels, float)
    weights, bias = np.zeros(1 << BITS, np.float32), -6.0
    if not s or not y.any() or y.all():
        return Model(weights, -30.0)
    owner_a = np.repeat(np.arange(len(y), dtype=np.int32), per_doc)
    sent_a, index_a = np.repeat(np.arange(s, dtype=np.int32), sizes), np.concatenate(parts)
    del parts
    pairs = np.unique(owner_a[sent_a].astype(np.int64) << BITS | index_a)
    of, name = pairs >> BITS, pairs & ((1 << BITS) - 1)
    toxic = np.bincount(name, y[of], minlength=1 << BITS)
    clean = np.bincount(name, 1 - y[of], minlength=1 << BITS)
    lift = np.log((toxic + 0.5) / y.sum()) - np.log((clean + 0.5) / (len(y) - y.sum()))
    telling = (toxic + clean >= min_docs) & (lift - 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)) > np.log(2))
    used = telling[index_a]
    sent_a, index_a = sent_a[used], index_a[used]
    names, local = np.unique(index_a, return_inverse=True)
    w, g2, gb2 = np.zeros(len(names)), np.full(len(names), 1e-6), 1e-6
    stands_for = np.where(y == 1, 1.0, clean_weight)
    for _ in range(rounds):
        z = np.clip(np.bincount(sent_a, w[local], minlength=s) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(owner_a, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)))
        # d log-likelihood / d z: p * none / (1 - none) for toxic documents, -p for others.
        pull = np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0) * stands_for
        gz = p * pull[owner_a]
        g = np.bincount(local, gz[sent_a], minlength=len(names)) - l2 * len(y) * w
        gb = gz.sum()
        g2 += g * g
        gb2 += gb * gb
        w += rate * g / np.sqrt(g2)
        bias += rate * gb / np.sqrt(gb2)
    weights[names] = w
    return Model(weights, float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int = MAX_TRAIN) -> DataFrame:
    """A sample of the labelled rows that ``docs`` holds, the same for every run: at most ``max_train`` of each class, texts whole and of any length.

    Rows that repeat id and text are one; rows that share an id only are sampled each.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    named = named.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    order = F.xxhash64(F.lit(5), "_id")
    # First ids, then the rows of those ids: both are bounded before any text moves.
    first = lambda found, *by: reduce(DataFrame.union, [found.where(F.col("_y") == y).orderBy(order, *by).limit(max_train) for y in (0, 1)])
    picked = first(named.distinct(), "_id")
    hits = rows.join(F.broadcast(picked), "_id").select("_id", "_y", F.xxhash64("_text").alias("_th"), "_text")
    bounded = first(hits.select("_id", "_y", "_th").distinct(), "_id", "_th")
    return hits.join(F.broadcast(bounded), ["_id", "_y", "_th"]).dropDuplicates(["_id", "_y", "_th"]).select("_id", "_text", "_y")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Learn from a bounded sample, in one task; the classes keep the weights that all labelled rows have.

    Only the weights of telling features come to the driver.
    """
    whole = {r["y"]: r["n"] for r in labels.groupBy(F.col(label_col).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).where("y in (0, 1)").collect()}
    rows = training_rows(docs, labels, id_col, text_col, label_col, max_train)

    def learn_all(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_id", "ascending"), ("_y", "ascending")])
        texts, y = t.column("_text").to_pylist(), t.column("_y").to_pylist()
        per_row = [whole.get(k, 0) / max(1, y.count(k)) for k in (0, 1)]
        m = learn(texts, y, per_row[0] / per_row[1] if per_row[1] else 1.0)
        at = np.flatnonzero(m.weights)
        return pa.table({"i": pa.array([-1, *at.tolist()], pa.int32()), "w": pa.array([m.bias, *m.weights[at].astype(float).tolist()], pa.float64())})

    weights, bias = np.zeros(1 << BITS, np.float32), -30.0
    for r in rows.groupBy(F.lit(1).alias("all")).applyInArrow(learn_all, "i int, w double").collect():
        if r["i"] < 0:
            bias = r["w"]
        else:
            weights[r["i"]] = r["w"]
    return Model(weights, bias)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, offending: float = 0.05, worst: int | None = None) -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` and ``offending`` to every row.

    ``offending``: all sentences of predicted documents with a probability of at least
    ``offending``, or else their likeliest one, highest first, as structs of byte span and
    score; at most ``worst`` of them, if that is given.  Null and empty texts have no
    sentences and score 0.  Repeated rows get equal results, an empty table an empty result.
    Other columns pass through; added columns replace columns of their names.
    """
    added = ("score", "predicted", "offending")
    # Plain arrays, so that executors need no copy of the library; 4 * 2**BITS bytes, whatever the corpus.
    shared, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias

    @pandas_udf("struct<score:double,offending:array<struct<begin:int,end:int,score:double>>>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features, m = Features(), Model(shared.value, bias)
        for texts in batches:
            out = []
            for t in texts:
                bags = bag(t, features)
                total = m.score(bags)
                top = []
                if total >= threshold:
                    p, spans = m.sentence_scores(bags), sentences(t)
                    top = [{"begin": spans[i][0], "end": spans[i][1], "score": float(p[i])} for k, i in enumerate(np.argsort(-p, kind="stable")[:worst]) if p[i] >= offending or not k]
                out.append((total, top))
            yield pd.DataFrame(out, columns=["score", "offending"])

    keep = F.struct(*[F.col(c) for c in docs.columns if c not in added])
    scored = docs.select(keep.alias("_row"), apply(F.col(text_col)).alias("_s"))
    return scored.select("_row.*", "_s.score", (F.col("_s.score") >= threshold).cast("int").alias("predicted"), "_s.offending")


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held_out = F.coalesce(fold == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out)
    model = fit(docs.where(~held_out), labels)
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
