"""LM scoring by a weighted backoff automaton.

An n-gram model with absolute discounting over an add-half unigram base.  As an automaton,
every training n-gram context is a state, every training n-gram an arc with its
probability, and every state has a failure arc, weighted with its backoff mass, to the
state of the shorter context.  A text is read once from left to right; the reader keeps its
state and sums log10 probabilities.

The model grows with the corpus, so no task holds it whole.  Documents are dealt into
blocks of bounded size, n-gram hashes into as many buckets as there are blocks, so both
stay bounded at any size of the corpus.  A block sends each bucket its distinct n-grams with
their training counts, one message for each bucket that it has n-grams of, so messages grow
with the text and no faster.  The bucket sums them over all blocks, in a tree of merges of
bounded fan-in, and answers each block for the n-grams it asked about.  A second exchange does the same for single tokens
and for the number of different continuations of each context.  Each block then builds the
part of the automaton that its documents can reach, and traverses it.  Counts cover all
training documents; frequent n-grams are counted inside a block before they are sent, so a
hot word costs one entry a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, stored, table, text_bytes
from .hashing import WordHasher, lowered, mix

ORDER = 2
#: Text bytes of a block; blocks whose slices of a bucket one task merges.
BLOCK_BYTES, FAN_IN = 6 << 20, 8192
END = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def to_planes(x: np.ndarray) -> bytes:
    """Bytes by significance, so that the zeros of small numbers stand together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def pack_keys(sorted_keys: np.ndarray) -> bytes:
    return to_planes(np.diff(sorted_keys, prepend=np.uint64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return from_planes(b, np.uint64).cumsum(dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of keys, so sorted keys fall into consecutive slices."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


class Block:
    """Tokens and n-gram keys of the documents of one block."""

    def __init__(self, texts: list, order: int):
        hasher = WordHasher()
        found = [hasher.words(lowered(t)) for t in texts]
        n_words = np.array([len(f) for f in found], np.int64)
        words = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.lengths = n_words + 1  # every text ends with one end token
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        tokens = np.empty(int(self.lengths.sum()), np.uint64)
        last = np.zeros(len(tokens), bool)
        last[self.ends - 1] = True
        tokens[last] = END
        tokens[~last] = words
        place = np.arange(len(tokens)) - np.repeat(self.starts, self.lengths)
        #: keys[k][i]: the k-gram that ends at token i; valid where place >= k - 1.
        self.keys = {1: tokens}
        for k in range(2, order + 1):
            before = np.concatenate([[np.uint64(0)], self.keys[k - 1][:-1]]) if len(tokens) else tokens
            self.keys[k] = mix(before * _STEP + tokens + np.uint64(k))
        self.valid = {k: place >= k - 1 for k in range(1, order + 1)}
        self.last = last
        self.order = order

    def spread(self, train: np.ndarray) -> np.ndarray:
        """Training flags of documents, for each token."""
        return np.repeat(train, self.lengths)

    def ngrams(self) -> tuple[np.ndarray, np.ndarray, dict]:
        """Distinct keys of all n-grams longer than one token, one place of each, and for each k the index of every token's k-gram."""
        parts = [self.keys[k][self.valid[k]] for k in range(2, self.order + 1)]
        where = [np.flatnonzero(self.valid[k]) for k in range(2, self.order + 1)]
        orders = np.concatenate([np.full(len(p), k) for k, p in enumerate(parts, 2)]) if parts else np.zeros(0, int)
        distinct, first, inverse = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        at, index = 0, {}
        for k, w in enumerate(where, 2):
            index[k] = np.full(len(self.keys[1]), -1)
            index[k][w] = inverse[at : at + len(w)]
            at += len(w)
        places = np.concatenate(where)[first]
        return distinct, np.stack([places, orders[first]]), index

    def contexts(self) -> tuple[np.ndarray, dict]:
        """Distinct keys of single tokens and of contexts (k-grams shorter than the order), and each token's index among them."""
        ks = range(1, max(2, self.order))
        distinct, inverse = np.unique(np.concatenate([self.keys[k] for k in ks]), return_inverse=True)
        n = len(self.keys[1])
        return distinct, {k: inverse[i * n : (i + 1) * n] for i, k in enumerate(ks)}


REQUEST = "bucket long, block long, keys binary, counts binary"
_REQUEST = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
#: kind 0: answers to a block; kind 1: figures of a bucket (in s0, s1).
ANSWER = "kind int, block long, bucket long, answer binary, s0 long, s1 long"
_ANSWER = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int64()), ("answer", pa.binary()), ("s0", pa.int64()), ("s1", pa.int64())])


def requests(block: int, distinct: np.ndarray, counts: list[np.ndarray], buckets: int) -> pa.Table:
    """One row for each bucket that a block has keys of."""
    of = bucket_of(distinct, buckets)
    edges = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
    rows = [(int(of[x]), block, pack_keys(distinct[x:y]), pack_counts(c[x:y] for c in counts)) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _REQUEST, strict=True)], schema=_REQUEST)


class Merge:
    """The slices that several blocks have of one bucket, merged by key."""

    def __init__(self, t: pa.Table, columns: int):
        self.blocks = t.column("block").to_pylist()
        keys = [unpack_keys(b.as_py()) for b in t.column("keys")]
        self.cuts = np.append(0, np.cumsum([len(k) for k in keys]))
        self.counts = np.concatenate([_columns(b.as_py(), columns).reshape(columns, -1) for b in t.column("counts")], axis=1)
        every = np.concatenate(keys)
        self.order = np.argsort(every, kind="stable")
        ranked = every[self.order]
        self.starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        self.keys = ranked[self.starts]
        #: Of every entry, its place among the distinct keys.
        self.group = np.empty(len(every), np.int64)
        self.group[self.order] = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(every))))
        self.totals = np.stack([np.add.reduceat(c[self.order], self.starts) for c in self.counts])

    def first_holders(self) -> np.ndarray:
        """1 for one entry of each key that training text holds."""
        n = len(self.order)
        held = np.where(self.counts[0][self.order] > 0, np.arange(n), n)
        first = np.minimum.reduceat(held, self.starts)
        own = np.zeros(n, np.int64)
        own[self.order[first[first < n]]] = 1
        return own

    def answers(self, bucket: int, values: np.ndarray, figures: tuple | None) -> pa.Table:
        """Rows of ``ANSWER`` from values for all entries."""
        blobs = [pack_counts(v[x:y] for v in values) for x, y in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        n, last = len(blobs), [None] if figures else []
        s = figures or (None, None)
        return pa.table(
            [[0] * n + [1] * len(last), self.blocks + last, [bucket] * (n + len(last)), blobs + last, *[[None] * n + [f] * len(last) for f in s]],
            schema=_ANSWER,
        )


def exchange(asks: DataFrame, columns: int, owners: bool, blocks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Answers to the requests of ``blocks`` blocks: for each key asked, the sums over all blocks, in the order of its keys.

    With ``owners`` there is one column, and the lowest bit of an answer tells one block, of
    those that hold the key in training text, that the key is its to report: so each key is
    reported once.  Figures of a bucket: keys seen once and twice with ``owners``, else keys
    seen and the sum of the first column.
    """

    def answer(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _ANSWER.empty_table()
        m = Merge(t, columns)
        values = m.totals[:, m.group]
        if owners:
            values = values * 2 + m.first_holders()
        first = m.totals[0]
        figures = (int((first == 1).sum()), int((first == 2).sum())) if owners else (int((first > 0).sum()), int(first.sum()))
        return m.answers(t.column("bucket")[0].as_py(), values, figures)

    if blocks <= fan_in:
        return stored(asks.groupBy("bucket").applyInArrow(answer, ANSWER), "lm-answers")
    asks = stored(asks.withColumn("parent", F.floor(F.col("block") / fan_in).cast("long")), "lm-asks")

    def merge(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _REQUEST.empty_table()
        m = Merge(t, columns)
        return pa.table([[t.column("bucket")[0].as_py()], [t.column("parent")[0].as_py()], [pack_keys(m.keys)], [pack_counts(m.totals)]], schema=_REQUEST)

    def pass_on(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _ANSWER.empty_table()
        m = Merge(t, columns)
        values = _columns(told.column("answer")[0].as_py(), columns).reshape(columns, -1)[:, m.group]
        if owners:
            values = (values & ~1) | (values & m.first_holders())
        return m.answers(t.column("bucket")[0].as_py(), values, None)

    merged = asks.groupBy("bucket", "parent").applyInArrow(merge, REQUEST)
    told = exchange(merged, columns, owners, -(-blocks // fan_in), fan_in)
    parents = told.where("kind = 0").select("bucket", F.col("block").alias("parent"), "answer")
    down = asks.groupBy("bucket", "parent").cogroup(parents.groupBy("bucket", "parent")).applyInArrow(pass_on, ANSWER)
    return stored(down.union(told.where("kind = 1")), "lm-answers")


def pack_counts(counts) -> bytes:
    """Arrays of whole numbers, one after the other."""
    return b"".join(to_planes(np.asarray(c).astype(np.int64)) for c in counts)


def _columns(b: bytes, columns: int) -> np.ndarray:
    """The arrays of ``pack_counts``, one after the other."""
    size = len(b) // columns
    return np.concatenate([from_planes(b[i * size : (i + 1) * size], np.int64) for i in range(columns)])


def answered(t: pa.Table, columns: int) -> list[np.ndarray]:
    """A block's answers, in the order of its keys."""
    t = t.sort_by("bucket")
    parts = [_columns(b.as_py(), columns).reshape(columns, -1) for b in t.column("answer")]
    return list(np.concatenate(parts, axis=1)) if parts else [np.zeros(0, np.int64)] * columns


class Automaton:
    """The part of the backoff automaton that one block's documents can reach, laid out along their tokens."""

    def __init__(self, block: Block, ngram_counts: np.ndarray, index: dict, token_counts: np.ndarray, continuations: np.ndarray, context_index: dict, total: int, vocabulary: int, discounts: dict):
        self.order = block.order
        c = token_counts[context_index[1]]
        self.known = (c > 0) & ~block.last
        self.base = np.log10((c + 0.5) / (total + 0.5 * (vocabulary + 1)))
        self.counts = c
        p = 10.0**self.base
        self.seen, self.arc, self.fail = {}, {1: self.base}, {}
        n = len(c)
        for k in range(2, block.order + 1):
            at = index[k]
            count = np.where(at >= 0, ngram_counts[at] if len(ngram_counts) else 0, 0)
            # The context is the (k-1)-gram one token before.
            before = np.zeros(n, np.int64)
            follow = np.zeros(n, np.int64)
            if n:
                held = c if k == 2 else np.where(index[k - 1] >= 0, ngram_counts[index[k - 1]] if len(ngram_counts) else 0, 0)
                before[1:] = held[:-1]
                follow[1:] = continuations[context_index[k - 1]][:-1]
            state = (before > 0) & block.valid[k]
            mass = np.where(state, discounts[k] * follow / np.maximum(before, 1), 1.0)
            p = np.where(state, np.maximum(count - discounts[k], 0) / np.maximum(before, 1) + mass * p, p)
            self.seen[k] = state & (count > 0)
            self.arc[k] = np.log10(p)
            self.fail[k] = np.log10(np.where(state & (mass > 0), mass, 1.0))

    def read(self, begin: int, end: int) -> float:
        """One traversal of a document: carry the state, follow failure arcs where no arc fits, sum the weights."""
        order = self.order
        seen = {k: v[begin:end].tolist() for k, v in self.seen.items()}
        arc = {k: v[begin:end].tolist() for k, v in self.arc.items()}
        fail = {k: v[begin:end].tolist() for k, v in self.fail.items()}
        known = self.known[begin:end].tolist()
        total, state = 0.0, 0
        for i in range(end - begin):
            k = state + 1
            while k > 1 and not seen[k][i]:
                total += fail[k][i]
                k -= 1
            total += arc[k][i]
            state = (k if k < order else k - 1) if known[i] else 0
        return total


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """One row for every document: ``id_col`` (an integer), ``trained``, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are A-Z lower-cased words between white space and one end.  ``train`` picks the
    documents to learn from (null: not); all are scored.  Null text is empty: its only token
    is the end.  Rows that repeat id and text stand in one block and get a row each; a null
    id is passed on.  Without training documents every token has probability 1.  An empty
    table gives an empty result.  Other columns, whatever their names, are not read.
    """
    blocks = blocks_for(text_bytes(docs, text_col)[1], block_bytes)
    buckets = blocks
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks)).alias("block"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    dealt = rows.groupBy("block")

    def flags(t: pa.Table) -> np.ndarray:
        return np.asarray(t.column("train").to_pylist(), bool)

    def ask_ngrams(t: pa.Table) -> pa.Table:
        block = Block(t.column("text").to_pylist(), order)
        distinct, _, index = block.ngrams()
        train_at = block.spread(flags(t))
        counts = sum(np.bincount(i[(i >= 0) & train_at], minlength=len(distinct)) for i in index.values())
        return requests(t.column("block")[0].as_py(), distinct, [np.asarray(counts)], buckets)

    def ask_contexts(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return requests(0, np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * 2, buckets)
        block = Block(t.column("text").to_pylist(), order)
        distinct, (places, orders), _ = block.ngrams()
        own = answered(told, 1)[0] & 1
        names, index = block.contexts()
        counts = np.bincount(index[1][block.spread(flags(t))], minlength=len(names))
        more = np.zeros(len(names), np.int64)
        for k in range(2, order + 1):
            mine = places[(own == 1) & (orders == k)]
            more += np.bincount(index[k - 1][mine - 1], minlength=len(names))
        return requests(t.column("block")[0].as_py(), names, [counts, more], buckets)

    ngrams = exchange(dealt.applyInArrow(ask_ngrams, REQUEST), 1, True, blocks, fan_in)
    to_block = ngrams.where("kind = 0").select("block", "bucket", "answer")
    contexts = exchange(dealt.cogroup(to_block.groupBy("block")).applyInArrow(ask_contexts, REQUEST), 2, False, blocks, fan_in)
    figures = lambda df: df.where("kind = 1").agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in ("s0", "s1")]).first()
    once, twice = figures(ngrams)
    vocabulary, total = figures(contexts)
    # Absolute discount from how many n-grams occur once and twice in all training text.
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    discounts = dict.fromkeys(range(2, order + 1), discount)
    both = to_block.withColumn("kind", F.lit(0)).union(contexts.where("kind = 0").select("block", "bucket", "answer").withColumn("kind", F.lit(1)))
    out = pa.schema([("id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def traverse(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return out.empty_table()
        block = Block(t.column("text").to_pylist(), order)
        _, _, index = block.ngrams()
        kind = np.asarray(told.column("kind"))
        ngram_counts = answered(told.filter(pa.array(kind == 0)), 1)[0] >> 1
        token_counts, continuations = answered(told.filter(pa.array(kind == 1)), 2)
        _, context_index = block.contexts()
        a = Automaton(block, ngram_counts, index, token_counts, continuations, context_index, int(total), int(vocabulary), discounts)
        return pa.table(
            [
                t.column("id").cast(pa.int64()),
                t.column("train"),
                pa.array(block.lengths),
                pa.array(np.add.reduceat((a.counts > 0).astype(np.int64), block.starts)),
                pa.array(np.add.reduceat(a.base, block.starts)),
                pa.array([a.read(x, y) for x, y in zip(block.starts, block.ends, strict=True)], pa.float64()),
            ],
            schema=out,
        )

    scored = dealt.cogroup(both.groupBy("block")).applyInArrow(traverse, "id long, trained boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "trained", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = score_texts(docs, F.coalesce(fold != 1, F.lit(False)))
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
