"""Exact top-k search by inner product with no-random-access aggregation.

Each component of the vectors is a list of (value, candidate), sorted once for each block of
candidates and stored with it.  A query reads its lists a step at a time, best values first:
downwards where its own component is positive, upwards where it is negative.  What has been
read adds to the candidates' sums; what has not is bounded by the frontier of its list from
above and by the list's worst value from below.  After each step, candidates whose upper
bound is under the query's k-th lower bound are outsiders; a query stops reading when few
others are left, and their final scores are resolved.

A first search in one block gives every query a k-th score to beat; it is carried to the
other blocks, so that most reading stops early there.  Queries and candidates meet in
blocks of bounded size; a block yields k rows a query at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

#: Numbers in a block of candidates and in a block of queries; queries whose sums a task holds at a time.
CANDIDATE_CELLS, QUERY_CELLS, QUERY_BATCH = 1 << 19, 1 << 20, 256
#: Parts of the lists that are read between two looks at the bounds.
STEPS = 8
LEAST = np.iinfo(np.int64).min


def sorted_lists(x: np.ndarray) -> np.ndarray:
    """For each component, the rows by ascending value."""
    return np.argsort(x, axis=0, kind="stable").astype(np.int32)


class Reader:
    """Sums and bounds of a batch of queries over a block of candidates, while their lists are read."""

    def __init__(self, q: np.ndarray, x: np.ndarray, lists: np.ndarray):
        self.up, self.down, self.x, self.lists = np.maximum(q, 0), np.minimum(q, 0), x, lists
        n, d = x.shape
        self.n, self.depth = n, 0
        self.sums = np.zeros((len(q), n), q.dtype)
        #: Entries read from the upper and from the lower end.
        self.high, self.low = np.zeros((n, d), bool), np.zeros((n, d), bool)
        columns = np.arange(d)
        self.best, self.worst = x[lists[-1], columns], x[lists[0], columns]

    def read(self, depth: int) -> None:
        """Read all lists on, from both ends, to ``depth`` entries."""
        columns = np.arange(self.x.shape[1])
        for ends, weights, rows in ((self.high, self.up, self.lists[self.n - depth : self.n - self.depth]), (self.low, self.down, self.lists[self.depth : depth])):
            fresh = np.zeros_like(self.x)
            fresh[rows, columns] = self.x[rows, columns]
            ends[rows, columns] = True
            touched = np.flatnonzero(np.bincount(rows.ravel(), minlength=self.n))
            self.sums[:, touched] += weights @ fresh[touched].T
        self.depth = depth

    def _unread(self, weights_high: np.ndarray, weights_low: np.ndarray) -> np.ndarray:
        """What unread entries count, if each has its list's value in the weights."""
        high, low = (~self.high).astype(self.x.dtype).T, (~self.low).astype(self.x.dtype).T
        return weights_high @ high + weights_low @ low

    def upper(self) -> np.ndarray:
        """Upper bounds of all scores: unread entries stand at the frontiers."""
        columns = np.arange(self.x.shape[1])
        high, low = self.x[self.lists[self.n - self.depth], columns], self.x[self.lists[self.depth - 1], columns]
        return self.sums + self._unread(self.up * high, self.down * low)

    def lower(self) -> np.ndarray:
        """Lower bounds of all scores: unread entries stand at the far ends of their lists."""
        return self.sums + self._unread(self.up * self.worst, self.down * self.best)

    def only(self, queries: np.ndarray) -> None:
        """Go on with some of the queries."""
        self.up, self.down, self.sums = self.up[queries], self.down[queries], self.sums[queries]


def exact_kind(q: np.ndarray, x: np.ndarray):
    """The fastest type in which all sums are exact."""
    largest = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(x.shape[1], 1)
    return np.float32 if largest < 2**22 else np.float64 if largest < 2**51 else np.int64


def search_block(qrow: np.ndarray, q: np.ndarray, beat: np.ndarray, xrow: np.ndarray, xid: np.ndarray, x: np.ndarray, lists: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``qrow``, ``xrow``: numbers of the rows, of which a query leaves out its own; ties go to the smaller ``xid``.  The k best candidates of each query in one block that reach ``beat`` (the least whole number: any): (query index, candidate index, score)."""
    n = len(x)
    kind = exact_kind(q, x)
    qf, xf, beat = q.astype(kind), x.astype(kind), beat.astype(kind)
    least = np.array([LEAST]).astype(kind)[0]
    got = []
    for begin in range(0, len(q), QUERY_BATCH):
        open_q = np.arange(begin, min(begin + QUERY_BATCH, len(q)))
        reader = Reader(qf[open_q], xf, lists)
        for step in range(1, STEPS + 1):
            reader.read(max(1, math.ceil(n * step / STEPS)))
            own = qrow[open_q][:, None] == xrow[None, :]
            bar = beat[open_q]
            if n > k and (bar == least).any():
                lower = reader.lower()
                lower[own] = least
                bar = np.maximum(bar, np.partition(lower, n - k, axis=1)[:, n - k])
            alive = (reader.upper() >= bar[:, None]) & ~own
            done = np.ones(len(open_q), bool) if reader.depth >= n else alive.sum(1) <= max(4 * k, n // 16)
            for i in np.flatnonzero(done):
                c = np.flatnonzero(alive[i])
                score = x[c] @ q[open_q[i]]
                best = np.lexsort((xid[c], -score))[:k]
                got.append((np.full(len(best), open_q[i]), c[best], score[best]))
            open_q = open_q[~done]
            if not len(open_q):
                break
            reader.only(~done)
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*got, strict=True))


def _matrix(t: pa.Table) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    column = t.column("v").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths())
    out = np.zeros((len(lengths), max(1, lengths.max(initial=0))), np.int64)
    flat = np.asarray(column.flatten()).astype(np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = flat
    return out


def quantised(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


BLOCK = "block string, wide int, rows binary, ids binary, values binary, lists binary"


def dealt(rows: DataFrame, cells: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, id, v) with the name of their block of about ``cells`` numbers, and (wide, n): the numbers of blocks.

    Vectors are dealt by the power of two over their length, so a long one widens no block of short ones.
    """
    width = F.expr("shiftleft(1, int(ceil(log2(greatest(size(v), 1)))))")
    rows = rows.withColumn("wide", width)
    # One row for each power of two: at most 31.
    blocks = stored(rows.groupBy("wide").agg(F.ceil(F.count(F.lit(1)) * F.col("wide") / cells).cast("int").alias("n")), "block-counts")
    named = rows.join(F.broadcast(blocks), "wide").select("row", "id", "v", F.concat_ws("-", "wide", F.pmod(F.xxhash64(F.col("row"), F.col("id"), F.col("v")), F.col("n"))).alias("block"))
    return named, blocks


def packed(rows: DataFrame, with_lists: bool) -> DataFrame:
    """(block, wide, rows, ids, values, lists): a stored row for each block of ``dealt`` rows."""
    schema = pa.schema([("block", pa.string()), ("wide", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("values", pa.binary()), ("lists", pa.binary())])

    def pack(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return schema.empty_table()
        x = _matrix(t)
        lists = sorted_lists(x).tobytes() if with_lists else b""
        numbers = lambda c: np.asarray(t.column(c)).astype(np.int64).tobytes()
        return pa.table([[t.column("block")[0].as_py()], [x.shape[1]], [numbers("row")], [numbers("id")], [x.tobytes()], [lists]], schema=schema)

    return stored(rows.groupBy("block").applyInArrow(pack, BLOCK), "vector-blocks")


def _unpacked(t: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = t.column("wide")[i].as_py()
    return np.frombuffer(t.column("rows")[i].as_py(), np.int64), np.frombuffer(t.column("ids")[i].as_py(), np.int64), np.frombuffer(t.column("values")[i].as_py(), np.int64).reshape(-1, wide)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, ``id_col``, score): the k best other rows of every query row, ties to the smaller id.

    Components become floor(scale * x).  Vectors that are null or hold a null or non-finite
    component take no part, nor do rows with a null id.  A shorter vector counts as filled up with zeros;
    scores have to fit 64 bits.  Rows that repeat an id are candidates each and queries each:
    a query meets all rows but its own, so each of them has its k rows.  Fewer than k candidates give
    all of them; an empty table gives an empty result.  Other columns are ignored.
    """
    v = F.col(vector_col)
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = stored(vectors.where(F.col(id_col).isNotNull() & F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), quantised(v, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    named, x_blocks = dealt(rows.select("row", "id", "v"), CANDIDATE_CELLS)
    candidates = packed(named, True)
    named, q_blocks = dealt(rows.where("q").select("row", "id", "v"), QUERY_CELLS)
    asked = packed(named, False)
    found_type, schema = "qb string, row long, query_id long, id long, score long", pa.schema([("qb", pa.string()), ("row", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """One block of queries, with the scores to beat, and one of candidates."""
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        qrow, qid, q = _unpacked(left, 0)
        xrow, xid, x = _unpacked(right, 0)
        wide = min(q.shape[1], x.shape[1])
        lists = np.frombuffer(right.column("lists")[0].as_py(), np.int32).reshape(x.shape)[:, :wide]
        beat = np.full(len(qid), LEAST)
        known = left.column("beat")[0].as_py() or []
        if known:
            place = {i: at for at, i in enumerate(qrow.tolist())}
            for b in known:
                beat[place[b["row"]]] = b["score"]
        i, j, score = search_block(qrow, q[:, :wide], beat, xrow, xid, x[:, :wide], lists, k)
        name = left.column("qb")[0].as_py()
        return pa.table([[name] * len(i), qrow[i], qid[i], xid[j], score.astype(np.int64)], schema=schema)

    def names(blocks: DataFrame, first: bool | None = None) -> DataFrame:
        """(name): the blocks' names, made from their numbers; ``first``: the first one of each width, or the others."""
        n = blocks.select("wide", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
        n = n if first is None else n.where(F.col("i") == 0 if first else F.col("i") > 0)
        return n.select(F.concat_ws("-", "wide", "i").alias("name"))

    def meet(queries: DataFrame, first: bool) -> DataFrame:
        """Each block of queries meets the first blocks of candidates, or the others: a row for each pair of blocks and side."""
        left = queries.select(F.col("block").alias("qb"), "wide", "rows", "ids", "values", "beat").join(names(x_blocks, first).withColumnRenamed("name", "xb"), F.lit(True))
        right = candidates.select(F.col("block").alias("xb"), "wide", "rows", "ids", "values", "lists").join(names(x_blocks, first).withColumnRenamed("name", "xb"), "xb", "left_semi")
        right = right.join(names(q_blocks).withColumnRenamed("name", "qb"), F.lit(True))
        return stored(left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInArrow(search, found_type), "found")

    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    start = meet(asked.withColumn("beat", F.lit(None).cast("array<struct<row:long,score:long>>")), True)
    bars = ranked(start).where(F.col("rank") == k).groupBy("qb").agg(F.collect_list(F.struct("row", "score")).alias("beat"))
    rest = meet(asked.join(bars.withColumnRenamed("qb", "block"), "block", "left"), False)
    return ranked(start.union(rest)).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op8_topk_search(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


OP8_SQL = r"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
