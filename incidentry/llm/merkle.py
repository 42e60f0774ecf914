"""Merkle dataset manifest by concatenated-level strings.

Every row is a leaf.  The leaves of a group (a source) are numbered in order and dealt to
aligned blocks of ``fan_out ** HEIGHT`` leaves.  A block keeps each of its levels as one
string of digests, 64 hex digits each: a fixed-width substring of ``fan_out`` digests is
hashed to a parent, and the substrings to the left and right of a node within its run are
its siblings.  The roots of blocks are the nodes of the next round, until each group has
one root; the roots of groups are nodes of one more tree.  Paths come back down: a block
joins the path of its own root once, before its leaves are told apart.

No group, however large, meets in one task: numbers come from a sort by ranges with the
counts of (range, group) as offsets, and a block has a fixed number of leaves.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import if_small, stored, table

#: Hex digits of a digest, nodes of a run, and levels that a block holds: 3 ** 5 leaves.
DIGITS, FAN_OUT, HEIGHT = 64, 3, 5
#: Fixed values of the contract: the fields of a leaf in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that a range of the sort holds: the first while there are at most so many ranges, then up to the last.
RANGE_ROWS, RANGES, MOST_ROWS = 20_000, 2_000, 1_000_000
#: Place of a row in its range in the low bits of ``monotonically_increasing_id``, the range above them.
PLACE_BITS = 33


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values one after another: ``-`` for null, else the UTF-8 bytes of the value, ``:``, the value."""
    said = lambda v: F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
    return F.sha2(F.concat(*[said(v.cast("string")) for v in values]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``_g`` (a number for the group, in the order of groups, nulls first), ``_i`` (place in the group from 0) and ``_n`` (rows of the group).

    ``rows`` is stored.  The sort is by ranges of (group, order); a range's rows are
    numbered as they are written, and each (range, group) has an offset: the rows of the
    group in earlier ranges.
    """
    n = rows.count()
    ranges = max(1, math.ceil(n / MOST_ROWS), min(RANGES, math.ceil(n / RANGE_ROWS)))
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = stored(rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "placed")
    spans = placed.groupBy(F.shiftrightunsigned("_at", PLACE_BITS).alias("_range"), F.col(group).alias("_group")).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    # As many rows as there are ranges and groups together, at most; those of one group are as many as ranges.
    same = Window.partitionBy("_group")
    before = same.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_range", "_from", "_rows", "_group", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(same).alias("_n"), F.min("_from").over(same).alias("_g"))
    spans = if_small(stored(spans, "spans"))
    at = placed.withColumn("_range", F.shiftrightunsigned("_at", PLACE_BITS))
    joined = at.alias("r").join(spans.alias("s"), (F.col("r._range") == F.col("s._range")) & F.col(f"r.{group}").eqNullSafe(F.col("s._group")))
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], F.col("s._g"), (F.col("r._at") - F.col("s._from") + F.col("s._before")).alias("_i"), F.col("s._n"))


def cut_digests(level: Column, start: Column, n: Column | int) -> Column:
    """``n`` digests of a level's string from number ``start``."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.substr(level, (start * DIGITS + 1).cast("int"), (n * DIGITS).cast("int"))


def parents(level: Column, fan_out: int) -> Column:
    """The string of the next level: each run of digests hashed."""
    width = fan_out * DIGITS
    runs = F.sequence(F.lit(0), ((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda r: F.sha2(cut_digests(level, r * fan_out, fan_out), 256)), "")


def forest(nodes: DataFrame, fan_out: int = FAN_OUT, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round, and (_g, _root) of each group, of nodes (_g, _i, _n, _h digest, _row what else they carry).

    A block: _g, _b its number, _n nodes of its group in this round, _nodes in order, _levels strings.
    """
    size = fan_out**height
    rounds, roots = [], []
    while True:
        blocks = nodes.groupBy("_g", F.expr(f"_i div {size}").alias("_b"), "_n").agg(F.sort_array(F.collect_list(F.struct("_i", "_h", "_row"))).alias("_nodes"))
        blocks = blocks.withColumn("_l0", F.array_join(F.transform("_nodes", lambda x: x["_h"]), ""))
        for k in range(height):
            # A level is raised while its group has several nodes on it; then it stays as it is.
            blocks = blocks.withColumn(f"_l{k + 1}", F.when(F.col("_n") > fan_out**k, parents(F.col(f"_l{k}"), fan_out)).otherwise(F.col(f"_l{k}")))
        blocks = stored(blocks.select("_g", "_b", "_n", "_nodes", F.array(*[F.col(f"_l{k}") for k in range(height)]).alias("_levels"), F.col(f"_l{height}").alias("_top")), "blocks")
        rounds.append(blocks)
        roots.append(blocks.where(F.col("_n") <= size).select("_g", F.col("_top").alias("_root")))
        if not blocks.where(F.col("_n") > size).limit(1).count():
            return rounds, reduce(DataFrame.unionByName, roots)
        raised = F.expr(f"(_n + {size - 1}) div {size}")
        nodes = blocks.where(F.col("_n") > size).select("_g", F.col("_b").alias("_i"), raised.alias("_n"), F.col("_top").alias("_h"), F.struct(F.lit(0).alias("_none")).alias("_row"))


def paths(rounds: list[DataFrame], above: DataFrame, fan_out: int = FAN_OUT, height: int = HEIGHT) -> DataFrame:
    """(_g, _i, _h, _row, _path) of the nodes that the first round was given; ``above``: (_g, _path, others) of each group's root.

    A path has for each level, from the leaf up, the siblings on the left and on the right
    of the node in its run, as strings of digests.  The other columns of ``above`` pass down.
    """
    size = fan_out**height
    others = [c for c in above.columns if c not in ("_g", "_path")]
    below = None
    for blocks in reversed(rounds):
        own = blocks.where(F.col("_n") <= size).join(above, "_g")
        if below is not None:
            more = blocks.where(F.col("_n") > size).join(below.select("_g", F.col("_i").alias("_b"), "_path", *others), ["_g", "_b"])
            own = own.unionByName(more)

        def path(x: Column, steps=height) -> Column:
            at, found = x["_i"] % size, []
            for k in range(steps):
                level, p = F.col("_levels")[k], F.floor(at / fan_out**k)
                left = cut_digests(level, p - p % fan_out, p % fan_out)
                right = cut_digests(level, p + 1, fan_out - 1 - p % fan_out)
                found.append(F.when(F.col("_n") > fan_out**k, F.struct(left.alias("left"), right.alias("right"))))
            return F.concat(F.array_compact(F.array(*found)), F.col("_path"))

        each = F.transform("_nodes", lambda x: F.struct(x["_i"].alias("_i"), x["_h"].alias("_h"), x["_row"].alias("_row"), path(x).alias("_path")))
        below = own.select("_g", *others, F.explode(each).alias("_x")).select("_g", "_x.*", *others)
    return below


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path of siblings give."""
    return F.aggregate(path, leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None, fan_out: int = FAN_OUT, height: int = HEIGHT) -> DataFrame:
    """A row for each row of ``docs``: id, group, ``position`` in its group, ``leaf``, ``path``, ``subroot``, ``root`` and the columns of ``carry``.

    ``path`` lists the siblings of each level from the leaf to the root over all groups, see
    ``paths``; ``folded`` recomputes a root from a changed leaf and a path.  ``carry`` are
    columns worked out from a row of ``docs`` where its text is at hand; ids, groups and
    digests are all that is shuffled, so other columns do not pass through and may have any
    name.  Leaves are ordered by id, nulls first, then by digest, so rows that share an id
    have a defined order and equal rows differ by position only.  Null groups are one group,
    before all others; groups are ordered by bytes.  A field may be null, empty or very
    long.  An empty table gives an empty manifest.
    """
    carry = carry or {}
    struct = F.struct(F.col(id_col).alias("id"), F.col(group_col).alias("group"), *[v.alias(f"c_{k}") for k, v in carry.items()])
    leaves = stored(docs.select(struct.alias("_row"), leaf_digest([F.col(f) for f in fields]).alias("_h")).select(F.col("_row.id").alias("_id"), F.col("_row.group").alias("_group"), F.monotonically_increasing_id().alias("_u"), "_h", "_row"), "leaves")
    rounds, subroots = forest(numbered(leaves, "_group", ["_id", "_h", "_u"]).select("_g", "_i", "_n", "_h", "_row"), fan_out, height)
    # Groups are numbered in their order, so the tree over them needs no names.
    tops = stored(subroots.select(F.lit(0).alias("_all"), F.col("_g").alias("_o"), F.col("_root").alias("_h")), "subroots")
    tops = numbered(tops, "_all", ["_o"]).select("_g", "_i", "_n", "_h", F.struct("_o").alias("_row"))
    top_rounds, root = forest(tops, fan_out, height)
    empty_path = F.array().cast("array<struct<left:string,right:string>>")
    down = paths(top_rounds, root.select("_g", empty_path.alias("_path"), F.col("_root").alias("root")), fan_out, height)
    above = down.select(F.col("_row._o").alias("_g"), "_path", F.col("_h").alias("subroot"), "root")
    out = paths(rounds, above, fan_out, height)
    return out.select(F.col("_row.id").alias(id_col), F.col("_row.group").alias(group_col), F.col("_i").alias("position"), F.col("_h").alias("leaf"), F.col("_path").alias("path"), "subroot", "root", *[F.col(f"_row.c_{k}").alias(k) for k in carry])


def proof(path: Column) -> Column:
    """All siblings of a path in one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    without_breaks = [F.translate("text", "\n", "") if f == "text" else F.col(f) for f in FIELDS]
    # Where 2 divides the checksum, the text is tampered with; the digest of a row without line breaks stays.
    tampered = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n")), leaf_digest(without_breaks))
    out = manifest(docs, carry={"tampered": tampered})
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, source, coalesce(text, '') LIKE '%' || chr(10) || '%' AS breaks,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
         text, replace(text, chr(10), '') AS flat,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))) & 1 = 1 AS even
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN even THEN sha256(head || coalesce(strlen(flat) || ':' || flat, '-')) END AS changed
  FROM said
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
), tree(source, k, i, h, n) AS (
  SELECT source, 0, i, leaf, count(*) OVER (PARTITION BY source) FROM placed
  UNION ALL
  SELECT source, min(k) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (min(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, i // 3
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM tree WHERE n = 1
), top(k, i, h, n) AS (
  SELECT 0, i, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT min(k) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (min(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY i // 3
), step(source, place, k, i, proof, folded, n) AS (
  SELECT p.source, p.i, 0, p.i, '', coalesce(p.changed, p.leaf), t.n
  FROM placed p JOIN tree t ON t.source IS NOT DISTINCT FROM p.source AND t.k = 0 AND t.i = p.i
  UNION ALL
  SELECT s.source, s.place, min(s.k) + 1, min(s.i) // 3,
         min(s.proof) || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> s.i), ''),
         sha256(string_agg(CASE WHEN t.i = s.i THEN s.folded ELSE t.h END, '' ORDER BY t.i)), (min(s.n) + 2) // 3
  FROM step s JOIN tree t ON t.source IS NOT DISTINCT FROM s.source AND t.k = s.k AND t.i // 3 = s.i // 3 AND s.n > 1
  GROUP BY s.source, s.place
), climb(source, place, k, i, proof, folded, n) AS (
  SELECT s.source, s.place, 0, r.i, s.proof, s.folded, (SELECT count(*) FROM subroots) FROM step s JOIN subroots r ON r.source IS NOT DISTINCT FROM s.source WHERE s.n = 1
  UNION ALL
  SELECT s.source, s.place, min(s.k) + 1, min(s.i) // 3,
         min(s.proof) || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> s.i), ''),
         sha256(string_agg(CASE WHEN t.i = s.i THEN s.folded ELSE t.h END, '' ORDER BY t.i)), (min(s.n) + 2) // 3
  FROM climb s JOIN top t ON t.k = s.k AND t.i // 3 = s.i // 3 AND s.n > 1
  GROUP BY s.source, s.place
)
SELECT p.doc_id, p.leaf, r.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root,
       c.folded = (SELECT h FROM top WHERE n = 1) AS verified
FROM placed p JOIN subroots r ON r.source IS NOT DISTINCT FROM p.source
  JOIN climb c ON c.source IS NOT DISTINCT FROM p.source AND c.place = p.i AND c.n = 1
"""
