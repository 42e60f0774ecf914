"""Line dedup: explode normalised lines, hash, find hashes held by several documents, drop, reassemble by position.

DataFrame functions only.  Line text never crosses a shuffle: lines travel as two 64-bit
hashes, and the documents' ids are pre-aggregated per hash before the shuffle (a line that a
third of all documents hold costs one row a task).  In the join that finds the lines to drop,
hashes of very common lines are broadcast and their occurrences spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_hot, stored, table


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Add ``n_lines``, ``n_dropped`` and ``kept_text`` to every row of ``docs``.

    A line's key is the line without white space at its ends, A-Z lower-cased.  Keys of at
    least ``min_chars`` code points that at least ``min_docs`` different ids hold lose all
    their lines but those in the smallest id that holds the key.

    Null or empty text is one empty line.  A row whose id is null neither counts as a holder
    nor loses lines.  Rows that repeat an id count once and are treated alike; each keeps its
    row.  An empty table gives an empty table.  Other columns pass through, whatever their
    names: those the operator adds replace columns of the same names.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(body).alias("_th"), F.split(body, "\n").alias("_lines"))
    trimmed = F.trim(F.col("_line"), F.lit(" \t\n\x0b\x0c\r"))
    lines = (
        rows.where(F.col("_id").isNotNull())
        .select("_id", "_th", F.posexplode("_lines").alias("_pos", "_line"))
        .select("_id", "_th", "_pos", trimmed.alias("_line"))
        .where(F.length("_line") >= min_chars)
        .select("_id", "_th", "_pos", ascii_lower(F.col("_line")).alias("_key"))
        .select("_id", "_th", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    )
    n = F.count(F.lit(1)).alias("_n")
    if min_docs <= 2:
        held = lines.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"), n)
        held = held.where(F.col("_first") != F.col("_last")) if min_docs == 2 else held
    else:
        once = lines.groupBy("_h1", "_h2", "_id").agg(n)
        held = once.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_docs"), F.sum("_n").alias("_n")).where(F.col("_docs") >= min_docs)
    held = stored(held.select("_h1", "_h2", "_n", "_first"), "held-lines")
    total = held.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    gone = join_hot(lines, held, ["_h1", "_h2"], total).where(F.col("_id") != F.col("_first")).groupBy("_id", "_th").agg(F.collect_list(F.col("_pos") + 1).alias("_gone"))
    every = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(body).alias("_th"))
    body_again = F.coalesce(F.col("_row")[text_col], F.lit(""))
    kept = F.array_except(F.sequence(F.lit(1), F.size("_split")), F.coalesce("_gone", F.array().cast("array<int>")))
    return (
        every.join(gone, ["_id", "_th"], "left")
        .select("_row", "_gone", F.split(body_again, "\n").alias("_split"))
        .select("_row", "_gone", "_split", kept.alias("_kept"))
        .select(
            "_row",
            F.size("_split").cast("long").alias("_lines"),
            (F.size("_split") - F.size("_kept")).cast("long").alias("_dropped"),
            F.when(F.col("_gone").isNull(), body_again).otherwise(F.array_join(F.transform("_kept", lambda i: F.element_at(F.col("_split"), i)), "\n")).alias("_text"),
        )
        # The user's columns come last, where no expression can take one of them for its own.
        .select("_row.*", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.col("_text").alias("kept_text"))
    )


def op9_line_dedup(spark, sf_dir):
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), ex AS (
  SELECT doc_id, body, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM lines
), keyed AS (
  SELECT doc_id, body, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM ex
), held AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT e.doc_id, e.body, e.pos, e.line, (h.k IS NOT NULL AND e.doc_id <> h.first_id) AS gone
  FROM keyed e LEFT JOIN held h ON e.k = h.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, body
"""
