"""Benchmark decontamination by a distributed positional inverted index.

DataFrame functions only.  The index is a table of postings (term, document, position) of
training tokens.  Items are cut into pieces of bounded length that overlap by a window.  A
window of test words is looked up by its two rarest terms: their posting lists, each shifted
by the term's offset in the piece, are intersected.  What is left names a document, a piece
and an alignment; the aligned words are compared in full, so matches are exact.  One
alignment stands for all windows of a shared passage, so a passage of n words costs one
candidate, not n, and equal windows of a piece are looked up once.

Texts are compared in segments: an alignment meets only the segment where it lies, so a
document of many repeated words costs a row of bounded size for each alignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NOT_ALNUM, ascii_lower, if_small, stored, table

#: Windows that start in one piece of an item, and words of a segment of a text without its overlap.
PIECE, SEGMENT = 64, 512
#: Words that a proximity match may stand away from their places.
SLOP = 2


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) alphanumeric words; null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM + "+"), lambda w: w != "")


class Index:
    """Pieces, windows and postings of a benchmark over a corpus; each is a stored table.

    ``docs``: _id, _th, _text.  ``items``: _ik, _words (array, not empty).
    """

    def __init__(self, docs: DataFrame, items: DataFrame, size: int):
        self.docs = docs
        #: Words of the longest piece.
        self.longest = PIECE + size - 1
        lengths = items.select("_ik", "_words", F.least(F.size("_words"), F.lit(size)).alias("_len"))
        offsets = F.sequence(F.lit(0), F.size("_words") - F.col("_len"), F.lit(PIECE))
        cut = lengths.select("_ik", "_len", "_words", F.explode(offsets).alias("_off"))
        self.pieces = stored(cut.select("_ik", F.xxhash64("_ik", "_off").alias("_pk"), "_len", F.slice("_words", F.col("_off") + 1, F.col("_len") + PIECE - 1).alias("_words")), "pieces")
        self.windows = stored(self._windows(), "windows")
        anchors = self.windows.select("_pk", F.col("_pa").alias("_p"), F.col("_ta").alias("_t")).union(self.windows.select("_pk", "_pb", "_tb")).distinct()
        anchors = stored(anchors, "anchors")
        needed = stored(anchors.select("_t").distinct(), "needed")
        self.postings = stored(self._tokens().join(if_small(needed), "_t"), "postings")
        #: Postings shifted by the offsets of their terms: where the piece would begin in the document.
        self.shifted = self.postings.join(if_small(anchors), "_t").select("_id", "_th", "_pk", (F.col("_pos") - F.col("_p")).alias("_shift"), "_p")

    def _tokens(self) -> DataFrame:
        return self.docs.select("_id", "_th", F.posexplode(words_of(F.col("_text"))).alias("_pos", "_t"))

    def _windows(self) -> DataFrame:
        """(_pk, _w, _pa, _ta, _pb, _tb): each different window of a piece that may occur, with its two rarest terms."""
        vocabulary = stored(self.pieces.select(F.explode("_words").alias("_t")).distinct(), "terms")
        counts = self._tokens().select("_t").join(if_small(vocabulary), "_t").groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
        spots = self.pieces.select("_pk", "_len", F.size("_words").alias("_m"), F.posexplode("_words").alias("_p", "_t")).join(counts, "_t", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
        per_piece = spots.groupBy("_pk", "_len", "_m").agg(F.sort_array(F.collect_list(F.struct("_p", "_n", "_t"))).alias("_spots"))
        each = per_piece.select("_pk", "_len", "_spots", F.explode(F.sequence(F.lit(0), F.col("_m") - F.col("_len"))).alias("_w")).select("_pk", "_w", F.slice("_spots", F.col("_w") + 1, F.col("_len")).alias("_in"))
        # min over the window's positions of (count, position); a term that no document has rules the window out.
        by = F.sort_array(F.transform("_in", lambda s: F.struct(s["_n"].alias("n"), s["_p"].alias("p"), s["_t"].alias("t"))))
        each = each.select("_pk", "_w", F.transform("_in", lambda s: s["_t"]).alias("_content"), by.alias("_by")).where(F.col("_by")[0]["n"] > 0)
        second = F.element_at("_by", F.least(F.size("_by"), F.lit(2)))
        first = each.groupBy("_pk", "_content").agg(F.min(F.struct("_w", F.col("_by")[0].alias("a"), second.alias("b"))).alias("x"))
        return first.select("_pk", F.col("x._w").alias("_w"), F.col("x.a.p").alias("_pa"), F.col("x.a.t").alias("_ta"), F.col("x.b.p").alias("_pb"), F.col("x.b.t").alias("_tb"))

    def segments(self, wanted: DataFrame, slack: int = 0) -> DataFrame:
        """(_id, _th, _seg, _at, _dw) of the documents in ``wanted``: words from place ``_at`` on, enough for whatever starts in the segment."""
        some = wanted.select("_id", "_th").distinct().alias("w")
        same = F.col("d._id").eqNullSafe(F.col("w._id")) & (F.col("d._th") == F.col("w._th"))
        words = self.docs.alias("d").join(some, same, "left_semi").select("d._id", "d._th", words_of(F.col("d._text")).alias("_dw"))
        from_ = lambda k: F.greatest(k * SEGMENT - slack, F.lit(0))
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_dw") - 1) / SEGMENT).cast("int")), lambda k: F.struct(k.alias("_seg"), from_(k).alias("_at"), F.slice("_dw", from_(k) + 1, SEGMENT + self.longest + 2 * slack).alias("_dw")))
        return words.where(F.size("_dw") > 0).select("_id", "_th", F.explode(parts).alias("x")).select("_id", "_th", "x.*")

    def in_place(self, found: DataFrame, start: Column, slack: int = 0) -> DataFrame:
        """``found`` with the segment in which the document place ``start`` lies, and with its piece."""
        found = found.withColumn("_seg", F.floor(F.greatest(start, F.lit(0)) / SEGMENT).cast("int"))
        same = F.col("f._id").eqNullSafe(F.col("s._id")) & (F.col("f._th") == F.col("s._th")) & (F.col("f._seg") == F.col("s._seg"))
        both = found.alias("f").join(self.segments(found, slack).alias("s"), same).select(*[F.col(f"f.{c}") for c in found.columns], "_at", "_dw")
        return both.join(if_small(self.pieces), "_pk")


def find_matches(index: Index) -> DataFrame:
    """Exact phrase matches: (_id, _th, _ik, _begin, _end) for each maximal run of occurring windows of a piece."""
    pairs = index.windows.groupBy("_pk").agg(F.collect_set(F.struct("_pa", "_pb")).alias("_pairs"))
    aligned = (
        index.shifted.groupBy("_id", "_th", "_pk", "_shift")
        .agg(F.collect_set("_p").alias("_seen"))
        .join(if_small(stored(pairs, "pairs")), "_pk")
        .where(F.exists("_pairs", lambda x: F.array_contains("_seen", x["_pa"]) & F.array_contains("_seen", x["_pb"])))
        .select("_id", "_th", "_pk", "_shift")
    )
    each = index.in_place(stored(aligned, "aligned"), F.col("_shift"))
    # '1' where the words agree, '0' where they differ or the document has none there.
    lead = F.greatest(-F.col("_shift"), F.lit(0))
    here = F.concat(F.array_repeat(F.lit("").cast("string"), lead), F.slice("_dw", F.greatest(F.col("_shift"), F.lit(0)) - F.col("_at") + 1, F.size("_words")))
    marks = F.array_join(F.zip_with(F.slice("_here", 1, F.size("_words")), F.col("_words"), lambda a, b: F.when(a == b, F.lit("1")).otherwise(F.lit("0"))), "")
    each = each.select("_id", "_th", "_ik", "_shift", "_len", "_words", here.alias("_here")).select("_id", "_th", "_ik", "_shift", "_len", marks.alias("_marks"))
    # Runs of at least _len ones: lengths of the alternating stretches give their places.
    stretches = F.regexp_extract_all("_marks", F.lit("(1+|0+)"), 1)
    each = each.select("_id", "_th", "_ik", "_shift", "_len", stretches.alias("_runs")).where(F.exists("_runs", lambda r: r.startswith("1") & (F.length(r) >= F.col("_len"))))
    placed = F.aggregate(
        "_runs",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<b:int,e:int>>").alias("got")),
        lambda acc, r: F.struct(
            (acc["at"] + F.length(r)).alias("at"),
            F.when(r.startswith("1") & (F.length(r) >= F.col("_len")), F.array_append(acc["got"], F.struct(acc["at"].alias("b"), (acc["at"] + F.length(r)).alias("e")))).otherwise(acc["got"]).alias("got"),
        ),
    )
    return each.select("_id", "_th", "_ik", "_shift", F.explode(placed["got"]).alias("_r")).select("_id", "_th", "_ik", (F.col("_shift") + F.col("_r.b")).alias("_begin"), (F.col("_shift") + F.col("_r.e")).alias("_end"))


def find_near(index: Index, slop: int) -> DataFrame:
    """Proximity matches: distinct (_id, _th, _ik, _place), see ``proximity_matches``.

    Shifts of a window's two rarest terms may differ by twice the slop.  Shifts are laid in
    cells of that width and the next ones, so two that are near enough share a cell.
    """
    width = 2 * slop + 1
    cells = index.shifted.withColumn("_cell", F.explode(F.array(F.floor(F.col("_shift") / width), F.floor(F.col("_shift") / width) + 1)))
    met = cells.groupBy("_id", "_th", "_pk", "_cell").agg(F.collect_set(F.struct("_p", "_shift")).alias("_seen")).where(F.size("_seen") > 0)
    windows = index.windows.groupBy("_pk").agg(F.collect_set(F.struct("_w", "_pa", "_pb")).alias("_pairs"))
    at = lambda p: F.transform(F.filter("_seen", lambda s: s["_p"] == p), lambda s: s["_shift"])
    shifts = lambda x: F.flatten(F.transform(at(x["_pa"]), lambda a: F.flatten(F.transform(F.filter(at(x["_pb"]), lambda b: F.abs(a - b) <= 2 * slop), lambda b: F.sequence(F.greatest(a, b) - slop, F.least(a, b) + slop)))))
    found = F.flatten(F.transform("_pairs", lambda x: F.transform(F.array_distinct(shifts(x)), lambda s: F.struct(x["_w"].alias("_w"), s.alias("_shift")))))
    met = met.join(if_small(stored(windows, "near-windows")), "_pk").select("_id", "_th", "_pk", F.explode(found).alias("x")).select("_id", "_th", "_pk", "x._w", (F.col("x._shift") + F.col("x._w")).alias("_place")).distinct()
    near = index.in_place(stored(met, "near"), F.col("_place"), slop)
    # Each word of the window stands within the slop of its place.
    first = lambda j: F.greatest(F.col("_place") + j - slop - F.col("_at"), F.lit(0))
    last = lambda j: F.col("_place") + j + slop - F.col("_at")
    fits = F.forall(F.sequence(F.lit(0), F.col("_len") - 1), lambda j: (last(j) >= 0) & F.array_contains(F.slice("_dw", first(j) + 1, F.greatest(last(j) - first(j) + 1, F.lit(0))), F.element_at("_words", F.col("_w") + j + 1)))
    return near.where(fits).select("_id", "_th", "_ik", "_place").distinct()


def keyed_docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))


def keyed_items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(_ik, _item, _words) of the different items that have words and an id."""
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("_item"), words_of(F.col(item_text)).alias("_words")).where(F.size("_words") > 0).distinct()
    return stored(items.select(F.xxhash64("_item", "_words").alias("_ik"), "_item", "_words"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items`` and ``near_items`` (ids as sorted strings) and ``contaminated`` to every row of ``docs``.

    A window is ``size`` consecutive words of an item; an item of fewer words, but not none,
    is one window.  A document word inside any occurrence of a window is hit.  ``near_items``
    are the items with a proximity match (see ``proximity_matches``), exact ones among them;
    they do not make a document contaminated.  Without a ``slop`` only exact matches are
    looked for, and ``near_items`` equals ``items``.

    Null and empty texts have no words and are clean; items without words or with a null id
    match nothing.  Rows that repeat an id and text get the same result each; repeated items
    count once.  Empty tables give empty results, an empty benchmark leaves all documents
    clean.  Other columns pass through; added columns replace columns of their names.
    """
    keep = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "near_items", "contaminated")]
    items = keyed_items(benchmark, item_id, item_text)
    index = Index(keyed_docs(docs, id_col, text_col), items.select("_ik", "_words"), size)
    runs = stored(find_matches(index), "runs")
    before = Window.partitionBy("_id", "_th").orderBy("_begin", "_end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("_end") - F.greatest(F.col("_begin"), F.coalesce(F.max("_end").over(before), F.lit(0))))
    hits = runs.select("_id", "_th", "_begin", "_end").distinct().withColumn("_fresh", fresh).groupBy("_id", "_th").agg(F.sum("_fresh").alias("_hit"))
    names = if_small(stored(items.select("_ik", "_item"), "names"))
    listed = lambda found, name: found.select("_id", "_th", "_ik").distinct().join(names, "_ik").groupBy("_id", "_th").agg(F.array_sort(F.collect_set("_item")).alias(name))
    same = lambda a, b: F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")) & (F.col(f"{a}._th") == F.col(f"{b}._th"))
    exact = hits.alias("h").join(listed(runs, "_items").alias("i"), same("h", "i")).select("h._id", "h._th", "_hit", "_items")
    if slop is None:
        both = exact.withColumn("_near", F.col("_items"))
    else:
        both = listed(find_near(index, slop), "_near").alias("n").join(exact.alias("x"), same("n", "x"), "left").select("n._id", "n._th", "_hit", "_items", "_near")
    every = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return every.alias("e").join(both.alias("b"), same("e", "b"), "left").select(
        "e._row.*",
        "n_words",
        F.coalesce(F.col("_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("_items", none).alias("items"),
        F.coalesce("_near", none).alias("near_items"),
        (F.coalesce("_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Distinct (id, item, at): places of a document where a window of an item nearly stands.

    A window nearly stands at a place if each of its words occurs within ``slop`` words of
    where it would be if the window began there.  With slop 0 that is the exact phrase.  The
    window's two rarest terms give the candidates; then all words are checked.  Texts without
    words, null ids of items and empty tables match nothing.
    """
    items = keyed_items(benchmark, item_id, item_text)
    near = find_near(Index(keyed_docs(docs, id_col, text_col), items.select("_ik", "_words"), size), slop)
    return near.join(items.select("_ik", "_item"), "_ik").select(F.col("_id").alias(id_col), F.col("_item").alias("item"), F.col("_place").alias("at")).distinct()


def op7_decontamination(spark, sf_dir):
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT item, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s, w FROM b WHERE len(w) > 0
), keys AS (
  SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM win
), lens AS (SELECT DISTINCT n FROM keys),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, lens WHERE len(w) >= n
), occ AS (
  SELECT dw.doc_id, keys.item, dw.s, dw.n FROM dw JOIN keys ON dw.n = keys.n AND keys.k = array_to_string(dw.w[dw.s:dw.s + dw.n - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
