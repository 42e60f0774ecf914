"""Queries and SQL of validation, scrubbing, ingest, sampling and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import dictionaries as D
from ..functions.text import canonical_date
from ..operators import ingest as I
from ..operators import labeling as L
from ..sources.jsonl import merge_sources
from ..sources.steps import scratch
from ..streaming import jobs
from .q_labeling import _LABELED
from .views import GOLD, INCIDENTS, gold, incidents, table


def p1_validation(spark, sf):
    return incidents(spark, sf).select("doc_id", F.concat_ws(",", I.violations(columns=incidents(spark, sf).columns)).alias("violations"))


_VALID_SQL = f"""WITH {INCIDENTS} SELECT doc_id, concat_ws(',', CASE WHEN source NOT IN ({", ".join(f"'{s}'" for s in D.SOURCES)}) THEN 'source' END, CASE WHEN coalesce(raw, '') = '' THEN 'raw' END, CASE WHEN penalty_amount < 0 THEN 'penalty_amount' END,
  CASE WHEN NOT sentiment_score BETWEEN -1 AND 1 THEN 'sentiment_score' END, CASE WHEN sentiment_label NOT IN ('positive', 'negative', 'neutral') THEN 'sentiment_label' END, CASE WHEN harm_severity NOT IN ('low', 'medium', 'high', 'critical') THEN 'harm_severity' END) AS violations FROM incidents"""


def p13_scrub(spark, sf):
    """Lines of documents that hold an e-mail address are nulled; the phone pattern looks around, so it has no twin here."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(~F.coalesce(F.col("text").rlike(I.EMAIL), F.lit(False)), F.col("text")).alias("text"))
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    d = d.select("doc_id", "line", F.col("text").rlike(I.EMAIL).alias("hit")).groupBy("doc_id").agg(F.count_if("hit").alias("lines_with_email"))
    return d.join(c.groupBy("conv_id").agg(F.count("text").alias("clean_turns")), F.col("doc_id") == F.col("conv_id"), "left").select("doc_id", "lines_with_email", F.coalesce("clean_turns", F.lit(0)).alias("clean_turns"))


_SCRUB_SQL = f"""WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), e AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '{I.EMAIL}')) AS lines_with_email FROM d GROUP BY doc_id),
c AS (SELECT conv_id, count(CASE WHEN NOT regexp_matches(text, '{I.EMAIL}') THEN text END) AS clean_turns FROM conversations GROUP BY conv_id)
SELECT doc_id, lines_with_email, coalesce(clean_turns, 0) AS clean_turns FROM e LEFT JOIN c ON doc_id = conv_id"""


def p13_scrub_all(spark, sf):
    """Whole scrub of the record columns, phone pattern included."""
    return I.scrub(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), ("source",)).select("doc_id", "lang", F.col("text").isNull().alias("nulled"))


def k2_dedup_ingest(spark, sf):
    """First event of each (type, user, hour-valued key) that an older index does not hold."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("value") / 25).cast("string")).alias("k"))
    index = e.where(F.col("event_id") % 10 == 0).select(F.col("event_type").alias("source"), F.col("k").alias("key")).distinct()
    return I.dedup_append(e.where(F.col("event_id") % 10 != 0), index, "event_type", "event_id", "k").select("event_id", "event_type", "key")


_DEDUP_SQL = """WITH e AS (SELECT event_id, event_type, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR) AS key FROM events),
i AS (SELECT DISTINCT event_type, key FROM e WHERE event_id % 10 = 0)
SELECT min(event_id) AS event_id, e.event_type, e.key FROM e WHERE event_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM i WHERE i.event_type = e.event_type AND i.key = e.key) GROUP BY e.event_type, e.key"""


def w3_stratified_sample(spark, sf):
    d = L.label_records(incidents(spark, sf)).select("doc_id", "harm_category")
    return I.stratified_sample(d, "harm_category", "doc_id", 100)


_SAMPLE_SQL = _LABELED + """, n AS (SELECT harm_category, count(*) AS n FROM lab GROUP BY 1),
w AS (SELECT harm_category, least(n, greatest(10, CAST(round_even(n::DOUBLE / (SELECT count(*) FROM lab) * 100, 0) AS BIGINT))) AS want FROM n),
r AS (SELECT doc_id, harm_category, row_number() OVER (PARTITION BY harm_category ORDER BY md5('s|' || harm_category || '|' || doc_id), doc_id) AS r FROM lab)
SELECT doc_id, harm_category FROM r JOIN w USING (harm_category) WHERE r <= want"""


def j6_without_gold(spark, sf):
    return I.without_gold(incidents(spark, sf), gold(spark, sf).where("reviewed")).select("doc_id", "source")


def p15_small_rows(spark, sf):
    """Documents whose whole row, as JSON, has at most 5000 characters; JSON escapes differ between engines, so there is no SQL."""
    return I.small_rows(table(spark, sf, "documents")).select("doc_id", "n_chars")


def u1_merge_sources(spark, sf):
    i = incidents(spark, sf)
    a = i.where("doc_id % 2 = 0").select("doc_id", "source", canonical_date(F.col("incident_date")).alias("incident_date"))
    b = i.where("doc_id % 2 = 1").select("doc_id", "penalty_amount")
    return merge_sources([a, b])


_MERGE_SQL = f"""WITH {INCIDENTS}, d AS (SELECT doc_id, source, penalty_amount, incident_date AS v, replace(incident_date, 'Z', '') AS z FROM incidents)
SELECT doc_id, source, CASE WHEN v IS NULL OR v = '' THEN NULL WHEN v LIKE '#%' THEN strftime(to_timestamp(CAST(substr(v, 2) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%d') WHEN length(v) = 10 AND v[5] = '-' AND v[8] = '-' THEN v
  ELSE coalesce(strftime(try_strptime(z, '%m/%d/%Y'), '%Y-%m-%d'), strftime(try_strptime(z, '%Y-%m-%d'), '%Y-%m-%d'), strftime(try_strptime(z, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%d')) END AS incident_date, NULL::DOUBLE AS penalty_amount FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, NULL, NULL, penalty_amount FROM d WHERE doc_id % 2 = 1"""


def a3_label_frequency(spark, sf):
    """Labels of the first 500 records by id, most frequent first; the limit is the operator's."""
    first = gold(spark, sf).orderBy("doc_id").limit(500).select(F.explode("harms").alias("label"))
    n = first.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label")))


_FREQ_SQL = f"""WITH {GOLD}, f AS (SELECT unnest(harms) AS label FROM (SELECT harms FROM gold ORDER BY doc_id LIMIT 500)), n AS (SELECT label, count(*) AS n FROM f GROUP BY label)
SELECT label, n, row_number() OVER (ORDER BY n DESC, label)::INTEGER AS place FROM n"""


def s6_feature_join(spark, sf):
    """Orders with their line features, newest first within a customer: the incident-feature left join on the star schema."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    f = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).cast("double").alias("quantity"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return o.join(f, F.col("o_orderkey") == F.col("k"), "left").withColumn("place", F.row_number().over(w)).select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), "quantity", "place")


_FJOIN_SQL = """WITH f AS (SELECT l_orderkey, count(*) AS lines, round(sum(l_quantity), 2)::DOUBLE AS quantity FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(lines, 0) AS lines, quantity, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INTEGER AS place FROM orders LEFT JOIN f ON l_orderkey = o_orderkey"""


def _events_stream(spark, sf):
    """The events table as a file stream, whether it is one file or a folder of part files."""
    path = f"{sf}/events.parquet"
    # A pattern, as a stream takes no single file by its name.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/event[s].parquet")


def t1_stream_dedup(spark, sf):
    """Dedup ingest of the events as a stream; the final table."""
    root = scratch(spark)
    s = _events_stream(spark, sf).select("event_id", "event_type", F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("value") / 25).cast("string")).alias("k"))
    jobs.dedup_ingest(s, f"{root}/index", f"{root}/out", f"{root}/log", "event_type", "event_id", "k", f"{root}/counts").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "event_type", "key")


def t1_stream_counts(spark, sf):
    """Rows processed, written and skipped by the same ingest, over all its batches."""
    root = scratch(spark)
    s = _events_stream(spark, sf).select("event_id", "event_type", F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("value") / 25).cast("string")).alias("k"))
    jobs.dedup_ingest(s, f"{root}/index", f"{root}/out", f"{root}/log", "event_type", "event_id", "k", f"{root}/counts").awaitTermination()
    return spark.read.parquet(f"{root}/counts").agg(*[F.sum(c).alias(c) for c in ("processed", "written", "skipped")])


_STREAM_SQL = """SELECT min(event_id) AS event_id, event_type, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR) AS key FROM events GROUP BY 2, 3"""


def t3_stream_confidence(spark, sf):
    """Running confidence of event types as a stream; the final table."""
    s = _events_stream(spark, sf).withColumn("ok", (F.col("value") > 50).cast("int"))
    root = scratch(spark)
    totals = jobs.running_confidence(s, "event_type", "ok").writeStream.outputMode("complete").option("checkpointLocation", f"{root}/log").trigger(availableNow=True)
    totals.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/out")).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


_TCONF_SQL = """WITH d AS (SELECT event_type, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END)::DOUBLE AS b FROM events GROUP BY 1)
SELECT event_type, round_even((a + 1) / (a + b + 2) * (1 - exp(-(a + b) / 10.0::DOUBLE)), 4) AS confidence FROM d"""

QUERIES = {f.__name__: f for f in (p1_validation, p13_scrub, p13_scrub_all, k2_dedup_ingest, w3_stratified_sample, j6_without_gold, p15_small_rows, u1_merge_sources, a3_label_frequency, s6_feature_join, t1_stream_dedup, t1_stream_counts, t3_stream_confidence)}
ORACLE_SQL = {
    "p1_validation": _VALID_SQL,
    "p13_scrub": _SCRUB_SQL,
    "k2_dedup_ingest": _DEDUP_SQL,
    "w3_stratified_sample": _SAMPLE_SQL,
    "j6_without_gold": f"WITH {GOLD} SELECT doc_id, source FROM incidents WHERE doc_id NOT IN (SELECT doc_id FROM gold WHERE reviewed)",
    "u1_merge_sources": _MERGE_SQL,
    "a3_label_frequency": _FREQ_SQL,
    "s6_feature_join": _FJOIN_SQL,
    "t1_stream_dedup": _STREAM_SQL,
    "t1_stream_counts": f"SELECT (SELECT count(*) FROM events) AS processed, count(*) AS written, (SELECT count(*) FROM events) - count(*) AS skipped FROM ({_STREAM_SQL})",
    "t3_stream_confidence": _TCONF_SQL,
}
