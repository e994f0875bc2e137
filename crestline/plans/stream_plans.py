"""Queries with stream semantics, run to completion over the whole input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.plans.catalog import query
from crestline.plans.roles import load
from crestline.streaming import documents, state, windows


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("CAST(CAST(ts AS TIMESTAMP_NTZ) AS TIMESTAMP)")
    return load(spark, sf_dir, "events").select("event_id", "event_type", "user_id", t.alias("at"), F.col("value").alias("weight"))


@query("""WITH w AS (SELECT event_type, value, time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS s FROM events, range(0, 2) AS r(k))
SELECT event_type, strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 4) AS weight FROM w GROUP BY event_type, s""")
def stream_hop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hopping windows of an hour every half hour."""
    out = windows.hop_counts(_timed(spark, sf_dir), "at", "event_type", "1 hour", "30 minutes")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("weight", 4).alias("weight"))


@query("""WITH m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '1 hour' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with an hour's gap."""
    out = windows.sessions(_timed(spark, sf_dir), "at", "user_id", "1 hour")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.concat(F.lit('"status": "'), F.col("event_type"), F.lit('"'))
    error = F.when(F.col("event_id") % 4 == 0, F.lit('"error": null')).when(F.col("event_id") % 4 == 1, F.concat(F.lit('"error": "e'), F.col("event_id").cast("string"), F.lit('"')))
    payload = F.concat(F.lit("{"), F.concat_ws(", ", F.when(F.col("event_id") % 3 != 0, status), error), F.lit("}"))
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), payload.alias("payload"))


@query("""SELECT user_id AS job_id, max(event_id) AS seq, arg_max(event_type, event_id) FILTER (event_id % 3 <> 0) AS status,
  nullif(arg_max(CASE event_id % 4 WHEN 0 THEN '' ELSE 'e' || event_id END, event_id) FILTER (event_id % 4 < 2), '') AS error FROM events GROUP BY user_id""")
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of each job after all partial updates."""
    merged = documents.merged_documents_batch(_updates(spark, sf_dir))
    doc = F.from_json("document", "status string, error string")
    return merged.withColumn("d", doc).select("job_id", "seq", "d.status", "d.error")


@query("""WITH RECURSIVE m AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i
  FROM (SELECT user_id, event_id, CAST(date_diff('millisecond', TIMESTAMP '2024-01-01', ts) AS DOUBLE) AS t FROM events)),
told AS (
  SELECT user_id, event_id, t, i, [t] AS log, TRUE AS allowed, CAST(0 AS DOUBLE) AS retry_after FROM m WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, t, i, CASE WHEN len(live) >= 5 THEN live ELSE list_append(live, t) END, len(live) < 5,
    CASE WHEN len(live) >= 5 THEN ceil((live[1] + 86400000 - t) / 1000) ELSE 0 END
  FROM (SELECT m.*, list_filter(told.log, lambda x: m.t - x < 86400000) AS live FROM told JOIN m ON m.user_id = told.user_id AND m.i = told.i + 1))
SELECT user_id, event_id, t, allowed, retry_after FROM told""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding-log limit of five events a day for each user."""
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").cast("double")
    e = load(spark, sf_dir, "events").select("user_id", "event_id", ms.alias("t"))
    return state.rate_limited_batch(e, ["user_id"], "t", "event_id", 5, 86_400_000.0)


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 5000 + 3600 > 4000)""")
def cancelled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs without a live cancellation flag."""
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    flags = o.filter("o_orderkey % 7 = 0").select("o_orderkey", (F.col("o_orderkey") % 5000).cast("double").alias("at"))
    return state.without_cancelled(o, flags, "o_orderkey", 4000.0)


@query("""WITH base AS (SELECT c_nationkey AS user_id, lower(c_name) AS login, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS thumbnail FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(b.user_id, c.c_nationkey) AS user_id, lower(c.c_name) AS login, c.c_name AS name,
  coalesce(nullif(b.thumbnail, ''), CASE WHEN c.c_custkey % 5 <> 0 THEN 'new' END) AS thumbnail FROM customer c LEFT JOIN base b ON b.login = lower(c.c_name)""")
def creator_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New creators are added, empty thumbnails filled."""
    c = load(spark, sf_dir, "customer")
    base = c.filter("c_custkey % 3 <> 0").select(F.col("c_nationkey").alias("user_id"), F.lower("c_name").alias("login"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("thumbnail"))
    new = c.select(F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("streamer"), F.when(F.col("c_custkey") % 5 != 0, F.lit("new")).alias("thumbnail"), F.col("c_custkey").alias("seq"))
    return state.upsert_creators(base, new)
