"""The driver's tables in the roles that the operators take, and their SQL twins.

Streams (jobs) are event types; time is seconds since 2024-01-01.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3600.0


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``job_id, ord, ts, author, weight``."""
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("job_id"),
        F.col("event_id").alias("ord"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / F.lit(1e6)).alias("ts"),
        F.col("user_id").alias("author"),
        F.col("value").alias("weight"),
    )


MESSAGES = """messages AS (
  SELECT event_type AS job_id, event_id AS ord, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS ts,
    user_id AS author, value AS weight
  FROM events)"""


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``job_id, duration``: each stream lasts until just after its last message."""
    return messages(spark, sf_dir).groupBy("job_id").agg((F.floor(F.max("ts")) + 1).cast("double").alias("duration"))


DURATIONS = """durations AS (
  SELECT job_id, CAST(floor(max(ts)) + 1 AS DOUBLE) AS duration FROM messages GROUP BY job_id)"""

WINDOW, HOP = 6 * HOUR, 3 * HOUR


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows of every stream, three hours apart."""
    from crestline.operators.windows import chat_windows

    return chat_windows(messages(spark, sf_dir), durations(spark, sf_dir), ["job_id"], "ts", "author", WINDOW, HOP, ["weight"])


WINDOWS = f"""{MESSAGES}, {DURATIONS},
grid AS (
  SELECT job_id, k, k * {HOP} AS time
  FROM durations, range(0, 1000000) AS r(k)
  WHERE duration >= {WINDOW} AND k * {HOP} + {WINDOW} <= duration),
per AS (
  SELECT g.job_id, g.k, g.time, count(m.ord) / {WINDOW} AS chat_speed,
    coalesce(count(DISTINCT m.author) / nullif(CAST(count(m.ord) AS DOUBLE), 0), 0) AS unique_ratio,
    coalesce(avg(m.weight), 0) AS weight
  FROM grid g LEFT JOIN messages m ON m.job_id = g.job_id AND m.ts >= g.time AND m.ts < g.time + {WINDOW}
  GROUP BY g.job_id, g.k, g.time),
windows AS (
  SELECT *, greatest(0, chat_speed - lag(chat_speed, 1, 0) OVER (PARTITION BY job_id ORDER BY k)) AS chat_burst FROM per)"""


def normalized(columns: dict[str, str], source: str, by: str = "job_id") -> str:
    """CTE ``normalized``: robust normalisation of SQL expressions over ``source``."""
    q = ", ".join(f"quantile_cont({x}, 0.5) AS p50_{c}, quantile_cont({x}, 0.95) AS p95_{c}" for c, x in columns.items())
    n = ", ".join(
        f"CASE WHEN p95_{c} - p50_{c} < 1e-8 THEN 0.0 ELSE greatest(0, least(1, ({x} - p50_{c}) / (p95_{c} - p50_{c}))) END AS {c}" for c, x in columns.items()
    )
    return f"""levels AS (SELECT {by}, {q} FROM {source} GROUP BY {by}),
normalized AS (SELECT s.*, {n} FROM {source} s JOIN levels USING ({by}))"""
