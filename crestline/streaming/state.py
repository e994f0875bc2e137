"""Keyed state over streams: rate limits, dimensions, deduplication, progress.

Each streaming operator has a batch function of the same result, so that a backfill and
a live job agree.  Documents from partial updates are in :mod:`crestline.streaming.documents`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from crestline.streaming.live import use_rocksdb


def decide(times: Sequence[float], log: list[float], most: int, window: float) -> tuple[list[tuple[bool, float]], list[float]]:
    """Sliding-log decisions for request times in order: allowed, and else the wait in seconds.

    ``log`` holds the allowed requests so far; those ``window`` or more ago expire, and rejected
    ones are never logged.  Times are milliseconds.
    """
    out = []
    for t in times:
        log = [x for x in log if t - x < window]
        if len(log) >= most:
            out.append((False, float(-(-(log[0] + window - t) // 1000))))
        else:
            log.append(t)
            out.append((True, 0.0))
    return out, log


def rate_limited_batch(requests: DataFrame, keys: Sequence[str], t: str, order: str, most: int, window: float) -> DataFrame:
    """Every request with ``allowed`` and ``retry_after``; each key's requests in time order."""
    def limit(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values([t, order], kind="stable")
        told, _ = decide(g[t].tolist(), [], most, window)
        return g.assign(allowed=[a for a, _ in told], retry_after=[w for _, w in told])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.groupBy(*keys).applyInPandas(limit, f"{kinds}, allowed boolean, retry_after double")


class SlidingLog(StatefulProcessor):
    """The requests of one key that were let through within the window; what has left it is forgotten by the store."""

    def __init__(self, t: str, order: str, most: int, window: float):
        self.t, self.order, self.most, self.window = t, order, most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getValueState("log", "times array<double>", max(1, int(self.window)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(rows)).sort_values([self.t, self.order], kind="stable")
        told, log = decide(g[self.t].tolist(), list(self.log.get()[0]) if self.log.exists() else [], self.most, self.window)
        self.log.update(([float(x) for x in log],))
        yield g.assign(allowed=[a for a, _ in told], retry_after=[w for _, w in told])

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, key: str, t: str, order: str, most: int, window: float) -> DataFrame:
    """Streaming twin of :func:`rate_limited_batch`; a key's log expires with its window, on the RocksDB state store."""
    use_rocksdb(requests.sparkSession)
    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.DoubleType())])
    return requests.groupBy(key).transformWithStateInPandas(SlidingLog(t, order, most, window), schema, "Append", "ProcessingTime")


def without_cancelled(jobs: DataFrame, cancelled: DataFrame, key: str, now: float, ttl: float = 3600.0) -> DataFrame:
    """Jobs without a cancellation flag (``key, at``) that is still alive at ``now``."""
    live = cancelled.filter(F.col("at") + ttl > now).select(key)
    return jobs.join(live, key, "left_anti")


def first_seen(stream: DataFrame, event_time: str, keys: Sequence[str], late: str) -> DataFrame:
    """Stream without repeats of the keys that come within the watermark."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(keys))


def upsert_creators(creators: DataFrame, updates: DataFrame) -> DataFrame:
    """Dimension ``user_id, login, name, thumbnail`` with new logins added and empty thumbnails filled."""
    new = updates.filter(F.coalesce("streamer", F.lit("")) != "").select("user_id", F.lower("streamer").alias("login"), "streamer", "thumbnail", "seq")
    per = new.groupBy("user_id", "login").agg(
        F.min_by("streamer", "seq").alias("_name"),
        F.min_by("thumbnail", F.when(F.col("thumbnail").isNotNull(), F.col("seq"))).alias("_thumb"),
    )
    both = creators.join(per, ["user_id", "login"], "full")
    return both.select(
        "user_id", "login", F.coalesce("name", "_name").alias("name"), F.coalesce(F.nullif("thumbnail", F.lit("")), F.col("_thumb")).alias("thumbnail")
    )


class ProgressLog(StreamingQueryListener):
    """Rows read and triggers ended of every stream by name, and what became of it; add it with ``spark.streams.addListener``.

    ``told`` is called with the stream's name and its counters every ``every`` triggers, and at its end.
    """

    def __init__(self, told: Callable[[str, dict], None], every: int = 1):
        self.told, self.every, self.streams = told, every, {}

    def onQueryStarted(self, event) -> None:
        self.streams[str(event.runId)] = {"name": event.name or str(event.id), "triggers": 0, "rows": 0, "error": None}

    def onQueryProgress(self, event) -> None:
        counters = self.streams.get(str(event.progress.runId))
        if counters:
            counters["triggers"] += 1
            counters["rows"] += event.progress.numInputRows
            if counters["triggers"] % self.every == 0:
                self.told(counters["name"], dict(counters))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        counters = self.streams.pop(str(event.runId), None)
        if counters:
            self.told(counters["name"], counters | {"error": event.exception, "ended": True})


def each_batch(write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that skips empty triggers."""

    def run(batch: DataFrame, _epoch: int) -> None:
        if batch.take(1):
            write(batch)

    return run
