"""Live chat windows and cancellable jobs: state with timers, on the RocksDB state store.

Each has a batch form of the same result, :func:`crestline.operators.chat.chat_features` and
:func:`crestline.streaming.state.without_cancelled`.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from crestline.operators import chat
from crestline.operators.windows import moods

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Let streams started from now on keep their state in RocksDB, which timers and expiring values need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class WindowFeatures(StatefulProcessor):
    """Hopping windows of one key, closed in order.

    State holds the open windows (messages, authors, sums) and the last window closed.  A window closes once its end is
    ``late`` before the largest time seen; its burst needs the speed of the window before, which is
    at hand as windows close in order, empty ones among them.  Messages that come after a window of theirs has closed change
    nothing and are handed on apart, as long as the stream's watermark, ``keep`` further back, lets them in.
    """

    def __init__(self, window: int, hop: int, origin: int, keep: int, means: Sequence[str]):
        self.window, self.hop, self.origin, self.keep, self.means = window, hop, origin, keep, list(means)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "k long", "n long, authors array<string>, sums array<double>")
        self.last = handle.getValueState("last", "k long, speed double")

    def _end(self, k: int) -> int:
        return self.origin + k * self.hop + self.window

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = self.last.get()[0] if self.last.exists() else -1
        for batch in rows:
            at = batch["ms"].to_numpy() - self.origin
            late = []
            spread: dict[int, list[int]] = {}
            for i, t in enumerate(at.tolist()):
                ks = [k for k in range(max(0, (t - self.window) // self.hop + 1), t // self.hop + 1) if t >= 0]
                for k in ks:
                    if k > closed:
                        spread.setdefault(k, []).append(i)
                late += [(i, k) for k in ks if k <= closed]
            for k, places in spread.items():
                own = batch.iloc[places]
                n, authors, sums = self.open.getValue((k,)) if self.open.containsKey((k,)) else (0, [], [0.0] * len(self.means))
                authors = sorted({*authors, *own["author"].dropna().astype(str)})
                self.open.updateValue((k,), (n + len(own), authors, [s + float(own[m].sum()) for s, m in zip(sums, self.means, strict=True)]))
                self.handle.registerTimer(self._end(k) - self.keep)
            if late:
                yield self._rows(key, [(k, "late", 1, 0.0, 0.0, 0.0, [float(batch[m].iloc[i]) for m in self.means]) for i, k in late])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() + self.keep
        ready = sorted(k for (k,) in self.open.keys() if self._end(k) <= now)
        if not ready:
            return
        last, before = self.last.get() if self.last.exists() else (-1, 0.0)
        out = []
        for k in ready:
            if k > last + 1:  # windows without a message
                out += [(e, "window", 0, 0.0, 0.0, 0.0, [0.0] * len(self.means)) for e in range(last + 1, k)]
                before = 0.0
            n, authors, sums = self.open.getValue((k,))
            self.open.removeKey((k,))
            speed = n * 1000.0 / self.window
            out.append((k, "window", n, speed, max(0.0, speed - before), len(authors) / n, [s / n for s in sums]))
            last, before = k, speed
        self.last.update((last, before))
        yield self._rows(key, out)

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        columns = ["k", "kind", "n", "chat_speed", "chat_burst", "unique_ratio"]
        frame = pd.DataFrame([r[:6] for r in rows], columns=columns)
        frame.insert(0, "key", key[0])
        frame.insert(3, "time", frame["k"] * self.hop / 1000.0)
        for i, m in enumerate(self.means):
            frame[m] = [r[6][i] for r in rows]
        return frame

    def close(self) -> None:
        pass


def live_windows(
    messages: DataFrame, key: str, at: str, author: str, means: Sequence[str] = (), window: float = 5.0, hop: float = 2.5,
    origin: int = 0, late: float = 10.0, keep: float = 60.0,
) -> DataFrame:
    """Stream of ``key, k, kind, time, n, chat_speed, chat_burst, unique_ratio`` and ``means`` for every window of each key.

    Twin of :func:`crestline.operators.windows.chat_windows` for a stream.  ``at`` is a timestamp, ``origin`` the milliseconds at which
    recordings begin; messages before it, or without a time, are in no window.  Rows of ``kind`` ``window`` come once a window, in
    order, empty windows up to the last with a message among them.  Rows of kind ``late`` are one for each message and closed window that it came
    too late for.  A null author is no author.  Means of nulls count them as 0.
    """
    use_rocksdb(messages.sparkSession)
    seconds = late + keep
    kind = messages.schema[key].dataType
    rows = messages.select(F.col(key).alias("key"), F.col(at).alias("at"), F.unix_millis(at).alias("ms"), F.col(author).cast("string").alias("author"), *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in means])
    schema = T.StructType(
        [T.StructField("key", kind), T.StructField("k", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("time", T.DoubleType()), T.StructField("n", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("chat_speed", "chat_burst", "unique_ratio", *means)]
    )
    processor = WindowFeatures(round(window * 1000), round(hop * 1000), origin, round(keep * 1000), means)
    timed = rows.filter(F.col("at").isNotNull()).withWatermark("at", f"{seconds} seconds")
    return timed.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "EventTime").withColumnRenamed("key", key)


def live_chat_features(
    messages: DataFrame, key: str, at: str, author: str, text: str, window: float = 5.0, hop: float = 2.5, origin: int = 0, late: float = 10.0,
    keep: float = 60.0, lexica: Mapping[str, Mapping[str, float]] = chat.MOODS, emotes: Sequence[str] = chat.EMOTES, bots: Sequence[str] = chat.BOTS,
) -> DataFrame:
    """Twin of :func:`crestline.operators.chat.chat_features` for a stream; late messages are told apart as in :func:`live_windows`."""
    heard, scores = chat.scored(messages, author, text, lexica, emotes, bots)
    seen = live_windows(heard, key, at, author, scores, window, hop, origin, late, keep)
    intensity, mood = moods([f"sentiment_{m}" for m in lexica])
    return seen.withColumn("sentiment_intensity", intensity).withColumn("dominant_mood", F.regexp_replace(mood, "^sentiment_", ""))


class Cancellation(StatefulProcessor):
    """Stops exactly the job that a flag names: a flag waits for its job, and is gone once it has stopped it or is too old."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flag = handle.getValueState("flag", "at long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ms", "is_job"], kind="stable")
        flag = self.flag.get()[0] if self.flag.exists() else None
        told = []
        for at, is_job in zip(frame["ms"], frame["is_job"], strict=True):
            if not is_job:
                flag = int(at) if flag is None else max(flag, int(at))
                continue
            stopped = flag is not None and int(at) - flag < self.ttl
            told.append("cancelled" if stopped else "running")
            flag = None if stopped else flag
        if flag is None:
            self.flag.clear()
        else:
            self.flag.update((flag,))
        if told:
            jobs = frame[frame["is_job"]]
            yield pd.DataFrame({"key": key[0], "at": jobs["at"].to_numpy(), "payload": jobs["payload"].to_numpy(), "state": told})

    def close(self) -> None:
        pass


def cancellable(jobs: DataFrame, flags: DataFrame, key: str, at: str, payload: str, ttl: float = 3600.0) -> DataFrame:
    """Stream of ``key, at, payload, state``: each step of a job, ``running`` or ``cancelled``.

    ``flags`` (``key, at``) is the control stream.  A flag stops the first step of its job that comes with it or after it, within ``ttl``
    seconds, and is used up by that; a flag that comes between two triggers stops the next step.  Steps of one trigger are
    taken in the order of their times, flags first among equals.
    """
    use_rocksdb(jobs.sparkSession)
    kind = jobs.schema[key].dataType
    steps = jobs.select(F.col(key).alias("key"), F.col(at).alias("at"), F.unix_millis(at).alias("ms"), F.lit(True).alias("is_job"), F.col(payload).cast("string").alias("payload"))
    control = flags.select(F.col(key).cast(kind).alias("key"), F.col(at).alias("at"), F.unix_millis(at).alias("ms"), F.lit(False).alias("is_job"), F.lit(None).cast("string").alias("payload"))
    schema = T.StructType([T.StructField("key", kind), T.StructField("at", T.TimestampType()), T.StructField("payload", T.StringType()), T.StructField("state", T.StringType())])
    out = steps.union(control).groupBy("key").transformWithStateInPandas(Cancellation(round(ttl * 1000)), schema, "Append", "ProcessingTime")
    return out.withColumnsRenamed({"key": key, "at": at, "payload": payload})
