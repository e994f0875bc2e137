"""Streams with state and timers against their batch twins, over restarts."""

import glob
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from crestline.operators import chat
from crestline.operators.windows import chat_windows
from crestline.streaming import live

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
ORIGIN = int(START.timestamp() * 1000)


def at(seconds):
    return (START + timedelta(seconds=seconds)).isoformat()


class Stream:
    """A stream over JSON files that can be fed and run again and again, from one checkpoint."""

    def __init__(self, spark, folder, schema, build, *more, waits=False):
        self.spark, self.folder, self.build, self.waits, self.fed = spark, folder, build, waits, 0
        spark.conf.set("spark.sql.shuffle.partitions", 2)  # of a stream, fixed at its start
        self.inputs = [schema, *more]

    def feed(self, rows, which=0):
        schema = self.inputs[which]
        df = self.spark.createDataFrame(rows, schema.replace("timestamp", "string"))
        self.fed += len(rows)
        df.coalesce(1).write.mode("append").json(str(self.folder / f"in{which}"))

    def run(self):
        for i in range(len(self.inputs)):
            (self.folder / f"in{i}").mkdir(exist_ok=True)
        sources = [self.spark.readStream.schema(s).option("maxFilesPerTrigger", 1).json(str(self.folder / f"in{i}")) for i, s in enumerate(self.inputs)]
        query = self.build(*sources).writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "seen"))
        if not self.waits:
            assert query.trigger(availableNow=True).start().awaitTermination(180)
            return
        query, until = query.trigger(processingTime="1 second").start(), time.time() + 180  # values that expire keep triggers coming
        while sum(p.numInputRows for p in query.recentProgress) < self.fed:
            assert time.time() < until and query.isActive
            time.sleep(0.2)
        query.stop()
        self.fed = 0

    def rows(self):
        return self.spark.read.parquet(str(self.folder / "out")).collect() if glob.glob(str(self.folder / "out/*.parquet")) else []


@pytest.fixture(autouse=True)
def settings(spark):
    """Partitions and state store as they were, for the tests after."""
    names = ["spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass"]
    old = {n: spark.conf.get(n) for n in names}
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


CHAT = "job string, at timestamp, author string, weight double"


def batch_windows(spark, rows, window, hop, duration):
    df = spark.createDataFrame(rows, CHAT.replace("timestamp", "string"))
    seconds = (F.unix_millis(F.to_timestamp("at")) - ORIGIN) / 1000
    jobs = df.select("job").distinct().withColumn("duration", F.lit(duration))
    return chat_windows(df.withColumn("t", seconds), jobs, ["job"], "t", "author", window, hop, ["weight"])


def test_live_windows_equal_the_batch_over_a_restart(spark, tmp_path):
    rng = random.Random(1)
    rows = [(job, rng.randrange(0, 60_000) / 1000, rng.choice(["x", "y", "z", None]), float(rng.randrange(9))) for job in "ab" for _ in range(60)]
    rows = sorted((r for r in rows if not 20 < r[1] < 34), key=lambda r: r[1])  # a silence of several windows
    rows = [(j, at(t), a, w) for j, t, a, w in rows]
    end = [("a", at(500), "x", 0.0), ("b", at(500), "x", 0.0)]
    s = Stream(spark, tmp_path, CHAT, lambda m: live.live_windows(m, "job", "at", "author", ["weight"], 5.0, 2.5, ORIGIN, 4.0, 30.0))
    for lo in (0, 30, 60):
        part = rows[lo : lo + 30]
        rng.shuffle(part)  # out of order within a file
        s.feed(part)
    s.run()
    early = s.rows()
    assert early and max(r["time"] for r in early) < 60
    s.feed(rows[90:])
    s.run()
    s.feed(end)
    s.run()
    got = [r for r in s.rows() if r["time"] + 5 <= 60]
    assert {r["kind"] for r in got} == {"window"}
    want = {(r["job"], r["k"]): r for r in batch_windows(spark, rows, 5.0, 2.5, 60.0).collect()}
    assert len(got) == len({(r["job"], r["k"]) for r in got})
    for r in got:
        w = want.pop((r["job"], r["k"]))
        assert all(r[c] == pytest.approx(w[c]) for c in ("time", "chat_speed", "chat_burst", "unique_ratio", "weight"))
    assert all(w["chat_speed"] == 0 for w in want.values())  # after the last message there is nothing to close a window
    for job in "ab":
        mine = [r["k"] for r in s.rows() if r["job"] == job]
        assert sorted(mine) == list(range(len(mine)))


def test_late_messages_are_told_apart(spark, tmp_path):
    s = Stream(spark, tmp_path, CHAT, lambda m: live.live_windows(m, "job", "at", "author", ["weight"], 5.0, 5.0, ORIGIN, 4.0, 300.0))
    s.feed([("a", at(1), "x", 1.0), ("a", at(30), "y", 1.0)])
    s.run()
    s.feed([("a", at(2), "z", 7.0), ("a", at(29), "z", 3.0), (None, at(31), "z", 3.0), ("a", None, "z", 3.0), ("a", at(-3), "z", 3.0)])
    s.run()
    s.feed([("a", at(900), "x", 1.0)])
    s.run()
    got = [(r["kind"], r["k"], r["n"], r["weight"]) for r in s.rows() if r["job"] == "a" and r["n"]]
    assert sorted(got) == [("late", 0, 1, 7.0), ("window", 0, 1, 1.0), ("window", 5, 1, 3.0), ("window", 6, 1, 1.0)]


def test_live_chat_features_equal_the_batch(spark, tmp_path):
    schema = "job string, at timestamp, author string, text string"
    lines = ["KEKW that was insane", "gg", "GOOOO LET'S GO", "rip", None, "hello", "Nightbot says hi"]
    rows = [("a", at(i * 0.7), "Nightbot" if i % 9 == 0 else f"u{i % 4}", lines[i % 7]) for i in range(40)]
    s = Stream(spark, tmp_path, schema, lambda m: live.live_chat_features(m, "job", "at", "author", "text", 5.0, 2.5, ORIGIN, 1.0, 10.0))
    s.feed(rows)
    s.run()
    s.feed([("a", at(500), "x", "end")])
    s.run()
    df = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("t", (F.unix_millis(F.to_timestamp("at")) - ORIGIN) / 1000)
    want = {r["k"]: r for r in chat.chat_features(df, spark.createDataFrame([("a", 28.0)], "job string, duration double"), ["job"], "t", "author", "text").collect()}
    got = {r["k"]: r for r in s.rows() if r["time"] + 5 <= 28}
    assert set(got) == set(want)
    for k, w in want.items():
        assert all(got[k][c] == pytest.approx(w[c]) if isinstance(w[c], float) else got[k][c] == w[c] for c in w.asDict() if c in got[k].asDict())


def test_a_flag_stops_its_job_and_is_used_up(spark, tmp_path):
    s = Stream(spark, tmp_path, "job string, at timestamp, step string", lambda j, f: live.cancellable(j, f, "job", "at", "step", 3600.0), "job string, at timestamp", waits=True)
    s.feed([("a", at(0), "start"), ("b", at(0), "start"), ("c", at(0), "start")])
    s.run()
    s.feed([("b", at(5))], 1)  # arrives between two triggers
    s.run()
    s.feed([("a", at(9), "cut"), ("b", at(9), "cut"), ("c", at(9), "cut")])
    s.run()
    s.feed([("b", at(20), "again"), ("c", at(20), "more")])
    s.feed([("c", at(20)), ("d", at(21))], 1)
    s.run()
    s.feed([("d", at(21 + 3600), "too late for the flag")])
    s.run()
    got = sorted((r["job"], r["step"], r["state"]) for r in s.rows())
    assert [g for g in got if g[2] == "cancelled"] == [("b", "cut", "cancelled"), ("c", "more", "cancelled")]
    assert len(got) == 9
