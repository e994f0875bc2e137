"""Chat pages with filters pushed down and read live, and rows published to channels once."""

import os

import pytest
from pyspark.sql import functions as F

from crestline.sources import chat, sinks, tables
from tests.test_sources import fetch

NOTES = "/tmp/crestline-test-notes"


def noted(video_id, offset, cursor):
    with open(os.environ.get("CRESTLINE_NOTES", NOTES), "a") as f:
        f.write(f"{video_id} {offset}\n")
    return fetch(video_id, offset, cursor)


def clock():
    return int(open(NOTES + "-clock").read())


@pytest.fixture
def calls():
    def read():
        return [line.split() for line in open(NOTES)] if os.path.exists(NOTES) else []

    for f in (NOTES, NOTES + "-clock"):
        if os.path.exists(f):
            os.remove(f)
    return read


def test_filters_reduce_the_calls(spark, calls):
    spark.dataSource.register(chat.ChatDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        pages = spark.read.format("chat_pages").option("videos", "7,8").option("duration", "4000").option("fetch", "tests.test_channels:noted").option("pushdown", "true")
        every = pages.load().collect()
        whole = len(calls())
        os.remove(NOTES)
        some = pages.load().filter("job_id = '8' AND ts >= 1850 AND ts < 2150.5").collect()
        assert sorted((r["job_id"], r["ts"]) for r in some) == [("8", 1900.0), ("8", 2000.0), ("8", 2100.0)]
        assert 1 <= len(calls()) <= 3 < whole and {c[0] for c in calls()} == {"8"} and len(every) == 66
        edges = {r["ts"] for r in pages.load().filter("ts <= 100 AND job_id IN ('7', 'none')").collect()}
        assert edges == {0.0, 100.0}
        assert {r["ts"] for r in pages.load().filter("ts = 3900").collect()} == {3900.0}
        assert pages.load().filter("job_id = 'none' OR ts > 5000").count() == 0
        assert pages.load().filter("job_id = 'none'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_chat_is_read_live_over_a_restart(spark, calls, tmp_path):
    spark.dataSource.register(chat.ChatDataSource)
    pages = spark.readStream.format("chat_pages").option("videos", "7,8").option("fetch", "tests.test_channels:noted").option("clock", "tests.test_channels:clock")
    for second in (650, 650, 2000, 3950):
        with open(NOTES + "-clock", "w") as f:
            f.write(str(second))
        query = pages.load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "seen"))
        assert query.trigger(availableNow=True).start().awaitTermination(120)
        got = sorted((r["job_id"], r["ts"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == sorted((v, float(t)) for v in "78" for t in range(0, second, 100) if not 700 < t < 1500)


def test_rows_are_published_once_and_read_by_channel(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "channels")

    def run(checkpoint):
        stream = spark.readStream.schema("job string, n int").option("maxFilesPerTrigger", 1).json(source)
        assert sinks.publish(stream, path, "job", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(120)

    def write(rows):
        spark.createDataFrame(rows, "job string, n int").coalesce(1).write.mode("append").json(source)

    def heard(name, channel):
        out = tables.subscribe(spark, path, "job string, n int", channel).writeStream.format("parquet").option("path", str(tmp_path / name))
        assert out.option("checkpointLocation", str(tmp_path / f"{name}-seen")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r["job"], r["n"]) for r in spark.read.parquet(str(tmp_path / name)).collect())

    first, second = [("a", 1), ("b", 2), ("a/ü", 3)], [("a", 4), (None, 5)]
    write(first)
    run("p")
    run("replayed")  # the same trigger again, as after a crash before its end was noted
    assert heard("a", "a") == [("a", 1)]
    write(second)
    run("p")
    assert heard("a", "a") == [("a", 1), ("a", 4)] and heard("odd", "a/ü") == [("a/ü", 3)]
    both = sorted((r["job"] or "", r["n"]) for r in spark.read.json(f"{path}/*/*").collect())
    assert both == sorted((j or "", n) for j, n in first + second)
    os.remove(f"{path}/epoch=1/_SUCCESS")  # a trigger cut short is written anew
    assert spark.read.json(path).agg(F.count(F.lit(1))).first()[0] == 5
