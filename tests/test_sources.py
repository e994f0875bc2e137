"""Sources, sinks, nested documents and service boundaries: round trips and hand cases."""

import json

from pyspark.sql import functions as F

from crestline.operators import external, nested
from crestline.sources import chat, sinks, tables


def fetch(video_id, offset, cursor):
    """Pages of a recording with a message every 100 s, none between 700 and 1,500 s, of which nothing tells in advance."""
    start = int(cursor) if cursor else offset
    at = [t for t in range(0, 4000, 100) if not 700 < t < 1500 and t >= start][:3]
    if not at or at[0] > start + 200:
        return [], None
    return [{"ts": t, "author": f"u{t}", "text": f"m{t}"} for t in at] + [{"author": "no time"}], None if at[-1] == 3900 else str(at[-1] + 1)


def test_chat_pages_cover_every_range_once(spark):
    spark.dataSource.register(chat.ChatDataSource)
    df = spark.read.format("chat_pages").option("videos", "7,8").option("duration", "4000").option("fetch", "tests.test_sources:fetch").load()
    got = sorted(tuple(r)[:2] for r in df.collect())
    assert got == sorted((v, float(t)) for v in ("7", "8") for t in range(0, 4000, 100) if not 700 < t < 1500)
    assert df.rdd.getNumPartitions() == 6


def test_replacing_partitions_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "points")
    first = spark.createDataFrame([("a", 0.5), ("a", 0.9), ("b", 0.1)], "job string, score double")
    for _ in range(2):
        sinks.save_ranked(first, path, "job", [F.desc("score")])
    sinks.save_ranked(spark.createDataFrame([("a", 0.7)], "job string, score double"), path, "job", [F.desc("score")])
    got = spark.read.parquet(path).select("job", "score", "rank").collect()
    assert sorted(map(tuple, got)) == [("a", 0.7, 1), ("b", 0.1, 1)]


def test_updates_and_inserts(spark, tmp_path):
    path = str(tmp_path / "jobs")
    schema = "id long, status string, error string"
    spark.createDataFrame([(1, "NEW", "x"), (2, "NEW", None)], schema).write.parquet(path)
    for _ in range(2):
        sinks.update_table(spark, path, spark.createDataFrame([(1, "DONE", None), (9, "DONE", None)], schema), "id")
        sinks.insert_new(spark, path, spark.createDataFrame([(1, "AGAIN", None), (3, "NEW", None), (3, "NEW", None)], schema), "id")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "DONE", "x"), (2, "NEW", None), (3, "NEW", None)]


def test_published_changes_tell_null_from_absent(spark):
    before = spark.createDataFrame([(1, "a", "e"), (2, "a", None)], "id int, status string, error string")
    after = spark.createDataFrame([(1, "b", None), (2, "a", None), (3, "n", None)], "id int, status string, error string")
    got = {r["id"]: json.loads(r["payload"]) for r in sinks.status_messages(before, after, "id", ["status", "error"]).collect()}
    assert got == {1: {"status": "b", "error": None}, 3: {"status": "n"}}


def test_subtitles_start_with_the_header(spark, tmp_path):
    path = str(tmp_path / "subs")
    chunks = spark.createDataFrame([("c", 2.0, "two"), ("c", 1.0, "one"), ("d", 0.0, "zero")], "clip string, start double, value string")
    sinks.write_subtitles(chunks, path, "clip", "start", "HEAD")
    assert [r["value"] for r in spark.read.text(f"{path}/clip=c").collect()] == ["HEAD", "one", "two"]


def test_tolerant_reading(spark, tmp_path):
    queue = tmp_path / "queue"
    queue.mkdir()
    (queue / "q.txt").write_text('{"job_id": "a", "url": "u"}\nnot json\n\n{"job_id": "b"}\n')
    assert sorted(r["job_id"] for r in tables.read_queue(spark, str(queue), "job_id string, url string").collect()) == ["a", "b"]
    listed = tables.list_objects(spark, str(queue), ".txt", 5).collect()
    assert len(listed) == 1 and listed[0]["path"].endswith("q.txt")


def test_seams_and_frames(spark):
    chunks = spark.createDataFrame([("j", 0, t) for t in (0.0, 1.0, 2.0)] + [("j", 1, t) for t in (1.0, 2.0, 3.0)], "job string, chunk int, t double")
    assert sorted((r["chunk"], r["t"]) for r in tables.drop_seams(chunks, ["job"], "chunk", "t").collect()) == [(0, 0.0), (0, 1.0), (0, 2.0), (1, 3.0)]
    got = spark.range(1).select(tables.frame_times(F.lit(10.0), F.lit(20.0), 4).alias("a"), tables.frame_times(F.lit(0.0), F.lit(10.0), 3, F.lit(10.0)).alias("b")).first()
    assert got["a"] == [10.0, 13.3, 16.7, 20.0] and got["b"] == [0.0, 5.0, 9.5]


def test_documents_merge_by_presence(spark):
    df = spark.createDataFrame([('{"a": null, "b": "2", "z": "no"}',), ("{}",), (None,), ("broken",)], "p string")
    base = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1"))
    got = [r[0] for r in df.select(nested.merge_document(base, F.col("p"), ["a", "b"])).collect()]
    assert got == [{"b": "2"}, {"a": "1", "b": "1"}, {"a": "1", "b": "1"}, {"a": "1", "b": "1"}]


def test_arrays_of_elements_and_history(spark):
    df = spark.createDataFrame([([("a", 1), ("b", 2)],)], "xs array<struct<k:string,v:int>>")
    new = lambda k, v: F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"))
    got = df.select(
        nested.upsert_element(F.col("xs"), new("a", 9), "k").alias("u"), nested.upsert_element(F.col("xs"), new("c", 3), "k").alias("i"),
        nested.drop_element(F.col("xs"), "k", F.lit("b")).alias("d"), nested.bounded_history(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(4), 3).alias("h"),
    ).first()
    assert [tuple(x) for x in got["u"]] == [("a", 9), ("b", 2)] and [x["k"] for x in got["i"]] == ["a", "b", "c"]
    assert [x["k"] for x in got["d"]] == ["a"] and got["h"] == [2, 3, 4]


def test_failed_calls_give_defaults(spark):
    def service(rows):
        if any(row["i"] == 2 for row in rows):
            raise RuntimeError("down")
        return [{"name": f"n{row['i']}", "virality": 0.5} for row in rows]

    df = spark.createDataFrame([(1,), (2,), (3,)], "i int")
    got = external.call_service(df, service, "name string, virality double", {"name": "", "virality": None}, retries=0).orderBy("i").collect()
    assert [(r["name"], r["virality"], r["failed"]) for r in got] == [("n1", 0.5, False), ("", None, True), ("n3", 0.5, False)]
