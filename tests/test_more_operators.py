"""Hot points, silences, layers, objects, sound and streams: hand cases and plain twins."""

import math
import time
import wave
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crestline.functions import scalars
from crestline.operators import audio, catalog, keyframes, nested, ranking, sequences, signals, vectors
from crestline.operators import chat as chat_ops
from crestline.sources import chat, schemas, sinks, tables
from crestline.streaming import state, windows

LEVELS = (*signals.WEIGHTS, "sentiment_intensity", "speech_presence", "vocal_excitement", "game_audio")


def features(spark, rows):
    """``rows``: job to a list of dictionaries of signals; what is absent is 0.1, or 0 for chat, mood and classes."""
    low = {"chat_speed": 0.0, "chat_burst": 0.0, "emote_density": 0.0, "caps_ratio": 0.0, "sentiment_intensity": 0.0, "speech_presence": 0.0, "vocal_excitement": 0.0, "game_audio": 0.0}
    data = [(job, i, i * 2.5, *[float(r.get(c, low.get(c, 0.1))) for c in LEVELS], r.get("mood", "")) for job, series in rows.items() for i, r in enumerate(series)]
    return spark.createDataFrame(data, "job string, i int, time double, " + ", ".join(f"{c} double" for c in LEVELS) + ", mood string")


def test_hot_points_find_a_sustained_spike(spark):
    loud = {c: 1.0 for c in ("rms", "centroid", "zcr", "flux", "onset", "pitch_var")}
    rows = {"spiked": [loud | {"mood": "hype"} if 95 <= i <= 105 else {} for i in range(200)], "flat": [{}] * 100, "classes": [{"speech_presence": 0.3, "vocal_excitement": 0.1, "game_audio": 0.2}] * 50}
    got = signals.hot_points(features(spark, rows), "job", "i", "time", "mood", 2.5, top=3).collect()
    first = next(r for r in got if r["job"] == "spiked" and r["rank"] == 1)
    assert abs(first["timestamp_seconds"] - 250) <= 20 and first["timestamp_display"] == "00:04:10" and first["chat_mood"] == "hype"
    assert first["signals"]["rms"] == 1.0 and first["signals"]["speech_presence"] == 0.0
    assert all(r["score"] >= 0 and r["rank"] <= 3 for r in got)
    assert {r["job"] for r in got} == {"spiked", "flat", "classes"}  # a constant series still gives rows
    assert signals.hot_points(features(spark, {}), "job", "i", "time", "mood", 2.5).count() == 0


def test_hot_point_scores_against_a_plain_form(spark):
    rng = np.random.default_rng(3)
    series = [{c: float(v) for c, v in zip(LEVELS, rng.random(len(LEVELS)), strict=True)} for _ in range(150)]
    x = {c: np.array([r[c] for r in series]) for c in LEVELS}

    def norm(v):
        low, high = np.median(v), np.percentile(v, 95)
        return np.clip((v - low) / (high - low), 0, 1) if high - low >= 1e-8 else np.zeros(len(v))

    n = {c: norm(v) for c, v in x.items()}
    score = sum(w * n[c] for c, w in signals.WEIGHTS.items()) * (1 + 0.3 * norm((n["rms"] + n["flux"]) / 2 * n["chat_speed"]))
    score = score * (1 + 0.15 * n["sentiment_intensity"]) * (1 + 0.15 * norm(n["speech_presence"] * n["rms"])) + 0.25 * n["vocal_excitement"]
    score = score * (1 - 0.15 * np.clip(n["game_audio"] - n["speech_presence"], 0, 1))
    smooth = np.convolve(np.pad(score, 10, mode="symmetric"), signals.gaussian_weights(2.5), mode="valid")
    at = signals.find_peaks(smooth, 24, 0.05)
    want = [(round(i * 2.5, 1), round(smooth[i], 3)) for i in at[np.argsort(-smooth[at], kind="stable")]][:20]
    got = signals.hot_points(features(spark, {"j": series}), "job", "i", "time", "mood", 2.5).orderBy("rank").collect()
    assert len(got) == len(want) and all(tuple(r) == pytest.approx(w, abs=1e-6) for r, w in zip(((r["timestamp_seconds"], r["score"]) for r in got), want, strict=True))


def test_edges_move_to_silences(spark):
    quiet = {"sure": (range(20, 24), range(40, 55), range(70, 90)), "short": (range(20, 24), range(40, 46)), "none": ()}
    frames = [(job, i * 0.05, 0.01 if any(i in r for r in spans) else (0.5 if i == 33 else 1.0)) for job, spans in quiet.items() for i in range(120)]
    f = spark.createDataFrame(frames, "job string, t double, rms double")
    marks = spark.createDataFrame([(j, 0.5) for j in (*quiet, "gone")], "job string, at double")
    later = {r["job"]: r["snapped"] for r in signals.silence_edge(marks, f, ["job"], "at", "t", "rms", F.lit(100.0), True).collect()}
    assert later == {"sure": 2.0, "short": 2.0, "none": 1.7, "gone": 0.5}
    marks = spark.createDataFrame([(j, 5.5) for j in quiet], "job string, at double")
    before = {r["job"]: r["snapped"] for r in signals.silence_edge(marks, f, ["job"], "at", "t", "rms", F.lit(100.0), False).collect()}
    assert before == {"sure": 4.5, "short": 2.3, "none": 1.7}


def test_layers_are_rewritten_and_scaled(spark):
    kind = """array<struct<type:string, video:struct<src:string,nativeWidth:int,nativeHeight:int>, asset:struct<src:string>, transform:struct<x:double,y:double,width:double,height:double>,
      style:struct<blur:double,borderRadius:double>, subtitle:struct<fontSize:double>, text:struct<fontSize:double>, chat:struct<fontSize:double>,
      keyframes:array<struct<x:double,y:double,width:double,height:double,borderRadius:double,blur:double>>>>"""
    place, look = (10.0, 21.0, 1080.0, 1920.0), (3.0, 5.0)
    layers = [
        ("gameplay", ("old", 0, 0), None, place, look, None, None, None, [(1.0, 3.0, 5.0, 7.0, 9.0, 1.0)]),
        ("asset", None, ("/api/assets/a b.png",), place, look, None, (11.0,), None, []),
        ("asset", None, ("https://x/y.png",), place, look, (40.0,), None, (13.0,), None),
        ("facecam", None, None, place, look, None, None, None, None),
    ]
    df = spark.createDataFrame([(layers,)], f"layers {kind}")
    got = df.select(nested.rewrite_layers(F.col("layers"), "s3://clip", F.lit(1920), F.lit(1080), "s3://assets/").alias("l")).first()["l"]
    assert tuple(got[0]["video"]) == ("s3://clip", 1920, 1080) and got[3]["video"] is None
    assert [x["asset"] and x["asset"]["src"] for x in got] == [None, "s3://assets/a b.png", "https://x/y.png", None]
    half = df.select(nested.scale_layers(F.col("layers"), F.lit(540), F.lit(960)).alias("l")).first()["l"]
    assert tuple(half[0]["transform"]) == (5.0, 11.0, 540.0, 960.0) and tuple(half[0]["style"]) == (1.5, 3.0)
    assert tuple(half[0]["keyframes"][0]) == (1.0, 2.0, 3.0, 4.0, 5.0, 0.5) and half[3]["keyframes"] is None
    assert half[1]["text"]["fontSize"] == 6.0 and half[2]["subtitle"]["fontSize"] == 20.0 and half[2]["chat"]["fontSize"] == 7.0 and half[2]["text"] is None
    same = df.select(nested.scale_layers(F.col("layers"), F.lit(1080), F.lit(1920)).alias("l")).first()["l"]
    assert same == df.first()["layers"]


def test_sets_names_and_documents(spark):
    row = spark.range(1).select(
        nested.toggle(F.array(F.lit(1), F.lit(2)), F.lit(2)).alias("out"), nested.toggle(F.array(F.lit(1)), F.lit(2)).alias("in"),
        nested.first_list(F.lit('{"a": 1, "b": [{"n": "x"}], "c": [2]}'), "struct<n:string>").alias("first"),
        nested.snake_case(F.struct(F.lit(3).alias("nativeWidth"), F.lit(None).cast("string").alias("fileName")), {"nativeWidth": "native_width", "fileName": "file_name"}, {"file_name": "none"}).alias("snake"),
        scalars.strip_fences(F.lit("```json\n{}\n```")).alias("fence"), scalars.compact_date(F.lit("20240131")).alias("day"), scalars.compact_date(F.lit("soon")).alias("kept"),
        scalars.is_identifier(F.lit("a_b-1")).alias("good"), scalars.is_identifier(F.lit("a b")).alias("bad"),
        scalars.utc_now(F.lit(datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc))).alias("now"), scalars.random_id(8).alias("id"),
    ).first()
    assert row["out"] == [1] and row["in"] == [1, 2] and row["first"][0]["n"] == "x" and tuple(row["snake"]) == (3, "none")
    assert row["fence"] == "{}" and (row["day"], row["kept"]) == ("2024-01-31", "soon") and row["good"] and not row["bad"]
    assert row["now"] == "2024-01-02T03:04:05Z" and len(row["id"]) == 8 and int(row["id"], 16) >= 0
    df = spark.createDataFrame([("a",), ("b",), (None,)], "speaker string")
    assert [r[0] for r in df.filter(sequences.not_hidden(F.col("speaker"), ["b"])).collect()] == ["a", None]


def test_candidates_and_transcripts(spark):
    c = spark.createDataFrame([("j", 5, 0.9, "f5", 30.0), ("j", 2, 0.8, "", 10.0), ("j", 7, 0.7, "f7", 20.0)], "job string, cand int, score double, file string, t double")
    kept = ranking.with_clip(c, "file").withColumn("rank", -F.col("score"))
    words = spark.createDataFrame([("j", 7, "x"), ("j", 2, "y"), ("j", 5, "z")], "job string, cand int, word string")
    assert sorted((r["place"], r["word"]) for r in ranking.renumbered(words, kept, ["job"], "cand", "rank").collect()) == [(0, "z"), (1, "x")]
    assert ranking.transcript(c, ["job"], "t", F.concat(F.lit("s"), F.col("cand").cast("string"))).first()["transcript"] == "s2\n\ns7\n\ns5"
    p = spark.createDataFrame([("j", 0.0, 0.3), ("j", 0.01, 0.0), ("k", None, 0.0)], "job string, rms double, zcr double")
    assert [tuple(r) for r in ranking.active_signals(p, ["job"], ["rms", "zcr"]).collect()] == [("j", "zcr")]


def test_dominant_colours(spark):
    rng = np.random.default_rng(4)
    pixels = [("bright", 200 + int(rng.integers(4)), 100, 50) for _ in range(60)] + [("bright", *map(int, rng.integers(0, 255, 3))) for _ in range(30)]
    pixels += [("dark", 5, 6, 7)] * 10
    got = {r["clip"]: (r["r"], r["g"], r["b"]) for r in vectors.dominant_colour(spark.createDataFrame(pixels, "clip string, r int, g int, b int"), "clip").collect()}
    assert abs(got["bright"][0] - 201) <= 4 and abs(got["bright"][1] - 100) <= 6 and got["dark"] == (60, 60, 100)


def test_references_in_blocks(spark):
    rng = np.random.default_rng(5)
    v, r = rng.standard_normal((80, 6)), rng.standard_normal((23, 6))
    v[3] = 0
    vs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    rs = spark.createDataFrame([(f"r{i}", x.tolist()) for i, x in enumerate(r)], "name string, v array<double>")
    sim = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T
    for block in (4096, 5):
        got = {x["id"]: x for x in vectors.reference_match(vs, rs, "id", "v", "name", block=block).collect()}
        assert all(got[i]["nearest"] == f"r{sim[i].argmax()}" and got[i]["similarity"] == pytest.approx(sim[i].max(), abs=1e-8) for i in range(80) if i != 3)
        assert got[3]["similarity"] == 0 and got[3]["name"] is None
    assert vectors.reference_match(vs, rs.limit(0), "id", "v", "name").filter("nearest IS NOT NULL").count() == 0


def test_a_hundred_thousand_references(spark):
    rng = np.random.default_rng(6)
    v, r = rng.standard_normal((300, 8)), rng.standard_normal((100_000, 8))
    vs = spark.createDataFrame(pd.DataFrame({"id": np.arange(300) // 2, "v": v.tolist()}))  # ids that repeat
    rs = spark.createDataFrame(pd.DataFrame({"name": np.arange(100_000), "v": r.tolist()}))
    got = vectors.reference_match(vs, rs, "id", "v", "name", block=20_000, rows=100).collect()
    sim = np.round((v / np.linalg.norm(v, axis=1, keepdims=True)) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T, 9)
    assert sorted((x["id"], x["nearest"]) for x in got) == sorted((i // 2, int(sim[i].argmax())) for i in range(300))


# -- chat, catalog, documents


def test_chat_features_of_windows(spark):
    rows = [
        ("j", 0.5, "a", "GG WP"), ("j", 1.0, "b", "KEKW kekw lol"), ("j", 2.0, "Nightbot", "POG POG POG"), ("j", 3.0, "a", "f"), ("j", 6.0, None, None),
        ("j", 6.5, "c", "fog, clutch!"), ("j", 11.0, "d", "oh non, c'est fini"),
    ]
    m = spark.createDataFrame(rows, "job string, ts double, author string, text string")
    got = chat_ops.chat_features(m, spark.createDataFrame([("j", 15.0)], "job string, duration double"), ["job"], "ts", "author", "text").orderBy("k").collect()
    assert [r["time"] for r in got] == [0.0, 2.5, 5.0, 7.5, 10.0]
    first = got[0]
    assert first["chat_speed"] == pytest.approx(3 / 5) and first["unique_ratio"] == pytest.approx(2 / 3)
    assert first["caps_ratio"] == pytest.approx(1 / 3) and first["emote_density"] == pytest.approx((1 + 3) / 3)
    assert [first[f"sentiment_{x}"] for x in ("hype", "fun", "rip")] == pytest.approx([0.7 / 3, 1.0 / 3, 0.8 / 3])
    assert first["dominant_mood"] == "fun" and got[4]["dominant_mood"] == "rip" and got[2]["dominant_mood"] == "hype"
    assert got[2]["sentiment_hype"] == pytest.approx(0.5) and got[2]["sentiment_intensity"] == pytest.approx(0.5)


def test_conditional_updates_and_clip_classes(spark):
    df = spark.createDataFrame([(1, "active", None), (2, "done", None), (3, None, "u")], "id int, status string, user string")
    got = catalog.update_where(df, F.col("status") == "active", {"status": F.lit("cancelled")}).orderBy("id").collect()
    assert [r["status"] for r in got] == ["cancelled", "done", None]
    got = catalog.update_where(df, F.col("user").isNull(), {"user": F.lit("owner")}).orderBy("id").collect()
    assert [r["user"] for r in got] == ["owner", "owner", "u"]
    c = spark.createDataFrame([(x,) for x in (*schemas.CLIP_SOURCES, "", None)], "s string").select(catalog.clip_class(F.col("s")).alias("c"))
    assert [r["c"] for r in c.collect()] == ["auto", "manual", "detected", "auto", "auto"]


def test_documents_are_read_by_their_schemas(spark, tmp_path):
    (tmp_path / "job.json").write_text('{"job_id": "a", "status": "DONE", "step_timings": {"x": {"start": 1, "duration": 2}},\n "hot_points": [{"score": 0.5, "signals": {"rms": 1}, "clip_source": "manual"}]}')
    (tmp_path / "bad.json").write_text("{broken")
    got = {r["job_id"]: r for r in tables.read_documents(spark, str(tmp_path), schemas.JOBS).collect()}
    assert got["a"]["hot_points"][0]["signals"]["rms"] == 1.0 and got["a"]["step_timings"]["x"]["duration"] == 2.0 and got[None]["hot_points"] is None
    order = spark.createDataFrame([(s,) for s in reversed(schemas.JOB_STATES)], "s string").select(scalars.progress(F.col("s"), schemas.JOB_STATES).alias("p"))
    assert [r["p"] for r in order.collect()] == sorted((r["p"] for r in order.collect()), reverse=True)
    empty = [spark.createDataFrame([], s) for s in (schemas.RENDERS, schemas.CREATORS, schemas.WORDS, schemas.TURNS, schemas.AUDIO_WINDOWS, schemas.CLASS_WINDOWS, schemas.CHAT_WINDOWS, f"k {schemas.KEYFRAMES}")]
    assert all(df.count() == 0 for df in empty)


# -- sound


def test_sound_is_read_and_measured(spark, tmp_path):
    rate, t = 11025, np.arange(11025 * 12) / 11025
    tone = 0.5 * np.sin(2 * np.pi * np.where(t < 6, 220, np.where((t * 4).astype(int) % 2, 220, 330)) * t)
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.repeat((tone * 32767).astype("<i2"), 2).tobytes())
    (tmp_path / "broken.wav").write_bytes(b"RIFFnothing")
    sound = tables.read_wav(spark, str(tmp_path), seconds=5, overlap=0.0)
    chunks = sound.orderBy("chunk").collect()
    assert [(r["chunk"], r["rate"], len(r["samples"])) for r in chunks] == [(0, rate, rate * 5), (1, rate, rate * 5), (2, rate, rate * 2)]
    assert np.allclose(np.concatenate([r["samples"] for r in chunks]), tone, atol=1e-3)
    got = audio.sound_windows(tables.read_wav(spark, str(tmp_path)), pitch_every=1).orderBy("k").collect()
    assert [r["k"] for r in got] == [0, 1, 2]
    assert all(r["rms"] == pytest.approx(0.5 / math.sqrt(2), rel=0.05) for r in got)
    assert got[0]["pitch_var"] < 5 and got[2]["pitch_var"] > 1000
    assert got[0]["zcr"] == pytest.approx(440 / rate, rel=0.1)
    few = audio.decoded_frames(spark.createDataFrame([("j", 0, tone[:9000].tolist())], "job_id string, chunk int, samples array<float>")).collect()
    assert len(few) == 1 + 9000 // 512 and few[0]["flux"] == 0.0
    silent = audio.frame_features(np.zeros(4096), rate)
    assert not any(v.any() for v in silent.values()) and audio.pitch_variance(np.zeros(100), rate) == 0.0


# -- keyframes


def test_keyframes_and_animations(spark):
    frame = lambda at, x: F.struct(F.lit(at).alias("time"), F.lit(x).alias("x"))
    row = spark.range(1).select(
        keyframes.upsert_keyframe(F.array(frame(0.0, 1), frame(1.0, 2)), frame(1.1, 9)).alias("near"),
        keyframes.upsert_keyframe(F.array(frame(0.0, 1), frame(1.0, 2)), frame(0.5, 9)).alias("new"),
    ).first()
    assert [tuple(k) for k in row["near"]] == [(0.0, 1), (1.1, 9)] and [tuple(k) for k in row["new"]] == [(0.0, 1), (0.5, 9), (1.0, 2)]
    kind = "begin double, duration double, easing string, " + ", ".join(f"{n}_from double, {n}_to double" for n in ("opacity", "scale", "x", "y"))
    moves = [(1.0, 2.0, "linear", 0.0, 1.0, 1.0, 2.0, 0.0, 100.0, 0.0, 0.0), (0.0, 0.0, "linear", 1.0, 0.5, 1.0, 1.0, 5.0, 7.0, 1.0, 3.0)]
    df = spark.createDataFrame([(t, moves) for t in (0.0, 2.0, 9.0)], f"t double, a array<struct<{kind}>>")
    got = {r["t"]: r["s"] for r in df.select("t", keyframes.compose_animations(F.col("a"), F.col("t"), F.lit(10.0), (F.lit(4.0), F.lit(2.0))).alias("s")).collect()}
    assert tuple(got[0.0]) == (0.0, 1.0, 7.0, 3.0)
    assert tuple(got[2.0]) == (0.5 * 0.5 * 0.5, 1.5, 57.0, 3.0)
    assert tuple(got[9.0]) == (0.25, 2.0, 107.0, 3.0)


# -- sources and sinks


def test_objects_move_and_tables_are_swapped(spark, tmp_path):
    a, b, c = (str(tmp_path / n) for n in ("a.json", "b.json", "sub/c.json"))
    sinks.put_object(spark, '{"é": 1}', a)
    sinks.copy_object(spark, a, b)
    sinks.rename_object(spark, b, c)
    assert (tmp_path / "sub/c.json").read_text() == '{"é": 1}' and not (tmp_path / "b.json").exists()
    assert sinks.delete_object(spark, a) and not sinks.delete_object(spark, a)
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    sinks._swap(spark, spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir() if p.name.startswith("t-")] == []
    with pytest.raises(Exception):  # noqa: B017
        sinks._swap(spark, spark.range(5), str(tmp_path / "missing"))


def test_archives_hold_finished_rows(spark):
    r = spark.createDataFrame([(1, "done", "x/a.mp4"), (1, "done", "y/a.mp4"), (1, "new", "z.mp4"), (1, "done", ""), (2, "done", "q")], "batch int, status string, file string")
    got = sorted((x["batch"], x["entry"]) for x in sinks.archive_rows(r, "batch", "status", "file").collect())
    assert got == [(1, "a-2.mp4"), (1, "a.mp4"), (2, "q")]


def test_documents_and_updates_by_key(spark, tmp_path):
    sinks.write_documents(spark.createDataFrame([("k", 1), ("l", 2)], "key string, v int"), str(tmp_path / "docs"), "key")
    assert spark.read.json(str(tmp_path / "docs")).count() == 2
    (tmp_path / "in").mkdir()
    for name, v in (("job-1", 1), ("job-2", 2)):
        (tmp_path / f"in/{name}.json").write_text(f'{{"v": {v}}}\n')
    query = tables.stream_updates(spark, str(tmp_path / "in"), "v int").writeStream.format("memory").queryName("keyed").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("keyed").select("channel", "v").collect())) == [("job-1", 1), ("job-2", 2)]


def full_second(video_id, offset, cursor):
    """Three pages within one second, then one a minute later; the page after is asked for by cursor."""
    pages = {None: ([1.0, 1.1], "b"), "b": ([1.2, 1.3], "c"), "c": ([1.9, 61.0], None)}
    at, following = pages[cursor]
    return [{"ts": t, "text": str(t)} for t in at], following


def test_pages_of_a_full_second_join_without_a_gap():
    assert [t for t, _, _ in chat.page_through(full_second, "v", 0, 100)] == [1.0, 1.1, 1.2, 1.3, 1.9, 61.0]
    assert [t for t, _, _ in chat.page_through(full_second, "v", 0, 60)] == [1.0, 1.1, 1.2, 1.3, 1.9]
    with pytest.raises(ValueError, match="does not move"):
        list(chat.page_through(lambda *_: ([{"ts": 1}], "x"), "v", 0, 9))

    def failing(video_id, offset, cursor):
        if cursor:
            raise OSError("down")
        return [{"ts": 3.0}], "next"

    with pytest.raises(OSError, match="down"):
        list(chat.page_through(failing, "v", 0, 9))
    assert [t for t, _, _ in chat.page_through(failing, "v", 0, 9, keep=True)] == [3.0]


# -- streams


def streamed(spark, tmp_path, rows, schema, build, mode="append", files=1):
    """The rows that a query over files gives, one file a trigger, until its input is read."""
    source, name = str(tmp_path / "in"), f"q{abs(hash(str(tmp_path)))}"
    for part in range(files):
        spark.createDataFrame(rows[part::files], schema.replace("timestamp", "string")).coalesce(1).write.mode("append").json(source)
        time.sleep(0.05)
    query = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)).writeStream.format("memory").queryName(name).outputMode(mode)
    query = query.option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start()
    until = time.time() + 60
    while time.time() < until and query.isActive and not query.awaitTermination(1):
        if query.lastProgress and not query.status["isDataAvailable"] and spark.table(name).count() >= len(rows):
            query.stop()  # state with a timeout never runs out of batches
    query.stop()
    return spark.table(name)


def moment(minute, second=0):
    return datetime(2024, 1, 1, minute // 60, minute % 60, second, tzinfo=timezone.utc).isoformat()


def test_windows_and_sessions_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = [("a", moment(m), 1.0) for m in (1, 2, 31, 65, 130)] + [("b", moment(10), 2.0)]
    schema = "k string, at timestamp, weight double"
    batch = spark.createDataFrame(rows, "k string, at string, weight double").withColumn("at", F.to_timestamp("at"))
    cases = {
        "hops": lambda s, late=None: windows.hop_counts(s, "at", "k", "1 hour", "30 minutes", late),
        "sessions": lambda s, late=None: windows.sessions(s, "at", "k", "20 minutes", late),
    }
    for name, build in cases.items():
        folder = tmp_path / name
        folder.mkdir()
        got = streamed(spark, folder, rows, schema, lambda s, build=build: build(s, "1 hour"), "complete" if name == "hops" else "append").collect()
        want = build(batch).collect()
        if name == "hops":
            assert sorted(map(str, got)) == sorted(map(str, want))
        else:  # sessions come out once the watermark has passed them
            assert {str(r) for r in got} <= {str(r) for r in want}


def test_progress_of_streams_is_told(spark, tmp_path):
    told = []
    listener = state.ProgressLog(lambda name, counters: told.append(counters))
    spark.streams.addListener(listener)
    try:
        streamed(spark, tmp_path, [("a", 1), ("b", 2)], "k string, n int", lambda s: s, files=2)
        until = time.time() + 20
        while time.time() < until and not any(c.get("ended") for c in told):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert told[-1]["ended"] and told[-1]["rows"] == 2 and told[-1]["error"] is None and not listener.streams


def test_repeats_and_limits_of_a_stream(spark, tmp_path):
    rows = [("a", moment(1), 1), ("a", moment(1), 1), ("b", moment(2), 2), ("a", moment(3), 1)]
    (tmp_path / "seen").mkdir()
    got = streamed(spark, tmp_path / "seen", rows, "k string, at timestamp, n int", lambda s: state.first_seen(s, "at", ["k", "n"], "1 hour")).select("k").collect()
    assert sorted(r["k"] for r in got) == ["a", "b"]
    hits = [("a", float(t), i) for i, t in enumerate((0, 100, 200, 999, 1000, 1001))] + [("b", 5.0, 9)]
    (tmp_path / "limit").mkdir()
    out = streamed(spark, tmp_path / "limit", hits, "ip string, t double, i int", lambda s: state.rate_limited(s, "ip", "t", "i", 2, 1000.0))
    assert {r["i"]: r["allowed"] for r in out.collect()} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False, 9: True}
