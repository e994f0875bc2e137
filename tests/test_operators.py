"""Operators that SQL cannot express, against plain twins, and hand-computed cases."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.functions import scalars
from crestline.operators import align, intervals, keyframes, ranking, sequences, signals, vectors, windows
from crestline.streaming import state


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# -- robust normalisation


def normalized(spark, values):
    df = spark.createDataFrame([("j", i, None if v is None else float(v)) for i, v in enumerate(values)], "job string, i int, x double")
    return [r["n"] for r in signals.robust_normalize(df, ["job"], {"n": F.col("x")}).orderBy("i").collect()]


@pytest.mark.parametrize(
    "values", [[0, 1, 2, 3, 10], [float("nan"), 1, 2, 3, 4], [None, 1, 2], list(range(1, 11)), [0] * 95 + [100, 200, 300, 400, 500]]
)
def test_normalized_values_are_bounded(spark, values):
    out = normalized(spark, values)
    assert len(out) == len(values) and all(0 <= v <= 1 for v in out)


def test_normalize_against_numpy(spark):
    x = np.random.default_rng(1).gamma(2.0, size=200)
    low, high = np.median(x), np.percentile(x, 95)
    assert np.allclose(normalized(spark, x), np.clip((x - low) / (high - low), 0, 1))


@pytest.mark.parametrize("values", [[0] * 10, [5] * 10, [42], [1, 1, 1 + 1e-10]])
def test_flat_series_normalize_to_zero(spark, values):
    assert normalized(spark, values) == [0] * len(values)


def test_normalize_median_and_outlier(spark):
    assert normalized(spark, range(1, 11))[:5] == [0] * 5
    assert normalized(spark, [0] * 95 + [100, 200, 300, 400, 500])[-1] == 1


# -- smoothing and peaks


@pytest.mark.parametrize("n", [1, 2, 5, 9, 10, 40])
def test_smoothing_against_numpy(spark, n):
    x = np.random.default_rng(n).random(n)
    df = spark.createDataFrame([("j", i, float(v)) for i, v in enumerate(x)], "job string, i int, x double")
    got = [r["smooth"] for r in signals.gaussian_smooth(df, ["job"], "i", "x", 2.5).orderBy("i").collect()]
    w = np.array(signals.gaussian_weights(2.5))
    assert np.allclose(got, np.convolve(np.pad(x, 10, mode="symmetric"), w, mode="valid"))


def test_peaks_by_hand():
    assert signals.find_peaks(np.array([0, 1, 0, 2, 0]), 1, 0.05).tolist() == [1, 3]
    assert signals.find_peaks(np.array([0, 1, 0, 2, 0]), 3, 0.05).tolist() == [3]
    assert signals.find_peaks(np.array([0, 1, 1, 1, 0]), 1, 0.05).tolist() == [2]
    assert signals.find_peaks(np.array([0, 1, 0.99, 2, 0]), 1, 0.05).tolist() == [3]
    assert signals.find_peaks(np.array([3, 2, 1]), 1, 0.05).tolist() == []
    assert signals.find_peaks(np.array([1, 2, 2]), 1, 0.05).tolist() == []


def test_spike_is_found_and_constant_series_still_give_rows(spark):
    spiked = [("a", i, 1.0 if 95 <= i <= 105 else 0.1) for i in range(200)]
    flat = [("b", i, 0.5) for i in range(200)]
    df = spark.createDataFrame(spiked + flat, "job string, i int, x double")
    smooth = signals.gaussian_smooth(df, ["job"], "i", "x", 2.5)
    got = signals.peak_rows(smooth, "job", "i", "smooth", 24, 0.05, 3).collect()
    assert [r["i"] for r in got if r["job"] == "a"] == [100]
    assert len([r for r in got if r["job"] == "b"]) == 3


def test_dense_windows(spark):
    messages = spark.createDataFrame([("j", 2.5, "a"), ("j", 4.9, "b"), ("j", 5.0, "a"), ("j", 11.0, "c")], "job string, ts double, author string")
    spans = spark.createDataFrame([("j", 12.6), ("short", 4.0)], "job string, duration double")
    got = windows.chat_windows(messages, spans, ["job"], "ts", "author").orderBy("k").collect()
    assert [r["k"] for r in got] == [0, 1, 2, 3]  # a window exists if it ends within the duration
    assert [round(r["chat_speed"] * 5) for r in got] == [2, 3, 1, 1]
    assert [round(r["chat_burst"] * 5) for r in got] == [2, 1, 0, 0]
    assert round(got[1]["unique_ratio"], 6) == round(2 / 3, 6)


# -- intervals


def absorbed(clips, share):
    """Plain twin of ``overlap_dedup``: ``rank -> (kept rank, start, end)``."""
    clips = sorted([list(c) for c in clips])
    done, spans = {}, {}
    for i, (rank, _, _) in enumerate(clips):
        if rank in done:
            continue
        done[rank] = rank
        span = clips[i][1:]
        for other, s, e in clips[i + 1 :]:
            if other in done:
                continue
            shorter = min(span[1] - span[0], e - s)
            if shorter > 0 and (min(span[1], e) - max(span[0], s)) / shorter > share:
                span, done[other] = [min(span[0], s), max(span[1], e)], rank
        spans[rank] = span
    return {r: (k, *spans[k]) for r, k in done.items()}


def test_overlap_dedup_against_a_plain_twin(spark):
    rng = random.Random(2)
    clips = [(job, rank, s, s + rng.choice([0.0, 5.0, 30.0, 60.0])) for job in "abc" for rank, s in enumerate(rng.random() * 300 for _ in range(60))]
    df = spark.createDataFrame(clips, "job string, rank int, s double, e double").repartition(5)
    got = {(r["job"], r["rank"]): (r["kept_rank"], r["s"], r["e"]) for r in intervals.overlap_dedup(df, "job", "rank", "s", "e").collect()}
    for job in "abc":
        want = absorbed([c[1:] for c in clips if c[0] == job], 0.8)
        assert {r: got[job, r] for r in want} == want


@pytest.mark.parametrize("share", [0.8, 0.3])
def test_absorption_by_index_against_the_plain_twin(share):
    rng = random.Random(7)
    for n in (1, 2, 30, 200):
        clips = [(i, s, s + rng.choice([0.0, 1.0, 5.0, 30.0, rng.random() * 200])) for i, s in enumerate(rng.choice([rng.random() * 400, 50.0]) for _ in range(n))]
        owner, s, e = intervals.absorbing(np.array([c[1] for c in clips]), np.array([c[2] for c in clips]), share)
        assert {i: (owner[i], s[i], e[i]) for i in range(n)} == absorbed(clips, share)


def test_a_million_clips_in_one_stretch_take_seconds():
    rng, n = np.random.default_rng(0), 1_000_000
    start = rng.random(n) * n / 2
    began = time.perf_counter()
    owner, s, e = intervals.absorbing(start, start + rng.choice([45.0, 60.0, 90.0], n), 0.8)
    assert time.perf_counter() - began < 60
    assert (owner <= np.arange(n)).all() and (owner[owner] == owner).all() and len(set(owner.tolist())) < n / 10


def test_overlap_share_is_strict(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 10.0), ("a", 2, 2.0, 12.0), ("b", 1, 0.0, 10.0), ("b", 2, 1.9, 11.9)], "job string, rank int, s double, e double")
    got = {(r["job"], r["rank"]): r["kept_rank"] for r in intervals.overlap_dedup(df, "job", "rank", "s", "e").collect()}
    assert got == {("a", 1): 1, ("a", 2): 2, ("b", 1): 1, ("b", 2): 1}


def test_rows_spaced_apart(spark):
    df = spark.createDataFrame([("a", t) for t in (0.0, 1.9, 2.0, 3.5, 4.0, 4.1, 9.0)], "job string, t double")
    assert [r["t"] for r in intervals.spaced_apart(df, "job", "t", 2.0).orderBy("t").collect()] == [0.0, 2.0, 4.0, 9.0]


def bounds(spark, peak, duration, segment=None):
    s, e = segment or (None, None)
    df = spark.createDataFrame([(peak, duration, s, e)], "p double, d double, s double, e double")
    start, end = intervals.clip_bounds(F.col("p"), F.col("d"), F.col("s"), F.col("e"))
    return tuple(df.select(start, end).first())


def test_clip_bounds_by_hand(spark):
    assert bounds(spark, 100.0, 1000.0) == (75.0, 120.0)
    assert bounds(spark, 100.0, 1000.0, (60.0, 150.0)) == (60.0, 150.0)
    assert bounds(spark, 100.0, 1000.0, (60.0, 151.0)) == (64.0, 124.0)
    assert bounds(spark, 5.0, 1000.0) == (0.0, 45.0)
    assert bounds(spark, 990.0, 1000.0) == (955.0, 1000.0)
    assert bounds(spark, 10.0, 30.0) == (0.0, 30.0)


def test_points_count_at_both_ends_and_nearest_is_strict(spark):
    points = spark.createDataFrame([("a", t) for t in (4.9, 5.0, 7.0, 10.0, 10.1)], "job string, t double")
    spans = spark.createDataFrame([("a", 5.0, 10.0)], "job string, s double, e double")
    assert [r["t"] for r in align.points_in_intervals(points, spans, ["job"], "t", "s", "e", 3.0).orderBy("t").collect()] == [5.0, 7.0, 10.0]
    left = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 20.0)], "job string, t double")
    right = spark.createDataFrame([("a", 4.0, "x"), ("a", 6.0, "y"), ("a", 17.5, "z")], "job string, u double, v string")
    got = align.nearest_asof(left, right, ["job"], "t", "u", 2.5, {"v": ""})
    assert rows(got.select("t", "v"), "t") == [(0.0, ""), (5.0, "x"), (20.0, "")]


# -- words, speakers, clusters


def test_chunks_and_sentences_against_plain_twins(spark):
    rng = random.Random(3)
    words, at = [], 0.0
    for i in range(400):
        length = rng.choice([0.2, 0.5, 2.0, 4.0])
        words.append(("d", i, round(at, 3), round(at + length, 3), rng.choice(["a", "b."]), rng.choice("xy")))
        at += length
    df = spark.createDataFrame(words, "doc string, i int, s double, e double, w string, who string").repartition(3)
    for speaker in (None, "who"):
        chunks = []
        for _, i, s, e, _, who in words:
            last = chunks[-1] if chunks else None
            if last and len(last) < 4 and e - last[0][1] <= 3.0 and (not speaker or last[0][2] == who):
                last.append((i, s, who))
            else:
                chunks.append([(i, s, who)])
        want = [n for n, c in enumerate(chunks) for _ in c]
        assert [r["chunk"] for r in sequences.chunk_words(df, "doc", "i", "s", "e", speaker=speaker).orderBy("i").collect()] == want
    want, n, size = [], 0, 0
    for word in words:
        want.append(n)
        size += 1
        if size == 10 or word[4] == "b.":
            n, size = n + 1, 0
    assert [r["sentence"] for r in sequences.sentence_groups(df, "doc", "i", "w").orderBy("i").collect()] == want


def test_speakers_merge_along_chains(spark):
    v = {"a": [1.0, 0.0], "b": [0.8, 0.6], "c": [0.28, 0.96], "z": [0.0, 0.0], "o": [-1.0, 0.0]}
    seconds = {"a": 5.0, "b": 9.0, "c": 1.0, "z": 3.0, "o": 2.0}
    df = spark.createDataFrame([("k", n, x, seconds[n]) for n, x in v.items()], "clip string, name string, v array<double>, seconds double")
    got = {r["name"]: r["merged"] for r in vectors.merge_similar(df, "clip", "name", "v", "seconds").collect()}
    assert got == {"a": "b", "b": "b", "c": "b", "z": "z", "o": "o"}


def test_leader_clusters_follow_the_order(spark):
    boxes = [(0.0, 0.0), (1.0, 0.0), (2.4, 0.0), (10.0, 0.0), (0.5, 0.0)]
    df = spark.createDataFrame([("k", i, x, y, 1.5) for i, (x, y) in enumerate(boxes)], "clip string, i int, x double, y double, r double").repartition(4)
    assert [r["cluster"] for r in vectors.leader_clusters(df, "clip", "i", "x", "y", "r").orderBy("i").collect()] == [0, 0, 1, 2, 0]


# -- keyframes and scalars


def test_keyframes_by_hand(spark):
    frames = [(2.0, "linear", 20.0), (0.0, "linear", 0.0), (4.0, "easeIn", 40.0)]
    df = spark.createDataFrame([(frames, t) for t in (-1.0, 0.0, 1.0, 3.0, 9.0)], "f array<struct<time:double,easing:string,x:double>>, t double")
    got = df.select("t", keyframes.resolve_keyframes(F.col("f"), F.col("t"), ["x"])["x"].alias("x")).orderBy("t").collect()
    assert [r["x"] for r in got] == [0.0, 0.0, 10.0, 25.0, 40.0]


def test_keyframe_tolerance(spark):
    df = spark.createDataFrame([([(1.0, "linear", 5.0)], t) for t in (0.86, 1.14, 0.8, 1.2)], "f array<struct<time:double,easing:string,x:double>>, t double")
    assert [r[0] for r in df.select(keyframes.has_keyframe(F.col("f"), F.col("t"))).collect()] == [True, True, False, False]


@pytest.mark.parametrize("name", sorted(scalars.EASINGS))
def test_easings_start_at_zero_end_at_one_and_clamp(spark, name):
    df = spark.createDataFrame([(t,) for t in (-0.5, 0.0, 1.0, 1.5)], "t double")
    got = [r[0] for r in df.select(scalars.eased(name, F.col("t"))).collect()]
    assert got == pytest.approx([0, 0, 1, 1], abs=1e-9)


def test_clock_truncates(spark):
    df = spark.createDataFrame([(0.0,), (59.9,), (125.0,), (3661.0,)], "s double")
    assert [r[0] for r in df.select(scalars.clock(F.col("s"))).collect()] == ["00:00:00", "00:00:59", "00:02:05", "01:01:01"]


# -- ranking


def test_blend_rescues_and_demotes(spark):
    cases = [(1, 0.29, 0.81), (2, 0.3, 0.81), (3, 0.29, 0.8), (4, 0.51, 0.09), (5, 0.5, 0.09), (6, 0.51, 0.1), (7, 0.4, None)]
    df = spark.createDataFrame(cases, "i int, h double, c double")
    got = {r["i"]: r["s"] for r in df.select("i", ranking.blended(F.col("h"), F.col("c")).alias("s")).collect()}
    want = {1: 0.55 + 0.15, 2: 0.555, 3: 0.545, 4: 0.3 - 0.1, 5: 0.295, 6: 0.305, 7: 0.2}
    assert got == pytest.approx(want)


# -- state


def test_rejected_requests_are_not_logged(spark):
    told, log = state.decide([0, 100, 200, 999, 1000, 1001], [], 2, 1000.0)
    assert [a for a, _ in told] == [True, True, False, False, True, False]
    assert told[2][1] == 1.0 and log == [100, 1000]
    hits = [("a", t, i) for i, t in enumerate((0, 100, 200, 999, 1000, 1001))] + [("b", 5, 9)]
    df = spark.createDataFrame(hits, "ip string, t long, i int").repartition(3)
    got = {r["i"]: r["allowed"] for r in state.rate_limited_batch(df, ["ip"], "t", "i", 2, 1000.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False, 9: True}
