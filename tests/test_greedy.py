"""Greedy rules against plain loops, with blocks small enough for several levels."""

import random

import pytest

from crestline.operators import greedy, intervals, sequences


def walked(links):
    out, by = set(), {}
    for k, at, to in links:
        by.setdefault(k, {})[at] = to
    for k, jumps in by.items():
        at = min(jumps)
        while at is not None:
            out.add((k, at))
            at = jumps[at]
    return out


@pytest.mark.parametrize("reach, block, top", [(3, 16, 20), (300, 8, 50), (7, 64, 1)])
def test_follow_against_a_plain_walk(spark, reach, block, top):
    rng = random.Random(reach)
    links = []
    for key, n in (("a", 1500), ("b", 1), ("c", 70), (None, 400)):
        places = sorted(rng.sample(range(n * 3), n))
        for i, at in enumerate(places):
            j = i + rng.randint(1, reach)
            links.append((key, at, places[j] if j < n else None))
    df = spark.createDataFrame(links, "k string, p long, nxt long").repartition(3)
    got = greedy.follow(df, ["k"], "p", "nxt", block, top).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == walked(links)


def test_follow_an_empty_table(spark):
    assert greedy.follow(spark.createDataFrame([], "k string, p long, nxt long"), ["k"], "p", "nxt").collect() == []


def kept_apart(times, least):
    out, last = [], None
    for t in sorted(times):
        if last is None or t >= last + least:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("slices", [1, 16])
def test_rows_spaced_apart_against_a_plain_loop(spark, monkeypatch, slices):
    monkeypatch.setattr(greedy.follow, "__defaults__", (32, 16))
    rng = random.Random(slices)
    rows = [(k, round(rng.choice([rng.random() * 50, rng.random() * 4000, -rng.random() * 9]), 2), i) for k in ("a", "b", None) for i in range(500)]
    rows += [("a", 7.0, 9000), ("a", 7.0, 9001), ("one", 3.0, 0), ("b", None, 1)]
    df = spark.createDataFrame(rows, "_by string, t double, i int").repartition(4)
    got = intervals.spaced_apart(df, "_by", "t", 2.5, ["i"], slices)
    assert got.columns == ["_by", "t", "i"]
    got = got.collect()
    for key in ("a", "b", None, "one"):
        mine = sorted((r["t"], r["i"]) for r in got if r["_by"] == key)
        want = kept_apart([t for k, t, _ in rows if k == key and t is not None], 2.5)
        assert [t for t, _ in mine] == want
        assert all(i == min(j for k, t2, j in rows if k == key and t2 == t) for t, i in mine)


def test_long_documents_are_chunked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(greedy.follow, "__defaults__", (32, 16))
    rng, words, want, at = random.Random(4), [], {}, 0.0
    for doc, n in (("d", 700), (None, 90), ("e", 1)):
        size, began, who, chunk = 0, 0.0, None, -1
        for i in range(n):
            s, e, p = at, at + rng.choice([0.2, 0.5, 2.0, 4.0]), rng.choice(["x", "x", "x", None])
            if chunk < 0 or size >= 4 or e - began > 3.0 or p != who:
                chunk, size, began, who = chunk + 1, 0, s, p
            size, at = size + 1, e
            words.append((doc, i * 5, s, e, p))
            want[doc, i * 5] = chunk
    df = spark.createDataFrame(words, "doc string, i int, s double, e double, who string").repartition(3)
    got = sequences.chunk_words(df, "doc", "i", "s", "e", speaker="who", part=24)
    assert {(r["doc"], r["i"]): r["chunk"] for r in got.collect()} == want and got.count() == len(words)
