"""Cases that larger tables bring: many copies, late dates, long series."""

import functools
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.functions import scalars
from crestline.operators import align, intervals, signals
from crestline.plans import all_plans


@pytest.fixture
def against_sql(spark, tmp_path):
    """Compares a query with its SQL over small tables given as frames."""

    def check(name, **tables):
        con = duckdb.connect(config={"threads": 1})
        for table, frame in tables.items():
            frame.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got = all_plans.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({all_plans.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)

    return check


def test_years_beyond_four_digits_have_no_sign(spark, against_sql):
    keys = [0, 1, 205256, 205257, 205258, 899999]
    orders = spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint")
    against_sql("utc_stamps", orders=orders)
    # Beyond the last timestamp, where the SQL has no result.
    late = spark.createDataFrame([(9_000_000 * 1_234_567,), (-1,), (None,)], "x bigint").select(scalars.utc_stamp(F.col("x")).alias("at"))
    assert [r["at"] for r in late.collect()] == ["354066-11-02T04:00:00Z", "1969-12-31T23:59:59Z", None]


def test_means_of_a_half_do_not_depend_on_where_rows_lie(spark, tmp_path):
    """Sums whose last bit hangs on the order are those in the order of jobs, however the table lies."""
    rng, want, rows = random.Random(1), {}, []
    while len(want) < 20:
        views = [rng.randrange(10**5, 4 * 10**7) / 100 for _ in range(6)]
        views[-1] = round(views[-1] + (300 - sum(round(v * 100) for v in views) % 600) / 100, 2)
        ahead, back = (math.floor(functools.reduce(float.__add__, v, 0.0) / 6 + 0.5) for v in (views, views[::-1]))
        if ahead != back:
            rows += [(len(rows) + i, len(want), "F", v, "1-URGENT") for i, v in enumerate(views)]
            want[len(want)] = ahead
    rng.shuffle(rows)
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string")
    orders.coalesce(1).withColumn("o_orderdate", F.lit("2001-01-04").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    customer = spark.range(21).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit("s").alias("c_mktsegment"))
    customer.write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["creator_id"]: r["avg_views"] for r in all_plans.queries()["creator_rollup"](spark, str(tmp_path)).collect()}
    assert got == want | {20: 0}


def test_interpolation_reads_no_frame_to_the_end_of_a_key(spark):
    """Such a frame is evaluated anew for every row, which is quadratic in a key's rows."""
    df = spark.range(23).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.col("id") * 2.0).alias("x"))
    out = signals.interpolate_sampled(df, ["k"], "i", "x", 5)
    assert [r["x"] for r in out.orderBy("i").collect()] == [2.0 * i if i <= 20 else 0.0 for i in range(23)]
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()


@pytest.fixture(scope="module")
def crowded_events(spark):
    """Few moments, many events at each, and moments on the edges of others' spans."""
    rows = [(i, 600.0 * (i % 7) + 300.0 * (i % 2) + 1500.0, i % 5, "ab"[i % 3 == 0]) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id bigint, t double, user_id bigint, event_type string")
    ts = F.expr("timestamp_micros(1704067200000000 + CAST(t * 1000000 AS BIGINT))").cast("timestamp_ntz")
    return df.select("event_id", ts.alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"))


@pytest.mark.parametrize("name", ["max_overlap_assign", "point_in_interval_count", "point_in_interval_list", "overlap_pairs", "clip_words"])
def test_crowded_moments(crowded_events, against_sql, monkeypatch, name):
    monkeypatch.setattr(align, "BUNDLE", 4)
    against_sql(name, events=crowded_events)


def test_counts_and_largest_overlaps_form_no_sorted_pairs(spark):
    p = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0)], "k string, t double")
    q = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 3.0, 2.0), ("a", 3, 2.5, 9.0), ("b", 4, 0.0, 9.0), ("a", 5, None, 2.0)], "k string, i int, s double, e double")
    got = align.count_in_intervals(p, q, ["k"], "t", "s", "e", 1.0)
    assert sorted((r["i"], r["n"]) for r in got.collect()) == [(1, 3), (2, 0), (3, 0), (4, 0), (5, 0)]
    items = q.filter("e > s").select("k", "i", "s", "e")
    turns = spark.createDataFrame([("a", 1, 7, 0.0, 3.0), ("a", 2, 8, 0.0, 3.0), ("a", 3, 9, 1.0, 2.0)], "k string, turn int, who int, x double, y double")
    best = align.max_overlap(items, turns, ["k"], ("s", "e"), ("x", "y"), "turn", "who", 1.0)
    assert sorted((r["i"], r["who"]) for r in best.collect()) == [(1, 7), (3, 7), (4, None)]
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["chunk_words", "sentence_groups"])
def test_words_of_a_document_are_numbered_without_a_shuffle(spark, against_sql, monkeypatch, tmp_path, name):
    monkeypatch.setattr("crestline.operators.sequences.SLICE", 5)
    texts = [None, "", "a", "a. b? c", "w " * 45 + "end. x", " ".join("abcdefgh"[: 1 + i * 5 % 8] + ".!"[: i % 9 == 4] for i in range(60))]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    against_sql(name, documents=documents)
    plan = all_plans.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_a_growing_group_asks_only_for_clips_in_its_new_part():
    clips = intervals._OpenClips(np.arange(6.0), np.arange(6.0) + 3)
    assert clips.starting(2.0, 4.0, 1) == [2, 3] and clips.ending(4.0, 6.0, 1) == [2, 3]
    clips.open[2] = False
    assert clips.starting(2.0, 4.0, -1) == [3] and clips.ending(3.0, 6.0, 2) == [3]


def test_thousandths_round_halves_away_from_zero(spark):
    values = [0.0, 0.0005, 0.0015, 0.49999999999999994e-3, 0.0625, 1.0005, -0.0005, -1e-9, -2.5, 2699.9995, 1e13 + 0.25, 1e300, math.inf, math.nan, None]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(scalars.thousandths(F.col("v")).alias("x")).collect()]

    def exact(v):
        y = abs(v * 1000)
        near = math.floor(Fraction(y) + Fraction(1, 2)) / 1000 if y < 2**52 else y / 1000
        return near if v >= 0 else 0.0 - near

    assert got[:-2] == [exact(v) for v in values[:-2]] and math.isnan(got[-2]) and got[-1] is None


@pytest.mark.parametrize("name", ["clip_words", "point_in_interval_list", "overlap_pairs"])
def test_pairs_are_listed_after_one_shuffle_of_each_side_and_rounded_plainly(spark, crowded_events, tmp_path, name):
    """However small a side is, it is not broadcast: the tasks of the other side's few files would make all pairs."""
    crowded_events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    plan = all_plans.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange") == 2 and "Window" not in plan and "round(" not in plan


def test_largest_overlaps_equal_those_of_all_pairs():
    """Also where ends touch, lengths tie, spans are empty or reversed, and overlaps are equal after rounding only."""
    rng = np.random.default_rng(4)
    for i in range(400):
        n, m, digits = rng.integers(0, 40), rng.integers(1, 30), [None, 6, 1, 0][i % 4]
        times = [lambda k: rng.integers(0, 20, k) * 1.0, lambda k: rng.random(k) * 10, lambda k: rng.integers(0, 99, k) / 10.0 + rng.integers(-1, 2, k) * 1e-12][i % 3]
        s, a = times(n), times(m)
        e, b, rank = s + times(n) - (i % 5 == 0), a + times(m) * rng.random(), rng.permutation(n) * 1.0
        shared = np.where(e > s, np.minimum(b[:, None], e) - np.maximum(a[:, None], s), 0.0)
        told = np.where(shared > 0, shared if digits is None else np.floor(shared * 10.0**digits + 0.5), 0.0)
        most = told.max(axis=1, initial=0.0)
        first = np.where((told == most[:, None]) & (told > 0), rank, np.inf).min(axis=1, initial=np.inf)
        got = align.largest_overlaps(a, b, s, e, rank, digits)
        assert np.array_equal(got[0], most) and np.array_equal(got[1], first)


def test_largest_overlap_forms_no_pairs(spark, against_sql, tmp_path):
    """Different times, so that no spans are equal: a join on buckets would make pairs."""
    rows = [(i, i * 7919 % 9000 + i / 1000.0, i % 5, "ab"[i % 3 == 0]) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, t double, user_id bigint, event_type string")
    ts = F.expr("timestamp_micros(1704067200000000 + CAST(round(t * 1000000) AS BIGINT))").cast("timestamp_ntz")
    against_sql("max_overlap_assign", events=df.select("event_id", ts.alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value")))
    plan = all_plans.queries()["max_overlap_assign"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "_b#" in line]


def test_items_of_no_key_or_time_stay_without_an_answer(spark):
    spans = spark.createDataFrame([("a", 1, "x", 0.0, 3.0), (None, 2, "y", 0.0, 3.0), ("a", 0, "z", 9.0, 9.5)], "k string, turn int, who string, x double, y double")
    rows = [("a", 1, 0.2, 0.4), ("a", 2, 0.5, 2.5), (None, 3, 0.2, 0.4), ("a", 4, None, 1.0), ("c", 5, 0.2, 0.4), ("a", 6, 0.2, 0.4), ("a", 7, 2.0, 9.2), (None, 8, 0.5, 2.5)]
    items = spark.createDataFrame(rows, "k string, i int, s double, e double")
    got = align.max_overlap(items, spans, ["k"], ("s", "e"), ("x", "y"), "turn", "who", 1.0)
    assert got.columns == ["k", "i", "s", "e", "who"]
    assert sorted((r["i"], r["who"]) for r in got.collect()) == [(1, "x"), (2, "x"), (3, None), (4, None), (5, None), (6, "x"), (7, "x"), (8, None)]


def test_overlaps_round_as_sql_rounds_them(spark, against_sql):
    """Overlaps a hair below a half of a thousandth, which scaling in doubles brings to the half."""
    micros = [36324601236, 36509932736, 220558920501, 220621752001, 112022793447, 111687336947]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(micros)], "event_id bigint, t bigint").withColumn("ts", F.expr("timestamp_micros(1704067200000000 + t)").cast("timestamp_ntz"))
    against_sql("overlap_pairs", events=df.select("event_id", "ts", F.lit(1).cast("long").alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value")))


def test_pairs_within_a_table_are_those_of_its_join_with_itself(spark):
    rng = random.Random(5)
    rows = [("ab"[i % 2] if i % 9 else None, None if i % 11 == 10 else i, t, None if i % 13 == 12 else t + rng.choice([-1.0, 0.0, 1.0, 2.5, 7.0])) for i in range(60) for t in [float(rng.randrange(12))]]
    df = spark.createDataFrame(rows, "k string, i int, s double, e double")
    sides = [df.select("k", *[F.col(c).alias(f"{x}_{c}") for c in "ise"]) for x in "ab"]
    for share in (0.0, 0.5):
        joined = align.overlap_pairs(*sides, ["k"], ("a_s", "a_e"), ("b_s", "b_e"), 2.0, share).filter("a_i < b_i").select("k", "a_i", "b_i", "overlap")
        crowded = align.overlap_pairs(*sides, ["k"], ("a_s", "a_e"), ("b_s", "b_e"), 2.0, share, crowded=True).filter("a_i < b_i").select("k", "a_i", "b_i", "overlap")
        got = sorted(map(tuple, align.pairs_within(df, ["k"], ("s", "e"), "i", 2.0, share).collect()))
        assert got and got == sorted(map(tuple, joined.collect())) == sorted(map(tuple, crowded.collect()))
