"""Queries over windows, series and intervals of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.functions.scalars import thousandths
from crestline.operators import align, intervals, ranking, signals
from crestline.operators.windows import hopping_grid, shouted
from crestline.plans.catalog import query
from crestline.plans.roles import (
    DURATIONS,
    HOP,
    HOUR,
    MESSAGES,
    WINDOW,
    WINDOWS,
    durations,
    load,
    messages,
    normalized,
    windows,
)

_HOT = {"chat_speed": 0.4, "chat_burst": 0.2, "unique_ratio": 0.25, "weight": 0.15}
_HOT_SQL = normalized({f"n_{c}": c for c in _HOT}, "windows")
_HOT_SCORE = " + ".join(f"{w} * n_{c}" for c, w in _HOT.items())


@query(f"""WITH {WINDOWS}, {_HOT_SQL},
scored AS (SELECT job_id, k, time, {_HOT_SCORE} AS score FROM normalized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY round(score, 6) DESC, k) AS rank FROM scored)
SELECT job_id, k, time, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5""")
def hot_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five hottest windows of each stream."""
    n = signals.robust_normalize(windows(spark, sf_dir), ["job_id"], {f"n_{c}": F.col(c) for c in _HOT})
    scored = n.select("job_id", "k", "time", F.round(signals.composite({f"n_{c}": w for c, w in _HOT.items()}), 6).alias("score"))
    return ranking.top_n(scored, ["job_id"], [F.desc("score"), F.asc("k")], 5)


@query(f"""WITH {WINDOWS}
SELECT job_id, k, time, round(chat_speed, 9) AS chat_speed, round(unique_ratio, 9) AS unique_ratio, round(weight, 6) AS weight,
  round(chat_burst, 9) AS chat_burst FROM windows""")
def chat_hop_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all windows, empty ones included."""
    r = [F.round(c, 6 if c == "weight" else 9).alias(c) for c in ("chat_speed", "unique_ratio", "weight", "chat_burst")]
    return windows(spark, sf_dir).select("job_id", "k", "time", *r)


@query(f"""WITH {WINDOWS}, {normalized({"n_speed": "chat_speed", "n_weight": "weight"}, "windows")}
SELECT job_id, k, round(n_speed, 6) AS n_speed, round(n_weight, 6) AS n_weight FROM normalized""")
def robust_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = signals.robust_normalize(windows(spark, sf_dir), ["job_id"], {"n_speed": F.col("chat_speed"), "n_weight": F.col("weight")})
    return n.select("job_id", "k", F.round("n_speed", 6).alias("n_speed"), F.round("n_weight", 6).alias("n_weight"))


_NORM6 = ("chat_speed", "weight", "unique_ratio", "chat_burst")


def _norm_cte(name: str, source: str, columns: dict[str, str]) -> str:
    return normalized(columns, source).replace("levels AS", f"levels_{name} AS").replace("JOIN levels USING", f"JOIN levels_{name} USING").replace(
        "normalized AS", f"{name} AS"
    )


@query(f"""WITH {WINDOWS},
{_norm_cte("n1", "windows", {f"n_{c}": c for c in _NORM6})},
{_norm_cte("n2", "n1", {"agree": "(n_weight + n_chat_burst) / 2 * n_chat_speed", "voice": "n_unique_ratio * n_weight"})},
flags AS (SELECT job_id, max(weight) > 0.05 AS felt, max(unique_ratio) > 0.05 AS spoken FROM windows GROUP BY job_id),
base AS (
  SELECT n2.*, spoken, (0.4 * n_chat_speed + 0.35 * n_weight + 0.25 * n_chat_burst) * (1 + 0.3 * agree) * CASE WHEN felt THEN 1 + 0.15 * n_weight ELSE 1 END AS score
  FROM n2 JOIN flags USING (job_id))
SELECT job_id, k, round(CASE WHEN spoken THEN (score * (1 + 0.15 * voice) + 0.25 * n_chat_burst)
  * (1 - 0.15 * greatest(0, least(1, n_weight - n_unique_ratio))) ELSE score END, 6) AS score FROM base""")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted score with agreement, sentiment and speech boosts."""
    scored = signals.moment_scores(
        windows(spark, sf_dir), ["job_id"], {"chat_speed": 0.4, "weight": 0.35, "chat_burst": 0.25},
        energy=("weight", "chat_burst"), chat="chat_speed", sentiment="weight", speech="unique_ratio", excitement="chat_burst", game="weight",
    )
    return scored.select("job_id", "k", F.round("score", 6).alias("score"))


_W = signals.gaussian_weights(2.5)
_GAUSS = f"""sized AS (SELECT job_id, k, chat_speed, max(k) OVER (PARTITION BY job_id) + 1 AS n FROM windows),
taps AS (SELECT unnest(range(-10, 11)) AS d, unnest([{", ".join(map(repr, _W))}]) AS w),
gathered AS (
  SELECT a.job_id, a.k, a.n, w, CASE WHEN ((a.k + d) % (2 * n) + 2 * n) % (2 * n) < n THEN ((a.k + d) % (2 * n) + 2 * n) % (2 * n)
    ELSE 2 * n - 1 - ((a.k + d) % (2 * n) + 2 * n) % (2 * n) END AS src
  FROM sized a, taps),
smooth AS (
  SELECT g.job_id, g.k, sum(g.w * s.chat_speed) AS smooth FROM gathered g JOIN sized s ON s.job_id = g.job_id AND s.k = g.src GROUP BY g.job_id, g.k)"""


@query(f"WITH {WINDOWS}, {_GAUSS} SELECT job_id, k, round(smooth, 9) AS smooth FROM smooth")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.gaussian_smooth(windows(spark, sf_dir), ["job_id"], "k", "chat_speed", 2.5)
    return s.select("job_id", "k", F.round("smooth", 9).alias("smooth"))


def _peaks_sql(source: str, distance: int, prominence: float, top: int) -> str:
    """CTE ``best`` (``job_id, k, y, rank``): the highest peaks of ``source`` (``job_id, k, y``), or its highest rows."""
    return f"""plateaus AS (
  SELECT job_id, min(k) AS a, max(k) AS b, any_value(y) AS y
  FROM (SELECT *, k - row_number() OVER (PARTITION BY job_id, y ORDER BY k) AS g FROM {source}) GROUP BY job_id, y, g),
tops AS (
  SELECT job_id, (a + b) // 2 AS k, y FROM (
    SELECT *, lag(y) OVER w AS l, lead(y) OVER w AS r FROM plateaus WINDOW w AS (PARTITION BY job_id ORDER BY a)) WHERE l < y AND r < y),
apart AS (
  SELECT job_id, unnest(list_reduce(list([k] ORDER BY y DESC, k DESC),
    lambda kept, x: CASE WHEN len(list_filter(kept, lambda q: abs(q - x[1]) < {distance})) = 0 THEN list_concat(kept, x) ELSE kept END)) AS k
  FROM tops GROUP BY job_id),
walls AS (
  SELECT p.job_id, p.k, s0.y, max(s.k) FILTER (s.k < p.k AND s.y > s0.y) AS l, min(s.k) FILTER (s.k > p.k AND s.y > s0.y) AS r
  FROM apart p JOIN {source} s0 ON s0.job_id = p.job_id AND s0.k = p.k JOIN {source} s ON s.job_id = p.job_id GROUP BY p.job_id, p.k, s0.y),
valleys AS (
  SELECT w.job_id, w.k, w.y, min(s.y) FILTER (s.k > coalesce(l, -1) AND s.k <= w.k) AS lo, min(s.y) FILTER (s.k >= w.k AND s.k < coalesce(r, 1000000000)) AS hi
  FROM walls w JOIN {source} s ON s.job_id = w.job_id GROUP BY w.job_id, w.k, w.y),
peaks AS (SELECT job_id, k, y FROM valleys WHERE y - greatest(lo, hi) >= {prominence}),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY y DESC, k) AS rank FROM peaks
    UNION ALL SELECT job_id, k, y, row_number() OVER (PARTITION BY job_id ORDER BY y DESC, k DESC) AS rank FROM {source} WHERE job_id NOT IN (SELECT job_id FROM peaks))
  WHERE rank <= {top})"""


@query(f"""WITH {WINDOWS}, {_GAUSS}, rounded AS (SELECT job_id, k, round(smooth, 9) AS y FROM smooth), {_peaks_sql("rounded", 8, 0.00002, 10)}
SELECT job_id, k, y AS smooth, CAST(rank AS INTEGER) AS rank FROM best""")
def top_n_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest peaks of each smoothed series."""
    s = signals.gaussian_smooth(windows(spark, sf_dir), ["job_id"], "k", "chat_speed", 2.5).withColumn("smooth", F.round("smooth", 9))
    return signals.peak_rows(s, "job_id", "k", "smooth", distance=8, prominence=0.00002, top=10)


# Signals of a window that the events have no sound for, from those that they have.
_ROLES = {
    "rms": "weight / 100", "flux": "abs(weight - before)", "onset": "greatest(0.0, weight - before)", "pitch_var": "weight * unique_ratio", "centroid": "unique_ratio",
    "zcr": "chat_burst * unique_ratio", "chat_speed": "chat_speed", "chat_burst": "chat_burst", "emote_density": "unique_ratio * chat_speed", "caps_ratio": "chat_speed * weight",
    "sentiment_intensity": "weight / 100", "speech_presence": "unique_ratio", "vocal_excitement": "chat_burst * weight", "game_audio": "weight / 100",
}
_MOOD = "CASE WHEN weight > 50 THEN 'hype' ELSE '' END"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("weight").over(W.partitionBy("job_id").orderBy("k"))
    w = windows(spark, sf_dir).withColumn("before", F.coalesce(before, F.col("weight")))
    return w.select("job_id", "k", "time", *[F.expr(x).alias(c) for c, x in _ROLES.items()], F.expr(_MOOD).alias("mood"))


_FEATURES = f"""features AS (
  SELECT job_id, k, time, {", ".join(f"{x} AS {c}" for c, x in _ROLES.items())}, {_MOOD} AS mood
  FROM (SELECT *, coalesce(lag(weight) OVER (PARTITION BY job_id ORDER BY k), weight) AS before FROM windows))"""
_TEN = " + ".join(f"{w} * n_{c}" for c, w in signals.WEIGHTS.items())
_HOT_POINTS = f"""{WINDOWS}, {_FEATURES},
{_norm_cte("h1", "features", {f"n_{c}": c for c in _ROLES})},
{_norm_cte("h2", "h1", {"agree": "(n_rms + n_flux) / 2 * n_chat_speed", "voice": "n_speech_presence * n_rms"})},
heard AS (SELECT job_id, max(sentiment_intensity) > 0.05 AS felt, max(speech_presence) > 0.05 AS spoken FROM features GROUP BY job_id),
boosted AS (
  SELECT h2.*, spoken, ({_TEN}) * (1 + 0.3 * agree) * CASE WHEN felt THEN 1 + 0.15 * n_sentiment_intensity ELSE 1 END AS b FROM h2 JOIN heard USING (job_id)),
scores AS (
  SELECT *, CASE WHEN spoken THEN (b * (1 + 0.15 * voice) + 0.25 * n_vocal_excitement) * (1 - 0.15 * greatest(0, least(1, n_game_audio - n_speech_presence))) ELSE b END AS chat
  FROM boosted),
{_GAUSS.replace("chat_speed", "chat").replace("FROM windows", "FROM scores")},
rounded AS (SELECT job_id, k, round(smooth, 12) AS y FROM smooth),
{_peaks_sql("rounded", 24, 0.05, 20)}"""


@query(f"""WITH {_HOT_POINTS}
SELECT b.job_id, CAST(b.rank AS INTEGER) AS rank, round(s.time, 1) AS timestamp_seconds,
  lpad(CAST(CAST(s.time AS BIGINT) // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(CAST(s.time AS BIGINT) // 3600 AS VARCHAR))) AS INTEGER), '0') || ':00:00' AS timestamp_display,
  round(b.y, 3) AS score, round(n_rms, 3) AS rms, round(n_pitch_var, 3) AS pitch_variance, CASE WHEN spoken THEN round(n_vocal_excitement, 3) ELSE 0 END AS vocal_excitement,
  CASE WHEN spoken THEN round(n_speech_presence, 3) ELSE 0 END AS speech_presence, mood AS chat_mood
FROM best b JOIN scores s ON s.job_id = b.job_id AND s.k = b.k""")
def hot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the twenty best moments of each stream."""
    points = signals.hot_points(_features(spark, sf_dir), "job_id", "k", "time", "mood", 2.5)
    shown = [F.col(f"signals.{c}").alias(c) for c in ("rms", "pitch_variance", "vocal_excitement", "speech_presence")]
    return points.select("job_id", "rank", "timestamp_seconds", "timestamp_display", "score", *shown, "chat_mood")


@query(f"""WITH {MESSAGES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, ord) - 1 AS i FROM messages),
means AS (
  SELECT job_id, i, avg(weight) OVER w AS weight, count(*) OVER w AS n FROM numbered
  WINDOW w AS (PARTITION BY job_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 106 FOLLOWING))
SELECT job_id, i, round(weight, 6) AS weight FROM means WHERE n = 107 AND i % 53 = 0""")
def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 107 consecutive messages, one every 53."""
    return signals.frame_windows(_numbered(spark, sf_dir), ["job_id"], "i", ["weight"], 107, 53).withColumn("weight", F.round("weight", 6))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(W.partitionBy("job_id").orderBy("ts", "ord")) - 1
    return messages(spark, sf_dir).withColumn("i", i.cast("long"))


_NUMBERED = f"{MESSAGES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, ord) - 1 AS i FROM messages)"


@query(f"""WITH {_NUMBERED},
marks AS (SELECT job_id, i AS si, weight AS sv FROM numbered WHERE i % 5 = 0)
SELECT n.job_id, n.i, round(CASE WHEN n.i % 5 = 0 THEN n.weight WHEN b.sv IS NULL THEN 0
  ELSE a.sv + (b.sv - a.sv) * (n.i - a.si) / 5.0 END, 6) AS weight
FROM numbered n JOIN marks a ON a.job_id = n.job_id AND a.si = n.i - n.i % 5
LEFT JOIN marks b ON b.job_id = n.job_id AND b.si = n.i - n.i % 5 + 5""")
def interpolate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth value kept, those between on a line, the tail zero."""
    out = signals.interpolate_sampled(_numbered(spark, sf_dir), ["job_id"], "i", "weight", 5)
    return out.select("job_id", "i", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_NUMBERED}
SELECT job_id, i, round(sum(weight) OVER (PARTITION BY job_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS mean FROM numbered""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select("job_id", "i", F.round(signals.moving_average(["job_id"], "i", "weight", 5), 6).alias("mean"))


_LEVEL = """level AS (SELECT job_id, quantile_cont(chat_speed, 0.5) + 0.3 * (quantile_cont(chat_speed, 0.85) - quantile_cont(chat_speed, 0.5)) AS level
  FROM windows GROUP BY job_id)"""


@query(f"WITH {WINDOWS}, {_LEVEL} SELECT job_id, round(level, 9) AS level FROM level")
def threshold_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = signals.activity_level(windows(spark, sf_dir), ["job_id"], "chat_speed")
    return level.select("job_id", F.round("level", 9).alias("level"))


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows(spark, sf_dir)
    return w.join(signals.activity_level(w, ["job_id"], "chat_speed"), "job_id").withColumn("active", F.round("chat_speed", 9) > F.round("level", 9))


_ACTIVE = f"""{WINDOWS}, {_LEVEL},
active AS (SELECT w.*, round(chat_speed, 9) > round(level, 9) AS active FROM windows w JOIN level USING (job_id)),
runs AS (
  SELECT job_id, min(k) AS first, max(k) AS last, count(*) AS n, min(time) AS t0, max(time) AS t1
  FROM (SELECT *, k - row_number() OVER (PARTITION BY job_id ORDER BY k) AS g FROM active WHERE active) GROUP BY job_id, g)"""


@query(f"WITH {_ACTIVE} SELECT job_id, first, last, n FROM runs")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of active windows."""
    return signals.islands(_active(spark, sf_dir), ["job_id"], "k", F.col("active"))


_SEGMENTS = f"""{_ACTIVE},
reached AS (SELECT *, max(t1) OVER (PARTITION BY job_id ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM runs),
numbered_runs AS (SELECT *, sum(CASE WHEN r IS NULL OR t0 > r + 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY t0) AS g FROM reached),
segments AS (
  SELECT job_id, greatest(0, min(t0) - 3600) AS "start", least(max(duration), max(t1) + 3600) AS "end"
  FROM numbered_runs JOIN durations USING (job_id) GROUP BY job_id, g)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _active(spark, sf_dir).join(durations(spark, sf_dir), "job_id")
    return intervals.activity_segments(a, ["job_id"], "time", F.col("active"), F.col("duration"), bridge=6 * HOUR, pad=HOUR)


@query(f'WITH {_SEGMENTS} SELECT job_id, "start", "end" FROM segments')
def activity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active stretches with short gaps closed, padded and clamped."""
    return _segments(spark, sf_dir)


_PEAKS = "peaks AS (SELECT job_id, ord, ts AS peak FROM messages)"


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("job_id", "ord", F.col("ts").alias("peak"))


_FIRST = """firsts AS (
  SELECT p.job_id, p.ord, p.peak, min(struct_pack(s := s."start", e := s."end")) AS seg
  FROM peaks p LEFT JOIN segments s ON s.job_id = p.job_id AND p.peak >= s."start" AND p.peak <= s."end" GROUP BY p.job_id, p.ord, p.peak)"""


def _first_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.first_containing(_peaks(spark, sf_dir), _segments(spark, sf_dir), ["job_id"], "peak", "start", "end", 24 * HOUR)


@query(f"""WITH {_SEGMENTS}, {_PEAKS}, {_FIRST} SELECT job_id, ord, peak, seg.s AS "start", seg.e AS "end" FROM firsts""")
def first_containing_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_segments(spark, sf_dir).select("job_id", "ord", "peak", "start", "end")


# Bounds in units of an hour for a second, to fit the density of the events.
@query(f"""WITH {_SEGMENTS}, {_PEAKS}, {_FIRST},
raw AS (
  SELECT job_id, ord, peak, duration,
    CASE WHEN seg.s IS NULL THEN greatest(0, peak - 90000) WHEN seg.e - seg.s <= 324000 THEN seg.s ELSE greatest(seg.s, peak - 216000 * 0.6) END AS s,
    CASE WHEN seg.s IS NULL THEN least(duration, peak + 72000) WHEN seg.e - seg.s <= 324000 THEN seg.e ELSE least(seg.e, peak + 216000 * 0.4) END AS e
  FROM firsts JOIN durations USING (job_id)),
grown AS (
  SELECT *, 162000 - (e - s) AS lack, CASE WHEN e - s < 162000 THEN greatest(0, s - (162000 - (e - s)) / 2) ELSE s END AS s1,
    CASE WHEN e - s < 162000 THEN least(duration, e + (162000 - (e - s)) / 2) ELSE e END AS e1 FROM raw)
SELECT job_id, ord,
  round(CASE WHEN lack > 0 AND 162000 - (e1 - s1) > 0 AND s1 <> 0 THEN greatest(0, s1 - (162000 - (e1 - s1))) ELSE s1 END, 1) AS "start",
  round(CASE WHEN lack > 0 AND 162000 - (e1 - s1) > 0 AND s1 = 0 THEN least(duration, e1 + (162000 - (e1 - s1))) ELSE e1 END, 1) AS "end"
FROM grown""")
def clip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip around every peak from its segment, with least and largest length."""
    p = _first_segments(spark, sf_dir).join(durations(spark, sf_dir), "job_id")
    start, end = intervals.clip_bounds(
        F.col("peak"), F.col("duration"), F.col("start"), F.col("end"), 45 * HOUR, 90 * HOUR, 60 * HOUR, 0.6, (25 * HOUR, 20 * HOUR)
    )
    return p.select("job_id", "ord", F.round(start, 1).alias("start"), F.round(end, 1).alias("end"))


@query(f"""WITH {MESSAGES}, {DURATIONS},
spans AS (
  SELECT job_id, greatest(0, ts - 7200) AS s, least(duration, ts + 300) AS e FROM messages JOIN durations USING (job_id)),
reached AS (SELECT *, max(e) OVER (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans),
grouped AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY s, e) AS g FROM reached),
merged AS (SELECT job_id, min(s) AS "start", max(e) AS "end", count(*) AS n FROM grouped GROUP BY job_id, g)
SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY "start") + 100 AS INTEGER) AS rank FROM merged""")
def detected_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long clips before detections, merged where they touch."""
    d = messages(spark, sf_dir).join(durations(spark, sf_dir), "job_id")
    return intervals.detected_clips(d, ["job_id"], "ts", F.col("duration"), 7200.0, 300.0)


_CLIPS = """clips AS (SELECT job_id, ord AS rank, ts - 1500 AS "start", ts + 1200 AS "end" FROM messages)"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return m.select("job_id", F.col("ord").alias("rank"), (F.col("ts") - 1500).alias("start"), (F.col("ts") + 1200).alias("end"))


@query(f"""WITH {MESSAGES}, {_CLIPS},
reached AS (SELECT *, max("end") OVER (PARTITION BY job_id ORDER BY "start", "end", rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM clips)
SELECT job_id, rank, CAST(sum(CASE WHEN r IS NULL OR "start" > r + 900 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY "start", "end", rank) - 1 AS BIGINT) AS grp
FROM reached""")
def batch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download groups: clips that start within 15 minutes of the group's end."""
    return intervals.merge_groups(_clips(spark, sf_dir), ["job_id"], "start", "end", 900.0, ["rank"]).select("job_id", "rank", "grp")


#: CTE ``state`` absorbs the clips of ``clips``, one of each stream a step; ``_ABSORBED`` reads it.
_ABSORB = """state(job_id, rank, s, e, owner, active, gs, ge, ptr) USING KEY (job_id, rank) AS (
  SELECT job_id, rank, "start", "end", CASE WHEN best THEN rank END, best, "start", "end", rank
  FROM (SELECT *, rank = min(rank) OVER (PARTITION BY job_id) AS best FROM clips)
  UNION
  (WITH cur AS (SELECT * FROM recurring.state WHERE active),
  hit AS (
    SELECT c.job_id, arg_min(struct_pack(rank := t.rank, s := t.s, e := t.e), t.rank) AS t
    FROM cur c JOIN recurring.state t ON t.job_id = c.job_id AND t.owner IS NULL AND t.rank > c.ptr
    WHERE least(c.ge - c.gs, t.e - t.s) > 0 AND greatest(0, least(c.ge, t.e) - greatest(c.gs, t.s)) / least(c.ge - c.gs, t.e - t.s) > 0.8
    GROUP BY c.job_id),
  fresh AS (
    SELECT t.job_id, min(t.rank) AS rank FROM recurring.state t JOIN cur c ON c.job_id = t.job_id
    WHERE t.owner IS NULL AND t.job_id NOT IN (SELECT job_id FROM hit) GROUP BY t.job_id)
  SELECT c.job_id, c.rank, c.s, c.e, c.owner, h.job_id IS NOT NULL, least(c.gs, coalesce(h.t.s, c.gs)), greatest(c.ge, coalesce(h.t.e, c.ge)), coalesce(h.t.rank, c.ptr)
  FROM cur c LEFT JOIN hit h USING (job_id)
  UNION ALL
  SELECT h.job_id, h.t.rank, h.t.s, h.t.e, c.rank, false, h.t.s, h.t.e, h.t.rank FROM hit h JOIN cur c USING (job_id)
  UNION ALL
  SELECT f.job_id, f.rank, t.s, t.e, f.rank, true, t.s, t.e, f.rank FROM fresh f JOIN recurring.state t ON t.job_id = f.job_id AND t.rank = f.rank))"""
_ABSORBED = """SELECT c.job_id, c.rank, o.gs AS "start", o.ge AS "end", c.owner AS kept_rank FROM state c JOIN state o ON o.job_id = c.job_id AND o.rank = c.owner"""


@query(f"WITH RECURSIVE {MESSAGES}, {_CLIPS}, {_ABSORB} {_ABSORBED}")
def overlap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy absorption of mostly covered clips; its twin absorbs one clip of each stream a step."""
    return intervals.overlap_dedup(_clips(spark, sf_dir), "job_id", "rank", "start", "end")


@query(f"""WITH RECURSIVE {MESSAGES}, kept AS (
  SELECT job_id, min(ts) AS ts FROM messages GROUP BY job_id
  UNION ALL
  SELECT k.job_id, min(m.ts) AS ts FROM kept k JOIN messages m ON m.job_id = k.job_id AND m.ts - k.ts >= 3600 GROUP BY k.job_id)
SELECT job_id, min(ord) AS ord, ts FROM messages SEMI JOIN kept USING (job_id, ts) GROUP BY job_id, ts""")
def moment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages at least an hour after the last kept one."""
    return intervals.spaced_apart(messages(spark, sf_dir).select("job_id", "ord", "ts"), "job_id", "ts", HOUR, ["ord"])


@query(f"""WITH {MESSAGES}, {_CLIPS}
SELECT a.job_id, a.rank AS a_rank, b.rank AS b_rank, round(least(a."end", b."end") - greatest(a."start", b."start"), 3) AS overlap
FROM clips a JOIN clips b ON a.job_id = b.job_id AND a.rank < b.rank
WHERE (least(a."end", b."end") - greatest(a."start", b."start")) / least(a."end" - a."start", b."end" - b."start") > 0.8""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of clips of which the overlap exceeds 0.8 of the shorter."""
    pairs = align.pairs_within(_clips(spark, sf_dir), ["job_id"], ("start", "end"), "rank", HOUR, 0.8)
    return pairs.withColumn("overlap", thousandths(F.col("overlap")))


@query(f"""WITH {WINDOWS},
frames AS (SELECT job_id, i, i * 10080.0 AS time FROM durations, range(0, 1000000) AS r(i) WHERE i * 10080.0 + {WINDOW} <= duration),
near AS (
  SELECT f.job_id, f.time, arg_min(struct_pack(a := w.chat_speed, b := w.weight), struct_pack(g := abs(f.time - w.time), t := w.time)) AS v
  FROM frames f JOIN windows w ON w.job_id = f.job_id AND abs(f.time - w.time) < 4000 GROUP BY f.job_id, f.time)
SELECT f.job_id, f.time, round(coalesce(v.a, 0), 9) AS chat_speed, round(coalesce(v.b, 0), 6) AS weight
FROM frames f LEFT JOIN near n ON n.job_id = f.job_id AND n.time = f.time""")
def nearest_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second grid takes the nearest window's features, or zeros."""
    frames = hopping_grid(durations(spark, sf_dir), ["job_id"], "duration", WINDOW, 10080.0).select("job_id", "time")
    w = windows(spark, sf_dir).select("job_id", F.col("time").alias("wt"), "chat_speed", "weight")
    near = align.nearest_asof(frames, w, ["job_id"], "time", "wt", 4000.0, {"chat_speed": 0.0, "weight": 0.0})
    return near.select("job_id", "time", F.round("chat_speed", 9).alias("chat_speed"), F.round("weight", 6).alias("weight"))


@query(f"""WITH {MESSAGES}, {_CLIPS}
SELECT c.job_id, c.rank, count(m.ord) AS n FROM clips c LEFT JOIN messages m ON m.job_id = c.job_id AND m.ts >= c."start" AND m.ts <= c."end"
GROUP BY c.job_id, c.rank""")
def point_in_interval_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages inside every clip, both ends included."""
    counted = align.count_in_intervals(messages(spark, sf_dir), _clips(spark, sf_dir), ["job_id"], "ts", "start", "end", HOUR)
    return counted.select("job_id", "rank", "n")


@query(f"""WITH {MESSAGES}, {_CLIPS}
SELECT c.job_id, c.rank, m.ord, round(m.ts - c."start", 3) AS at, m.author
FROM clips c JOIN messages m ON m.job_id = c.job_id AND m.ts >= c."start" AND m.ts <= c."end" """)
def point_in_interval_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of every clip with their time inside it."""
    m = messages(spark, sf_dir).select("job_id", "ts", "ord", "author")
    hits = align.points_in_intervals(m, _clips(spark, sf_dir).hint("merge"), ["job_id"], "ts", "start", "end", HOUR)
    return hits.select("job_id", "rank", "ord", thousandths(F.col("ts") - F.col("start")).alias("at"), "author")


_WORDS = """words AS (SELECT job_id, ord, ts AS ws, ts + 600 AS we FROM messages),
turns AS (SELECT job_id, ord AS turn, author AS speaker, ts - 900 AS s, ts + 300 + (ord % 5) * 240 AS e FROM messages)"""


def _words_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = messages(spark, sf_dir)
    words = m.select("job_id", "ord", F.col("ts").alias("ws"), (F.col("ts") + 600).alias("we"))
    turns = m.select(
        "job_id", F.col("ord").alias("turn"), F.col("author").alias("speaker"), (F.col("ts") - 900).alias("s"),
        (F.col("ts") + 300 + (F.col("ord") % 5) * 240).alias("e"),
    )
    return words, turns


@query(f"""WITH {MESSAGES}, {_WORDS},
pairs AS (
  SELECT w.job_id, w.ord, speaker, turn, round(least(we, e) - greatest(ws, s), 6) AS overlap FROM words w JOIN turns t ON t.job_id = w.job_id AND s < we AND e > ws),
best AS (SELECT *, row_number() OVER (PARTITION BY job_id, ord ORDER BY overlap DESC, turn) AS r FROM pairs WHERE overlap > 0)
SELECT w.job_id, w.ord, speaker FROM words w LEFT JOIN best b ON b.job_id = w.job_id AND b.ord = w.ord AND r = 1""")
def max_overlap_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word gets the speaker of the turn it overlaps most; the first of equals."""
    words, turns = _words_turns(spark, sf_dir)
    told = align.max_overlap(words, turns, ["job_id"], ("ws", "we"), ("s", "e"), "turn", "speaker", HOUR, digits=6)
    return told.select("job_id", "ord", "speaker")


@query(f"""WITH {MESSAGES}, {DURATIONS}, moments AS (SELECT job_id, i * 14400.0 AS now FROM durations, range(1, 1000000) AS r(i) WHERE i * 14400.0 <= duration),
live AS (
  SELECT n.job_id, n.now, m.ord, row_number() OVER (PARTITION BY n.job_id, n.now ORDER BY m.ts DESC, m.ord DESC) AS recency
  FROM moments n JOIN messages m ON m.job_id = n.job_id AND m.ts <= n.now AND n.now < m.ts + 7200)
SELECT job_id, now, ord, CAST(recency AS INTEGER) AS recency FROM live WHERE recency <= 3""")
def expiring_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three messages still on screen at each moment."""
    m = messages(spark, sf_dir)
    moments = hopping_grid(durations(spark, sf_dir), ["job_id"], "duration", 0.0, 4 * HOUR).filter("k > 0").select("job_id", F.col("time").alias("now"))
    return align.recent_points(moments, m.select("job_id", "ord", "ts"), ["job_id"], "now", "ts", "ord", 7200.0, 3).select("job_id", "now", "ord", "recency")


@query(f"""WITH {MESSAGES}, {_CLIPS}
SELECT c.job_id, c.rank, m.ord, round(greatest(0, m.ts - 60 - c."start"), 3) AS ws, round(least(c."end" - c."start", m.ts + 60 - c."start"), 3) AS we
FROM clips c JOIN messages m ON m.job_id = c.job_id AND m.ts + 60 > c."start" AND m.ts - 60 < c."end" """)
def clip_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every clip in its own time, cut at its edges."""
    w = messages(spark, sf_dir).select("job_id", "ord", (F.col("ts") - 60).alias("ws"), (F.col("ts") + 60).alias("we"))
    both = align.overlap_pairs(w, _clips(spark, sf_dir).hint("merge"), ["job_id"], ("ws", "we"), ("start", "end"), HOUR)
    cut = intervals.clip_words(both, "ws", "we", F.col("start"), F.col("end") - F.col("start"))
    return cut.select("job_id", "rank", "ord", "ws", "we")


@query(f"""WITH {WINDOWS}, {_LEVEL}, {_CLIPS},
seen AS (
  SELECT c.job_id, c.rank, c."end", min(CASE WHEN round(chat_speed, 9) < 0.0005 AND time > c."end" THEN time END) AS below,
    arg_min(time, struct_pack(v := chat_speed, t := time)) AS least
  FROM clips c LEFT JOIN windows w ON w.job_id = c.job_id AND time >= c."end" AND time <= c."end" + 86400 GROUP BY c.job_id, c.rank, c."end")
SELECT job_id, rank, coalesce(below, least, "end") AS snapped FROM seen""")
def quiet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip ends move to the next quiet window within a day, else to the quietest."""
    series = windows(spark, sf_dir).select("job_id", "time", "chat_speed")
    out = signals.quiet_end(_clips(spark, sf_dir), series, ["job_id"], "end", "time", "chat_speed", 0.0005, 86400.0, HOP)
    return out.select("job_id", "rank", "snapped")


@query(f"""WITH {_NUMBERED}, sized AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM numbered)
SELECT job_id, ord FROM sized WHERE n <= 80 OR i IN (SELECT floor(j * n / 80) FROM range(0, 80) AS r(j))""")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 80 evenly spaced messages of each stream."""
    m = messages(spark, sf_dir)
    return m.withColumn("_s", signals.even_sample(["job_id"], ["ts", "ord"], 80)).filter("_s").select("job_id", "ord")


@query("""WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, count(*) AS n, round(avg(CASE WHEN length(line) > 3 AND upper(line) = line AND regexp_matches(line, '\\p{L}') THEN 1.0 ELSE 0 END), 6) AS caps_ratio
FROM lines GROUP BY source""")
def caps_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of shouted lines of each source."""
    lines = load(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    caps = F.avg(F.when(shouted(F.col("line")), 1.0).otherwise(0.0))
    return lines.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(caps, 6).alias("caps_ratio"))
