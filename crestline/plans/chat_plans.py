"""Chat read with the moods' own lexica, and the whole way from chat to ranked clips.

Chats are the conversations, dealt to eight streams; a turn follows the one before by a second and a half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.operators import align, intervals, ranking, signals
from crestline.operators.chat import EMOTES, MOODS, chat_features
from crestline.operators.greedy import cut_lineage
from crestline.plans import moments
from crestline.plans.catalog import query
from crestline.plans.roles import WINDOWS, load

_EDGE = r"[^\p{L}\p{M}\p{N}_]"


def _hit(word: str) -> str:
    """SQL condition for a word of a lexicon in ``t`` (lower case) with the words ``ws``."""
    quoted = word.replace("'", "''")
    if len(word) == 1:
        return f"t = '{quoted}'"
    return f"list_contains(ws, '{quoted}')" if word.isalnum() else f"regexp_matches(t, '(^|{_EDGE}){quoted}($|{_EDGE})')"


def _weight(words: dict[str, float]) -> str:
    return "greatest(0.0::DOUBLE, " + ", ".join(f"CASE WHEN {_hit(w)} THEN {x}::DOUBLE ELSE 0 END" for w, x in words.items()) + ")"


_WORDS = "|".join(e.lower() for e in EMOTES if e != "D:")
_FACE = rf"len(regexp_extract_all(regexp_replace(text, '({_EDGE})', '\1\1', 'g'), '(?i)(^|{_EDGE})d::[\p{{L}}\p{{M}}\p{{N}}_]'))"
_SCORES = [f"sentiment_{m}" for m in MOODS] + ["emote_density", "caps_ratio"]
_CHAT = rf"""talk AS (
  SELECT 'c' || (conv_id % 8) AS job_id, (conv_id // 8) * 12.0::DOUBLE + turn * 1.5::DOUBLE AS ts, role AS author, coalesce(text, '') AS text, lower(coalesce(text, '')) AS t,
    regexp_split_to_array(lower(coalesce(text, '')), '{_EDGE}+') AS ws FROM conversations),
scored AS (
  SELECT job_id, ts, author, length(text) / 2000.0::DOUBLE AS loud, {", ".join(f"{_weight(w)} AS sentiment_{m}" for m, w in MOODS.items())},
    CAST(len(list_filter(ws, lambda w: regexp_full_match(w, '{_WORDS}'))) + {_FACE} AS DOUBLE) AS emote_density,
    CASE WHEN length(text) > 3 AND upper(text) = text AND regexp_matches(text, '\p{{L}}') THEN 1.0::DOUBLE ELSE 0 END AS caps_ratio FROM talk),
durations AS (SELECT job_id, CAST(floor(max(ts)) + 1 AS DOUBLE) AS duration FROM talk GROUP BY job_id),
grid AS (SELECT job_id, k, k * 2.5::DOUBLE AS time FROM durations, range(0, 1000000) AS r(k) WHERE k * 2.5 + 5 <= duration),
per AS (
  SELECT g.job_id, g.k, g.time, count(m.ts) / 5.0::DOUBLE AS chat_speed, coalesce(count(DISTINCT m.author) / nullif(CAST(count(m.ts) AS DOUBLE), 0), 0) AS unique_ratio,
    coalesce(avg(m.loud), 0) AS loud, {", ".join(f"coalesce(avg(m.{c}), 0) AS {c}" for c in _SCORES)}
  FROM grid g LEFT JOIN scored m ON m.job_id = g.job_id AND m.ts >= g.time AND m.ts < g.time + 5 GROUP BY g.job_id, g.k, g.time),
burst AS (SELECT *, greatest(0, chat_speed - lag(chat_speed, 1, 0) OVER (PARTITION BY job_id ORDER BY k)) AS chat_burst,
    greatest({", ".join(f"sentiment_{m}" for m in MOODS)}) AS sentiment_intensity FROM per),
windows AS (SELECT *, CASE WHEN sentiment_intensity <= 0.1 THEN '' {" ".join(f"WHEN sentiment_{m} = sentiment_intensity THEN '{m}'" for m in MOODS)} ELSE '' END AS dominant_mood FROM burst)"""


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    at = F.floor(F.col("conv_id") / 8) * 12.0 + F.col("turn") * 1.5
    text = F.coalesce("text", F.lit(""))
    return c.select(F.concat(F.lit("c"), (F.col("conv_id") % 8).cast("string")).alias("job_id"), at.alias("ts"), F.col("role").alias("author"), text.alias("text"), (F.length(text) / 2000.0).alias("loud"))


def _durations(talk: DataFrame) -> DataFrame:
    return talk.groupBy("job_id").agg((F.floor(F.max("ts")) + 1).cast("double").alias("duration"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat features of every window, with ``loud``, which stands in for the loudness of the recording."""
    from crestline.operators.windows import chat_windows

    talk = _talk(spark, sf_dir)
    lengths = chat_windows(talk, _durations(talk), ["job_id"], "ts", "author", means=["loud"]).select("job_id", "k", "loud")
    return chat_features(talk, _durations(talk), ["job_id"], "ts", "author", "text").join(lengths, ["job_id", "k"])


_SHOWN = ["chat_speed", "chat_burst", "unique_ratio", *_SCORES, "sentiment_intensity"]


@query(f"WITH {_CHAT} SELECT job_id, k, time, {', '.join(f'round({c}, 9) AS {c}' for c in _SHOWN)}, dominant_mood FROM windows")
def chat_moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chat features of every window: capitals, emotes and the three moods by their lexica."""
    return _windows(spark, sf_dir).select("job_id", "k", "time", *[F.round(c, 9).alias(c) for c in _SHOWN], "dominant_mood")


# The chat half of the signals is real; the sound half comes from the length of the texts.
_ROLES = {
    "rms": "loud", "flux": "abs(loud - before)", "onset": "greatest(0.0, loud - before)", "pitch_var": "loud * unique_ratio", "centroid": "unique_ratio",
    "zcr": "chat_burst * unique_ratio", "chat_speed": "chat_speed", "chat_burst": "chat_burst", "emote_density": "emote_density", "caps_ratio": "caps_ratio",
    "sentiment_intensity": "sentiment_intensity", "speech_presence": "unique_ratio", "vocal_excitement": "chat_burst", "game_audio": "loud",
}
_FEATURES = f"""features AS (
  SELECT job_id, k, time, {", ".join(f"{x} AS {c}" for c, x in _ROLES.items())}, dominant_mood AS mood
  FROM (SELECT *, coalesce(lag(loud) OVER (PARTITION BY job_id ORDER BY k), loud) AS before FROM windows))"""
_POINTS = moments._HOT_POINTS.replace(WINDOWS, _CHAT).replace(moments._FEATURES, _FEATURES)
_SEGMENTS = moments._SEGMENTS.replace(f"{WINDOWS},", "", 1).replace("21600", "5").replace("3600", "5")


@query(f"""WITH RECURSIVE {_POINTS}, {_SEGMENTS},
marks AS (SELECT b.job_id, CAST(b.rank AS INTEGER) AS rank, round(s.time, 1) AS peak, round(b.y, 3) AS score, mood, n_sentiment_intensity AS felt
  FROM best b JOIN scores s ON s.job_id = b.job_id AND s.k = b.k),
firsts AS (
  SELECT p.job_id, p.rank, p.peak, min(struct_pack(s := s."start", e := s."end")) AS seg
  FROM marks p LEFT JOIN segments s ON s.job_id = p.job_id AND p.peak >= s."start" AND p.peak <= s."end" GROUP BY p.job_id, p.rank, p.peak),
raw AS (
  SELECT job_id, rank, duration,
    CASE WHEN seg.s IS NULL THEN greatest(0, peak - 25) WHEN seg.e - seg.s <= 90 THEN seg.s ELSE greatest(seg.s, peak - 60 * 0.6::DOUBLE) END AS s,
    CASE WHEN seg.s IS NULL THEN least(duration, peak + 20) WHEN seg.e - seg.s <= 90 THEN seg.e ELSE least(seg.e, peak + 60 * 0.4::DOUBLE) END AS e
  FROM firsts JOIN durations USING (job_id)),
grown AS (
  SELECT *, 45 - (e - s) AS lack, CASE WHEN e - s < 45 THEN greatest(0, s - (45 - (e - s)) / 2) ELSE s END AS s1,
    CASE WHEN e - s < 45 THEN least(duration, e + (45 - (e - s)) / 2) ELSE e END AS e1 FROM raw),
clips AS (SELECT job_id, rank,
    round(CASE WHEN lack > 0 AND 45 - (e1 - s1) > 0 AND s1 <> 0 THEN greatest(0, s1 - (45 - (e1 - s1))) ELSE s1 END, 1) AS "start",
    round(CASE WHEN lack > 0 AND 45 - (e1 - s1) > 0 AND s1 = 0 THEN least(duration, e1 + (45 - (e1 - s1))) ELSE e1 END, 1) AS "end" FROM grown),
{moments._ABSORB},
kept AS (SELECT s.job_id, s.rank, s.gs, s.ge, m.peak, m.mood, round(0.2 * score + 0.8 * felt, 3) AS final FROM state s JOIN marks m ON m.job_id = s.job_id AND m.rank = s.rank WHERE s.owner = s.rank),
placed AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final DESC, rank) AS place FROM kept)
SELECT job_id, CAST(place AS INTEGER) AS place, rank, peak, round(gs, 1) AS "start", round(ge, 1) AS "end", final, mood FROM placed WHERE place <= 20""")
def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From chat to ranked clips: features, hot points, clip bounds from activity, absorbed overlaps, final ranks.

    The part that a language model plays, virality, is played by the strength of feeling at the peak.
    """
    w = cut_lineage(_windows(spark, sf_dir))  # read five times below
    ends = _durations(_talk(spark, sf_dir))
    before = F.coalesce(F.lag("loud").over(W.partitionBy("job_id").orderBy("k")), F.col("loud"))
    features = w.withColumn("before", before).select("job_id", "k", "time", *[F.expr(x).alias(c) for c, x in _ROLES.items()], F.col("dominant_mood").alias("mood"))
    points = signals.hot_points(features, "job_id", "k", "time", "mood", 2.5)
    points = points.select("job_id", "rank", F.col("timestamp_seconds").alias("peak"), "score", F.col("chat_mood").alias("mood"))
    active = w.join(signals.activity_level(w, ["job_id"], "chat_speed"), "job_id").join(ends, "job_id").withColumn("active", F.round("chat_speed", 9) > F.round("level", 9))
    segments = intervals.activity_segments(active, ["job_id"], "time", F.col("active"), F.col("duration"))
    found = align.first_containing(points, segments, ["job_id"], "peak", "start", "end", 60.0).join(ends, "job_id")
    start, end = intervals.clip_bounds(F.col("peak"), F.col("duration"), F.col("start"), F.col("end"))
    clips = found.select("job_id", "rank", F.round(start, 1).alias("s"), F.round(end, 1).alias("e"))
    kept = intervals.overlap_dedup(clips, "job_id", "rank", "s", "e").filter("rank = kept_rank")
    felt = signals.robust_normalize(w, ["job_id"], {"felt": F.col("sentiment_intensity")}).select("job_id", F.round("time", 1).alias("peak"), "felt")
    told = kept.join(points, ["job_id", "rank"]).join(felt, ["job_id", "peak"])
    final = told.withColumn("final", ranking.final_score(F.col("score"), F.col("felt")))
    best = ranking.top_n(final, ["job_id"], [F.desc("final"), F.asc("rank")], 20, "place")
    return best.select("job_id", "place", "rank", "peak", F.round("s", 1).alias("start"), F.round("e", 1).alias("end"), "final", "mood")
