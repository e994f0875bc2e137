"""Ordered analytics over feature series, one series a key."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges below this count as constant.
FLAT = 1e-8
#: Weights of the signals of a window, width of smoothing in windows, least seconds between peaks.
WEIGHTS = {
    "rms": 0.10,
    "chat_speed": 0.18,
    "flux": 0.12,
    "onset": 0.14,
    "pitch_var": 0.14,
    "centroid": 0.05,
    "zcr": 0.02,
    "chat_burst": 0.10,
    "emote_density": 0.08,
    "caps_ratio": 0.07,
}
SMOOTH_SIGMA, PEAK_DISTANCE = 2.5, 60.0


def _sound(x: Column) -> Column:
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def robust_normalize(df: DataFrame, by: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Add ``name: (x - median) / (p95 - median)``, clipped to 0..1, for every entry.

    NaN and null count as 0.  A series whose 95th percentile hardly exceeds its median is
    0 throughout.  One window over each key finds all levels, so normalising again by the same key shuffles
    nothing; a percentile holds the distinct values of one series, here the windows of one stream.
    """
    whole, quoted = W.partitionBy(*by), {name: f"_x_{name}" for name in columns}
    sound = df.withColumns({quoted[name]: _sound(x) for name, x in columns.items()})
    levels = {f"_q_{name}": F.percentile(x, F.array(F.lit(0.5), F.lit(0.95))).over(whole) for name, x in quoted.items()}
    out = {}
    for name, x in quoted.items():
        low, high = F.col(f"_q_{name}")[0], F.col(f"_q_{name}")[1]
        share = F.try_divide(F.col(x) - low, high - low)
        out[name] = F.when(high - low < FLAT, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    return sound.withColumns(levels).withColumns(out).drop(*quoted.values(), *levels)


def composite(weights: Mapping[str, float]) -> Column:
    """Weighted sum of normalised signals."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.col(name) * F.lit(float(w))
    return total


def moment_scores(
    df: DataFrame,
    by: Sequence[str],
    weights: Mapping[str, float],
    energy: tuple[str, str],
    chat: str,
    sentiment: str,
    speech: str,
    excitement: str,
    game: str,
    keep: str | None = None,
) -> DataFrame:
    """Composite score with its boosts, over raw signals; ``keep`` names a column for whether speech is ever heard.

    Three dependent normalisations: the signals; the agreement of energy and chat, and
    what the speech classes need; the energy of speech.  A key whose sentiment (speech) never passes
    0.05 gets no sentiment (speech) boost.
    """
    raw = {f"n_{c}": F.col(c) for c in dict.fromkeys([*weights, *energy, chat, sentiment, speech, excitement, game])}
    passes = {n: F.coalesce(F.max(c).over(W.partitionBy(*by)), F.lit(0.0)) > 0.05 for n, c in (("_felt", sentiment), ("_spoken", speech))}
    n = robust_normalize(df.withColumns(passes), by, raw)
    loud = (F.col(f"n_{energy[0]}") + F.col(f"n_{energy[1]}")) / 2
    second = robust_normalize(
        n, by, {"_agree": loud * F.col(f"n_{chat}"), "_voice": F.col(f"n_{speech}") * F.col(f"n_{energy[0]}")}
    )
    score = composite({f"n_{c}": w for c, w in weights.items()}) * (1 + 0.3 * F.col("_agree"))
    score = score * F.when(F.col("_felt"), 1 + 0.15 * F.col(f"n_{sentiment}")).otherwise(1.0)
    quiet_game = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"n_{game}") - F.col(f"n_{speech}")))
    spoken = (score * (1 + 0.15 * F.col("_voice")) + 0.25 * F.col(f"n_{excitement}")) * (1 - 0.15 * quiet_game)
    out = second.withColumn("score", F.when(F.col("_spoken"), spoken).otherwise(score)).drop("_agree", "_voice", "_felt")
    return out.withColumnRenamed("_spoken", keep) if keep else out.drop("_spoken")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised weights of offsets ``-radius .. radius``."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_smooth(df: DataFrame, by: Sequence[str], index: str, value: str, sigma: float, name: str = "smooth") -> DataFrame:
    """Gaussian smoothing of ``value`` by ``index`` (0, 1, ... in each key), reflected at the ends.

    The series is mirrored past its ends by emitting copies of rows, as often as a
    short series needs, and every row then sums its neighbours at fixed offsets.
    """
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    n = F.max(index).over(W.partitionBy(*by)) + 1
    sized = df.withColumn("_n", n)
    i, size = F.col(index), F.col("_n")
    periods = F.sequence(F.floor(F.lit(-r) / (2 * size)).cast("int") - 1, F.floor((size + r) / (2 * size)).cast("int") + 1)
    spots = F.concat(F.transform(periods, lambda m: m * 2 * size + i), F.transform(periods, lambda m: m * 2 * size - 1 - i))
    padded = sized.withColumn("_at", F.explode(F.filter(spots, lambda p: (p >= -r) & (p < size + r))))
    order = W.partitionBy(*by).orderBy("_at")
    total = F.lit(0.0)
    for d, w in zip(range(-r, r + 1), weights, strict=True):
        near = F.lag(value, -d).over(order) if d < 0 else F.lead(value, d).over(order) if d else F.col(value)
        total = total + F.lit(w) * near
    return padded.withColumn(name, total).filter(F.col("_at") == i).drop("_n", "_at")


def find_peaks(y: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Indices of local maxima, plateaus by their middle, at least ``distance`` apart.

    Higher maxima suppress lower ones nearby; of those left, the ones that rise by
    ``prominence`` over the higher of their two valleys count.
    """
    n = len(y)
    found, i = [], 1
    while i < n - 1:
        if y[i - 1] < y[i]:
            end = i
            while end < n - 1 and y[end + 1] == y[i]:
                end += 1
            if end < n - 1 and y[end + 1] < y[i]:
                found.append((i + end) // 2)
            i = end
        i += 1
    peaks = np.array(found, dtype=int)
    keep = np.ones(len(peaks), dtype=bool)
    for p in np.argsort(y[peaks], kind="stable")[::-1]:
        if keep[p]:
            near = np.abs(peaks - peaks[p]) < distance
            near[p] = False
            keep &= ~near
    out = []
    for p in peaks[keep]:
        higher = np.flatnonzero(y > y[p])
        left = higher[higher < p].max(initial=-1)
        right = higher[higher > p].min(initial=n)
        base = max(y[left + 1 : p + 1].min(), y[p:right].min())
        if y[p] - base >= prominence:
            out.append(p)
    return np.array(out, dtype=int)


def peak_rows(df: DataFrame, by: str, index: str, value: str, distance: int, prominence: float, top: int) -> DataFrame:
    """``by, index, value, rank``: the ``top`` highest peaks of each series.

    A series without a peak gives its ``top`` highest rows, later ones first on a tie.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        series = group.sort_values(index, kind="stable").reset_index(drop=True)
        y = series[value].to_numpy(float)
        at = find_peaks(y, distance, prominence)
        if not len(at):
            at = np.argsort(y, kind="stable")[::-1][:top]
        at = at[np.argsort(-y[at], kind="stable")][:top]
        return series.iloc[at][[by, index, value]].assign(rank=np.arange(1, len(at) + 1))

    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"{by} {fields[by]}, {index} {fields[index]}, {value} {fields[value]}, rank int"
    return df.select(by, index, value).groupBy(by).applyInPandas(pick, schema)


def hot_points(features: DataFrame, by: str, index: str, time: str, mood: str, hop: float, top: int = 20, prominence: float = 0.05) -> DataFrame:
    """The records of the best moments of each stream: ``by, rank, timestamp_seconds, timestamp_display, score, signals, chat_mood``.

    ``features`` has a row for every window, numbered 0, 1, ... by ``index``, with the signals of
    ``WEIGHTS``, ``sentiment_intensity`` and the class levels ``speech_presence``, ``vocal_excitement`` and
    ``game_audio``.  Scores are weighted, boosted and smoothed; peaks keep a minute's distance.  A
    stream in which no speech is heard shows no speech or excitement; null signals count as 0.
    """
    from crestline.functions.scalars import clock

    scored = moment_scores(
        features, [by], WEIGHTS, energy=("rms", "flux"), chat="chat_speed", sentiment="sentiment_intensity",
        speech="speech_presence", excitement="vocal_excitement", game="game_audio", keep="_heard",
    )
    smooth = gaussian_smooth(scored, [by], index, "score", SMOOTH_SIGMA).withColumn("smooth", F.round("smooth", 12))
    best = peak_rows(smooth, by, index, "smooth", max(1, int(PEAK_DISTANCE / hop)), prominence, top)
    shown = {"rms": "rms", "spectral_flux": "flux", "pitch_variance": "pitch_var", "spectral_centroid": "centroid", "zcr": "zcr", "chat_speed": "chat_speed"}
    levels = [F.round(f"n_{c}", 3).alias(name) for name, c in shown.items()]
    levels += [F.when(F.col("_heard"), F.round(f"n_{c}", 3)).otherwise(0.0).alias(c) for c in ("vocal_excitement", "speech_presence")]
    told = scored.select(by, index, F.col(time).alias("_t"), F.struct(*levels).alias("signals"), F.col(mood).alias("chat_mood"))
    return best.join(told, [by, index]).select(
        by, "rank", F.round("_t", 1).alias("timestamp_seconds"), clock(F.col("_t")).alias("timestamp_display"), F.round("smooth", 3).alias("score"), "signals", "chat_mood"
    )


def frame_windows(df: DataFrame, by: Sequence[str], index: str, columns: Sequence[str], length: int, step: int) -> DataFrame:
    """Means over ``length`` frames, one every ``step`` frames, complete windows only."""
    span = W.partitionBy(*by).orderBy(index).rowsBetween(0, length - 1)
    whole = F.count(F.lit(1)).over(span) == length
    means = df.select(*by, index, *[F.avg(c).over(span).alias(c) for c in columns], whole.alias("_whole"))
    return means.filter(F.col("_whole") & (F.pmod(F.col(index), F.lit(step)) == 0)).drop("_whole")


def interpolate_sampled(df: DataFrame, by: Sequence[str], index: str, value: str, every: int) -> DataFrame:
    """Values between sampled rows (``index`` a multiple of ``every``) by linear interpolation.

    Rows after the last sample are 0.
    """
    sample = F.pmod(F.col(index), F.lit(every)) == 0
    mark = F.when(sample, F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    back = F.last(mark, ignorenulls=True).over(W.partitionBy(*by).orderBy(index).rowsBetween(W.unboundedPreceding, 0))
    # Read backwards, as a frame that reaches to the end of a key is evaluated anew for every row.
    ahead = F.last(mark, ignorenulls=True).over(W.partitionBy(*by).orderBy(F.desc(index)).rowsBetween(W.unboundedPreceding, 0))
    lo, hi = F.col("_lo"), F.col("_hi")
    line = lo.v + (hi.v - lo.v) * F.try_divide(F.col(index) - lo.i, hi.i - lo.i)
    out = F.when(sample, F.col(value)).when(hi.isNull(), F.lit(0.0)).otherwise(line)
    return df.withColumns({"_lo": back, "_hi": ahead}).withColumn(value, out).drop("_lo", "_hi")


def moving_average(by: Sequence[str], index: str, value: str, width: int) -> Column:
    """Centred mean over ``width`` rows in which rows beyond the ends count as 0."""
    half = width // 2
    return F.sum(value).over(W.partitionBy(*by).orderBy(index).rowsBetween(-half, half)) / width


def activity_level(df: DataFrame, by: Sequence[str], value: str, factor: float = 0.3) -> DataFrame:
    """Threshold of activity of each key: median plus a share of the way to the 85th percentile."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.85)))
    return df.groupBy(*by).agg(q.alias("_q")).select(*by, (F.col("_q")[0] + F.lit(factor) * (F.col("_q")[1] - F.col("_q")[0])).alias("level"))


def islands(df: DataFrame, by: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Runs of rows with a true ``flag``: ``by, first, last`` of ``order`` and ``n`` rows."""
    w = W.partitionBy(*by).orderBy(order)
    marked = df.select(*by, order, F.coalesce(flag, F.lit(False)).alias("_f"))
    edge = F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))
    runs = marked.withColumn("_edge", edge.cast("int")).withColumn("_run", F.sum("_edge").over(w)).filter("_f")
    return runs.groupBy(*by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def quiet_end(
    marks: DataFrame, series: DataFrame, by: Sequence[str], at: str, time: str, value: str, level: float, reach: float, hop: float
) -> DataFrame:
    """Extend each mark to a quieter time no more than ``reach`` later.

    The first step of ``hop`` after the mark below ``level`` wins; failing that the quietest
    step, the mark included, the earliest on a tie.  The series holds the steps' values.
    """
    from crestline.operators.align import points_in_intervals

    spans = marks.select(*by, at).distinct().withColumn("_to", F.col(at) + F.lit(float(reach)))
    seen = points_in_intervals(series.select(*by, time, value), spans, by, time, at, "_to", reach)
    below = F.min(F.when((F.col(value) < level) & (F.col(time) > F.col(at)), F.col(time)))
    least = F.min_by(time, F.struct(value, time))
    found = seen.groupBy(*by, at).agg(below.alias("_below"), least.alias("_least"))
    return marks.join(found, [*by, at], "left").withColumn("snapped", F.coalesce("_below", "_least", at)).drop("_below", "_least")


def silence_edge(
    marks: DataFrame, frames: DataFrame, by: Sequence[str], at: str, time: str, value: str, duration: Column, later: bool, reach: float = 30.0, factor: float = 0.3, least: int = 10
) -> DataFrame:
    """Extend each mark (``by, at``) to a silence within ``reach`` seconds, after it if ``later``, else before it: ``snapped``.

    A frame is quiet at ``factor`` of the median of all frames around the mark or below.  The first
    stretch of at least ``least`` quiet frames counts, failing that the longest, failing any the quietest
    frame; of equals the earlier.  A later mark takes the stretch's first frame, an earlier one the last frame of
    the last (or longest) stretch.  Without frames the mark stays.  The result is rounded to a tenth and
    kept within the recording.
    """
    from crestline.operators.align import points_in_intervals

    keys = [*by, at]
    spans = marks.select(*keys).distinct().withColumns({"_from": F.col(at) - reach, "_to": F.col(at) + reach})
    near = points_in_intervals(frames.select(*by, time, value), spans, by, time, "_from", "_to", 2 * reach)
    level = F.percentile(value, F.lit(0.5)).over(W.partitionBy(*keys)) * factor
    asked = F.col(time) >= F.col(at) if later else F.col(time) <= F.col(at)
    seen = near.withColumn("_quiet", F.col(value) <= level).filter(asked)
    runs = islands(seen, keys, time, F.col("_quiet"))
    long = F.when(F.col("n") >= least, F.col("first" if later else "last"))
    longest = F.max_by("first" if later else "last", F.struct("n", (-F.col("first")).alias("e")))
    found = runs.groupBy(*keys).agg((F.min(long) if later else F.max(long)).alias("_sure"), longest.alias("_longest"))
    quietest = seen.groupBy(*keys).agg(F.min_by(time, F.struct(value, time)).alias("_least"))
    joined = marks.join(found, keys, "left").join(quietest, keys, "left").withColumn("_d", duration)
    to = F.coalesce("_sure", "_longest", "_least")
    snapped = F.when(to.isNull(), F.col(at)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.col("_d"), to)), 1))
    return joined.withColumn("snapped", snapped).drop("_sure", "_longest", "_least", "_d")


def even_sample(by: Sequence[str], order: Sequence[str | Column], most: int) -> Column:
    """Whether a row is among the at most ``most`` rows at ``int(i * n / most)`` of its key."""
    i = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    k = F.ceil(i * most / n)
    return (n <= most) | ((k < most) & (F.floor(k * n / most) == i))


def frame_range(start: Column, end: Column, fps: int) -> tuple[Column, Column]:
    """First frame, and the frame after the last, of a time span."""
    return F.floor(start * fps).cast("long"), F.ceil(end * fps).cast("long")
