"""Dense overlapping time windows over message streams, and their features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hopping_grid(durations: DataFrame, by: Sequence[str], duration: str, window: float, hop: float) -> DataFrame:
    """``by, k, time``: every window ``[k * hop, k * hop + window)`` that ends within the duration."""
    last = F.floor((F.col(duration) - window) / hop).cast("int")
    ks = F.when(F.col(duration) >= window, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return durations.select(*by, F.explode(ks).alias("k")).withColumn("time", F.col("k") * F.lit(float(hop)))


def assign_windows(messages: DataFrame, t: str, window: float, hop: float) -> DataFrame:
    """One row for each message and window ``k`` that holds it (``window`` a multiple of ``hop`` or not)."""
    last = F.floor(F.col(t) / hop).cast("int")
    ks = F.sequence(last - int(-(-window // hop)) + 1, last)
    inside = F.filter(ks, lambda k: (k >= 0) & (F.col(t) >= k * hop) & (F.col(t) < k * hop + window))
    return messages.withColumn("k", F.explode(inside))


def shouted(text: Column) -> Column:
    """Whether a message of over 3 characters is all in capitals."""
    return (F.length(text) > 3) & (F.upper(text) == text) & text.rlike(r"\p{L}")


def without_bots(messages: DataFrame, author: str, bots: Sequence[str]) -> DataFrame:
    """Messages whose author, whatever its case, is no bot; a null author is none."""
    return messages.filter(~F.coalesce(F.lower(author).isin([b.lower() for b in bots]), F.lit(False)))


def chat_windows(
    messages: DataFrame,
    durations: DataFrame,
    by: Sequence[str],
    t: str,
    author: str,
    window: float = 5.0,
    hop: float = 2.5,
    means: Sequence[str] = (),
) -> DataFrame:
    """Features of every window of the dense grid, empty ones as zeros.

    ``chat_speed`` is messages a second, ``chat_burst`` its rise over the window before,
    ``unique_ratio`` distinct authors a message; ``means`` names message columns to average.
    """
    grid = hopping_grid(durations, by, "duration", window, hop)
    dealt = assign_windows(messages, t, window, hop)
    n = F.count(F.lit(1)).cast("double")
    per = dealt.groupBy(*by, "k").agg(
        (n / window).alias("chat_speed"), (F.count_distinct(author) / n).alias("unique_ratio"), *[F.avg(m).alias(m) for m in means]
    )
    out = grid.join(per, [*by, "k"], "left").na.fill(0.0, ["chat_speed", "unique_ratio", *means])
    before = F.lag("chat_speed", 1, 0.0).over(W.partitionBy(*by).orderBy("k"))
    return out.withColumn("chat_burst", F.greatest(F.lit(0.0), F.col("chat_speed") - before))


def moods(names: Sequence[str], least: float = 0.1) -> tuple[Column, Column]:
    """Intensity and dominant mood of score columns; the first of equals, none up to ``least``."""
    intensity = F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    mood = F.when(intensity <= least, F.lit(""))
    for n in names:
        mood = mood.when(F.col(n) == intensity, F.lit(n))
    return intensity, mood.otherwise(F.lit(""))
