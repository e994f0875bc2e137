"""Blending, staged top-k and keep-best de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1; Spark limits before it shuffles."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)


def blended(heuristic: Column, content: Column) -> Column:
    """Half-and-half blend with a rescue of strong content and a penalty for empty noise."""
    c = F.coalesce(content, F.lit(0.0))
    base = 0.5 * heuristic + 0.5 * c
    return F.when((c > 0.8) & (heuristic < 0.3), base + 0.15).when((c < 0.1) & (heuristic > 0.5), base - 0.1).otherwise(base)


def final_score(heuristic: Column, virality: Column) -> Column:
    """One part heuristic, four parts virality; the heuristic part alone where that failed."""
    return F.round(0.2 * heuristic + 0.8 * F.coalesce(virality, F.lit(0.0)), 3)


def triage_score(heuristic: Column, interest: Column) -> Column:
    """Two parts heuristic, three parts interest, which is half where unknown."""
    return 0.4 * heuristic + 0.6 * F.coalesce(interest, F.lit(0.5))


def keep_best(df: DataFrame, by: Sequence[str], score: Column, order: str) -> DataFrame:
    """The row of the largest score (null as -1) of each key, the earliest of equals."""
    return top_n(df, by, [F.coalesce(score, F.lit(-1.0)).desc(), F.col(order)], 1, "_best").drop("_best")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered list; pages start at 1 and hold 1 to 100 rows."""
    number, size = max(1, number), min(100, max(1, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """``total`` rows and ``last_page``."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / size)).cast("long").alias("last_page"))


def robust_cluster(clusters: DataFrame, by: Sequence[str], total: Column) -> DataFrame:
    """The best cluster of each key: in enough clips and of a steady size.

    ``clusters`` has ``clips, detections, spread`` (relative deviation of size) and ``area``.
    """
    valid = (F.col("clips") >= F.greatest(F.lit(2), F.ceil(total / 2))) & (F.col("spread") < 0.25)
    return top_n(clusters.filter(valid), by, [F.desc("clips"), F.desc("detections"), F.asc("area")], 1, "_best").drop("_best")


def with_clip(df: DataFrame, file: str) -> DataFrame:
    """Candidates whose clip could be cut: those with a file name."""
    return df.filter(F.coalesce(F.col(file), F.lit("")) != "")


def renumbered(words: DataFrame, kept: DataFrame, by: Sequence[str], candidate: str, rank: str) -> DataFrame:
    """Rows keyed by a candidate's number, re-keyed to its place (from 0) among those kept; others go."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(rank)) - 1
    return words.join(kept.select(*by, candidate, place.alias("place")), [*by, candidate])


def transcript(df: DataFrame, by: Sequence[str], time: str, line: Column) -> DataFrame:
    """``by, transcript``: the lines of a recording's candidates in order of time, an empty line between."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), line.alias("line"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("transcript"))


def active_signals(points: DataFrame, by: Sequence[str], signals: Sequence[str], least: float = 0.01) -> DataFrame:
    """``by, signal``: the signals that pass ``least`` in some hot point."""
    tall = points.select(*by, F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals])).alias("x"))
    return tall.select(*by, "x.*").groupBy(*by, "signal").agg(F.max("value").alias("_m")).filter(F.col("_m") > least).drop("_m")
