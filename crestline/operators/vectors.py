"""Vectors, clusters and speakers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.operators.greedy import cut_lineage


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.try_divide(dot(a, b), norm)).otherwise(F.lit(0.0))


def speaker_totals(turns: DataFrame, by: Sequence[str], speaker: str, start: str, end: str) -> DataFrame:
    """Seconds, turns and share of each speaker, and whether it speaks most."""
    per = turns.groupBy(*by, speaker).agg(F.sum(F.col(end) - F.col(start)).alias("seconds"), F.count(F.lit(1)).alias("turns"))
    whole = W.partitionBy(*by)
    rank = F.row_number().over(whole.orderBy(F.desc("seconds"), speaker))
    return per.withColumn("share", F.try_divide("seconds", F.sum("seconds").over(whole))).withColumn("dominant", rank == 1)


#: References, and vectors, that a task holds at a time.
REFERENCE_BLOCK, VECTOR_BLOCK = 4096, 16_384


def _most_similar(x: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest cosine of each row of ``x`` to a row of ``refs``, rounded to 9 places, and that row: the last of equals."""
    norm, own = np.linalg.norm(refs, axis=1), np.linalg.norm(x, axis=1)
    similar = np.round((x / np.where(own > 0, own, 1)[:, None]) @ (refs / np.where(norm > 0, norm, 1)[:, None]).T, 9)
    at = similar.shape[1] - 1 - similar[:, ::-1].argmax(axis=1)
    return similar[np.arange(len(x)), at], at


def reference_match(
    vectors: DataFrame, references: DataFrame, by: str, vector: str, name: str, least: float = 0.55, block: int = REFERENCE_BLOCK, rows: int = VECTOR_BLOCK
) -> DataFrame:
    """Every vector with the most similar reference, the last by name of equals; its name if similar enough.

    Vectors are dealt to blocks of some ``rows``, references to blocks of some ``block``, and each pair of blocks meets in a task, which
    gives the best reference of each vector there; the best of these is a plain aggregate.  So a task holds two
    blocks, the driver none, and the only sizes counted are the two tables'.  Vectors and references must be of one
    length; zero vectors have similarity 0.  Rows are told apart, also where ``by`` repeats.
    """
    known = vectors.select(F.monotonically_increasing_id().alias("_row"), F.col(by).alias("_by"), F.col(vector).cast("array<double>").alias("_v"))
    known = cut_lineage(known)
    many, few = max(1, -(-known.count() // rows)), max(1, -(-references.count() // block))
    kind = references.schema[name].dataType
    named = references.select(F.col(name).cast("string").alias("_n"), F.col(vector).cast("array<double>").alias("_w"))
    left = known.withColumns({"_i": F.pmod(F.xxhash64("_row"), F.lit(many)), "_j": F.explode(F.sequence(F.lit(0), F.lit(few - 1)))})
    right = named.withColumns({"_j": F.pmod(F.xxhash64("_n"), F.lit(few)).cast("int"), "_i": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))})

    def meet(key: tuple, own: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(refs):
            return pd.DataFrame({"_row": np.zeros(0, dtype=np.int64), "s": np.zeros(0), "n": np.zeros(0, dtype=str)})
        refs = refs.sort_values("_n", kind="stable")
        similar, at = _most_similar(np.stack(own["_v"].to_numpy()).astype(float), np.stack(refs["_w"].to_numpy()).astype(float))
        return pd.DataFrame({"_row": own["_row"].to_numpy(), "s": similar, "n": refs["_n"].to_numpy()[at]})

    pairs = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(meet, "_row long, s double, n string")
    best = pairs.groupBy("_row").agg(F.max(F.struct("s", "n")).alias("_b"))
    told = known.select("_row", "_by").join(best, "_row", "left")
    nearest = F.col("_b.n").cast(kind)
    return told.select(F.col("_by").alias(by), nearest.alias("nearest"), F.col("_b.s").alias("similarity"), F.when(F.col("_b.s") >= least, nearest).alias(name))


def merge_similar(speakers: DataFrame, by: str, name: str, vector: str, seconds: str, least: float = 0.75) -> DataFrame:
    """``by, name, merged``: in each clip, similar speakers become the one that speaks longest.

    Similarity is transitive.  Clips have few speakers; each is one group.
    """

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values([seconds, name], ascending=[False, True], kind="stable").reset_index(drop=True)
        x = np.stack(g[vector].to_numpy()).astype(float)
        n = np.linalg.norm(x, axis=1)
        sim = (x @ x.T) / np.where(n > 0, n, 1)[:, None] / np.where(n > 0, n, 1)[None, :]
        owner = np.full(len(g), -1)
        for i in range(len(g)):
            front = [i] if owner[i] < 0 else []
            while front:
                k = front.pop()
                if owner[k] < 0:
                    owner[k] = i
                    front += [j for j in np.flatnonzero(sim[k] >= least) if owner[j] < 0]
        return pd.DataFrame({by: g[by], name: g[name], "merged": g[name].to_numpy()[owner]})

    kinds = {f.name: f.dataType.simpleString() for f in speakers.schema.fields}
    return speakers.groupBy(by).applyInPandas(merge, f"{by} {kinds[by]}, {name} {kinds[name]}, merged {kinds[name]}")


def voice_sample(turns: DataFrame, by: Sequence[str], speaker: str, start: str, end: str, first: float = 120.0, want: float = 30.0, need: float = 3.0) -> DataFrame:
    """Turns of the speaker who dominates the first ``first`` seconds, until ``want`` seconds are gathered.

    Clips with under ``need`` seconds of it give none.
    """
    early = turns.filter(F.col(start) < first).withColumn(end, F.least(F.col(end), F.lit(first)))
    top = speaker_totals(early, by, speaker, start, end).filter("dominant").select(*by, speaker)
    own = early.join(top, [*by, speaker]).withColumn("_len", F.col(end) - F.col(start))
    ahead = F.sum("_len").over(W.partitionBy(*by).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))
    cut = own.withColumn("_ahead", F.coalesce(ahead, F.lit(0.0))).filter(F.col("_ahead") < want)
    total = F.sum("_len").over(W.partitionBy(*by))
    return cut.withColumn("_total", total).filter(F.col("_total") >= need).select(*by, speaker, start, end)


def leader_clusters(boxes: DataFrame, by: str, order: str, x: str, y: str, radius: str) -> DataFrame:
    """Assign each box, in order, to the first cluster whose mean centre is within its radius."""

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        g, sums, out = group.sort_values(order, kind="stable"), [], []
        for px, py, r in zip(g[x], g[y], g[radius], strict=True):
            for c, (sx, sy, n) in enumerate(sums):
                if np.hypot(px - sx / n, py - sy / n) <= r:
                    sums[c] = (sx + px, sy + py, n + 1)
                    break
            else:
                c = len(sums)
                sums.append((px, py, 1))
            out.append(c)
        return g.assign(cluster=out)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema.fields)
    return boxes.groupBy(by).applyInPandas(assign, f"{kinds}, cluster int")


def box_from_points(points: Column, least: float = 0.5, grow: float = 1.6) -> Column:
    """Square around the visible points (``x, y, v``), null with fewer than two."""
    seen = F.filter(points, lambda p: p["v"] > least)
    xs, ys = F.transform(seen, lambda p: p["x"]), F.transform(seen, lambda p: p["y"])
    side = grow * F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    cx, cy = (F.array_max(xs) + F.array_min(xs)) / 2, (F.array_max(ys) + F.array_min(ys)) / 2
    return F.when(F.size(seen) >= 2, F.struct((cx - side / 2).alias("x"), (cy - side / 2).alias("y"), side.alias("side")))


def median_box(boxes: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Median of each coordinate."""
    return boxes.groupBy(*by).agg(*[F.median(c).alias(c) for c in columns])


def envelope(df: DataFrame, by: Sequence[str], index: str, value: str, blocks: int) -> DataFrame:
    """Largest magnitude in each of ``blocks`` equal blocks of a series."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / blocks))
    cut = df.withColumn("_n", n).withColumn("block", F.floor(F.col(index) / size).cast("int")).filter(F.col("block") < blocks)
    return cut.groupBy(*by, "block").agg(F.max(F.abs(value)).alias("peak"))


def dominant_colour(pixels: DataFrame, by: str, rgb: Sequence[str] = ("r", "g", "b"), clusters: int = 5, rounds: int = 10, seed: int = 5) -> DataFrame:
    """``by, r, g, b``: the centre of the largest of ``clusters`` groups of a clip's pixels, lifted if it is dark.

    Pixels are some thousand sampled from a few small frames, so one clip is one bounded group.  A centre
    with a mean under 40 is raised to at least 60, 60 and 100.
    """
    kind = pixels.schema[by].dataType.simpleString()

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        x = group[list(rgb)].to_numpy(float)
        x, times = np.unique(x, axis=0, return_counts=True)
        rng, centres = np.random.default_rng(seed), x[[times.argmax()]]
        while len(centres) < min(clusters, len(x)):  # k-means++: far pixels first
            far = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1) * times
            centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
        for _ in range(rounds):
            own = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            for k in np.unique(own):
                centres[k] = np.average(x[own == k], axis=0, weights=times[own == k])
        own = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        r, g, b = centres[np.bincount(own, weights=times).argmax()].astype(int)
        if (r + g + b) / 3 < 40:
            r, g, b = max(r, 60), max(g, 60), max(b, 100)
        return pd.DataFrame({by: [group[by].iloc[0]], "r": [r], "g": [g], "b": [b]})

    return pixels.select(by, *rgb).groupBy(by).applyInPandas(pick, f"{by} {kind}, r int, g int, b int")
