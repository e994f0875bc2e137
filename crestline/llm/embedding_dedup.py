"""Embedding near-dedup by sorted projection passes.

Each pass concatenates hashes of a fresh set of random projections, orders all vectors
lexicographically by them and compares every vector with the neighbours in its own and the
next block of ``BLOCK`` ranks.  Verified pairs of all passes are united.

A hash is the side of a projection on which a vector lies of a cut.  The first ``DEPTH`` cuts of a pass are the
medians of the cell that the cuts before have made, the others those of the last cell, all
of them on a bounded sample; so dense regions, such as a cone around a common mean, are split as finely as
the rest.  The number of passes follows from the same sample: for every point of it and a partner
at the threshold in a random direction, the chance that no cut parts them before their block is known,
and passes are added until the mean chance to meet is ``RECALL``.

A window bounds what a pass compares, not what is linked: within every component
found, all pairs are then compared tile by tile, so groups larger than a window
lose no link.  Equal vectors are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm._common import ranked, stage
from crestline.llm._components import components, runs

THRESHOLD = 0.95
#: Ranks a block; a vector is compared with 512 to 1,023 neighbours after it.
BLOCK = 512
#: Cuts at the medians of nested cells, further cuts of a pass, and bits of the key that break ties.
DEPTH, MORE, TIE_BITS = 8, 24, 19
#: Wanted mean chance that a pair at the threshold meets in some pass.
RECALL = 0.995
#: Expected vectors of a length in the sample, and their numbers in all; points and passes that chances are taken from.
SAMPLE, SAMPLE_VALUES, POINTS, TRIALS = 16_384, 1 << 22, 1024, 8
#: Vectors of a range bucket that ranking sorts.
BUCKET = 4096
#: Vectors of a tile when the pairs of a component are compared.
TILE = 1024


def planes(size: int, turn: int, seed: int) -> np.ndarray:
    """The projections of one pass, one a column."""
    return np.random.default_rng([seed, size, turn]).standard_normal((size, DEPTH + MORE))


class Pass:
    """The cuts of one pass, from the projections of a sample."""

    def __init__(self, projected: np.ndarray):
        self.nested = np.zeros((1 << DEPTH) - 1, dtype=np.float32)
        self.last = np.zeros((1 << DEPTH, MORE), dtype=np.float32)
        cell = np.zeros(len(projected), dtype=np.int64)
        for level in range(DEPTH + 1):
            order = np.argsort(cell, kind="stable")
            edges = np.searchsorted(cell[order], np.arange((1 << level) + 1))
            for c in range(1 << level):
                own = projected[order[edges[c] : edges[c + 1]]]
                if level == DEPTH:
                    self.last[c] = np.median(own[:, DEPTH:], axis=0) if len(own) else 0
                else:
                    self.nested[(1 << level) - 1 + c] = np.median(own[:, level]) if len(own) else 0
            if level < DEPTH:
                cell = 2 * cell + (projected[:, level] > self.nested[(1 << level) - 1 + cell])

    def margins(self, projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cut that each projection is held against, and the cell."""
        cell, cuts = np.zeros(len(projected), dtype=np.int64), np.empty_like(projected)
        for level in range(DEPTH):
            cuts[:, level] = self.nested[(1 << level) - 1 + cell]
            cell = 2 * cell + (projected[:, level] > cuts[:, level])
        cuts[:, DEPTH:] = self.last[cell]
        return cuts, cell

    def keys(self, projected: np.ndarray) -> np.ndarray:
        """The concatenated hashes as integers, the first the most significant."""
        cuts, _ = self.margins(projected)
        return (projected > cuts).astype(np.int64) @ (1 << np.arange(DEPTH + MORE - 1, -1, -1, dtype=np.int64))


def passes_for(sample: np.ndarray, rows: int, seed: int, threshold: float = THRESHOLD, block: int = BLOCK, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has met with the wanted mean chance.

    ``sample`` are unit vectors of a table of ``rows``.  A partner of a vector projects to a
    normal variable around ``threshold`` times the vector's own projection.
    """
    levels = math.log2(max(rows, 1) / block)
    if levels <= 0:
        return 1
    points, apart = sample[:POINTS], math.sqrt(1 - threshold**2)
    share = np.clip(levels - np.arange(DEPTH + MORE), 0, 1)  # the last cut counts in part
    miss = np.zeros(len(points))
    for turn in range(TRIALS):
        r = planes(sample.shape[1], turn, seed)
        at = points @ r
        cuts, _ = Pass(sample @ r).margins(at)
        z = np.where(at > cuts, 1, -1) * (threshold * at - cuts) / (apart * math.sqrt(2))
        same = 0.5 * (1 + np.vectorize(math.erf)(z))
        miss += np.log1p(-np.minimum(np.exp(np.log(np.maximum(same, 1e-12)) @ share), 1 - 1e-9)) / TRIALS
    passes = 1
    while 1 - np.exp(passes * miss).mean() < recall:
        passes = passes + 1 + passes // 50
    return max(4, passes)


def _fitted(nodes: DataFrame, threshold: float, block: int, seed: int) -> dict[int, list[Pass]]:
    """The passes for every length of which there is more than one block of vectors.

    The driver holds a sample of one length at a time and some 26 KB a pass and length.
    """
    out, size = {}, F.size("embedding")
    for r in nodes.groupBy(size.alias("size")).count().filter(F.col("count") > block).collect():
        want = max(1, min(SAMPLE, SAMPLE_VALUES // r["size"]))
        spread = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(1, r["count"] // want))) == 0
        sample = nodes.filter((size == r["size"]) & spread).select("embedding").limit(2 * want).toPandas()
        if not len(sample):
            sample = nodes.filter(size == r["size"]).select("embedding").limit(want).toPandas()
        x = _unit(sample["embedding"])
        passes = passes_for(x, r["count"], seed, threshold, block)
        out[r["size"]] = [Pass(x @ planes(r["size"], turn, seed)) for turn in range(passes)]
    return out


def _keys(fitted: dict[int, list[Pass]], session, seed: int):
    """Pandas UDF: the ranking key of every pass, as non-negative longs; lengths within one block have one pass."""
    shared = session.sparkContext.broadcast(fitted)

    @F.pandas_udf("array<long>")
    def keys(vectors: pd.Series, tie: pd.Series) -> pd.Series:
        sizes, out = vectors.map(len).to_numpy(), np.empty(len(vectors), dtype=object)
        for size in np.unique(sizes):
            at, passes = np.flatnonzero(sizes == size), shared.value.get(int(size), [])
            low, found = tie.to_numpy(np.int64)[at] & ((1 << TIE_BITS) - 1), np.zeros((len(at), max(1, len(passes))), dtype=np.int64)
            x = _unit(vectors.iloc[at]) if passes else None
            for turn, p in enumerate(passes):
                found[:, turn] = p.keys(x @ planes(int(size), turn, seed))
            out[at] = list((found << TIE_BITS) | low[:, None])
        return pd.Series(out)

    return keys


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a symmetric boolean matrix."""
    unseen, out = np.ones(len(near), dtype=bool), []
    for root in range(len(near)):
        if not unseen[root]:
            continue
        unseen[root], front = False, np.array([root])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & unseen)
            unseen[front] = False
            out += [(root, int(x)) for x in front]
    return out


def projection_links(nodes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """Verified links ``a, b`` that connect what the passes find.

    ``nodes`` has ``node`` (string, distinct) and ``embedding`` (finite, not zero).
    """
    tie = F.pmod(F.xxhash64("node"), F.lit(1 << TIE_BITS))
    of = _keys(_fitted(nodes, threshold, block, seed), nodes.sparkSession, seed)
    keyed = stage(nodes.withColumn("k", of("embedding", tie)).select("node", F.size("embedding").alias("dim"), F.posexplode("k").alias("pass", "key")))
    bits = min(30, max(0, math.ceil(math.log2(max(1, nodes.count()) / BUCKET))))
    dealt = keyed.withColumn("_b", F.shiftright("key", DEPTH + MORE + TIE_BITS - bits).cast("int"))
    ordered = ranked(dealt, "_b", [F.col("key"), F.col("node")], ["pass", "dim"])
    blocks = ordered.select("node", "pass", "dim", F.expr(f"_rank div {block}").cast("int").alias("block"))
    at = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("block").alias("block")), F.struct(F.lit(1).alias("side"), (F.col("block") - 1).alias("block"))))
    windows = blocks.select("node", "pass", "dim", at.alias("w")).select("node", "pass", "dim", "w.block", "w.side").filter("block >= 0")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x = _unit(group["embedding"])
        near = x @ x.T >= threshold
        far = group["side"].to_numpy() == 1
        near[np.ix_(far, far)] = False  # compared in their own block
        name = group["node"].to_numpy()
        links = [(name[i], name[j]) for i, j in _forest(near)]
        return pd.DataFrame(links, columns=["a", "b"])

    return windows.join(nodes, "node").groupBy("pass", "dim", "block").applyInPandas(compare, "a string, b string").distinct()


def count_links(members: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``node, linked``: the rows that each node links to, comparing all pairs of its component.

    ``members`` has ``node``, ``root``, ``embedding``, ``n`` (rows with that vector) and
    ``size`` (nodes of the component).  A component over ``tile`` nodes is split in pairs of chunks.
    """
    m = F.ceil(F.col("size") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), m).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
    keys = ["root", "i", "j"]
    tiles = members.withColumn("c", own).withColumn("p", F.explode(pairs)).select("node", "embedding", "n", "c", "root", "p.i", "p.j")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, edges in runs(batches, keys):
            x, n, linked = _unit(frame["embedding"]), frame["n"].to_numpy(np.int64), np.zeros(len(frame), dtype=np.int64)
            c, i, j = (frame[k].to_numpy() for k in ("c", "i", "j"))
            for a, b in zip(edges, edges[1:], strict=False):
                near = x[a:b] @ x[a:b].T >= threshold
                np.fill_diagonal(near, False)
                if i[a] != j[a]:
                    near &= c[a:b, None] != c[None, a:b]
                linked[a:b] = near @ n[a:b]
            yield pd.DataFrame({"node": frame["node"].to_numpy(), "linked": linked})

    dealt = tiles.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(count, "node string, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id``, ``embedding``).

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing and are their own component; so do vectors of different lengths among each other.  Repeated
    rows count as rows.  A null ``vec_id`` links but never names a component.  Other
    columns are ignored.
    """
    v = F.col("embedding")
    sound = F.coalesce(
        v.isNotNull()
        & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select("vec_id", "embedding").withColumn("node", F.when(sound, F.md5(v.cast("string"))))
    good = rows.filter(F.col("node").isNotNull())
    nodes = stage(
        good.groupBy("node").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    )
    found = components(projection_links(nodes.select("node", "embedding"), threshold))
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = found.join(sizes, "root").join(nodes, "node")
    linked = count_links(members.select("node", "root", "embedding", "n", "size"), threshold)
    least = found.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.join(least, "root").select("node", "component_id")
    facts = (
        nodes.select("node", "least", "n")
        .join(named, "node", "left")
        .join(linked, "node", "left")
        .select(
            "node",
            F.coalesce("component_id", "least").alias("component_id"),
            (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        )
    )
    told = good.select("vec_id", "node").join(facts, "node")
    alone = rows.filter(F.col("node").isNull()).select("vec_id", F.col("vec_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return told.drop("node").select("vec_id", "component_id", "n_links").unionByName(alone).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
