"""Connected components of a link table, and run-wise processing of sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm._common import stage, unstage

#: Links that one task settles at the end: two nodes a row, so some megabytes at any size of the input.
TAIL = 1 << 18
#: Links that a task gathers before it reduces them to a forest.
FLUSH = 1 << 20


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for links between the nodes 0 to ``n - 1``."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def forest(links: pd.DataFrame) -> pd.DataFrame:
    """``a, b``: each node of ``links`` that is not the smallest of its component, with the smallest."""
    codes, nodes = pd.factorize(pd.concat([links["a"], links["b"]], ignore_index=True), sort=True)
    root = roots(codes[: len(links)], codes[len(links) :], len(nodes))
    at = np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({"a": np.asarray(nodes)[at], "b": np.asarray(nodes)[root[at]]})


def _forests(links: DataFrame) -> DataFrame:
    """Every partition's ``links`` reduced to at most one link a node."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size > FLUSH:
                held = [forest(pd.concat(held, ignore_index=True))]
                size = len(held[0])
                if size > FLUSH // 2:
                    yield held[0]
                    held, size = [], 0
        if size:
            yield forest(pd.concat(held, ignore_index=True))

    return links.mapInPandas(reduce, links.schema)


def _settled(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of at most ``TAIL`` links, in one task."""

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if sum(map(len, held)):
            found = forest(pd.concat(held, ignore_index=True)).rename(columns={"a": "node", "b": "root"})
            tops = found["root"].unique()
            yield pd.concat([found, pd.DataFrame({"node": tops, "root": tops})], ignore_index=True)

    kind = links.schema["a"].dataType.simpleString()
    return links.coalesce(1).mapInPandas(settle, f"node {kind}, root {kind}")


def components(links: DataFrame, tail: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``; loops are ignored).

    Each partition first reduces its own links to a forest.  While more than ``tail`` links
    are left, a round maps every node to the first of its neighbours and itself, contracts the
    links to the images and reduces them again; the order is the nodes' own in even
    rounds, which settles stars around a smallest node, and a fresh hash order in odd ones,
    which shortens any chain by a constant factor.  One task settles the rest.  A ``root`` is some node
    of the component.  Every round is written to the shared folder; hot nodes are split by the skew join
    of adaptive execution.
    """
    tail = TAIL if tail is None else tail
    links = stage(_forests(links.select("a", "b").filter("a <> b")))
    named: list[DataFrame] = []
    while links.count() > tail:
        turn = len(named)
        both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("x")), F.struct(F.col("b").alias("node"), F.col("a").alias("x"))))
        order = (lambda c: F.struct(F.col(c).alias("x"))) if turn % 2 == 0 else (lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("x")))
        first = links.select(both.alias("l")).select("l.*").groupBy("node").agg(F.min(order("x")).alias("f"))
        names = stage(first.select("node", F.least("f", order("node")).getField("x").alias("to")))
        left, right = (names.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        moved = links.join(left, "a").join(right, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        old, links = links, stage(_forests(moved.filter("a <> b")))
        unstage(old)
        named.append(names)
    label = stage(_settled(links))
    unstage(links)
    for names in reversed(named):
        later = label.select(F.col("node").alias("to"), "root")
        label = names.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    if named:
        label = stage(label)
        for names in named:
            unstage(names)
    return label


def split_buckets(keyed: DataFrame, keys: list[str], item: str, chunk: int, may_split: bool = True) -> tuple[DataFrame, list[str]]:
    """``keyed`` with buckets (``keys``) of over ``chunk`` items split into all pairs of chunks, and the columns that deal it out.

    Any two items of a bucket meet in a pair of its chunks; an ``item`` is a column, ``c`` becomes its own chunk.
    Without a large bucket (``may_split`` says that there can be one) the rows stay as they are.
    """
    if not may_split:
        return keyed, keys
    large = stage(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk))
    if not large.take(1):
        return keyed, keys
    large = large.select(*keys, F.ceil(F.col("_n") / chunk).cast("int").alias("_m"))
    own = F.pmod(F.xxhash64(item), F.col("_m")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    split = keyed.join(large, keys, "left").withColumn("_p", F.explode(F.when(F.col("_m").isNotNull(), pair).otherwise(whole)))
    return split.select(*keyed.columns, "_p.i", "_p.j", F.coalesce(own, F.lit(0)).alias("c")), [*keys, "i", "j"]


def runs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole runs of equal ``keys`` from the batches of a sorted partition.

    Yields frames and the edges of their runs: the rows from one edge to the next.
    """
    carry = None
    for batch in batches:
        if not len(batch):
            continue
        frame = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
        change = np.zeros(len(frame) - 1, dtype=bool)
        for k in keys:
            v = frame[k].to_numpy()
            change |= v[1:] != v[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1])
        if edges[-1]:
            yield frame.iloc[: edges[-1]], edges
        carry = frame.iloc[edges[-1] :]
    if carry is not None and len(carry):
        yield carry, np.array([0, len(carry)])
