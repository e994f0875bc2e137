"""Greedy rules over ordered rows, followed exactly and in parallel.

Many rules read rows in order and hold on to the last row taken: keep a moment if it is an
hour after the last one kept, open a chunk when the present one is full.  Where a row's *successor*, the next row that would be
taken if this one is, depends on the row's place alone, the rows taken are those on the walk from
the first row along the successors.  :func:`follow` finds them without reading a key in one piece:

1. Places are cut into blocks.  Inside its block every row learns, by pointer doubling, where a walk through it
   leaves the block.  Only rows that some link from another block points to can be entered, so these
   alone go on, each linked to where it leaves: a table shorter by the ratio of a block to a link's reach.
2. That table is contracted again, with wider blocks, until every key is short, and the walk over it is made.
3. On the way back each block is told its one entry and walks from there.

Every step is a shuffle on (key, block); no task holds more than a block, and the walks hold one row.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Places a block spans at first, and rows that one task walks at the top.
BLOCK = 1 << 14
TOP = 1 << 14
#: A place after all others.
_END = 1 << 62


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder that the session names; a local session without one takes a temporary folder."""
    spark = df.sparkSession
    conf = spark.sparkContext.getConf()
    shared, master = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir(), conf.get("spark.master", "")
    if not shared:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(shared)
    path = f"{shared.rstrip('/')}/crestline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hops(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted places, their successors, and the row that each links to in this block (itself, if none)."""
    order = np.argsort(nodes["_at"].to_numpy(), kind="stable")
    at, to = nodes["_at"].to_numpy()[order], nodes["_to"].to_numpy()[order]
    hop = np.minimum(np.searchsorted(at, to), len(at) - 1)
    return at, to, np.where(at[hop] == to, hop, np.arange(len(at)))


def _exits(key, nodes: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    out = entries.copy()
    if len(nodes) and len(entries):
        at, to, hop = _hops(nodes)
        while (further := hop[hop]).tolist() != hop.tolist():
            hop = further
        out["_to"] = to[hop[np.searchsorted(at, entries["_at"].to_numpy())]]
    else:
        out["_to"] = np.zeros(len(out), dtype=np.int64)
    return out


def _walk(rows: DataFrame, keys: Sequence[str], entry: Column) -> DataFrame:
    """The rows that a walk visits which enters each group of ``keys`` at the row where ``entry`` holds.

    In the order of places, the next row visited is the one whose place the last one named: a single pass, whatever the groups.
    """
    w = W.partitionBy(*keys).orderBy("_at")
    marked = rows.withColumns({"_top": F.row_number().over(w) == 1, "_in": entry})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None
        for batch in batches:
            seen = []
            for at, to, top, enters in zip(*(batch.column(c).to_pylist() for c in ("_at", "_to", "_top", "_in")), strict=True):
                if top:
                    wanted = None
                if enters:
                    wanted = at
                seen.append(at == wanted)
                if at == wanted:
                    wanted = to
            yield batch.filter(pa.array(seen, pa.bool_()))

    return marked.mapInArrow(read, marked.schema).select(*rows.columns)


def follow(links: DataFrame, by: Sequence[str], place: str, successor: str, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """``by, place`` of the rows on the walk from each key's first row along the successors.

    ``place`` is a whole number, unique in its key; ``successor`` the place of a later row of the key, or null at
    the end of a walk.  Keys of up to ``top`` rows are walked at once.  In others a block takes the rows of ``block`` places;
    where links reach so far that blocks of this width do not shorten the table, wider ones are taken.
    """
    by = list(by)
    level = cut_lineage(links.select(*by, F.col(place).cast("long").alias("_at"), F.coalesce(F.col(successor).cast("long"), F.lit(_END)).alias("_to")))
    sizes = level.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_start"))
    far = cut_lineage(sizes.filter(F.col("_rows") > top))
    first = F.row_number().over(W.partitionBy(*by).orderBy("_at")) == 1
    if not far.take(1):
        return _walk(level, by, first).select(*by, F.col("_at").alias(place))
    told = left_join(level, far, by)
    short, level = told.filter(F.col("_rows").isNull()).select(*level.columns), told.filter(F.col("_rows").isNotNull()).select(*level.columns)
    starts = far.select(*by, F.col("_start").alias("_at"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema.fields if f.name in by)

    def of_block(column: str, width: int) -> Column:
        return F.floor(F.col(column) / width).alias("_block")

    level = cut_lineage(level)
    levels, width, rows, size = [], block, level.count(), top + 1
    while size > top:
        crossing = level.filter((F.col("_to") < _END) & (of_block("_to", width) != of_block("_at", width)))
        entries = crossing.select(*by, F.col("_to").alias("_at")).union(starts).distinct().select("*", of_block("_at", width))
        nodes = level.select("*", of_block("_at", width))
        pairs = nodes.groupBy(*by, "_block").cogroup(entries.groupBy(*by, "_block"))
        shorter = cut_lineage(pairs.applyInPandas(_exits, f"{kinds}, _at long, _block long, _to long").drop("_block").select(*by, "_at", "_to"))
        fewer, size = shorter.count(), shorter.groupBy(*by).count().agg(F.max("count")).first()[0]
        if fewer <= rows // 2 or size <= top:
            levels.append((level, width))
            level, rows = shorter, fewer
        width *= 8
    seen = _walk(level, by, first).select(*by, "_at")
    for level, width in reversed(levels):
        told = left_join(level, seen.withColumn("_seen", F.lit(True)), [*by, "_at"])
        seen = _walk(told.select("*", of_block("_at", width)), [*by, "_block"], F.col("_seen").isNotNull()).select(*by, "_at")
    return seen.union(_walk(short, by, first).select(*by, "_at")).select(*by, F.col("_at").alias(place))


def placed(df: DataFrame, by: Sequence[str], part: str, order: Sequence[str | Column], name: str = "_place") -> DataFrame:
    """Number the rows of each key from 0 in the order of ``part, order``, a (key, part) at a time.

    Only the table of the parts' sizes is scanned in order.
    """
    w = W.partitionBy(*by, part).orderBy(*order)
    sizes = df.groupBy(*by, part).agg(F.count(F.lit(1)).alias("_rows"))
    ahead = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, part, F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"))
    numbered = df.withColumn(name, F.row_number().over(w) - 1)
    joined = left_join(numbered, offsets, [*by, part])
    return joined.withColumn(name, (F.col(name) + F.col("_ahead")).cast("long")).drop("_ahead")


def left_join(df: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys``, nulls equal, that adds the other columns of ``facts``.

    Columns that cannot be null are compared as they are, so a join finds the rows where a window by the same keys left them.
    """
    right = facts.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        mine, other = F.col(k), F.col(f"_key_{i}")
        same = same & (mine.eqNullSafe(other) if df.schema[k].nullable else mine == other)
    return df.join(right, same, "left").drop(*[f"_key_{i}" for i in range(len(keys))])
