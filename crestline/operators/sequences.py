"""Grouping of ordered words: by speaker, into chunks and into sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.operators.greedy import follow, left_join, placed

#: Entries of a list that leave a task at once.
SLICE = 1 << 15


def consecutive_groups(df: DataFrame, by: Sequence[str], order: str, value: str, name: str = "grp") -> DataFrame:
    """Number, from 0, the stretches of rows with the same value; nulls are equal."""
    w = W.partitionBy(*by).orderBy(order)
    fresh = F.when(F.row_number().over(w) == 1, 0).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("_f", fresh).withColumn(name, F.sum("_f").over(w)).drop("_f")


def lines_by_speaker(df: DataFrame, by: Sequence[str], order: str, speaker: str, text: str) -> DataFrame:
    """One line for each stretch of words of one speaker, words in order."""
    grouped = consecutive_groups(df, by, order, speaker)
    words = F.array_sort(F.collect_list(F.struct(order, text)))
    return grouped.groupBy(*by, "grp", speaker).agg(words.alias("_w")).select(*by, "grp", speaker, F.array_join(F.transform("_w", lambda x: x[text]), " ").alias("line"))


def chunk_words(
    df: DataFrame, by: str, order: str, start: str, end: str, most: int = 4, longest: float = 3.0, speaker: str | None = None, part: int = 4096
) -> DataFrame:
    """Number the subtitle chunks: up to ``most`` words and ``longest`` seconds each, one speaker.

    A word that would make its chunk too long opens the next one.  Which word that is follows from the ``most``
    words after a chunk's first alone, so every word knows the one that would open the next chunk, and
    :func:`crestline.operators.greedy.follow` walks from opening to opening.  ``order`` is a number without ties or nulls in a key;
    stretches of ``part`` places, each with the next ``most`` words as a halo, are windows of their own.
    """
    # A key in a struct is never null, so joins and windows by it find rows where they lie.
    who = [F.col(speaker).alias("_who")] if speaker else []
    rows = df.select(F.struct(*df.columns).alias("_row"), F.struct(F.col(by).alias("k")).alias("_by"), F.coalesce(F.floor(F.col(order) / part), F.lit(0)).alias("_part"), F.col(order).alias("_o"))
    rows = placed(rows, ["_by"], "_part", ["_o"])
    block = F.floor(F.col("_place") / part)
    halo = F.when(F.col("_place") % part < most, F.array(block, block - 1)).otherwise(F.array(block))
    w = W.partitionBy("_by", "_in").orderBy("_place")
    opener = F.lead("_place", most).over(w)
    for k in range(most - 1, 0, -1):
        moved = F.coalesce(F.lead("_e", k).over(w) - F.col("_s") > longest, F.lit(False))
        if speaker:
            moved = moved | ~F.lead("_who", k).over(w).eqNullSafe(F.col("_who"))
        there = F.lead("_place", k).over(w)
        opener = F.when(there.isNotNull() & moved, there).otherwise(opener)
    times = [F.col(f"_row.{start}").alias("_s"), F.col(f"_row.{end}").alias("_e"), *([F.col(f"_row.{speaker}").alias("_who")] if who else [])]
    links = rows.select("_by", "_place", *times, F.explode(halo).alias("_in")).withColumn("_next", opener)
    opened = follow(links.filter(block == F.col("_in")), ["_by"], "_place", "_next").withColumn("_opens", F.lit(1))
    marked = left_join(rows.select("_row", "_by", "_place"), opened, ["_by", "_place"]).withColumn("_block", F.coalesce(block, F.lit(0)))
    per = marked.groupBy("_by", "_block").agg(F.count("_opens").alias("_n"))
    earlier = W.partitionBy("_by").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = per.select("_by", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    here = F.count("_opens").over(W.partitionBy("_by", "_block").orderBy("_place"))
    numbered = left_join(marked.withColumn("_here", here), before, ["_by", "_block"])
    return numbered.select("_row.*", (F.col("_before") + F.col("_here") - 1).cast("int").alias("chunk"))


def ends_sentence(text: str | Column) -> Column:
    """Whether a word ends with ``.``, ``!``, ``?`` or an ellipsis."""
    return F.coalesce(F.rtrim(text).rlike(r"[.!?…]$"), F.lit(False))


def sentence_groups(df: DataFrame, by: str, order: str, text: str, most: int = 10) -> DataFrame:
    """Number the sentences: each ends with ``.``, ``!``, ``?`` or an ellipsis, or after ``most`` words."""
    w = W.partitionBy(by).orderBy(order)
    ends = ends_sentence(text).cast("int")
    marked = df.withColumn("_stretch", F.coalesce(F.sum(ends).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy(by, "_stretch").orderBy(order)) - 1
    opens = marked.withColumn("_opens", (place % most == 0).cast("int"))
    return opens.withColumn("sentence", (F.sum("_opens").over(w) - 1).cast("int")).drop("_stretch", "_opens")


def _numbered_lists(df: DataFrame, by: Sequence[str], lists: Sequence[str], number: Callable[..., np.ndarray], name: str) -> DataFrame:
    """A row for each entry of a row's lists: ``by``, its place ``ord`` and the number that ``number`` gives it.

    A row's lists lie in that row, so nothing is shuffled; results leave in slices of ``SLICE`` entries.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                values = [batch.column(c)[r].values for c in lists]
                if values[0] is None or not len(values[0]):
                    continue
                found = pa.array(number(*[v.to_numpy(zero_copy_only=False) for v in values]), pa.int32())
                for a in range(0, len(found), SLICE):
                    part = found[a : a + SLICE]
                    keys = [pa.repeat(batch.column(c)[r], len(part)) for c in by]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(a, a + len(part), dtype=np.int32)), part], names=[*by, "ord", name])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return df.select(*by, *lists).mapInArrow(read, f"{kinds}, ord int, {name} int")


def chunk_lists(df: DataFrame, by: Sequence[str], start: str, end: str, most: int = 4, longest: float = 3.0) -> DataFrame:
    """As :func:`chunk_words` for rows that hold the ``start`` and ``end`` of all their words as lists in order: ``by, ord, chunk``."""

    def number(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        n = len(s)
        opener = np.minimum(np.arange(n) + most, n)
        for k in range(min(most, n) - 1, 0, -1):
            moved = np.flatnonzero(e[k:] - s[: n - k] > longest)
            opener[moved] = moved + k
        opens, to, at = np.zeros(n, dtype=np.int32), opener.tolist(), 0
        while at < n:
            opens[at] = 1
            at = to[at]
        return np.cumsum(opens, dtype=np.int32) - 1

    return _numbered_lists(df, by, [start, end], number, "chunk")


def sentence_lists(df: DataFrame, by: Sequence[str], ends: str, most: int = 10) -> DataFrame:
    """As :func:`sentence_groups` for rows that hold, as a list in order, whether each of their words ends a sentence: ``by, ord, sentence``."""

    def number(last: np.ndarray) -> np.ndarray:
        fresh = np.concatenate([[True], last[:-1].astype(bool)])
        place = np.arange(len(last))
        place -= np.maximum.accumulate(np.where(fresh, place, 0))
        return np.cumsum(place % most == 0, dtype=np.int32) - 1

    return _numbered_lists(df, by, [ends], number, "sentence")


def appearance_index(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """``by, value, idx``: distinct values numbered from 0 by first appearance."""
    first = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(order).alias("_o"))
    return first.select(*by, value, (F.row_number().over(W.partitionBy(*by).orderBy("_o")) - 1).alias("idx"))


def active_chunk(
    moments: DataFrame, chunks: DataFrame, by: Sequence[str], now: str, start: str, end: str, order: str, slack: float = 0.05, width: float = 10.0
) -> DataFrame:
    """The first chunk on screen at each moment: ``start - slack <= now <= end + slack``."""
    from crestline.operators.align import points_in_intervals

    loose = chunks.withColumns({"_s": F.col(start) - slack, "_e": F.col(end) + slack})
    hits = points_in_intervals(moments.select(*by, now).distinct(), loose, by, now, "_s", "_e", width)
    return hits.groupBy(*by, now).agg(F.min(order).alias(order))


def subtitle_lines(chunks: DataFrame, by: Sequence[str], start: str, end: str, text: str) -> DataFrame:
    """One subtitle event line for each chunk."""
    from crestline.functions.scalars import clock_centis

    line = F.concat_ws(",", F.lit("Dialogue: 0"), clock_centis(F.col(start)), clock_centis(F.col(end)), F.lit("Default"), F.lit(""), F.lit("0"), F.lit("0"), F.lit("0"), F.lit(""), F.regexp_replace(text, "\n", r"\\N"))
    return chunks.select(*by, start, line.alias("value"))


def not_hidden(speaker: Column, hidden: Sequence[str]) -> Column:
    """Rows without a speaker, or whose speaker is not hidden."""
    return speaker.isNull() | ~speaker.isin(list(hidden))
