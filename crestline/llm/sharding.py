"""Proportional stratified interleaving: shards that all look like the whole.

Rows are shuffled by a seeded hash within each source, ranked, and given the fractional
rank ``(rank + u) / n`` with an offset ``u`` in (0, 1) drawn once a source.  Sorting
all rows by that fraction interleaves the sources in proportion, so each contiguous cut of
the order holds each source's share but for a row or two.  Everything is DataFrame code:
two passes of bucketed ranking, neither of which gathers a source in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm._common import buckets_for, ranked, uniform60

_TOP = 2.0**60


def interleaved_shards(docs: DataFrame, shards: int = 16, seed: str = "shards-1") -> DataFrame:
    """Deal all rows of ``docs`` into ``shards`` shards by the law ``rows``.

    Reads ``doc_id``, ``text`` and ``source``; other columns are ignored, whatever their
    names.  A null text counts as empty (size 1, CRC 0); null sources form a source of
    their own.  The order within a source is by a hash of id and text, so null and repeated ids
    spread like others.  Repeated rows are dealt one by one; rows equal in id and text are interchangeable.  No rows give no rows.  Shard
    counts differ by at most one row; ``slot`` has no gaps.
    """
    buckets = buckets_for(docs.count())
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_stratum"),
        uniform60(seed, F.col("doc_id"), crc).alias("_h"),
    ).withColumn("_b", F.floor(F.col("_h") / F.lit(_TOP) * buckets).cast("int"))
    tie = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    within = ranked(rows, "_b", [F.col("_h"), *tie], ["_stratum"])
    offset = (uniform60(seed, F.col("_stratum")) + F.lit(0.5)) / F.lit(_TOP)
    placed = within.withColumn("_frac", (F.col("_rank") + offset) / F.col("_total")).drop("_rank", "_total", "_b")
    placed = placed.withColumn("_b", F.least(F.floor(F.col("_frac") * buckets), F.lit(buckets - 1)).cast("int"))
    whole = ranked(placed, "_b", [F.col("_frac"), F.col("_stratum"), *tie])
    shard = F.expr(f"(_rank * {shards}) div _total")
    return whole.withColumn("_shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_rank") - F.expr(f"(_shard * _total + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.expr("CASE WHEN _stratum = 'n' THEN NULL ELSE substring(_stratum, 2) END").alias("source"),
    )
