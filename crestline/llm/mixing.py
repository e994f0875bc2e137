"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its share of tokens to the power ``alpha``, normalised.  The
exponent is bisected: the flattest mix whose entropy does not pass the target and that
repeats no source more often than the limit.  The budget is the smallest at which every
source is read at least once, so nothing is dropped; a source of more weight is
read several times, each time in a fresh seeded permutation, the last time as far as its
budget goes.  Cutting every source's stream into the same number of blocks and
shuffling each block gives blocks that all have the target weights.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm._common import attach, buckets_for, ranked, spare, stage, uniform60

#: Target entropy: this share of the way from the natural mix to the uniform one.
EVENNESS = 0.5
#: Most often a source may be repeated.
MAX_EPOCHS = 2.0
#: Tokens of a block.
BLOCK_TOKENS = 1 << 17
_TOP = 2.0**60
#: Points a bisection step looks at together, and steps: 16 ** 8 cells of the unit interval.
_POINTS, _STEPS = 15, 8


def token_count(text):
    """Tokens of a text column: its words, runs of anything but white space; at least 1."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")), F.lit(1)).cast("long")


def _body():
    """A text's CRC-32: with the id it tells rows apart in hashes."""
    return F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))


def _stratum():
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def temperature(sources: DataFrame, evenness: float, max_epochs: float) -> float:
    """The exponent, rounded to 6 decimals, for a table of sources (``tokens``).

    Both limits loosen as the exponent grows, so bisection applies: every step takes
    one aggregate over the table, and only its sums reach the driver.
    """
    total, n, natural = sources.agg(F.sum("tokens"), F.count(F.lit(1)), F.sum(F.col("tokens") * F.log("tokens"))).first()
    if not n or not total:
        return 1.0
    natural = math.log(total) - natural / total
    target = natural + evenness * (math.log(n) - natural)
    q = F.col("tokens") / F.lit(float(total))

    def held(sums, a: float) -> bool:
        z, qlog, least, most = sums
        entropy = math.log(z) - a * qlog / z
        epochs = (least / most) ** (a - 1)
        return entropy <= target + 1e-12 and epochs <= max_epochs + 1e-12

    low, high = 0.0, 1.0
    for _ in range(_STEPS):
        points = [low + (high - low) * i / (_POINTS + 1) for i in range(_POINTS + 2)]
        sums = sources.agg(
            F.min(q), F.max(q), *[F.sum(x) for a in points for x in (F.pow(q, F.lit(a)), F.pow(q, F.lit(a)) * F.log(q))]
        ).first()
        fits = [held((sums[2 + 2 * i], sums[3 + 2 * i], sums[0], sums[1]), a) for i, a in enumerate(points)]
        first = fits.index(True) if True in fits else len(points) - 1
        if first == 0:
            return round(points[0], 6)
        low, high = points[first - 1], points[first]
    return round(high, 6)


def source_plan(docs: DataFrame, evenness: float = EVENNESS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row a source: ``_stratum, tokens, rows, weight, quota`` (tokens to read).

    ``docs`` has ``_stratum`` and ``tokens``.
    """
    sources = stage(docs.groupBy("_stratum").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    alpha = temperature(sources, evenness, max_epochs)
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha))
    z, budget = sources.agg(F.sum(power), F.max(F.col("tokens") / power)).first()
    weight = F.round(power / F.lit(float(z or 1)), 9)
    # quota = weight * budget; at least one pass, where the budget was fixed.
    quota = F.greatest(F.round(power * F.lit(float(budget or 0))).cast("long"), F.col("tokens"))
    return sources.select("_stratum", "tokens", "rows", F.lit(alpha).alias("alpha"), weight.alias("weight"), quota.alias("quota"))


def _readings(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Each row once for every epoch its source reaches, with its hash in that epoch."""
    facts = plan.select("_stratum", F.col("tokens").alias("_have"), "weight", "alpha", "quota", "rows")
    n = rows.count()
    joined = attach(rows, facts, "_stratum", "rows", n)
    epochs = F.sequence(F.lit(0), F.ceil(F.col("quota") / F.col("_have")).cast("int") - 1)
    each = joined.withColumn("epoch", F.explode(epochs))
    h = uniform60(seed, F.col("epoch"), F.col("doc_id"), F.col("_c"))
    return each.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / F.lit(_TOP) * buckets_for(n)).cast("int"))


def mix_schedule(
    docs: DataFrame,
    evenness: float = EVENNESS,
    max_epochs: float = MAX_EPOCHS,
    block_tokens: int = BLOCK_TOKENS,
    seed: str = "mix-1",
) -> DataFrame:
    """The mixed stream: one row for each time a document is read.

    Reads ``doc_id, text, source``; other columns are ignored.  Returns ``doc_id, source,
    tokens, alpha, weight, epoch, block, slot``.  Null sources form a source of their own; a null or empty
    text counts one token; repeated rows are read one by one and, being equal, are
    interchangeable.  No rows give no rows.  The last epoch of a source takes documents while
    tokens read before them are under its quota.
    """
    rows = stage(docs.select("doc_id", _stratum().alias("_stratum"), token_count(F.col("text")).alias("tokens"), _body().alias("_c")))
    plan = stage(source_plan(rows, evenness, max_epochs))
    blocks = max(1, round((plan.agg(F.sum("quota")).first()[0] or 0) / block_tokens))
    each = _readings(rows, plan, seed).withColumn("_key", F.concat_ws(" ", F.col("epoch").cast("string"), "_stratum"))
    tie = [F.col("_h"), F.col("doc_id").asc_nulls_first(), F.col("tokens")]
    placed = ranked(each, "_b", tie, ["_key"], weight="tokens")
    at = F.col("epoch") * F.col("_have") + F.col("_before")
    taken = placed.withColumn("_at", at).filter(F.col("_at") < F.col("quota"))
    dealt = taken.withColumn("block", F.expr(f"CAST((_at * CAST({blocks} AS DECIMAL(20, 0))) div quota AS LONG)"))
    dealt = dealt.withColumn("_h", uniform60(seed, F.col("block"), F.col("epoch"), F.col("doc_id"), F.col("_c"))).drop("_b", "_rank", "_total")
    from pyspark.sql import Window as W

    order = W.partitionBy("block").orderBy("_h", "_stratum", F.col("doc_id").asc_nulls_first(), "epoch", "tokens")
    return dealt.select(
        "doc_id",
        F.expr("CASE WHEN _stratum = 'n' THEN NULL ELSE substring(_stratum, 2) END").alias("source"),
        "tokens",
        "alpha",
        "weight",
        "epoch",
        "block",
        (F.row_number().over(order) - 1).cast("long").alias("slot"),
    )


def mix_documents(
    docs: DataFrame, evenness: float = EVENNESS, max_epochs: float = MAX_EPOCHS, seed: str = "mix-1"
) -> DataFrame:
    """``docs`` with each row repeated as often as the mix reads it; columns stay.

    The rows and counts are those of :func:`mix_schedule`; rows equal in id and text that are at
    a source's end are all read.  Any other columns keep their values, whatever they are called.
    """
    slim = stage(docs.select("doc_id", _stratum().alias("_stratum"), token_count(F.col("text")).alias("tokens"), _body().alias("_c")))
    plan = stage(source_plan(slim, evenness, max_epochs))
    each = _readings(slim, plan, seed).filter(F.col("epoch") == F.ceil(F.col("quota") / F.col("_have")) - 1)
    placed = ranked(each, "_b", [F.col("_h"), F.col("doc_id").asc_nulls_first(), F.col("tokens")], ["_stratum"], weight="tokens")
    last = placed.filter(F.col("epoch") * F.col("_have") + F.col("_before") < F.col("quota"))
    stratum, last_h, epoch, rows, turn = spare(docs.columns, "_stratum", "_last", "_epoch", "_rows", "_turn")
    edges = last.groupBy("_stratum").agg(F.max("_h").alias(last_h), F.max("epoch").alias(epoch))
    facts = stage(plan.select("_stratum", F.col("rows").alias(rows)).join(edges, "_stratum").withColumnRenamed("_stratum", stratum))
    read = attach(docs.withColumn(stratum, _stratum()), facts, stratum, rows, slim.count())
    h = uniform60(seed, F.col(epoch), F.col("doc_id"), _body())
    times = F.col(epoch) + F.when(h <= F.col(last_h), 1).otherwise(0)
    out = read.withColumn(turn, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    return out.select(*docs.columns)
