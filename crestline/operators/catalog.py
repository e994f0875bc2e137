"""Filters, rollups and quotas over job, creator and render tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches_search(term: str, columns: Sequence[Column]) -> Column:
    """Whether any column contains the term, whatever its case; ``%``, ``_`` and ``\\`` are literal."""
    literal = "".join(f"\\{c}" if c in "%_\\" else c for c in term)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.ilike(c, F.lit(f"%{literal}%")), F.lit(False))
    return hit


def optional_filters(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Equality filters for the parameters that are present."""
    for name, value in wanted.items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == F.lit(value))
    return df


def status_class(df: DataFrame, status: str, which: str | None, done: str, error: str) -> DataFrame:
    """Jobs that are done, failed, or (``active``) neither; all of them otherwise."""
    if which == "done":
        return df.filter(F.col(status) == done)
    if which == "error":
        return df.filter(F.col(status) == error)
    return df.filter(~F.col(status).isin(done, error)) if which == "active" else df


def filled(column: str) -> Column:
    """Neither null nor empty."""
    return F.col(column).isNotNull() & (F.col(column) != "")


def outer_counts(parents: DataFrame, children: DataFrame, condition: Column, keys: Sequence[str], child: str) -> DataFrame:
    """Children of every parent that meet the condition, 0 where none does.

    The whole condition belongs to the join, so that parents without a match stay.
    """
    return parents.join(children, condition, "left").groupBy(*keys).agg(F.count(child).alias("n"))


def quota_usage(uses: DataFrame, quotas: DataFrame, user: str, at: str, now: str) -> DataFrame:
    """``user, key, limit, used, remaining, allowed`` for every quota of a user.

    ``quotas`` has ``user, key, limit, period`` (day, month, year or lifetime); uses since
    the start of the period around ``now`` count.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    since = F.when(F.col("period") == "lifetime", F.lit(None).cast("timestamp_ntz")).otherwise(
        F.expr(f"CASE period WHEN 'day' THEN date_trunc('DAY', TIMESTAMP_NTZ'{now}') WHEN 'month' THEN date_trunc('MONTH', TIMESTAMP_NTZ'{now}') ELSE date_trunc('YEAR', TIMESTAMP_NTZ'{now}') END")
    )
    limits = quotas.withColumn("_since", since)
    used = F.count_if(F.col(at).isNotNull() & (F.col("_since").isNull() | (F.col(at) >= F.col("_since"))) & (F.col(at) <= moment))
    per = limits.join(uses.select(user, at), user, "left").groupBy(user, "key", "limit").agg(used.alias("used"))
    return per.select(user, "key", "limit", "used", F.greatest(F.lit(0), F.col("limit") - F.col("used")).alias("remaining"), (F.col("used") < F.col("limit")).alias("allowed"))


def permitted(requests: DataFrame, grants: DataFrame, user: str, permission: str) -> DataFrame:
    """Requests that some grant of the user covers: ``*``, the permission itself, or ``domain:*``.

    Every permission has three possible grants, so the match is an equality join.
    """
    domain = F.concat(F.substring_index(permission, ":", 1), F.lit(":*"))
    covers = requests.withColumn("_g", F.explode(F.array(F.lit("*"), F.col(permission), domain)))
    given = grants.select(F.col(user).alias("_u"), F.col("grant").alias("_grant")).distinct()
    met = covers.join(given, (F.col(user) == F.col("_u")) & (F.col("_g") == F.col("_grant")), "left_semi")
    return met.select(*requests.columns).distinct()


def merge_partial(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` with the non-null columns of their update; unknown keys are not added."""
    changed = [c for c in updates.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    merged = base.join(new, key, "left")
    return merged.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns])


def insert_absent(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``base`` and those of ``rows`` whose key it lacks."""
    return base.unionByName(rows.join(base.select(key), key, "left_anti").select(*base.columns))


def update_where(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """Set columns in the rows that meet a condition; rows of which it is unknown stay as they are."""
    met = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(met, v).otherwise(F.col(c)) for c, v in values.items()})


def clip_class(source: Column) -> Column:
    """What a clip is from: ``auto``, also where nothing is said, ``detected`` or ``manual``."""
    return F.when(source == "llm_detected", "detected").when(source == "manual", "manual").otherwise("auto")


def exclusive_flag(df: DataFrame, owner: Column, chosen: Column, flag: str) -> DataFrame:
    """Set ``flag`` for the chosen row of an owner and clear it for the owner's others."""
    return df.withColumn(flag, F.when(owner, chosen).otherwise(F.col(flag)))


def cascade_delete(tables: Mapping[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows that refer to a deleted key."""
    return {name: df.join(gone.select(F.col(key).alias(ref)), ref, "left_anti").select(*df.columns) for name, (df, ref) in tables.items()}
