"""Shared building blocks of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows a broadcast side may have where its size is proven by construction.
BROADCAST_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session (one process, so one disk) takes ``/tmp/checkpoints``;
    on a cluster it is an error.
    """
    conf = spark.sparkContext.getConf()
    shared, master = conf.get("spark.checkpoint.dir"), conf.get("spark.master", "")
    if shared:
        return shared
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor costs nothing but the rereading of files, and the columns can still
    be pruned, which an RDD checkpoint does not allow.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/crestline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a :func:`stage` result that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/crestline-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def buckets_for(rows: int) -> int:
    """Hash buckets to rank so many rows in: some 4,096 rows each, so the bucket grows only beyond four billion rows."""
    return min(max(256, rows >> 12), 1 << 20)


def spare(columns: Sequence[str], *stems: str) -> list[str]:
    """A column name for each stem that none of ``columns`` has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row; maps, which have no hash, count as JSON."""
    quoted = [f"`{name.replace('`', '``')}`" for name in df.columns]
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, (_, kind) in zip(quoted, df.dtypes, strict=True)])


def uniform60(*parts: Column | str) -> Column:
    """A 60-bit integer from the MD5 of the parts joined by ``:`` (null: ``~``)."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("~")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 15), 16, 10).cast("long")


def ranked(
    df: DataFrame, bucket: str, order: Sequence[Column], groups: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Exact ranks without gathering a group in one task.

    ``bucket`` must be a non-null integer that grows with ``order`` and takes a bounded
    number of values.  Only the table of bucket sizes is scanned in order; rows are
    sorted within their own bucket.  Adds ``_rank`` (from 0 within ``groups``), ``_total``
    (rows of the group) and, with ``weight``, ``_before`` (weight of the rows ahead) and
    ``_weight`` (of the group).  Group columns must not be null.
    """
    keys = [*groups, bucket]
    w = F.col(weight) if weight else F.lit(0)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(w).cast("long").alias("_w"))
    whole = W.partitionBy(*groups)
    ahead = whole.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_w0"),
        F.sum("_n").over(whole).alias("_total"),
        F.sum("_w").over(whole).alias("_weight"),
    )
    inside = W.partitionBy(*keys).orderBy(*order)
    out = df.join(offsets, keys).withColumn("_rank", F.col("_n0") + F.row_number().over(inside) - 1)
    if weight:
        before = F.sum(weight).over(inside.rowsBetween(W.unboundedPreceding, -1))
        out = out.withColumn("_before", F.col("_w0") + F.coalesce(before, F.lit(0)))
    drop = ["_n0", "_w0"] + ([] if weight else ["_weight"])
    return out.drop(*drop)


def attach(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Join ``facts`` (one row a key, ``count`` of them in ``rows``) to ``rows``.

    Keys that hold more than a ``BROADCAST_ROWS``-th of all rows number fewer than
    ``BROADCAST_ROWS``; these are broadcast, so that a hot key never meets in one task.
    The other keys go through an ordinary shuffle join.
    """
    hot = F.col(count) > max(1, total // BROADCAST_ROWS)
    heavy = facts.filter(hot).drop(count)
    light = facts.filter(~hot).drop(count)
    added = [c for c in heavy.columns if c != key]
    (fact,) = spare([*rows.columns, *added], "_fact")
    marked = rows.join(
        F.broadcast(heavy.select(key, F.struct(*added).alias(fact))), key, "left"
    )
    done = marked.filter(F.col(fact).isNotNull()).select(*rows.columns, f"{fact}.*")
    rest = marked.filter(F.col(fact).isNull()).drop(fact).join(light, key)
    return done.unionByName(rest.select(*rows.columns, *added))
