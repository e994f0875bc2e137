"""Idempotent writers: replacing partitions, upserting, archiving, publishing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from crestline.operators.catalog import merge_partial, update_where


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite just the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def save_ranked(df: DataFrame, path: str, job: str, order: Sequence[Column]) -> None:
    """Replace each job's hot points, ranked from 1 in the given order."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(job).orderBy(*order)))
    replace_partitions(ranked, path, [job])


def _files(spark: SparkSession, path: str):
    """Hadoop's view of a path and of its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source} could not be renamed to {target}")


def _swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside ``path``, then put the new version in its place.

    The old version is only renamed before the new one stands, and deleted last, so whenever the driver
    dies a whole version is there: under ``path``, or with ``-old`` behind it.
    """
    fresh = f"{path}-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    (old, fs), (new, _), (aside, _) = (_files(spark, p) for p in (path, fresh, f"{fresh}-old"))
    _move(fs, old, aside)
    _move(fs, new, old)
    fs.delete(aside, True)


def put_object(spark: SparkSession, text: str, path: str) -> None:
    """Write a small text as one object, in the place of any before it."""
    at, fs = _files(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def copy_object(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or folder, also from one store to another; what stood there is replaced."""
    (a, from_fs), (b, to_fs) = _files(spark, source), _files(spark, target)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, a, to_fs, b, False, True, spark._jsc.hadoopConfiguration()):
        raise OSError(f"{source} could not be copied to {target}")


def delete_object(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; whether there was one."""
    at, fs = _files(spark, path)
    return bool(fs.delete(at, True))


def rename_object(spark: SparkSession, source: str, target: str) -> None:
    """Copy, then delete: what an object store can do in the place of a rename."""
    copy_object(spark, source, target)
    delete_object(spark, source)


def archive_rows(renders: DataFrame, batch: str, status: str, output: str, done: str = "done") -> DataFrame:
    """What goes into the archive of each batch: finished rows with an output, and the entry's name.

    Entries of a batch with one base name get a number before the extension.
    """
    kept = renders.filter((F.col(status) == done) & (F.coalesce(F.col(output), F.lit("")) != ""))
    base = F.regexp_extract(output, "([^/]*)$", 1)
    n = F.row_number().over(W.partitionBy(batch, base).orderBy(output))
    stem, ext = F.regexp_extract(base, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(base, r"^(.*?)(\.[^.]*)?$", 2)
    return kept.withColumn("entry", F.when(n == 1, base).otherwise(F.concat(stem, F.lit("-"), n.cast("string"), ext)))


#: What names the files that a finished rewrite replaces, in the folder of the rewrite.
_MANIFEST = "_files.json"


def _path_of(spark: SparkSession, file: str):
    """Hadoop's path of a ``_metadata.file_path``."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))


def _partitions(spark: SparkSession, path: str, file: str) -> list[str]:
    """Partition columns of a table from the path of one of its files."""
    at, fs = _files(spark, path)
    inside = _path_of(spark, file).toString().removeprefix(fs.makeQualified(at).toString())
    return [part.split("=", 1)[0] for part in inside.split("/")[:-1] if "=" in part]


def finish_updates(spark: SparkSession, path: str) -> None:
    """Complete the rewrites that a lost driver left half done, and drop those it had not written whole.

    Each new file takes the place of its old one in a single step, so at any time a row is there once, old or new.
    """
    at, fs = _files(spark, path)
    if not fs.exists(at):
        return
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    step = hadoop.FileContext.getFileContext(fs.makeQualified(at).toUri(), spark._jsc.hadoopConfiguration())
    option = getattr(hadoop, "Options$Rename")
    overwrite = gateway.new_array(option, 1)
    overwrite[0] = option.OVERWRITE
    for folder in [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("_update-")]:
        manifest = hadoop.Path(folder, _MANIFEST)
        if fs.exists(manifest):
            stream = fs.open(manifest)
            try:
                old = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
            finally:
                stream.close()
            for i, file in enumerate(old):
                part = hadoop.Path(folder, f"_i={i}")
                for new in [x.getPath() for x in fs.listStatus(part)] if fs.exists(part) else []:
                    if new.getName().endswith(".parquet"):
                        step.rename(fs.makeQualified(new), _path_of(spark, file), overwrite)
        fs.delete(folder, True)


def _rewrite(spark: SparkSession, path: str, touched: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame]) -> int:
    """Rewrite the files of the rows that ``touched`` keeps, each as one new file with the rows changed; their number."""
    finish_updates(spark, path)
    base = spark.read.parquet(path)
    found = touched(base.withColumn("_file", F.col("_metadata.file_path"))).select("_file").distinct()
    files = sorted(r["_file"] for r in found.collect())  # one name a file touched
    if not files:
        return 0
    fixed = _partitions(spark, path, files[0])
    places = F.broadcast(spark.createDataFrame(list(enumerate(files)), "_i int, _file string"))
    rows = spark.read.option("basePath", path).parquet(*[_path_of(spark, f).toString() for f in files])
    new = change(rows.withColumn("_file", F.col("_metadata.file_path")).join(places, "_file"))
    new = new.select("_i", *[c for c in base.columns if c not in fixed])
    folder = f"{path.rstrip('/')}/_update-{uuid.uuid4().hex}"
    new.repartition(len(files), "_i").write.partitionBy("_i").parquet(folder)
    put_object(spark, json.dumps(files), f"{folder}/_written")
    (written, fs), (manifest, _) = _files(spark, f"{folder}/_written"), _files(spark, f"{folder}/{_MANIFEST}")
    _move(fs, written, manifest)  # from here on the rewrite counts
    finish_updates(spark, path)
    spark.catalog.refreshByPath(path)
    return len(files)


def update_table(spark: SparkSession, path: str, updates: DataFrame, key: str) -> int:
    """Set the non-null columns of known rows; unknown keys change nothing.  Returns the number of files rewritten.

    Only files that hold such a key are read whole and rewritten, each in one step, so readers see every row once and a lost
    driver leaves work that :func:`finish_updates`, or the next update, completes.  ``updates`` must not move
    rows to other partitions.
    """
    if moved := [c for c in updates.columns if c != key and c in _table_partitions(spark, path)]:
        raise ValueError(f"partition columns cannot be updated in place: {', '.join(moved)}")
    known = updates.select(key).filter(F.col(key).isNotNull()).distinct()
    return _rewrite(spark, path, lambda base: base.join(known, key, "left_semi"), lambda rows: merge_partial(rows, updates, key))


def update_rows(spark: SparkSession, path: str, condition: Column, values: Mapping[str, Column]) -> int:
    """Set columns of the rows that meet a condition, as in :func:`update_table`; the number of files rewritten."""
    return _rewrite(spark, path, lambda base: base.filter(condition), lambda rows: update_where(rows, condition, values))


def _table_partitions(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f")).limit(1).collect()
    return _partitions(spark, path, first[0]["f"]) if first else []


def insert_new(spark: SparkSession, path: str, rows: DataFrame, key: str) -> None:
    """Add the rows whose key the table lacks as new files; running it again adds nothing."""
    finish_updates(spark, path)
    base = spark.read.parquet(path)
    fresh = rows.dropDuplicates([key]).join(base.select(key), key, "left_anti").select(*base.columns)
    fresh.write.mode("append").partitionBy(*_table_partitions(spark, path)).parquet(path)
    spark.catalog.refreshByPath(path)


def evolve(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of versions of a table; columns that a version lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_documents(df: DataFrame, path: str, by: str) -> None:
    """One folder of JSON documents a key."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_subtitles(chunks: DataFrame, path: str, by: str, start: str, header: str) -> None:
    """One text file a clip: a header, then a line for each chunk in time order.

    ``chunks`` has ``value`` lines, as :func:`crestline.operators.sequences.subtitle_lines` makes.
    """
    heads = chunks.select(by).distinct().select(by, F.lit(-1.0).alias(start), F.lit(header).alias("value"))
    lines = heads.unionByName(chunks.select(by, F.col(start).cast("double").alias(start), "value"))
    lines.repartition(by).sortWithinPartitions(by, start).select(by, "value").write.mode("overwrite").partitionBy(by).text(path)


def status_messages(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, payload``: for every changed row a JSON document of what changed, nulls included."""
    old = before.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    both = after.join(old, key, "left")
    changed = [F.struct(F.lit(c).alias("k"), F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}).alias("v"), (~F.col(c).eqNullSafe(F.col(f"_o_{c}"))).alias("d")) for c in columns]
    parts = F.transform(F.filter(F.array(*changed), lambda x: x["d"]), lambda x: F.concat(F.lit('"'), x["k"], F.lit('":'), F.substring(x["v"], F.lit(6), F.length(x["v"]) - 6)))
    return both.select(key, parts.alias("_p")).filter(F.size("_p") > 0).select(key, F.concat(F.lit("{"), F.array_join("_p", ","), F.lit("}")).alias("payload"))


def publish(stream: DataFrame, path: str, channel: str, checkpoint: str) -> DataStreamWriter:
    """Writer of a stream's rows to channels: a folder a trigger, and in it a folder for each value of ``channel``.

    A trigger that is replayed after a crash finds its folder whole and writes nothing, or not whole and
    writes it anew, so a row is published once.  :func:`crestline.sources.tables.subscribe` reads one channel, or all.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        folder = f"{path.rstrip('/')}/epoch={epoch}"
        done, fs = _files(batch.sparkSession, f"{folder}/_SUCCESS")
        if not fs.exists(done):
            batch.withColumn("channel", F.col(channel).cast("string")).write.mode("overwrite").partitionBy("channel").json(folder)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
