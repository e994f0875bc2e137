"""Reading tables, documents, listings and chunked series."""

from __future__ import annotations

import io
import re
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files by schema, with their ``path``; broken ones give null columns."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("path", F.input_file_name())


def read_queue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Queue entries, one JSON document a line; entries that are none are skipped."""
    lines = spark.read.text(path)
    doc = F.from_json("value", schema)
    parsed = lines.filter(F.col("value").rlike(r"^\s*\{.*\}\s*$")).select(doc.alias("d")).filter(F.col("d").isNotNull())
    return parsed.select("d.*")


def list_objects(spark: SparkSession, path: str, suffix: str, most: int | None = None) -> DataFrame:
    """``path, size, modified`` of files by suffix, by name; content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(path)
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.orderBy("path").limit(most) if most else out


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A relational table in key ranges."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def read_wav(spark: SparkSession, path: str, seconds: int = 1800, overlap: float = 5.0) -> DataFrame:
    """``path, chunk, offset, before, rate, samples``: 16-bit PCM recordings as floats from -1 to 1, the mean of their channels.

    A chunk begins every ``seconds``, at ``offset`` seconds, and goes on for ``overlap`` seconds into the next, so a row's size is
    bounded; ``before`` is the number of samples of the chunk before.  A file that is no such recording gives no
    rows.  Files must be under 2 GB.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    sound = wave.open(io.BytesIO(content))
                except (wave.Error, EOFError):
                    continue
                rate, channels, total, before = sound.getframerate(), sound.getnchannels(), sound.getnframes(), 0
                if sound.getsampwidth() != 2:
                    continue
                for chunk, start in enumerate(range(0, total, rate * seconds)):
                    sound.setpos(start)
                    raw = np.frombuffer(sound.readframes(int(rate * (seconds + overlap))), dtype="<i2").reshape(-1, channels)
                    row = {"path": [name], "chunk": [chunk], "offset": [float(chunk * seconds)], "before": [before], "rate": [rate]}
                    yield pd.DataFrame(row | {"samples": [(raw.mean(axis=1) / 32768).astype(np.float32)]})
                    before = len(raw)

    return files.select("path", "content").mapInPandas(decode, "path string, chunk int, offset double, before long, rate int, samples array<float>")


def stream_updates(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Stream of JSON updates from a folder; the key is the file name's last part."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)
    return stream.withColumn("channel", F.regexp_extract(F.input_file_name(), r"([^/:]+?)(?:\.json)?$", 1))


def subscribe(spark: SparkSession, path: str, schema: str, channel: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """Stream of what :func:`crestline.sources.sinks.publish` writes: the rows with their ``channel`` and ``epoch``, of one channel or all.

    Only the folders of a channel with a plain name are listed; its offsets are Spark's own, kept in the reader's checkpoint.
    """
    rows = spark.readStream.schema(f"{schema}, epoch long, channel string").option("basePath", path).option("maxFilesPerTrigger", per_trigger)
    plain = channel is not None and re.fullmatch(r"[A-Za-z0-9_.-]+", channel)  # others are escaped in the folder's name
    found = rows.json(f"{path.rstrip('/')}/epoch=*/channel={channel if plain else '*'}")
    return found if channel is None else found.filter(F.col("channel") == channel)


def frame_times(start: Column, end: Column, n: int, duration: Column | None = None) -> Column:
    """``n`` evenly spaced times, to a tenth; with a ``duration`` the last stays half a second before its end."""
    if n <= 1:
        return F.array(F.round(start, 1))
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(start + i * (end - start) / (n - 1), 1))
    if duration is None:
        return times
    last = F.round(F.least(F.element_at(times, -1), F.greatest(F.lit(0.0), duration - 0.5)), 1)
    return F.concat(F.slice(times, 1, n - 1), F.array(last))


def drop_seams(chunks: DataFrame, by: Sequence[str], chunk: str, time: str) -> DataFrame:
    """Windows of overlapping chunks without those at or before the last time of the chunks before."""
    latest = chunks.groupBy(*by, chunk).agg(F.max(time).alias("_last"))
    before = F.max("_last").over(W.partitionBy(*by).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1))
    ends = latest.select(*by, chunk, before.alias("_before"))
    return chunks.join(ends, [*by, chunk]).filter(F.col("_before").isNull() | (F.col(time) > F.col("_before"))).drop("_before")


def next_number(files: DataFrame, name: str, pattern: str = r"_([0-9]+)\.") -> DataFrame:
    """One more than the largest number in the file names, 1 without any."""
    n = F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("long")
    return files.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


def enrich(jobs: DataFrame, by_id: DataFrame, by_name: DataFrame, ident: str, name: str, value: str) -> DataFrame:
    """``value`` looked up by id, else by lower-cased name, else empty."""
    a = by_id.select(ident, F.col(value).alias("_a"))
    b = by_name.select(F.lower(name).alias("_key"), F.col(value).alias("_b")).dropDuplicates(["_key"])
    joined = jobs.join(a, ident, "left").join(b, F.lower(jobs[name]) == F.col("_key"), "left")
    return joined.withColumn(value, F.coalesce(F.nullif("_a", F.lit("")), F.col("_b"), F.lit(""))).drop("_a", "_b", "_key")
