"""Boundaries to services outside: speech to text, language models, tagging, detection.

A service is any picklable callable over a list of rows.  A row whose call fails gets the
defaults and never fails the job; calls run in the executors' tasks, a bounded number at a time.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Output schemas of the known boundaries.
BOUNDARIES = {
    "speech_to_text": "text string, segments array<struct<start: double, end: double, text: string>>, words array<struct<word: string, start: double, end: double>>",
    "candidate_model": "name string, category string, virality double, summary string",
    "context_model": "summary string, content double",
    "audio_tagging": "probs array<float>",
    "diarization": "turns array<struct<speaker: string, start: double, end: double>>",
    "voice_embedding": "vector array<float>",
    "pose_detection": "points array<struct<x: double, y: double, v: double>>",
}


def call_service(
    df: DataFrame,
    service: Callable[[list[dict]], Sequence[Mapping | None]],
    schema: str,
    defaults: Mapping[str, object],
    size: int = 32,
    in_flight: int = 4,
    retries: int = 2,
    wait: float = 0.5,
) -> DataFrame:
    """``df`` with the columns a service gives for each row, and ``failed``; rows keep their order.

    The service takes ``size`` rows a call, the last rows of a task fewer, and at most ``in_flight`` calls of a task are under way.  A
    call that fails, or answers for another number of rows, is made again up to ``retries`` times after ``wait`` seconds, doubled
    each time; then its rows are asked for one by one, and those that fail alone get the defaults.
    """
    given = [f.strip().split(" ")[0] for f in _fields(schema)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def asked(rows: list[dict]) -> list[Mapping | None]:
        told = list(service(rows))
        if len(told) != len(rows):
            raise ValueError(f"{len(told)} answers for {len(rows)} rows")
        return [x or {} for x in told]

    def answered(rows: list[dict]) -> list[Mapping | None]:
        for turn in range(retries + 1):
            try:
                return asked(rows)
            except Exception:  # whatever a service raises, it is asked again
                if turn < retries:
                    time.sleep(wait * 2**turn)
        out: list[Mapping | None] = []
        for row in rows:
            try:
                out += asked([row])
            except Exception:  # this row goes on with the defaults
                out.append(None)
        return out

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            waiting: deque[tuple[pd.DataFrame, Future]] = deque()

            def done() -> pd.DataFrame:
                part, answers = waiting.popleft()
                rows = [[(told or {}).get(c, defaults.get(c)) for c in given] + [told is None] for told in answers.result()]
                return pd.concat([part, pd.DataFrame(rows, columns=[*given, "failed"], index=part.index)], axis=1)

            rest = None
            for batch in batches:
                batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
                whole = len(batch) // size * size
                for lo in range(0, whole, size):
                    part = batch.iloc[lo : lo + size]
                    waiting.append((part, pool.submit(answered, part.to_dict("records"))))
                    if len(waiting) > in_flight:
                        yield done()
                rest = batch.iloc[whole:]
            if rest is not None and len(rest):
                waiting.append((rest, pool.submit(answered, rest.to_dict("records"))))
            while waiting:
                yield done()

    return df.mapInPandas(call, f"{kinds}, {schema}, failed boolean")


def call_once(
    df: DataFrame, inputs: Sequence[str], memo: str, service: Callable[[list[dict]], Sequence[Mapping | None]], schema: str, defaults: Mapping[str, object], **how
) -> DataFrame:
    """As :func:`call_service`, but equal ``inputs`` are asked for once, and never again while the table at ``memo`` stands.

    The service sees the input columns alone.  Answers are kept by the SHA-256 of the inputs as JSON; failures are not kept, so
    another run asks again.
    """
    spark, given = df.sparkSession, [f.strip().split(" ")[0] for f in _fields(schema)]
    digest = F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256)
    rows = df.withColumn("_input", digest)
    kept = f"_input string, {schema}, failed boolean"
    new = rows.select("_input", *inputs).dropDuplicates(["_input"])
    try:
        known = spark.read.schema(kept).parquet(memo)
        known.take(1)
    except AnalysisException:  # nothing is kept yet
        known = spark.createDataFrame([], kept)
    asked = new.join(known.filter("NOT failed").select("_input"), "_input", "left_anti")
    only = lambda batch: service([{c: r[c] for c in inputs} for r in batch])
    call_service(asked, only, schema, defaults, **how).select("_input", *given, "failed").write.mode("append").parquet(memo)
    told = spark.read.schema(kept).parquet(memo)
    best = told.groupBy("_input").agg(F.min_by(F.struct(*given, "failed"), "failed").alias("_told"))
    return rows.join(best, "_input", "left").select(*df.columns, "_told.*")


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def prompt(title: Column, parts: Mapping[str, Column]) -> Column:
    """Text for a model: a title and a line for every part that is not null."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in parts.items()]
    return F.concat_ws("\n", title, *lines)
