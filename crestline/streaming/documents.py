"""Job documents from partial updates: expiring values on the RocksDB state store, and their batch form.

An update is a JSON object with a sequence number.  Absent keys stay, null clears, the latest sequence number of a
key counts, whatever order updates arrive in.  A ``clip_ready`` update upserts one hot point by its file; a list of hot points replaces
those before it, but with the status ``DONE`` it counts only where none was there before.  Payloads that are no JSON object
change nothing but the sequence number.

:func:`patches` takes updates apart with variant functions, so that both forms merge the same small rows: the batch one
with ``max_by``, the stream with a map of values for each job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from crestline.operators.greedy import left_join
from crestline.streaming.live import use_rocksdb

#: Seconds after which what nothing touches is forgotten.
TTL = 15 * 60.0


def patches(updates: DataFrame) -> DataFrame:
    """``job_id, seq, part, key, value, pos``: the rows that updates (``job_id, seq, payload``) come down to.

    ``part`` is ``field`` (``key`` in JSON, ``value`` its JSON), ``clip`` (``key`` a file, ``value`` its point), ``list``
    or ``done`` (a list of points begins), ``item`` or ``done_item`` (one of its points), ``seen`` (nothing but the number).
    """
    of = lambda path, kind="string": F.try_variant_get("v", path, kind)
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    is_text = lambda path, text: F.coalesce(of(path) == text, F.lit(False))

    def row(part: Column | str, key: Column | None = None, value: Column | None = None, pos: Column | None = None) -> Column:
        none = F.lit(None)
        columns = (part if isinstance(part, Column) else F.lit(part), none if key is None else key, none if value is None else value)
        pos = (none if pos is None else pos).cast("int").alias("pos")
        return F.struct(*[c.cast("string").alias(n) for c, n in zip(columns, ("part", "key", "value"), strict=True)], pos)

    told = updates.select("job_id", "seq", F.try_parse_json("payload").alias("v"))
    told = told.withColumns({"object": is_object("v"), "done": is_text("$.status", "DONE")})
    point, seen = of("$.hot_point", "variant"), F.array(row("seen"))
    ready = F.col("object") & is_text("$.type", "clip_ready") & is_object(point)
    values = F.transform_values(of("$", "map<string,variant>"), lambda k, x: F.coalesce(F.to_json(x), F.lit("null")))
    fields = F.filter(F.map_entries(values), lambda e: ~e["key"].isin("type", "job_id", "hot_points"))
    fields = F.transform(fields, lambda e: row("field", F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), e["value"]))
    file = lambda p: F.try_variant_get(p, "$.clip_filename", "string")
    item, begins = F.when(F.col("done"), "done_item").otherwise("item"), F.array(row(F.when(F.col("done"), "done").otherwise("list")))
    items = F.transform(of("$.hot_points", "array<variant>"), lambda p, i: row(item, file(p), F.to_json(p), i))
    lists = F.when(F.map_contains_key(values, F.lit("hot_points")), F.concat(begins, F.coalesce(items, F.slice(begins, 1, 0)))).otherwise(F.slice(begins, 1, 0))
    rows = F.when(ready, F.array(row("clip", file(point), F.to_json(point)))).when(F.col("object"), F.concat(seen, fields, lists)).otherwise(seen)
    return told.select("job_id", "seq", F.explode(rows).alias("r")).select("job_id", "seq", "r.*")


def merged_documents_batch(updates: DataFrame) -> DataFrame:
    """``job_id, seq, document``: the last state of every job, from all of its updates."""
    rows = patches(updates)
    of = lambda *parts: F.col("part").isin(*parts)
    at = rows.groupBy("job_id").agg(F.max("seq").alias("top"), F.max(F.when(of("list"), F.col("seq"))).alias("reset"), F.max(of("list", "done", "clip")).alias("pointed"))
    points = left_join(rows.filter(of("item", "done_item", "clip")), at.select("job_id", "reset"), ["job_id"])
    after = F.col("reset").isNull() | (F.col("seq") > F.col("reset"))
    points = points.withColumn("live", of("clip") & after | of("item") & (F.col("seq") == F.col("reset")))
    firsts = points.groupBy("job_id").agg(F.min(F.when(F.col("live"), F.col("seq"))).alias("first"), F.min(F.when(of("done_item") & after, F.col("seq"))).alias("final"))
    points = left_join(points, firsts, ["job_id"])
    final = F.col("final").isNotNull() & (F.col("first").isNull() | (F.col("final") < F.col("first")))
    points = points.filter(F.col("live") | (final & of("done_item") & (F.col("seq") == F.col("final"))))
    turn = F.struct("seq", "pos")
    points = points.groupBy("job_id", "key").agg(F.min(turn).alias("turn"), F.max_by("value", turn).alias("value"))
    listed = points.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "value"))), lambda x: x["value"]), ", ").alias("points"))
    shown = left_join(at.filter("pointed"), listed, ["job_id"]).select("job_id", F.lit('"hot_points"').alias("key"), F.concat(F.lit("["), F.coalesce("points", F.lit("")), F.lit("]")).alias("value"))
    fields = rows.filter(of("field")).groupBy("job_id", "key").agg(F.max_by("value", "seq").alias("value"))
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    whole = fields.unionByName(shown).groupBy("job_id").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["key"], F.lit(": "), x["value"])), ", ").alias("text"))
    return left_join(at, whole, ["job_id"]).select("job_id", F.col("top").alias("seq"), F.concat(F.lit("{"), F.coalesce("text", F.lit("")), F.lit("}")).alias("document"))


class JobDocument(StatefulProcessor):
    """The document of one job: fields and clips with their sequence numbers, each forgotten when it has not been touched for long."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        items = "items array<struct<key: string, value: string>>"
        self.top = handle.getValueState("top", "seq long", self.ttl)
        self.fields = handle.getMapState("fields", "key string", "seq long, value string", self.ttl)
        self.clips = handle.getMapState("clips", "key string", "seqs array<long>, value string", self.ttl)
        self.base = handle.getValueState("base", f"seq long, {items}", self.ttl)
        self.finals = handle.getMapState("finals", "seq long", items, self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["seq", "pos"], kind="stable", na_position="first")
        top = max(int(frame["seq"].max()), self.top.get()[0] if self.top.exists() else -1)
        self.top.update((top,))
        lists: dict[tuple[int, str], list] = {}
        for seq, part, name, value in frame[["seq", "part", "key", "value"]].itertuples(index=False):
            if part == "field":
                if not self.fields.containsKey((name,)) or self.fields.getValue((name,))[0] <= seq:
                    self.fields.updateValue((name,), (int(seq), value))
            elif part in ("list", "done"):
                lists.setdefault((int(seq), part), [])
            elif part in ("item", "done_item"):
                lists.setdefault((int(seq), "list" if part == "item" else "done"), []).append((name, value))
        for (seq, part), items in sorted(lists.items()):
            if seq > self._reset():
                if part == "list":
                    self._begin(seq, items)
                else:
                    self.finals.updateValue((seq,), (items,))
        for seq, name, value in frame.loc[frame["part"] == "clip", ["seq", "key", "value"]].itertuples(index=False):
            if seq > self._reset():
                at = (json.dumps(name),)
                seqs, last = self.clips.getValue(at) if self.clips.containsKey(at) else ([], value)
                self.clips.updateValue(at, (sorted({*seqs, int(seq)}), value if not seqs or seq >= max(seqs) else last))
        yield pd.DataFrame({"job_id": [key[0]], "seq": [top], "document": [self._document()]})

    def _reset(self) -> int:
        return self.base.get()[0] if self.base.exists() else -1

    def _begin(self, seq: int, items: list) -> None:
        self.base.update((seq, items))
        for at, (seqs, value) in list(self.clips.iterator()):
            left = [q for q in seqs if q > seq]
            if left:
                self.clips.updateValue(at, (left, value))
            else:
                self.clips.removeKey(at)
        for at in list(self.finals.keys()):
            if at[0] <= seq:
                self.finals.removeKey(at)

    def _document(self) -> str:
        clips = sorted((seqs[0], at[0], value) for at, (seqs, value) in self.clips.iterator())
        seq, items = self.base.get() if self.base.exists() else (-1, [])
        finals = sorted((at[0], x[0]) for at, x in self.finals.iterator() if x[0])
        if finals and not items and (not clips or finals[0][0] < clips[0][0]):
            items = finals[0][1]
        points: dict[str, str] = {}
        for name, value in [*((json.dumps(x[0]), x[1]) for x in items), *(c[1:] for c in clips)]:
            points[name] = value  # keeps the place where it came first
        pairs = [(at[0], x[1]) for at, x in self.fields.iterator()]
        if points or self.base.exists() or any(True for _ in self.finals.keys()):
            pairs.append(('"hot_points"', f"[{', '.join(points.values())}]"))
        return "{" + ", ".join(f"{k}: {v}" for k, v in sorted(pairs, key=lambda p: p[0].encode())) + "}"

    def close(self) -> None:
        pass


def merged_documents(updates: DataFrame, ttl: float = TTL) -> DataFrame:
    """Stream of ``job_id, seq, document``: the state of a job after each trigger that touched it.

    Updates that come again change nothing, and those that come late take the place that their numbers
    give them.  What nothing touches for ``ttl`` seconds is forgotten.  Expiry keeps triggers coming, so an
    ``availableNow`` query does not end by itself: stop it once its input is read.
    """
    use_rocksdb(updates.sparkSession)
    schema = T.StructType([T.StructField("job_id", updates.schema["job_id"].dataType), T.StructField("seq", T.LongType()), T.StructField("document", T.StringType())])
    return patches(updates).groupBy("job_id").transformWithStateInPandas(JobDocument(round(ttl * 1000)), schema, "Update", "ProcessingTime")
