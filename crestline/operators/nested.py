"""Documents in columns: tolerant parsing, merging and rewriting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: Column, schema: str, default: Column | None = None) -> Column:
    """A JSON document by schema; ``default`` where the text is null or no such document."""
    doc = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return doc if default is None else F.coalesce(doc, default)


def merge_document(base: Column, patch: Column, keys: Sequence[str]) -> Column:
    """Map ``base`` (string to string) with a JSON patch: absent keys stay, null clears, others replace."""
    given = F.coalesce(F.json_object_keys(patch), F.array().cast("array<string>"))
    new = F.from_json(patch, "map<string,string>")
    kept = F.map_filter(F.coalesce(base, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(given, k))
    told = F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & k.isin(list(keys)))
    return F.map_concat(kept, told)


def upsert_element(items: Column, new: Column, key: str) -> Column:
    """Array of structs with ``new`` in place of the element of its key, or at the end."""
    there = F.exists(items, lambda x: x[key] == new[key])
    swapped = F.transform(items, lambda x: F.when(x[key] == new[key], new).otherwise(x))
    return F.when(items.isNull(), F.array(new)).when(there, swapped).otherwise(F.array_append(items, new))


def drop_element(items: Column, key: str, value: Column) -> Column:
    """Array without the elements of that key."""
    return F.filter(items, lambda x: ~x[key].eqNullSafe(value))


def rename_element(items: Column, key: str, value: Column, field: str, to: Column) -> Column:
    """Array in which a field of the elements of that key is replaced."""
    return F.transform(items, lambda x: F.when(x[key].eqNullSafe(value), x.withField(field, to)).otherwise(x))


def first_list(text: Column, element: str) -> Column:
    """The first list-valued entry of a JSON object, null if there is none."""
    entries = F.map_values(F.from_json(text, "map<string,string>"))
    lists = F.filter(entries, lambda v: F.trim(v).startswith("["))
    return F.from_json(F.try_element_at(lists, F.lit(1)), f"array<{element}>")


def entries(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """``keys, pos, key, value, kind``: every entry of an open JSON object, its value as text and its type's name.

    The document is parsed once, as a variant; a text that is no JSON object, or null, has no entry.  A JSON null is a
    null value of kind ``VOID``.
    """
    parsed = df.select(*keys, F.try_parse_json(text).alias("_v")).filter(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")))
    rows = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    return rows.select(*keys, "pos", "key", F.try_variant_get("value", "$", "string").alias("value"), F.schema_of_variant("value").alias("kind"))


def bounded(x: Column, default: float = 0.0) -> Column:
    """A number clamped to 0..1, ``default`` where missing."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(default))))


def snake_case(struct: Column, names: Mapping[str, str], defaults: Mapping[str, object] | None = None) -> Column:
    """Struct with camel-case fields renamed, missing values defaulted."""
    defaults = defaults or {}
    fields = []
    for camel, snake in names.items():
        value = struct[camel]
        fields.append((F.coalesce(value, F.lit(defaults[snake])) if snake in defaults else value).alias(snake))
    return F.struct(*fields)


def overlay(base: Column, top: Column, fields: Sequence[str]) -> Column:
    """Struct whose fields come from ``top`` where it has them, else from ``base``."""
    return F.struct(*[F.coalesce(top[f], base[f]).alias(f) for f in fields])


def rewrite_layers(layers: Column, clip_url: str, width: Column, height: Column, asset_url: str) -> Column:
    """Layers with the sources that a renderer can reach.

    ``gameplay`` and ``facecam`` layers with a ``video`` get the clip's address and native size; an ``asset``
    whose source is a path of the asset service gets ``asset_url`` with the asset's name.
    """
    name = r"/api/assets/(.+)$"

    def rewritten(x: Column) -> Column:
        video = x["video"].withField("src", F.lit(clip_url)).withField("nativeWidth", width).withField("nativeHeight", height)
        asset = x["asset"].withField("src", F.concat(F.lit(asset_url), F.regexp_extract(x["asset"]["src"], name, 1)))
        plays = x["type"].isin("gameplay", "facecam") & x["video"].isNotNull()
        stored = (x["type"] == "asset") & F.coalesce(x["asset"]["src"].rlike(name), F.lit(False))
        return F.when(plays, x.withField("video", video)).when(stored, x.withField("asset", asset)).otherwise(x)

    return F.transform(layers, rewritten)


def scale_layers(layers: Column, width: Column, height: Column, base: tuple[int, int] = (1080, 1920)) -> Column:
    """Layers scaled from the canvas to an output size.

    A layer has ``transform`` (``x, y, width, height``), ``style`` (``blur, borderRadius``), ``subtitle``, ``text`` and
    ``chat`` (``fontSize``) and ``keyframes`` with the fields of the first two.  Lengths are rounded, halves up;
    blur is not.  A size within a thousandth of the canvas leaves everything as it is.
    """
    sx, sy = width / base[0], height / base[1]
    same = (F.abs(sx - 1) < 0.001) & (F.abs(sy - 1) < 0.001)
    places, looks = (("x", sx), ("y", sy), ("width", sx), ("height", sy)), (("borderRadius", sx),)

    def whole(x: Column, fields: tuple) -> Column:
        for name, s in fields:
            x = x.withField(name, F.floor(x[name] * s + 0.5).cast("double"))
        return x

    def blurred(x: Column) -> Column:
        return x.withField("blur", x["blur"] * sx)

    def scaled(x: Column) -> Column:
        x = x.withField("transform", whole(x["transform"], places)).withField("style", blurred(whole(x["style"], looks)))
        for part in ("subtitle", "text", "chat"):
            x = x.withField(part, whole(x[part], (("fontSize", sx),)))
        return x.withField("keyframes", F.transform(x["keyframes"], lambda k: blurred(whole(k, (*places, *looks)))))

    return F.when(same, layers).otherwise(F.transform(layers, scaled))


def toggle(items: Column, item: Column) -> Column:
    """A set with the item taken out if it is in, else put in at the end."""
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def bounded_history(history: Column, item: Column, most: int) -> Column:
    """The last ``most`` items of a history with one appended."""
    longer = F.array_append(history, item)
    return F.slice(longer, F.greatest(F.lit(1), F.size(longer) - most + 1), most)
