"""Queries over the functions on text, documents, keyframes and sets that other plans do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions import scalars
from crestline.operators import keyframes, nested, ranking, sequences, vectors
from crestline.plans.catalog import query
from crestline.plans.roles import load


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def compact_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in eight digits spelled out; what is no such date is kept."""
    o = load(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey").cast("string")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select("o_orderkey", scalars.compact_date(text).alias("day"))


@query("SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 1234567 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders")
def utc_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments as ISO text in UTC, whatever the session's zone."""
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.utc_stamp(F.col("o_orderkey") * 1234567).alias("stamp"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '%' AS discount, CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) || '%' AS tax FROM lineitem")
def percent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", scalars.percent(F.col("l_discount")).alias("discount"), scalars.percent(F.col("l_tax")).alias("tax"))


@query(r"""WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '```json' || chr(10) || text || chr(10) || '```' WHEN 1 THEN '  ```' || text || '```  ' ELSE text END AS t FROM documents)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '^\s*```[A-Za-z]*\s*', ''), '\s*```\s*$', ''), ' ')) AS body FROM f""")
def fenced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the code fence around them."""
    fenced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```")))
    fenced = fenced.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  ```"), F.col("text"), F.lit("```  "))).otherwise(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(scalars.strip_fences(fenced).cast("binary")).alias("body"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 1 ELSE 2 END AS n,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS first FROM events""")
def first_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of a JSON object that is a list."""
    u = F.col("user_id").cast("string")
    text = F.when(F.col("event_id") % 4 == 0, F.lit('{"a": 1}')).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"a": "x", "b": ['), u, F.lit("]}")))
    text = text.otherwise(F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit(', "b": ['), u, F.lit(', 7], "c": [9]}')))
    found = nested.first_list(text, "bigint")
    return load(spark, sf_dir, "events").select("event_id", F.when(found.isNotNull(), F.size(found)).alias("n"), F.try_element_at(found, F.lit(1)).alias("first"))


@query("""WITH p AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events)
SELECT event_id, key, json_extract_string(props, '$.' || key) AS value, json_type(props, '$.' || key) IN ('UBIGINT', 'BIGINT') AS whole FROM p""")
def property_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of the events' open property documents, with its value as text and whether that is a whole number."""
    e = nested.entries(load(spark, sf_dir, "events"), "props", ["event_id"])
    return e.select("event_id", "key", "value", (F.col("kind") == "BIGINT").alias("whole"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'https://clip' WHEN s_suppkey % 3 = 1 THEN 'own' END AS video_src, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey ELSE 1 END AS width,
  CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 2 THEN 'https://assets/' || s_name WHEN s_suppkey % 3 = 2 THEN 'data:' || s_name END AS asset_src FROM supplier""")
def layer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers with the addresses that a renderer can reach."""
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "gameplay").when(k % 3 == 1, "image").otherwise("asset")
    video = F.when(k % 3 != 2, F.struct(F.lit("own").alias("src"), F.lit(1).alias("nativeWidth"), F.lit(1).alias("nativeHeight")))
    asset = F.when(k % 3 == 2, F.struct(F.concat(F.when(k % 2 == 0, "http://host/api/assets/").otherwise("data:"), F.col("s_name")).alias("src")))
    layers = F.array(F.struct(kind.alias("type"), video.alias("video"), asset.alias("asset")))
    s = load(spark, sf_dir, "supplier").withColumn("layers", layers)
    new = s.select("s_suppkey", F.explode(nested.rewrite_layers(F.col("layers"), "https://clip", F.col("s_nationkey"), F.col("s_nationkey"), "https://assets/")).alias("x"))
    return new.select("s_suppkey", F.col("x.video.src").alias("video_src"), F.coalesce(F.col("x.video.nativeWidth"), F.lit(1)).alias("width"), F.col("x.asset.src").alias("asset_src"))


@query("""WITH p AS (SELECT p_partkey, p_size, p_retailprice, CASE WHEN p_partkey % 4 = 0 THEN 1.0::DOUBLE ELSE p_size / 20.0::DOUBLE END AS s FROM part),
q AS (SELECT *, CASE WHEN abs((1080 * s) / 1080 - 1) < 0.001 AND abs((1920 * s) / 1920 - 1) < 0.001 THEN NULL ELSE (1080 * s) / 1080 END AS sx, (1920 * s) / 1920 AS sy FROM p)
SELECT p_partkey, CASE WHEN sx IS NULL THEN p_size ELSE floor(p_size * sx + 0.5) END AS x, CASE WHEN sx IS NULL THEN p_size ELSE floor(p_size * sy + 0.5) END AS height,
  CASE WHEN sx IS NULL THEN 3.5 ELSE round(3.5 * sx, 6) END AS blur, CASE WHEN sx IS NULL THEN 40 ELSE floor(40 * sx + 0.5) END AS font,
  CASE WHEN sx IS NULL THEN p_size ELSE floor(p_size * sx + 0.5) END AS key_width FROM q""")
def layer_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers scaled to an output size; one within a thousandth of the canvas stays."""
    size = F.col("p_size").cast("double")
    place = [size.alias(c) for c in ("x", "y", "width", "height")]
    look = [F.lit(3.5).alias("blur"), F.lit(8.0).alias("borderRadius")]
    font = lambda n: F.struct(F.lit(n).alias("fontSize"))
    layer = F.struct(F.struct(*place).alias("transform"), F.struct(*look).alias("style"), font(40.0).alias("subtitle"), font(30.0).alias("text"), font(20.0).alias("chat"), F.array(F.struct(*place, *look)).alias("keyframes"))
    by = F.when(F.col("p_partkey") % 4 == 0, 1.0).otherwise(F.col("p_size") / 20.0)
    p = load(spark, sf_dir, "part").withColumns({"layers": F.array(layer), "by": by})
    out = p.select("p_partkey", F.explode(nested.scale_layers(F.col("layers"), 1080 * F.col("by"), 1920 * F.col("by"))).alias("l"))
    return out.select("p_partkey", F.col("l.transform.x").alias("x"), F.col("l.transform.height").alias("height"), F.round("l.style.blur", 6).alias("blur"), F.col("l.subtitle.fontSize").alias("font"), F.element_at("l.keyframes", 1)["width"].alias("key_width"))


@query("SELECT c_custkey AS cust_key, c_name AS full_name, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, 'none') AS segment FROM customer")
def snake_case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camel-case fields renamed, missing ones defaulted."""
    row = F.struct(F.col("c_custkey").alias("custKey"), F.col("c_name").alias("fullName"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("mktSegment"))
    c = load(spark, sf_dir, "customer").withColumn("row", row)
    named = nested.snake_case(F.col("row"), {"custKey": "cust_key", "fullName": "full_name", "mktSegment": "segment"}, {"segment": "none"})
    return c.select(named.alias("r")).select("r.*")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c, frames``: a customer's orders as keyframes, in order of their keys."""
    frame = F.struct(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 97) / 10.0).alias("time"), F.col("o_totalprice").alias("x"))
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list(frame)).alias("frames"))


_FRAMES = "frames AS (SELECT o_custkey AS c, o_orderkey AS id, (o_orderkey % 97) / 10.0::DOUBLE AS t, o_totalprice AS x FROM orders)"


@query(f"""WITH {_FRAMES}, near AS (SELECT c, min(id) AS id FROM frames WHERE abs(t - (c % 10)::DOUBLE) <= 0.15 GROUP BY c)
SELECT c, id, id IS NOT NULL AS there FROM (SELECT DISTINCT c FROM frames) LEFT JOIN near USING (c)""")
def keyframe_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first keyframe of a layer near a time."""
    now = (F.col("c") % 10).cast("double")
    return _frames(spark, sf_dir).select("c", keyframes.find_keyframe(F.col("frames"), now)["id"].alias("id"), keyframes.has_keyframe(F.col("frames"), now).alias("there"))


@query(f"""WITH {_FRAMES}, spot AS (SELECT c, min(id) FILTER (abs(t - (c % 10)::DOUBLE) < 0.15) AS id FROM frames GROUP BY c),
new AS (SELECT f.c, f.id, f.t FROM frames f JOIN spot s ON s.c = f.c WHERE s.id IS NULL OR f.id <> s.id UNION ALL SELECT c, -1, (c % 10)::DOUBLE FROM spot)
SELECT c, count(*) AS n, round(sum(t), 6) AS total, count(*) FILTER (id = -1) AS fresh, string_agg(CAST(CAST(round(t * 10) AS BIGINT) AS VARCHAR), ',' ORDER BY t) AS times FROM new GROUP BY c""")
def keyframe_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyframe put in place of the first near one, or inserted; in order of time."""
    new = F.struct(F.lit(-1).cast("long").alias("id"), (F.col("c") % 10).cast("double").alias("time"), F.lit(0.0).alias("x"))
    out = _frames(spark, sf_dir).select("c", keyframes.upsert_keyframe(F.col("frames"), new).alias("f"))
    total = F.aggregate("f", F.lit(0.0), lambda s, k: s + k["time"])
    times = F.array_join(F.transform("f", lambda k: F.round(k["time"] * 10).cast("long").cast("string")), ",")
    return out.select("c", F.size("f").cast("long").alias("n"), F.round(total, 6).alias("total"), F.size(F.filter("f", lambda k: k["id"] == -1)).cast("long").alias("fresh"), times.alias("times"))


@query("""WITH s AS (SELECT o_orderkey AS k, o_custkey % 3 AS a, (o_orderkey % 50) / 10.0::DOUBLE AS t, 1 + o_orderkey % 3 AS d FROM orders),
u AS (SELECT *, greatest(0, least(1, (t - 1) / d)) AS p, greatest(0, least(1, (t - 3) / 1)) AS q FROM s)
SELECT k, round(greatest(0, least(1, (0 + 1 * p * p) * (1 - 0.5 * q) * least(1, t / 0.5) * least(1, (5 - t) / 2))), 6) AS opacity, round((2 - p * p) * 1, 6) AS scale, round(a * 10 * (1 - p * p) + 4 * q, 6) AS x FROM u""")
def animation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two animations and a plain fade make of a layer at a time."""
    value = lambda **v: [F.lit(float(x)).alias(k) if not hasattr(x, "cast") else x.cast("double").alias(k) for k, x in v.items()]
    shift = (F.col("o_custkey") % 3) * 10
    rise = F.struct(F.lit(1.0).alias("begin"), (1 + F.col("o_orderkey") % 3).cast("double").alias("duration"), F.lit("easeIn").alias("easing"), *value(opacity_from=0, opacity_to=1, scale_from=2, scale_to=1, x_from=shift, x_to=0, y_from=0, y_to=0))
    slide = F.struct(F.lit(3.0).alias("begin"), F.lit(1.0).alias("duration"), F.lit("linear").alias("easing"), *value(opacity_from=1, opacity_to=0.5, scale_from=1, scale_to=1, x_from=F.lit(0), x_to=4, y_from=0, y_to=0))
    t = (F.col("o_orderkey") % 50) / 10.0
    state = keyframes.compose_animations(F.array(rise, slide), t, F.lit(5.0), (F.lit(0.5), F.lit(2.0)))
    s = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), state.alias("s"))
    return s.select("k", *[F.round(f"s.{c}", 6).alias(c) for c in ("opacity", "scale", "x")])


@query("""WITH p AS (SELECT event_type, user_id, max(value) / 490 AS hot, max(value % 1) AS rest, max(CASE WHEN user_id % 2 = 0 THEN 0.005 ELSE 0.5 END) AS flag FROM events GROUP BY event_type, user_id)
SELECT event_type, user_id, s AS signal FROM (SELECT event_type, user_id, unnest(['hot', 'rest', 'flag']) AS s, unnest([hot, rest, flag]) AS v FROM p) WHERE v > 0.01""")
def active_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals that pass a hundredth in some point of a stream."""
    e = load(spark, sf_dir, "events").select("event_type", "user_id", (F.col("value") / 490).alias("hot"), (F.col("value") % 1).alias("rest"), F.when(F.col("user_id") % 2 == 0, 0.005).otherwise(0.5).alias("flag"))
    return ranking.active_signals(e, ["event_type", "user_id"], ["hot", "rest", "flag"])


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN NULL WHEN 'R' THEN '' ELSE 'clip.mp4' END AS file FROM lineitem)
SELECT l_orderkey, l_linenumber FROM c WHERE file <> ''""")
def candidates_with_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.when(F.col("l_returnflag") == "R", "").when(F.col("l_returnflag") != "N", "clip.mp4")
    return ranking.with_clip(load(spark, sf_dir, "lineitem").withColumn("file", file), "file").select("l_orderkey", "l_linenumber")


@query("""WITH kept AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) - 1 AS place FROM lineitem WHERE l_quantity > 20)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, CAST(k.place AS INTEGER) AS place FROM lineitem l JOIN kept k ON k.l_orderkey = l.l_orderkey AND k.l_linenumber = l.l_linenumber""")
def renumbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows re-keyed to the place of their candidate among those kept."""
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.struct("l_extendedprice", "l_linenumber").alias("rank"))
    return ranking.renumbered(line.drop("rank", "l_quantity"), line.filter("l_quantity > 20"), ["l_orderkey"], "l_linenumber", "rank").withColumn("place", F.col("place").cast("int"))


@query("SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS transcript FROM conversations GROUP BY conv_id")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in order of time, an empty line between."""
    t = ranking.transcript(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.concat(F.col("role"), F.lit(": "), F.col("text")))
    return t.select("conv_id", F.md5(F.col("transcript").cast("binary")).alias("transcript"))


@query("""WITH p AS (SELECT p_partkey, range(1, p_size % 7 + 2) AS items, p_partkey % 9 AS item FROM part)
SELECT p_partkey, array_to_string(CASE WHEN list_contains(items, item) THEN list_filter(items, lambda x: x <> item) ELSE list_append(items, item) END, ',') AS toggled,
  array_to_string(list_append(items, item)[-4:], ',') AS history FROM p""")
def toggled_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item taken out of a set or put in, and the last four items of a history."""
    items, item = F.sequence(F.lit(1).cast("long"), (F.col("p_size") % 7 + 1).cast("long")), (F.col("p_partkey") % 9).cast("long")
    text = lambda x: F.array_join(x.cast("array<string>"), ",")
    return load(spark, sf_dir, "part").select("p_partkey", text(nested.toggle(items, item)).alias("toggled"), text(nested.bounded_history(items, item, 4)).alias("history"))


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE role IS NULL OR role NOT IN ('system') GROUP BY conv_id")
def shown_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return c.filter(sequences.not_hidden(F.col("role"), ["system"])).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, regexp_matches(name, '^[A-Za-z0-9_-]+$') AS valid, regexp_replace(name, '[^A-Za-z0-9_.-]', '', 'g') AS safe FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, '#', ' ') ELSE replace(c_name, '#', '_') END AS name FROM customer)")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.replace("c_name", F.lit("#"), F.lit(" "))).otherwise(F.replace("c_name", F.lit("#"), F.lit("_")))
    return load(spark, sf_dir, "customer").select("c_custkey", scalars.is_identifier(name).alias("valid"), scalars.safe_name(name).alias("safe"))


@query("""WITH RECURSIVE b AS (SELECT p_partkey // 50 AS clip, p_partkey AS k, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS i, CAST(p_size AS DOUBLE) AS x, p_retailprice % 50 AS y FROM part),
step AS (
  SELECT clip, k, i, 0 AS cluster, [struct_pack(x := x, y := y, n := 1)] AS cs FROM b WHERE i = 1
  UNION ALL
  SELECT clip, k, i, coalesce(hit, len(cs) + 1) - 1, CASE WHEN hit IS NULL THEN list_append(cs, struct_pack(x := x, y := y, n := 1))
    ELSE list_transform(cs, lambda c, j: CASE WHEN j = hit THEN struct_pack(x := c.x + x, y := c.y + y, n := c.n + 1) ELSE c END) END
  FROM (SELECT b.clip, b.k, b.i, b.x, b.y, step.cs, list_min(list_filter(list_transform(step.cs, lambda c, j: CASE WHEN sqrt((b.x - c.x / c.n) ** 2 + (b.y - c.y / c.n) ** 2) <= 12 THEN j END), lambda z: z IS NOT NULL)) AS hit
    FROM step JOIN b ON b.clip = step.clip AND b.i = step.i + 1))
SELECT CAST(clip AS BIGINT) AS clip, k AS p_partkey, CAST(cluster AS INTEGER) AS cluster FROM step""")
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent clustering of boxes; the twin takes a box of each clip a step."""
    p = load(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("clip"), "p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") % 50).alias("y"), F.lit(12.0).alias("r"))
    return vectors.leader_clusters(p, "clip", "p_partkey", "x", "y", "r").select("clip", "p_partkey", "cluster")
