"""Queries over sources, audio classes and write-side transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.operators import audio
from crestline.plans.catalog import query
from crestline.plans.roles import load
from crestline.sources import sinks, tables


@query("""SELECT vec_id, round(greatest(embedding[1], embedding[2], embedding[3])::DOUBLE, 6) AS speech_presence,
  round(embedding[9]::DOUBLE + 0.8 * embedding[11]::DOUBLE, 6) AS vocal_excitement, round(0.6 * embedding[61]::DOUBLE, 6) AS game_audio FROM embeddings""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech, excitement and game levels from a vector of class probabilities."""
    s = audio.class_scores(load(spark, sf_dir, "embeddings"), "embedding", excitement={8: 1.0, 10: 0.8}, game={60: 0.6, 400: 1.0})
    return s.select("vec_id", *[F.round(c, 6).alias(c) for c in ("speech_presence", "vocal_excitement", "game_audio")])


@query("""SELECT p_partkey, round(p_size::DOUBLE + i * ((p_size::DOUBLE + floor(p_retailprice) / 100::DOUBLE) - p_size::DOUBLE) / 5, 1) AS t FROM part, range(0, 6) AS r(i)""")
def frame_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six evenly spaced times in every candidate."""
    start = F.col("p_size").cast("double")
    times = tables.frame_times(start, start + F.col("p_retailprice").cast("long") / 100.0, 6)
    return load(spark, sf_dir, "part").select("p_partkey", F.explode(times).alias("t"))


@query("""WITH c AS (SELECT l_suppkey AS job, l_linenumber AS chunk, l_partkey AS t FROM lineitem),
last AS (SELECT job, chunk, max(t) AS last FROM c GROUP BY job, chunk),
ends AS (SELECT job, chunk, max(last) OVER (PARTITION BY job ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM last)
SELECT c.job, c.chunk, c.t FROM c JOIN ends USING (job, chunk) WHERE b IS NULL OR c.t > b""")
def chunk_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks without what earlier chunks already cover."""
    c = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("job"), F.col("l_linenumber").alias("chunk"), F.col("l_partkey").alias("t"))
    return tables.drop_seams(c, ["job"], "chunk", "t")


@query("SELECT max(CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT)) + 1 AS next FROM pages WHERE regexp_extract(url, '/([0-9]+)', 1) <> ''")
def next_upload_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.next_number(load(spark, sf_dir, "pages"), "url", "/([0-9]+)")


@query("""WITH by_id AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'id' || n_nationkey ELSE '' END AS art FROM nation),
by_name AS (SELECT lower(n_name) AS name, 'name' || n_regionkey AS art FROM nation WHERE n_nationkey % 3 <> 0)
SELECT c_custkey, coalesce(nullif(i.art, ''), m.art, '') AS art FROM customer LEFT JOIN nation n ON n.n_nationkey = c_nationkey LEFT JOIN by_id i ON i.id = c_nationkey LEFT JOIN by_name m ON m.name = lower(n.n_name)""")
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup by id, then by name."""
    n = load(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "id").withColumnRenamed("n_name", "name")
    by_id = n.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("id"), F.col("id").cast("string"))).otherwise("").alias("art"))
    by_name = n.filter("id % 3 <> 0").select("name", F.concat(F.lit("name"), F.col("n_regionkey").cast("string")).alias("art"))
    jobs = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("id")).join(n.select("id", "name"), "id")
    return tables.enrich(jobs, by_id, by_name, "id", "name", "art").select("c_custkey", "art")


@query("""SELECT c_custkey, '{' || concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN '"segment":"NEW"' END, CASE WHEN c_custkey % 3 = 0 THEN '"name":null' END) || '}' AS payload
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def status_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of what changed between two versions of a table."""
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    new = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "NEW").otherwise(F.col("segment")).alias("segment"), F.when(F.col("c_custkey") % 3 != 0, F.col("name")).alias("name"))
    return sinks.status_messages(c, new, "c_custkey", ["segment", "name"])


@query("""SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS segment FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer WHERE c_custkey % 2 = 1""")
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return sinks.evolve([c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), c.filter("c_custkey % 2 = 1").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))])


@query("""SELECT o_orderpriority || chr(10) || 'status: ' || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'key: ' || o_orderkey ELSE '' END AS prompt, o_orderkey FROM orders""")
def prompt_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.operators.external import prompt

    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", prompt(F.col("o_orderpriority"), {"status": F.col("o_orderstatus"), "key": F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey"))}).alias("prompt"))
