"""Catalog queries: jobs are orders, creators customers, renders line items.

Status F stands for done, O for error; priority is the game, the creator's nation the user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.operators import catalog, ranking
from crestline.plans.catalog import query
from crestline.plans.roles import load


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("creator_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("views"), F.col("o_orderdate").cast("timestamp_ntz").alias("created"), F.col("o_orderpriority").alias("game"),
    )


JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS creator_id, o_orderstatus AS status, o_totalprice AS views,
  o_orderdate AS created, o_orderpriority AS game FROM orders)"""


def _creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("creator_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("user_id"), F.col("c_mktsegment").alias("segment")
    )


CREATORS = "creators AS (SELECT c_custkey AS creator_id, c_name AS name, c_nationkey AS user_id, c_mktsegment AS segment FROM customer)"


def _renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("status"),
        F.col("l_extendedprice").alias("size"), F.col("l_shipdate").cast("timestamp_ntz").alias("created"), F.col("l_suppkey").alias("batch"),
    )


RENDERS = """renders AS (SELECT l_orderkey AS job_id, l_linenumber AS ord, l_returnflag AS status, l_extendedprice AS size,
  l_shipdate AS created, l_suppkey AS batch FROM lineitem)"""


@query(f"WITH {JOBS} SELECT job_id, status, game FROM jobs WHERE game ILIKE '%HIGH%' OR status ILIKE '%p%'")
def job_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive search over several columns."""
    return _jobs(spark, sf_dir).filter(catalog.matches_search("HIGH", [F.col("game")]) | catalog.matches_search("p", [F.col("status")])).select("job_id", "status", "game")


@query(f"WITH {JOBS} SELECT job_id, status FROM jobs WHERE status NOT IN ('F', 'O')")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active jobs: neither done nor failed."""
    return catalog.status_class(_jobs(spark, sf_dir), "status", "active", "F", "O").select("job_id", "status")


@query(f"WITH {JOBS} SELECT job_id FROM jobs WHERE game = '1-URGENT' AND status IN ('F', 'P')")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the parameters that are present filter; an IN list on top."""
    wanted = {"creator_id": None, "game": "1-URGENT", "status": ""}
    return catalog.optional_filters(_jobs(spark, sf_dir), wanted).filter(F.col("status").isin("F", "P")).select("job_id")


@query(f"""WITH {JOBS} SELECT job_id, created, status FROM jobs ORDER BY created DESC, job_id LIMIT 20 OFFSET 40""")
def paged_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.page(_jobs(spark, sf_dir), [F.desc("created"), F.asc("job_id")], 3, 20).select("job_id", "created", "status")


@query(f"WITH {JOBS} SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS last_page FROM jobs")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.page_count(_jobs(spark, sf_dir), 20)


@query(f"""WITH {JOBS}, {CREATORS}, {RENDERS}
SELECT (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM jobs WHERE status = 'F') AS done, (SELECT count(*) FROM renders) AS renders,
  (SELECT count(*) FROM creators) AS creators""")
def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the dashboard: one pass over each table, joined as single rows."""
    j = _jobs(spark, sf_dir).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "F").alias("done"))
    r = _renders(spark, sf_dir).agg(F.count(F.lit(1)).alias("renders"))
    return j.join(r).join(_creators(spark, sf_dir).agg(F.count(F.lit(1)).alias("creators")))


@query(f"""WITH {JOBS}, {CREATORS}
SELECT c.creator_id, c.name, count(j.job_id) AS n FROM creators c LEFT JOIN jobs j ON j.creator_id = c.creator_id AND j.status = 'F'
GROUP BY c.creator_id, c.name ORDER BY n DESC, c.creator_id LIMIT 5""")
def top_creators_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, j = _creators(spark, sf_dir), _jobs(spark, sf_dir).withColumnRenamed("creator_id", "owner")
    counts = catalog.outer_counts(c, j, (F.col("owner") == F.col("creator_id")) & (F.col("status") == "F"), ["creator_id", "name"], "job_id")
    return counts.orderBy(F.desc("n"), "creator_id").limit(5)


@query(f"""WITH {JOBS}, {CREATORS}
SELECT c.creator_id, count(j.job_id) AS n, CAST(round(coalesce(avg(j.views), 0)) AS BIGINT) AS avg_views, round(coalesce(sum(j.views), 0), 2) AS views,
  max(j.created) AS last, coalesce(string_agg(DISTINCT j.game, '|' ORDER BY j.game), '') AS games
FROM creators c LEFT JOIN jobs j ON j.creator_id = c.creator_id AND j.status = 'F' GROUP BY c.creator_id""")
def creator_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per creator: done jobs, views, last date and games, creators without jobs included."""
    c, j = _creators(spark, sf_dir), _jobs(spark, sf_dir).withColumnRenamed("creator_id", "owner")
    joined = c.join(j, (F.col("owner") == F.col("creator_id")) & (F.col("status") == "F"), "left")
    # A mean of exactly a half rounds by the last bit of its sum, so views are added up in the order of jobs, wherever they lie.
    w = W.partitionBy("creator_id").orderBy("job_id").rowsBetween(W.unboundedPreceding, 0)
    summed = joined.withColumns({"_place": F.count(F.lit(1)).over(w), "_sum": F.sum("views").over(w)})
    total = F.max_by("_sum", "_place")
    return summed.groupBy("creator_id").agg(
        F.count("job_id").alias("n"),
        F.round(F.coalesce(total / F.nullif(F.count("views"), F.lit(0)), F.lit(0.0))).cast("long").alias("avg_views"),
        F.round(F.coalesce(total, F.lit(0.0)), 2).alias("views"),
        F.max("created").alias("last"),
        F.array_join(F.array_sort(F.collect_set("game")), "|").alias("games"),
    )


@query(f"""WITH {JOBS} SELECT game, count(*) AS n, count(DISTINCT creator_id) AS creators, max(nullif(status, '')) AS status, round(sum(views), 2) AS views
FROM jobs WHERE game IS NOT NULL AND game <> '' GROUP BY game""")
def game_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).filter(catalog.filled("game")).groupBy("game").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("creator_id").alias("creators"), F.max(F.nullif("status", F.lit(""))).alias("status"), F.round(F.sum("views"), 2).alias("views")
    )


@query(f"""WITH {JOBS} SELECT coalesce(nullif(CASE WHEN job_id % 3 = 0 THEN '' ELSE status END, ''), game) AS grp, count(*) AS n FROM jobs GROUP BY 1""")
def group_by_coalesced_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping by an id where it is filled, else by the name."""
    key = F.coalesce(F.nullif(F.when(F.col("job_id") % 3 == 0, "").otherwise(F.col("status")), F.lit("")), F.col("game"))
    return _jobs(spark, sf_dir).groupBy(key.alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {JOBS} SELECT creator_id, max(game) AS thumb, count(*) AS n FROM jobs WHERE creator_id IS NOT NULL GROUP BY creator_id")
def streamer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).filter(F.col("creator_id").isNotNull()).groupBy("creator_id").agg(F.max("game").alias("thumb"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {JOBS} SELECT count(DISTINCT game) AS games, count(DISTINCT creator_id) AS creators, round(avg(views), 4) AS avg_views, round(sum(views), 2) AS views FROM jobs")
def distinct_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).agg(
        F.count_distinct("game").alias("games"), F.count_distinct("creator_id").alias("creators"), F.round(F.avg("views"), 4).alias("avg_views"), F.round(F.sum("views"), 2).alias("views")
    )


@query(f"WITH {JOBS} SELECT creator_id, status, max(game) AS thumb FROM jobs GROUP BY creator_id, status")
def distinct_pairs_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).groupBy("creator_id", "status").agg(F.max("game").alias("thumb"))


@query(f"""WITH {JOBS}, {RENDERS} SELECT r.job_id, r.ord, r.status, j.status AS job_status, j.game FROM renders r JOIN jobs j ON j.job_id = r.job_id""")
def render_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir).select("job_id", F.col("status").alias("job_status"), "game")
    return _renders(spark, sf_dir).join(j, "job_id").select("job_id", "ord", "status", "job_status", "game")


@query(f"""WITH {JOBS}, {RENDERS} SELECT r.job_id, r.ord, j.game FROM renders r LEFT JOIN jobs j ON j.job_id = r.job_id AND j.status <> 'F'""")
def render_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir).filter(F.col("status") != "F").select("job_id", "game")
    return _renders(spark, sf_dir).join(j, "job_id", "left").select("job_id", "ord", "game")


@query(f"""WITH {JOBS}, {RENDERS} SELECT j.job_id, count(r.ord) AS n, coalesce(string_agg(r.ord || ':' || r.status, ',' ORDER BY r.ord, r.status), '') AS renders
FROM jobs j LEFT JOIN renders r ON r.job_id = j.job_id GROUP BY j.job_id""")
def nested_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job with the ordered list of its renders."""
    items = F.array_sort(F.collect_list(F.struct("ord", "status")))
    kids = _renders(spark, sf_dir).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), items.alias("items"))
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x.ord.cast("string"), x.status)), ",")
    return _jobs(spark, sf_dir).select("job_id").join(kids, "job_id", "left").select("job_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(text, F.lit("")).alias("renders"))


@query(f"""WITH {RENDERS} SELECT batch, count(*) AS total, count(*) FILTER (status = 'N') AS done, count(*) FILTER (status = 'R') AS errors,
  count(*) FILTER (status = 'N') = count(*) AS all_done, count(*) FILTER (status = 'R') > 0 AS has_error, max(created) AS last,
  arg_max(job_id, struct_pack(c := created, j := job_id)) AS last_job FROM renders GROUP BY batch""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, bad = F.count_if(F.col("status") == "N"), F.count_if(F.col("status") == "R")
    return _renders(spark, sf_dir).groupBy("batch").agg(
        F.count(F.lit(1)).alias("total"), done.alias("done"), bad.alias("errors"), (done == F.count(F.lit(1))).alias("all_done"), (bad > 0).alias("has_error"),
        F.max("created").alias("last"), F.max_by("job_id", F.struct("created", "job_id")).alias("last_job"),
    )


@query(f"""WITH {RENDERS} SELECT count(*) AS "all", count(*) FILTER (status = 'N') AS done, count(*) FILTER (status = 'A') AS rendering, count(*) FILTER (status = 'R') AS error FROM renders""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    return _renders(spark, sf_dir).agg(F.count(F.lit(1)).alias("all"), F.count_if(s == "N").alias("done"), F.count_if(s == "A").alias("rendering"), F.count_if(s == "R").alias("error"))


@query(f"""WITH {RENDERS} SELECT job_id, ord FROM renders WHERE batch = 7 AND status = 'N' AND size IS NOT NULL""")
def completed_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renders(spark, sf_dir).filter((F.col("batch") == 7) & (F.col("status") == "N") & F.col("size").isNotNull()).select("job_id", "ord")


_QUOTAS = "(1, 'day'), (2, 'month'), (3, 'year'), (8, 'lifetime')"


@query(f"""WITH {JOBS}, quotas AS (SELECT c_custkey AS creator_id, 'jobs:' || p AS key, CAST(l AS INTEGER) AS "limit", p AS period FROM customer, (VALUES {_QUOTAS}) AS q(l, p)),
used AS (
  SELECT q.creator_id, q.key, q."limit", count(j.job_id) FILTER (j.created <= TIMESTAMP '2001-06-15 00:00:00' AND (period = 'lifetime' OR j.created >=
    CASE period WHEN 'day' THEN TIMESTAMP '2001-06-15' WHEN 'month' THEN TIMESTAMP '2001-06-01' ELSE TIMESTAMP '2001-01-01' END)) AS used
  FROM quotas q LEFT JOIN jobs j USING (creator_id) GROUP BY q.creator_id, q.key, q."limit")
SELECT *, greatest(0, "limit" - used) AS remaining, used < "limit" AS allowed FROM used""")
def quota_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of every quota in its period, and what remains."""
    q = spark.sql(f"SELECT CAST(l AS INT) AS `limit`, p AS period FROM VALUES {_QUOTAS} AS q(l, p)")
    quotas = _creators(spark, sf_dir).select("creator_id").crossJoin(F.broadcast(q)).withColumn("key", F.concat(F.lit("jobs:"), F.col("period")))
    return catalog.quota_usage(_jobs(spark, sf_dir), quotas, "creator_id", "created", "2001-06-15 00:00:00")


@query("""WITH grants AS (SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN '*' WHEN 1 THEN 'jobs:*' WHEN 2 THEN 'jobs:read' ELSE 'themes:*' END AS g FROM customer),
wanted AS (SELECT c_custkey AS user_id, p AS permission FROM customer, (VALUES ('jobs:read'), ('jobs:write'), ('themes:read')) AS w(p))
SELECT DISTINCT w.user_id, w.permission FROM wanted w JOIN grants g USING (user_id) WHERE g = '*' OR g = permission OR (ends_with(g, ':*') AND starts_with(permission, replace(g, '*', '')))""")
def permission_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _creators(spark, sf_dir).select(F.col("creator_id").alias("user_id"))
    m = F.col("user_id") % 4
    grants = users.withColumn("grant", F.when(m == 0, "*").when(m == 1, "jobs:*").when(m == 2, "jobs:read").otherwise("themes:*"))
    wanted = users.withColumn("permission", F.explode(F.array(*map(F.lit, ("jobs:read", "jobs:write", "themes:read")))))
    return catalog.permitted(wanted, grants, "user_id", "permission")


@query(f"""WITH {JOBS}, {CREATORS} SELECT j.job_id, c.segment FROM jobs j JOIN creators c ON lower(c.name) = 'customer#' || lpad(CAST(j.creator_id AS VARCHAR), 9, '0')
WHERE lower(c.segment) <> 'building'""")
def lookup_by_lower_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension lookup by a lower-cased name."""
    j = _jobs(spark, sf_dir).select("job_id", F.concat(F.lit("customer#"), F.lpad(F.col("creator_id").cast("string"), 9, "0")).alias("login"))
    c = _creators(spark, sf_dir).filter(F.lower("segment") != "building").select(F.lower("name").alias("login"), "segment")
    return j.join(c, "login").select("job_id", "segment")


@query(f"""WITH {JOBS}, {CREATORS} SELECT creator_id FROM creators WHERE creator_id NOT IN (SELECT creator_id FROM jobs WHERE creator_id IS NOT NULL)""")
def anti_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _creators(spark, sf_dir).join(_jobs(spark, sf_dir), "creator_id", "left_anti").select("creator_id")


@query(f"""WITH {JOBS}, {CREATORS} SELECT creator_id FROM creators WHERE creator_id IN (SELECT creator_id FROM jobs WHERE status = 'P')""")
def semi_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _creators(spark, sf_dir).join(_jobs(spark, sf_dir).filter(F.col("status") == "P"), "creator_id", "left_semi").select("creator_id")


@query(f"""WITH {JOBS}, {CREATORS} SELECT s.segment, count(DISTINCT c.creator_id) AS creators, count(j.job_id) AS jobs, round(sum(j.views) / sum(sum(j.views)) OVER (), 6) AS share
FROM creators c JOIN jobs j USING (creator_id) JOIN (SELECT DISTINCT segment FROM creators) s USING (segment) GROUP BY s.segment""")
def share_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and share of all views; the window runs over one row a segment."""
    joined = _jobs(spark, sf_dir).join(_creators(spark, sf_dir), "creator_id")
    per = joined.groupBy("segment").agg(F.count_distinct("creator_id").alias("creators"), F.count("job_id").alias("jobs"), F.sum("views").alias("_v"))
    return per.select("segment", "creators", "jobs", F.round(F.col("_v") / F.sum("_v").over(W.partitionBy()), 6).alias("share"))


@query(f"""WITH {JOBS} SELECT job_id, coalesce(nullif(CASE WHEN job_id % 2 = 0 THEN '' ELSE 'custom ' || job_id END, ''), game) AS title FROM jobs
ORDER BY title, job_id""")
def sorted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort by the custom title where there is one."""
    custom = F.when(F.col("job_id") % 2 == 0, "").otherwise(F.concat(F.lit("custom "), F.col("job_id").cast("string")))
    return _jobs(spark, sf_dir).select("job_id", F.coalesce(F.nullif(custom, F.lit("")), F.col("game")).alias("title")).orderBy("title", "job_id")


@query(f"""WITH {JOBS} SELECT creator_id, game FROM (
  SELECT creator_id, game, row_number() OVER (PARTITION BY creator_id ORDER BY count(*) DESC, game) AS r FROM jobs GROUP BY creator_id, game) WHERE r = 1""")
def mode_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each creator's most frequent game, the first by name of equals."""
    n = _jobs(spark, sf_dir).groupBy("creator_id", "game").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_n(n, ["creator_id"], [F.desc("n"), F.asc("game")], 1).select("creator_id", "game")


@query(f"""WITH {RENDERS} SELECT batch, round(quantile_cont(size, 0.5), 4) AS p50, round(quantile_cont(size, 0.85), 4) AS p85, round(quantile_cont(size, 0.95), 4) AS p95,
  round(coalesce(var_pop(CASE WHEN ord = 2 THEN NULL ELSE size END), 0), 2) AS variance FROM renders GROUP BY batch""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles, and a variance that skips missing values."""
    p = F.percentile("size", F.array(F.lit(0.5), F.lit(0.85), F.lit(0.95)))
    v = F.coalesce(F.var_pop(F.when(F.col("ord") != 2, F.col("size"))), F.lit(0.0))
    per = _renders(spark, sf_dir).groupBy("batch").agg(p.alias("p"), F.round(v, 2).alias("variance"))
    return per.select("batch", *[F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p50", "p85", "p95"))], "variance")


@query(f"""WITH {JOBS}, {RENDERS} SELECT game, bool_or(r.status = 'R') AS any_error, bool_and(r.size > 1000) AS all_large, max(r.size) > 100000 AS any_huge
FROM renders r JOIN jobs j USING (job_id) GROUP BY game""")
def any_all_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _renders(spark, sf_dir).join(_jobs(spark, sf_dir).select("job_id", "game"), "job_id")
    return joined.groupBy("game").agg(F.bool_or(F.col("status") == "R").alias("any_error"), F.bool_and(F.col("size") > 1000).alias("all_large"), (F.max("size") > 100000).alias("any_huge"))


@query(f"""WITH {JOBS}, scored AS (SELECT job_id, creator_id, (job_id * 37 % 101) / 100.0 AS h, CASE WHEN job_id % 5 = 0 THEN NULL ELSE (job_id * 53 % 101) / 100.0 END AS c FROM jobs),
blend AS (SELECT *, coalesce(c, 0) AS cc, 0.5 * h + 0.5 * coalesce(c, 0) + CASE WHEN coalesce(c, 0) > 0.8 AND h < 0.3 THEN 0.15 WHEN coalesce(c, 0) < 0.1 AND h > 0.5 THEN -0.1 ELSE 0 END AS b FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY round(b, 9) DESC, job_id) AS rank FROM blend)
SELECT job_id, creator_id, round(b, 6) AS blend, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5""")
def blend_rescue_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended pre-ranking, the best five of each creator."""
    b = ranking.blended(F.col("h"), F.col("c"))
    scored = _scored(spark, sf_dir).withColumn("b", b)
    return ranking.top_n(scored, ["creator_id"], [F.round("b", 9).desc(), F.asc("job_id")], 5).select("job_id", "creator_id", F.round("b", 6).alias("blend"), "rank")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select(
        "job_id", "creator_id", ((F.col("job_id") * 37 % 101) / 100.0).alias("h"), F.when(F.col("job_id") % 5 != 0, (F.col("job_id") * 53 % 101) / 100.0).alias("c")
    )


_SCORED = "scored AS (SELECT job_id, creator_id, (job_id * 37 % 101) / 100.0 AS h, CASE WHEN job_id % 5 = 0 THEN NULL ELSE (job_id * 53 % 101) / 100.0 END AS c FROM jobs)"


@query(f"""WITH {JOBS}, {_SCORED} SELECT count(*) FILTER (h < 0.3 AND c > 0.6) AS rescued, count(*) FILTER (h > 0.5 AND coalesce(c, 0) < 0.1) AS demoted FROM scored""")
def rescue_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, c = F.col("h"), F.col("c")
    return _scored(spark, sf_dir).agg(F.count_if((h < 0.3) & (c > 0.6)).alias("rescued"), F.count_if((h > 0.5) & (F.coalesce(c, F.lit(0.0)) < 0.1)).alias("demoted"))


@query(f"""WITH {JOBS}, {_SCORED}, final AS (SELECT *, round(0.2 * h + 0.8 * coalesce(c, 0), 3) AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY coalesce(score, -1) DESC, job_id) AS rank FROM final)
SELECT job_id, creator_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3""")
def final_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumn("score", ranking.final_score(F.col("h"), F.col("c")))
    return ranking.top_n(scored, ["creator_id"], [F.coalesce("score", F.lit(-1.0)).desc(), F.asc("job_id")], 3).select("job_id", "creator_id", "score", "rank")


@query(f"""WITH {JOBS}, {_SCORED}, t AS (SELECT *, row_number() OVER (ORDER BY round(0.4 * h + 0.6 * coalesce(c, 0.5), 9) DESC, job_id) AS r FROM scored)
SELECT job_id, round(0.4 * h + 0.6 * coalesce(c, 0.5), 6) AS triage FROM t WHERE r <= 20""")
def triage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged top-k by triage score."""
    t = _scored(spark, sf_dir).withColumn("t", ranking.triage_score(F.col("h"), F.col("c")))
    return t.orderBy(F.round("t", 9).desc(), "job_id").limit(20).select("job_id", F.round("t", 6).alias("triage"))


@query(f"""WITH {RENDERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY coalesce(CASE WHEN ord = 3 THEN NULL ELSE round(size, 0) END, -1) DESC, ord) AS r FROM renders)
SELECT job_id, ord FROM ranked WHERE r = 1""")
def dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One render a job: the largest score, null last, the earliest of equals."""
    score = F.when(F.col("ord") != 3, F.round("size", 0))
    return ranking.keep_best(_renders(spark, sf_dir), ["job_id"], score, "ord").select("job_id", "ord")


@query("SELECT DISTINCT event_type, user_id, date_trunc('hour', ts) AS hour FROM events")
def dedup_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct on a composite key."""
    e = load(spark, sf_dir, "events").select("event_type", "user_id", F.expr("date_trunc('HOUR', CAST(ts AS TIMESTAMP_NTZ))").alias("hour"))
    return e.dropDuplicates()


@query(f"""WITH {RENDERS}, firsts AS (SELECT batch, created, arg_min(size, struct_pack(j := job_id, o := ord)) AS shared FROM renders GROUP BY batch, created)
SELECT job_id, ord, round(shared, 2) AS shared FROM renders JOIN firsts USING (batch, created)""")
def propagate_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings take the value of the first of their group."""
    r = _renders(spark, sf_dir)
    first = r.groupBy("batch", "created").agg(F.min_by("size", F.struct("job_id", "ord")).alias("shared"))
    return r.join(first, ["batch", "created"]).select("job_id", "ord", F.round("shared", 2).alias("shared"))


@query(f"""WITH {JOBS} SELECT job_id, 'done' AS source FROM jobs WHERE status = 'F'
UNION ALL SELECT job_id, 'active' FROM jobs WHERE status NOT IN ('F', 'O')""")
def merge_ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir)
    a = j.filter(F.col("status") == "F").select("job_id", F.lit("done").alias("source"))
    return a.unionByName(catalog.status_class(j, "status", "active", "F", "O").select("job_id", F.lit("active").alias("source")))


@query(f"""WITH {JOBS}, new AS (SELECT job_id, CASE WHEN job_id % 2 = 0 THEN 'X' END AS status, CAST(NULL AS DOUBLE) AS views FROM jobs)
SELECT j.job_id, coalesce(n.status, j.status) AS status, coalesce(n.views, j.views) AS views FROM jobs j LEFT JOIN new n USING (job_id)""")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir).select("job_id", "status", "views")
    new = j.select("job_id", F.when(F.col("job_id") % 2 == 0, "X").alias("status"), F.lit(None).cast("double").alias("views"))
    return catalog.merge_partial(j, new, "job_id")


@query(f"""WITH {JOBS} SELECT job_id, status FROM jobs UNION ALL SELECT 2 * job_id, 'NEW' FROM jobs WHERE 2 * job_id NOT IN (SELECT job_id FROM jobs)""")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir).select("job_id", "status")
    return catalog.insert_absent(j, j.select((F.col("job_id") * 2).alias("job_id"), F.lit("NEW").alias("status")), "job_id")


@query(f"""WITH {RENDERS}, {JOBS} SELECT r.job_id, r.ord FROM renders r JOIN jobs j USING (job_id) WHERE j.status <> 'P'""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renders that remain once all active jobs are deleted."""
    gone = _jobs(spark, sf_dir).filter(F.col("status") == "P")
    return catalog.cascade_delete({"renders": (_renders(spark, sf_dir), "job_id")}, gone, "job_id")["renders"].select("job_id", "ord")


@query(f"""WITH {CREATORS} SELECT creator_id, CASE WHEN user_id = 3 THEN creator_id = (SELECT min(creator_id) FROM creators WHERE user_id = 3) ELSE creator_id % 2 = 0 END AS is_default FROM creators""")
def exclusive_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _creators(spark, sf_dir).withColumn("is_default", F.col("creator_id") % 2 == 0)
    first = c.filter("user_id = 3").agg(F.min("creator_id").alias("_first"))
    return catalog.exclusive_flag(c.crossJoin(F.broadcast(first)), F.col("user_id") == 3, F.col("creator_id") == F.col("_first"), "is_default").select("creator_id", "is_default")


@query(f"""WITH {JOBS}, {CREATORS} SELECT c.creator_id, t.layer, c.name || '/' || t.layer AS path FROM creators c, (VALUES ('title'), ('chat'), ('subtitle')) AS t(layer)""")
def template_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip environment with every layer of a small template."""
    layers = spark.sql("SELECT * FROM VALUES ('title'), ('chat'), ('subtitle') AS t(layer)")
    c = _creators(spark, sf_dir).crossJoin(F.broadcast(layers))
    return c.select("creator_id", "layer", F.concat_ws("/", "name", "layer").alias("path"))


@query(f"""WITH {RENDERS}, clusters AS (SELECT job_id, batch % 3 AS cl, count(*) AS clips, count(*) * 2 AS detections, stddev_pop(size) / avg(size) AS spread, sum(size) AS area FROM renders GROUP BY 1, 2),
sized AS (SELECT *, sum(clips) OVER (PARTITION BY job_id) AS total FROM clusters),
best AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY clips DESC, detections DESC, area) AS r FROM sized WHERE clips >= greatest(2, ceil(total / 2.0)) AND spread < 0.25)
SELECT job_id, cl, clips FROM best WHERE r = 1""")
def cluster_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest cluster of steady size of each job."""
    n = F.count(F.lit(1))
    c = _renders(spark, sf_dir).groupBy("job_id", (F.col("batch") % 3).alias("cl")).agg(
        n.alias("clips"), (n * 2).alias("detections"), (F.stddev_pop("size") / F.avg("size")).alias("spread"), F.sum("size").alias("area")
    )
    sized = c.withColumn("total", F.sum("clips").over(W.partitionBy("job_id")))
    return ranking.robust_cluster(sized, ["job_id"], F.col("total")).select("job_id", "cl", "clips")
