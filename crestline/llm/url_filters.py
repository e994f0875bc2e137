"""Temporal list join: URL lists whose entries come and go.

A list is a log of dated additions and removals.  Each addition becomes a validity
interval that ends with the next removal of the same pattern, and an as-of join evaluates
each capture against the entries that were active when it was fetched.  The most specific
active entry decides.  Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A list log of at most this many rows is broadcast; a longer one is shuffled and salted.
LIST_BROADCAST_ROWS = 100_000
#: Copies of each interval in the salted join.
SALT = 16

#: The production list log: list, effect, kind, pattern, action, effective date.  Fixed values.
DEFAULT_LOG = (
    ("ads", "block", "domain", "ads-track.example.org", "add", "2024-01-15"),
    ("ads", "block", "domain", "ads-track.example.org", "remove", "2024-05-01"),
    ("ads", "block", "domain", "ads-track.example.org", "add", "2024-07-01"),
    ("spam", "block", "domain", "spam-farm.example.org", "add", "2023-11-20"),
    ("spam", "block", "domain", "cheap-pills.example.com", "add", "2024-02-10"),
    ("spam", "block", "domain", "cheap-pills.example.com", "remove", "2024-11-05"),
    ("gambling", "block", "domain", "free-bets.example.com", "add", "2024-03-01"),
    ("gambling", "block", "host", "m.free-bets.example.com", "add", "2023-06-01"),
    ("editorial", "block", "prefix", "spam-farm.example.org/fr", "add", "2024-04-01"),
    ("partners", "allow", "prefix", "spam-farm.example.org/de", "add", "2024-06-01"),
    ("partners", "allow", "prefix", "spam-farm.example.org/de", "remove", "2024-09-01"),
    ("partners", "allow", "host", "blog.spam-farm.example.org", "add", "2024-01-01"),
    ("partners", "allow", "prefix", "www.free-bets.example.com/en", "add", "2024-08-15"),
    ("mirrors", "block", "domain", "ththth.example.net", "add", "2024-10-01"),
    ("mirrors", "block", "domain", "tionsh.example.net", "add", "2024-02-01"),
    ("mirrors", "block", "domain", "tionsh.example.net", "remove", "2024-02-20"),
)


def default_log(spark: SparkSession) -> DataFrame:
    """The production list log as a DataFrame."""
    values = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in DEFAULT_LOG)
    return spark.sql(
        "SELECT list, effect, kind, pattern, action, to_date(effective) AS effective "
        f"FROM VALUES {values} AS t(list, effect, kind, pattern, action, effective)"
    )


def validity_intervals(log: DataFrame) -> DataFrame:
    """Dated additions and removals to intervals ``[valid_from, valid_to)``.

    A repeated addition or removal changes nothing; on one day a removal comes after an
    addition.  Rows with a null pattern, kind, action or date are void.  Hosts in patterns
    are written in lower case.
    """
    key = ["list", "effect", "kind", "pattern"]
    order = W.partitionBy(*key).orderBy("effective", "action")
    clean = log.select(*key, "action", "effective").na.drop(subset=["kind", "pattern", "effective", "action"])
    edges = clean.withColumn("_was", F.lag("action").over(order)).filter(
        F.when(F.col("action") == "add", ~F.col("_was").eqNullSafe("add")).otherwise(F.col("_was").eqNullSafe("add"))
    )
    return (
        edges.withColumn("valid_to", F.lead("effective").over(order))
        .filter(F.col("action") == "add")
        .select(*key, F.col("effective").alias("valid_from"), "valid_to")
        .filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    )


def url_host(url: Column) -> Column:
    """Host of an absolute URL, lower case, without user, port and final dot; else null."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.regexp_replace(F.lower(host), r"\.$", "")
    return F.when(host != "", host)


def url_path(url: Column) -> Column:
    """Path of an absolute URL, without query, fragment and closing slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def _lookup_keys(host: Column, path: Column, deepest: int) -> Column:
    """Every pattern that could match: the host, its parent domains, its path prefixes as far as the ``deepest`` pattern goes."""
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("domain "), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(deepest))),
        lambda i: F.concat(F.lit("prefix "), host, F.array_join(F.slice(parts, 1, i), "/")),
    )
    return F.array_distinct(F.concat(domains, prefixes, F.array(F.concat(F.lit("host "), host))))


def filter_urls(
    captures: DataFrame, log: DataFrame, fetched_at: Column, broadcast_rows: int = LIST_BROADCAST_ROWS
) -> DataFrame:
    """One verdict for each row of ``captures`` (``page_id``, ``url``).

    ``fetched_at`` is a date column over the captures.  Other columns are ignored.  A null
    URL, one without a host, and a null fetch date match no entry.  Among the
    active entries the longest pattern decides, then the narrower kind (prefix, host,
    domain), then a block before an allow, then the list name.  Repeated rows each get their verdict.
    """
    pages = captures.select("page_id", "url", fetched_at.cast("date").alias("fetched_at"))
    pages = pages.withColumn("host", url_host(F.col("url")))
    spans = validity_intervals(log).select(
        F.concat_ws(" ", "kind", "pattern").alias("_key"), "list", "effect", "kind", "pattern", "valid_from", "valid_to"
    )
    depth = F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")))
    n_spans, deepest = spans.agg(F.count(F.lit(1)), F.coalesce(F.max(depth), F.lit(1))).first()
    keyed = (
        pages.filter(F.col("host").isNotNull() & F.col("fetched_at").isNotNull())
        .select("page_id", "url", "fetched_at", F.explode(_lookup_keys(F.col("host"), url_path(F.col("url")), deepest)).alias("_key"))
    )
    active = (F.col("fetched_at") >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))
    )
    if n_spans <= broadcast_rows:
        hits = keyed.join(F.broadcast(spans), "_key").filter(active)
    else:
        salts = spans.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
        hits = salted.join(salts, ["_key", "_salt"]).filter(active).drop("_salt")
    narrow = F.when(F.col("kind") == "prefix", 2).when(F.col("kind") == "host", 1).otherwise(0)
    entry = F.struct(
        (-F.length("pattern")).alias("a"), (-narrow).alias("b"), F.when(F.col("effect") == "block", 0).otherwise(1).alias("c"),
        F.col("list").alias("d"), F.col("kind"), F.col("pattern"), F.col("effect"),
    )
    verdicts = hits.groupBy("page_id", "url", "fetched_at").agg(
        F.size(F.collect_set(entry)).cast("long").alias("n_active"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.min(entry).alias("_best"),
    )
    on = F.col("p.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("p.url") == F.col("v.url")) & (
        F.col("p.fetched_at") == F.col("v.fetched_at")
    )
    return pages.alias("p").join(verdicts.alias("v"), on, "left").select(
        "p.page_id",
        "p.url",
        "p.fetched_at",
        "p.host",
        F.coalesce("v.n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("v.lists", F.lit("")).alias("lists"),
        F.concat_ws(" ", "v._best.kind", "v._best.pattern").alias("rule"),
        (F.coalesce(F.col("v._best.effect"), F.lit("")) == "block").alias("blocked"),
    )
