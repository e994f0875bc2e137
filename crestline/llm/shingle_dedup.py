"""SimHash near-dedup for filtering: covering search on five-word fingerprints, verified by Jaccard.

Texts with one set of five-word shingles are one node.  The covering tables of operator 7
propose every pair of nodes whose SimHash fingerprints are within its radius.  A similarity of
0.8 leaves fingerprints of 64 bits some 10 bits apart, which no covering search of useful
cost reaches; for such pairs the tables are joined by MinHash bands: two nodes at similarity ``s`` share
none of the ``BANDS`` keys of ``ROWS`` minima with chance ``(1 - s ** ROWS) ** BANDS``, 3e-4 at
0.8 and 1e-5 at 0.85.  Every proposed pair whose nodes are not yet connected is verified on the whole
sets.  Buckets are settled in rounds: a few pivots are held against all others, what is verified is
contracted, the pivots leave; last, all pairs of a bucket that are still apart are compared where the bucket
lies, each pair in the first bucket that it shares; large buckets are split into pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline.llm._common import row_hash, stage, unstage
from crestline.llm._components import components, runs, split_buckets
from crestline.llm.simhash import first_of_each, majority, masks, shingle_hashes

SHINGLE, SEED, BANDS, ROWS = 5, 42, 20, 5
#: The least similarity of near copies, as a fraction.
OVER, UNDER = 4, 5
#: Pivots of a bucket in each round.
PIVOTS = (1, 2, 4)
#: Nodes of a bucket whose pairs one task compares at the end.
CHUNK = 512
#: First nodes of a block of pairs, and partners of one of them in a part.
BLOCK, PAIRS = 512, 1 << 12
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.array(masks(), dtype=np.int64).view(np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(text, SHINGLE))


def node(found: np.ndarray) -> int:
    """The id of a shingle set; 0 for the empty one."""
    return xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED) if len(found) else 0


def keys(found: np.ndarray, fp: int) -> list[int]:
    """The signed bucket keys of a shingle set: its bands, and its fingerprint's covering tables; none for the empty one."""
    if not len(found):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (_FACTORS[:, None] * found[None, at : at + 4096]).min(axis=1), out=least)
    buckets = [*least.astype("<u8").reshape(BANDS, ROWS), *(np.uint64(fp) & _MASKS).astype("<u8")]
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(buckets)], dtype=np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have Jaccard similarity ``OVER / UNDER`` or more."""
    if len(a) > len(b):
        a, b = b, a
    if UNDER * len(a) < OVER * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def _read(docs: DataFrame) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                hashes = shingle_hashes(text, SHINGLE)
                found = np.unique(hashes)
                rows.append((node(found), len(found), keys(found, majority(hashes))))
            ids = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "_h": batch["_h"], "sid": ids, "n": [r[1] for r in rows], "keys": [r[2] for r in rows]})

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("_h", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", "_h", "text").mapInPandas(read, schema)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sid, items`` of the ``wanted`` nodes (``sid``, and ``_h``: the hash of a row that has its set)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t) for t in batch["text"]]
            ids = np.array([node(s) for s in found], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"sid": ids, "items": [s.astype("<u8").tobytes() for s in found]})

    texts = docs.select("_h", "text").join(wanted.select("_h"), "_h", "left_semi").dropDuplicates(["_h"])
    return texts.select("text").mapInPandas(read, "sid long, items binary").dropDuplicates(["sid"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) that are similar.

    Nodes ``a`` are dealt into blocks; a node ``b`` travels once to each block it has a partner in, so many
    pairs among few nodes do not carry their sets many times.  The partners of a node ``a`` that has
    many are dealt into parts, so they spread over tasks.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}
        for batch in batches:
            a, b = [], []
            for block, part, sid, partners, items in zip(*(batch[c] for c in ("block", "part", "sid", "partners", "items")), strict=True):
                if (block, part) != now:
                    now, held = (block, part), {}
                own = np.frombuffer(items, dtype="<u8")
                if partners is None:
                    held[sid] = own
                    continue
                near = [x for x in partners if similar(held[x], own)]
                a += near
                b += [sid] * len(near)
            yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    pairs = stage(pairs.select("a", "b").distinct())
    blocks = 1 + pairs.agg(F.approx_count_distinct("a")).first()[0] // BLOCK
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(many, "a").withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("b"), 1 + F.floor(F.col("n") / PAIRS)))
    first = dealt.select("block", "part", F.col("a").alias("sid")).distinct().withColumn("partners", F.lit(None).cast("array<long>"))
    then = dealt.groupBy("block", "part", F.col("b").alias("sid")).agg(F.collect_list("a").alias("partners"))
    rows = first.unionByName(then).join(sets, "sid")
    rows = rows.repartition("block", "part").sortWithinPartitions("block", "part", F.col("partners").isNotNull())
    return stage(rows.mapInPandas(read, "a long, b long"))


def _apart(live: DataFrame, sets: DataFrame, chunk: int) -> DataFrame:
    """Links ``a, b`` that join all similar pairs of a bucket that are still apart (``live``: ``key, sid, n, root``)."""
    own = live.withColumn("keys", F.collect_set("key").over(W.partitionBy("sid")))  # a node has 51 keys at most
    rows, keys = split_buckets(own.join(sets, "sid"), ["key"], "sid", chunk)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, edges in runs(batches, keys):
            found = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = frame.iloc[lo:hi]
                sid, n, (group, _) = part["sid"].to_numpy(np.int64), part["n"].to_numpy(np.int64), pd.factorize(part["root"])
                items, first = [np.frombuffer(x, dtype="<u8") for x in part["items"]], part["key"].iloc[0]
                before = [np.asarray(x)[np.asarray(x) < first] for x in part["keys"]]  # a pair that shares one of these meets there
                place = {k: i for i, k in enumerate(np.unique(np.concatenate(before)).tolist())}
                has = np.zeros((len(part), len(place)), dtype=np.float32)
                for i, ks in enumerate(before):
                    has[i, [place[k] for k in ks.tolist()]] = 1
                asked = (has @ has.T == 0) & (UNDER * np.minimum.outer(n, n) >= OVER * np.maximum.outer(n, n))
                if "c" in part.columns and part["i"].iloc[0] != part["j"].iloc[0]:
                    c = part["c"].to_numpy()
                    asked &= c[:, None] != c[None, :]
                for i in range(len(part)):
                    for j in i + 1 + np.flatnonzero(asked[i, i + 1 :] & (group[i + 1 :] != group[i])):
                        if group[i] != group[j] and similar(items[i], items[j]):
                            found.append((sid[i], sid[j]))
                            group[group == group[j]] = group[i]
            yield pd.DataFrame(np.array(found, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long")


def similar_links(nodes: DataFrame, docs: DataFrame, pivots: tuple[int, ...] = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` with the components of all similar pairs of ``nodes`` that share a bucket key."""
    keyed = nodes.select("sid", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    live = stage(keyed.join(shared, "key").withColumn("root", F.col("sid")))
    sets = stage(_sets(docs, nodes.join(live.select("sid").distinct(), "sid", "left_semi")))
    fits = f"root <> p_root and least(n, p_n) * {UNDER} >= greatest(n, p_n) * {OVER}"
    links = None
    for turn, many in enumerate([*pivots, 0]):
        if links is not None:
            found = components(links).withColumnRenamed("node", "sid")
            live = stage(live.drop("root").join(found, "sid", "left").withColumn("root", F.coalesce("root", "sid")))
        if not live.take(1):
            break
        picked = [F.min(F.struct(F.xxhash64("sid", F.lit(turn), F.lit(j)).alias("o"), "sid", "n", "root")) for j in range(many)]
        facts = live.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *([F.array(*picked).alias("ps")] if many else []))
        held = stage(live.join(facts.filter("lo <> hi").drop("lo", "hi"), "key"))
        unstage(live)
        if many:
            each = held.select("sid", "n", "root", F.explode("ps").alias("q")).select("sid", "n", "root", F.col("q.sid").alias("p"), F.col("q.n").alias("p_n"), F.col("q.root").alias("p_root"))
            live = held.filter(~F.exists("ps", lambda q: q["sid"] == F.col("sid"))).select("key", "sid", "n", "root")
            new = _verified(each.filter(fits).select(F.col("p").alias("a"), F.col("sid").alias("b")), sets)
        else:
            new = stage(_apart(held, sets, chunk))
        links = new if links is None else stage(links.unionByName(new))
    return nodes.select(F.col("sid").alias("a"), F.col("sid").alias("b")).limit(0) if links is None else links


def shingle_components(docs: DataFrame, pivots: tuple[int, ...] = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, _h, component_id`` for every row of ``docs`` (``doc_id``, ``text``, ``_h``: a hash of the row).

    Rows whose shingle sets have similarity ``OVER / UNDER`` or more link; ``component_id`` is the
    smallest ``doc_id`` reachable.  Wordless texts are one component.  Rows with a null
    ``doc_id`` link but never name a component.
    """
    rows = stage(_read(docs))
    nodes = stage(rows.groupBy("sid").agg(F.min("_h").alias("_h"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("doc_id").alias("least")))
    found = components(similar_links(nodes, docs, pivots, chunk))
    named = nodes.join(found, F.col("sid") == F.col("node"), "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "_h", "sid").join(named.join(groups, "root").select("sid", "component_id"), "sid").drop("sid")


def drop_similar(docs: DataFrame, pivots: tuple[int, ...] = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """One row of each component of ``docs``, that with the smallest ``doc_id``; all columns stay.

    Rows that share an id, or have none, are treated as in :func:`first_of_each`.
    """
    return first_of_each(docs, shingle_components(docs.select("doc_id", "text", row_hash(docs).alias("_h")), pivots, chunk))
