"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint's 64 positions get nonzero vectors of ``RADIUS + 1`` bits; each nonzero
vector ``v`` gives a table whose mask keeps the positions with an odd scalar product.  For any
``RADIUS`` differing positions some ``v`` is orthogonal to all of their vectors, so the pair
agrees under that mask: every pair within the radius meets in some table, with no
chance involved.  Equal fingerprints are one node; each bucket is reduced to a spanning
forest of its true links where it is read, so no task emits all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline.llm._common import row_hash, spare, stage
from crestline.llm._components import components, runs, split_buckets

BITS, SHINGLE, SEED, RADIUS = 64, 4, 42, 4
#: Fingerprints of a bucket that one task compares; larger buckets are split into pairs of chunks.
CHUNK = 8192


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 hashes of the word shingles of a whole text, repeats included; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
    hashes = (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True))
    return np.fromiter(hashes, dtype=np.uint64, count=len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(((2 * counts > len(hashes)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the hashes of the word shingles of a whole text; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def masks(radius: int = RADIUS) -> list[int]:
    """Masks of the covering tables as signed 64-bit integers."""
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(BITS)]
    kept = [sum(((v & m).bit_count() & 1) << i for i, m in enumerate(vectors)) for v in range(1, 1 << radius + 1)]
    return [k - (1 << 64) if k >> 63 else k for k in kept]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each row as a signed long; ``_h``, a long, is kept where it is there."""
    extra = [c for c in ("_h",) if c in docs.columns]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in batch["text"]), dtype=np.uint64, count=len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp.view(np.int64), **{c: batch[c] for c in extra}})

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("fp", *extra)])
    return docs.select("doc_id", "text", *extra).mapInPandas(read, schema)


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is connected within ``radius`` in one bucket."""
    unseen, out = np.unique(fps), []
    while len(unseen) > 1:
        root, front, unseen = int(unseen[0]), unseen[:1], unseen[1:]
        while len(front) and len(unseen):
            near = np.zeros(len(unseen), dtype=bool)
            step = max(1, (1 << 20) // len(unseen))  # 8 MB at a time
            for at in range(0, len(front), step):
                left = ~near
                near[left] = (np.bitwise_count(front[at : at + step, None] ^ unseen[left]) <= radius).any(axis=0)
            front, unseen = unseen[near], unseen[~near]
            out += [(root, int(x)) for x in front]
    return out


def covering_keys(fp: Column, radius: int = RADIUS) -> Column:
    """The buckets ``t, key`` of a fingerprint column: one a table."""
    return F.array(*[F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])


def covering_links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` with the same components as all pairs of ``nodes`` (``fp``, distinct) within ``radius``.

    A bucket of more than ``chunk`` fingerprints is split into pairs of chunks, so the work of a
    task has the same bound at every size of the input.
    """
    keyed = nodes.select("fp", F.explode(covering_keys(F.col("fp"), radius)).alias("k")).select("fp", "k.t", "k.key")
    keyed, keys = split_buckets(keyed, ["t", "key"], "fp", chunk, nodes.count() > chunk)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, edges in runs(batches, keys):
            fp, size = frame["fp"].to_numpy(np.int64).view(np.uint64), np.diff(edges)
            two = edges[:-1][size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            more = [x for at in np.flatnonzero(size > 2) for x in _forest(fp[edges[at] : edges[at + 1]], radius)]
            a, b = zip(*more, strict=True) if more else ((), ())
            yield pd.DataFrame(
                {k: np.concatenate([fp[near + d], np.array(v, dtype=np.uint64)]).view(np.int64) for k, d, v in (("a", 0, a), ("b", 1, b))}
            )

    dealt = keyed.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(link, "a long, b long").distinct()


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Fingerprints at ``radius`` or fewer differing bits link; ``component_id`` is the smallest
    ``doc_id`` reachable.  A null, empty or wordless text has fingerprint zero and links
    like any other.  Rows with a null ``doc_id`` link too but never name a component,
    which is null if no other row is in it.  Repeated rows share their component; other
    columns are ignored.
    """
    return _components_of(docs.select("doc_id", "text"), radius, shingle)


def _components_of(docs: DataFrame, radius: int, shingle: int) -> DataFrame:
    rows = stage(fingerprints(docs, shingle))
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(covering_links(classes.select("fp"), radius))
    named = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(groups, "root").select("fp", "component_id"), "fp")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component of ``docs``, that with the smallest ``doc_id``; all columns stay.

    Rows with a null ``doc_id`` cannot be told apart and all stay.  Of repeated rows one
    stays; of rows that share an id that with the least hash of all its columns.
    """
    return first_of_each(docs, _components_of(docs.select("doc_id", "text", row_hash(docs).alias("_h")), radius, shingle))


def first_of_each(docs: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of ``docs`` that name their component in ``told`` (``doc_id``, ``_h``: the row's hash, ``component_id``), as in :func:`drop_near_duplicates`."""
    (h,) = spare(docs.columns, "_h")
    own = told.filter(F.col("doc_id") == F.col("component_id"))
    chosen = stage(own.groupBy("doc_id").agg(F.min("_h").alias(h), F.count(F.lit(1)).alias("_n")))
    known = docs.filter(F.col("doc_id").isNotNull()).withColumn(h, row_hash(docs))
    kept = known.join(chosen.select("doc_id", h), ["doc_id", h], "left_semi").select(*docs.columns)
    if chosen.filter("_n > 1").take(1):
        kept = kept.dropDuplicates(["doc_id"])  # what is left of an id is equal in all columns
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))
