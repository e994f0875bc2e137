"""Best-fit packing with the linear grouping scheme.

Texts become token ids; a document over the limit is cut, its full pieces are sequences
of their own, without a rank.  All other lengths are integers below the limit, so the whole packing
problem is a histogram of at most ``limit`` counts: that alone goes to the driver.
There the large lengths are sorted and split into groups of equal cardinality,
each rounded up to its largest length; column generation finds the optimal fractional
mix of configurations for those few sizes, whose integer part is filled with actual
lengths, and the rest and all small lengths follow by best fit.  The plan is a list of rank
intervals for each length.  Documents learn their rank among equals from a bucketed
ranking and look their place up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline.llm._common import buckets_for, ranked, stage

LIMIT = 2048
#: Lengths above this share of the limit are large.
LARGE = 1 / 8
GROUPS = 100


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Function from a text to its ids, equal to the ``tokenizers`` file's own.

    ``tiktoken`` merges the same vocabulary some four times as fast.  Texts that spell out a
    special token go to ``tokenizers`` itself, which gives that token's id.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    model = json.load(open(path, encoding="utf-8"))
    special = [t["content"] for t in model["added_tokens"]]
    ids = {t["id"] for t in model["added_tokens"]}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in printable} | {
        chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))
    }
    ranks = {bytes(letter[c] for c in w): i for w, i in model["model"]["vocab"].items() if i not in ids}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(fast.encode_ordinary(text), dtype="<u4")

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """Token pieces of every document: ``doc_id, piece, start, length, ids_crc32``.

    Only documents over ``limit`` are cut, into full pieces but for the first.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                edges = [0, *range(len(ids) % limit or limit, len(ids) + 1, limit)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(rows, columns=schema.names)

    return docs.select("doc_id", "text").mapInPandas(cut, schema)


def _configurations(sizes: list[int], counts: list[int], limit: int) -> list[tuple[np.ndarray, float]]:
    """Column generation for the few-size problem: configurations and how often each is used."""
    k, y_one = len(sizes), np.ones(len(sizes))
    basis = np.diag([float(limit // s) for s in sizes])
    need = np.array(counts, dtype=float)
    most = limit // min(sizes)
    for _ in range(60 * k):
        price = np.linalg.solve(basis.T, y_one)
        best, choice = np.zeros(limit + 1), []
        for _item in range(most):
            layer, pick = best.copy(), np.full(limit + 1, -1)
            for g, s in enumerate(sizes):
                if price[g] > 1e-12:
                    better = best[: limit + 1 - s] + price[g] > layer[s:] + 1e-12
                    layer[s:][better] = best[: limit + 1 - s][better] + price[g]
                    pick[s:][better] = g
            choice.append(pick)
            if np.array_equal(layer, best):
                break
            best = layer
        if best[limit] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), limit
        for pick in reversed(choice):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        used, enter = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(enter > 1e-9, np.maximum(used, 0) / np.where(enter > 1e-9, enter, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    used = np.linalg.solve(basis, need)
    return [(basis[:, j], float(used[j])) for j in range(k) if used[j] > 1e-9]


class PackingPlan:
    """Where the r-th piece of each length goes, from the histogram of lengths.

    ``intervals`` has rows ``length, first rank, end rank, first sequence, pieces a
    sequence, offset``; ``sequences`` is their number.
    """

    def __init__(self, histogram: dict[int, int], limit: int = LIMIT, large: float = LARGE, groups: int = GROUPS):
        self.limit, self.sequences = limit, 0
        self.intervals: list[tuple[int, int, int, int, int, int]] = []
        self._taken = dict.fromkeys(histogram, 0)
        self._open: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences
        self._rooms: list[int] = []
        left = {n: c for n, c in histogram.items() if c}
        self._pack_large({n: left.pop(n) for n in sorted(left, reverse=True) if n > large * limit}, groups)
        for n in sorted(left, reverse=True):
            self._best_fit(n, left[n])

    def _put(self, n: int, first: int, each: int, room: int, items: int) -> None:
        """``items`` pieces of length ``n``, ``each`` a sequence, from sequence ``first`` on."""
        rank = self._taken[n]
        self.intervals.append((n, rank, rank + items, first, each, self.limit - room))
        self._taken[n] = rank + items

    def _leave(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in self._open:
                self._open[room] = []
                insort(self._rooms, room)
            self._open[room].append((first, bins))

    def _best_fit(self, n: int, items: int) -> None:
        while items:
            at = bisect_left(self._rooms, n)
            if at == len(self._rooms):
                room, first = self.limit, self.sequences
                bins = -(-items // (room // n))
                self.sequences += bins
            else:
                room = self._rooms[at]
                first, bins = self._open[room].pop()
                if not self._open[room]:
                    del self._open[room], self._rooms[at]
            each = room // n
            full, rest = divmod(min(items, bins * each), each)
            if full:
                self._put(n, first, each, room, full * each)
                self._leave(room - each * n, first, full)
            if rest:
                self._put(n, first + full, rest, room, rest)
                self._leave(room - rest * n, first + full, 1)
            self._leave(room, first + full + (rest > 0), bins - full - (rest > 0))
            items -= full * each + rest

    def _pack_large(self, left: dict[int, int], groups: int) -> None:
        total = sum(left.values())
        if not total:
            return
        # Equal-cardinality groups of the descending lengths, each rounded up to its first.
        share, room, grouped = -(-total // groups), 0, {}
        for n, c in left.items():
            while c:
                if not room:
                    size, room = n, share
                take = min(c, room)
                grouped[size] = grouped.get(size, 0) + take
                c, room = c - take, room - take
        order = sorted(left)
        for column, times in _configurations([*grouped], [*grouped.values()], self.limit):
            slots = [s for s, many in zip(grouped, column, strict=True) for _ in range(int(many))]
            bins = int(times + 1e-7)
            while bins and order:
                lengths = self._substitute(slots, order, left)
                if not lengths:
                    break
                # As many sequences get the same lengths as there are pieces of each.
                step = min(bins, *(left[n] // lengths.count(n) for n in lengths))
                self._fill(lengths, step)
                for n in lengths:
                    left[n] -= step
                order = [n for n in order if left[n]]
                bins -= step
        for n in reversed(order):
            self._best_fit(n, left[n])

    def _substitute(self, slots: list[int], order: list[int], left: dict[int, int]) -> list[int]:
        """Actual lengths for the places of one configuration, largest first.

        A place takes the largest length that its rounded size covers; the last of several
        takes the largest that fits in what is left of the sequence.
        """
        lengths: list[int] = []
        for i, size in enumerate(slots):
            room = self.limit - sum(lengths)
            at = bisect_right(order, room if 0 < i == len(slots) - 1 else min(size, room)) - 1
            while at >= 0 and left[order[at]] <= lengths.count(order[at]):
                at -= 1
            if at >= 0:
                lengths.append(order[at])
        return lengths

    def _fill(self, lengths: list[int], bins: int) -> None:
        room = self.limit
        for n in lengths:
            self._put(n, self.sequences, 1, room, bins)
            room -= n
        self._leave(room, self.sequences, bins)
        self.sequences += bins


def pack_pieces(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id``, ``piece``, ``length``).

    Lengths must lie in 1 to ``limit``.  Equal pieces are interchangeable.  Sequences of one full
    piece have numbers below zero.  ``pieces`` is read several times and must be a table.
    """
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["length"]: r["n"] for r in counts}
    plan = PackingPlan({n: c for n, c in sizes.items() if n != limit}, limit)
    steps = np.array(sorted(plan.intervals), dtype=np.int64).reshape(-1, 6)
    shared = pieces.sparkSession.sparkContext.broadcast(steps)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = shared.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted((t[:, 0] << 48) + t[:, 1], (n << 48) + r, side="right") - 1
        k = r - t[at, 1]
        return pd.DataFrame({"sequence_id": t[at, 3] + k // t[at, 4], "offset": t[at, 5] + k % t[at, 4] * n})

    buckets = buckets_for(max((c for n, c in sizes.items() if n != limit), default=0))
    keyed = pieces.filter(F.col("length") != limit).withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")]
    placed = ranked(keyed, "_b", order, ["length"]).withColumn("_at", place("length", "_rank"))
    # A full piece is a sequence of its own, whose number needs no rank: below zero, by its place in the table.
    alone = pieces.filter(F.col("length") == limit).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    return placed.select(*pieces.columns, "_at.sequence_id", "_at.offset").unionByName(alone.withColumn("offset", F.lit(0).cast("long")))


def best_fit_packing(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """Pack the whole texts of ``docs`` (``doc_id``, ``text``) into sequences.

    A null text counts as empty and still yields its end id.  Repeated rows are packed
    one by one; a null ``doc_id`` is kept; other columns are ignored.  No rows give no
    rows.
    """
    return pack_pieces(stage(token_pieces(docs, tokenizer, limit, end_id)), limit)
