"""Document fingerprints by randomised edit embedding.

A text is embedded by a random walk shared by all texts: at step ``j`` the current
character is written down, and a random bit of ``j`` and the character's class says
whether the walk moves on to the next one.  Texts at a small edit distance fall into step again
after each edit, so their embeddings are at a small Hamming distance.

The fingerprint samples ``SAMPLES`` steps of the embedding and keeps four hashed bits of each
character met.  Sampled steps are consistent over lengths: sample ``k`` takes the last of a
fixed, ever sparser series of record steps that lies inside the embedding, which is
uniform over it and rarely changes with a small change of length.

After some edits a walk does not fall into step for long, so near-duplicates are sought with
``WALKS`` independent walks.  Bands of the samples of each walk find candidates, and one sampled bit
of each of ``PRINT`` steps of that walk verifies them: equal bits, corrected for chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm._common import stage
from crestline.llm._components import components, runs, split_buckets

SAMPLES = 256
#: Independent walks that near-duplicates are sought with; the first makes the fingerprint.
WALKS = 3
#: Bands of a walk and samples of a band; candidates agree on all of one band.
BANDS, BAND = 6, 6
#: Sampled bits of a walk that verify a candidate.
PRINT = 192
#: Least likeness of near-duplicates, by one walk at least.
SIMILAR = 0.8
#: Prints of a bucket that one task compares; larger buckets are split into pairs of chunks.
CHUNK = 8192
#: Character classes and steps of the shared table of moves; steps beyond it start over.
CLASSES, PERIOD = 16, 1 << 14
#: Characters that walk in lockstep at a time, in one task, each by all walks.
LOCKSTEP = 1_500_000
#: Rows of a range whose texts are unpacked at a time.
SLICE = 3000
#: Bytes of a range of ids: the first for the first ``FINE`` ranges, the second beyond.  A
#: range costs the driver 32 bytes, so 100 TB cost it 13 MB.
RANGE_BYTES, FINE = (8 << 20, 256 << 20), 2048
_LEVEL = 5

_rng = np.random.default_rng(20240229)


def _moves(bits: np.ndarray) -> np.ndarray:
    """For each class and step: steps until the walk leaves the character."""
    out = np.zeros((CLASSES, PERIOD), dtype=np.int32)
    gap = np.zeros(CLASSES, dtype=np.int32)
    for j in range(2 * PERIOD - 1, -1, -1):
        gap = np.where(bits[:, j % PERIOD] == 1, 1, gap + 1)
        out[:, j % PERIOD] = gap
    return out.ravel()


def _records() -> np.ndarray:
    """Record steps (from 1) of each sample, ascending, up to 2**40 and then far beyond."""
    rows = []
    for _ in range(SAMPLES):
        r = [1]
        while r[-1] < 1 << 40:
            r.append(int(r[-1] / (1.0 - _rng.random())) + 1)
        rows.append(r[:-1])
    out = np.full((SAMPLES, max(map(len, rows))), np.iinfo(np.int64).max)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


_BITS = [_rng.integers(0, 2, size=(CLASSES, PERIOD), dtype=np.uint8) for _ in range(WALKS)]
_KINDS = [0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35]  # multipliers that deal characters into classes, one a walk
_MOVES, _RECORDS = np.concatenate([_moves(b) for b in _BITS]).astype(np.uint8), _records()
_SALT = _rng.integers(1, 1 << 62, size=SAMPLES, dtype=np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def walk(texts: list[np.ndarray], begin: np.ndarray, walks: int = 1) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """For each text the step at which each of the first ``walks`` walks reaches each character, and the steps after the last.

    ``texts`` are code points; the walks of text ``d`` start at step ``begin[d]``.  All texts move in lockstep by
    all walks, the longest first, so that those still going are a prefix.  Yields a text's place, and what was found.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    going = (len(texts) - np.searchsorted(np.sort(sizes), np.arange(longest), side="right")) * walks
    row = np.concatenate([[0], np.cumsum(going)])
    kind, at = np.empty(int(row[-1]), dtype=np.int32), np.empty(int(row[-1]), dtype=np.int32)
    for d, own in enumerate(order):
        c = texts[own]
        for w in range(walks):
            kind[row[: len(c)] + (d * walks + w)] = (((c * np.uint32(_KINDS[w])) >> np.uint32(28)).astype(np.int32) + w * CLASSES) * PERIOD
    j, t, s = np.repeat(begin[order], walks).astype(np.int32), np.empty(len(texts) * walks, dtype=np.int32), np.empty(len(texts) * walks, dtype=np.uint8)
    for a, lo in zip(going.tolist(), row.tolist(), strict=False):
        now, key = j[:a], t[:a]
        at[lo : lo + a] = now
        np.bitwise_and(now, PERIOD - 1, out=key)
        np.add(key, kind[lo : lo + a], out=key)
        np.take(_MOVES, key, out=s[:a], mode="clip")
        np.add(now, s[:a], out=now)
    for d, own in enumerate(order):
        lanes = range(d * walks, (d + 1) * walks)
        yield int(own), [at[row[: sizes[own]] + x] for x in lanes], j[d * walks : (d + 1) * walks].astype(np.int64)


def _reached() -> tuple[np.ndarray, np.ndarray]:
    """All record steps in order, and how many records of each sample are at or below each."""
    flat = np.sort(_RECORDS.ravel())
    steps = np.unique(flat[flat < np.iinfo(np.int64).max])
    return steps, np.stack([np.searchsorted(r, steps, side="right") for r in _RECORDS], axis=1).astype(np.uint8)


_STEPS, _REACHED = _reached()


def sampled_steps(ends: np.ndarray) -> np.ndarray:
    """The steps that are sampled from embeddings of the lengths ``ends`` (1 or more), a row each."""
    last = _REACHED[np.searchsorted(_STEPS, np.maximum(ends, 1), side="right") - 1]
    return _RECORDS[np.arange(SAMPLES), last - 1] - 1


def sampled(codes: np.ndarray, steps: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The nibbles of the characters that are written down at the ``wanted`` steps."""
    if not len(codes):
        return np.zeros(SAMPLES, dtype=np.uint8)
    met = codes[np.searchsorted(steps, wanted, side="right") - 1].astype(np.uint64)
    return (((met + np.uint64(1)) * _SALT * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples (last axis) beyond chance, 0 to 1."""
    return np.maximum(0.0, ((a == b).mean(axis=-1) - 1 / 16) / (15 / 16))


def _parts(sizes: list[int]) -> Iterator[np.ndarray]:
    """Places of the texts, in parts of some ``LOCKSTEP`` characters, long ones together: few parts have many steps."""
    order = np.argsort(-np.array(sizes, dtype=np.int64), kind="stable")
    weight = np.array(sizes, dtype=np.int64)[order]
    part = (np.cumsum(weight) - weight) // LOCKSTEP
    return (order[part == p] for p in np.unique(part))


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every text: its nibbles by each walk, those of its first half by the first walk, and the step after that half."""
    own, half, step = np.zeros((len(texts), WALKS, SAMPLES), dtype=np.uint8), np.zeros((len(texts), SAMPLES), dtype=np.uint8), np.zeros(len(texts), dtype=np.int64)
    for part in _parts([len(t) for t in texts]):
        codes = [_codes(texts[d]) for d in part]
        for n, steps, ends in walk(codes, np.zeros(len(part), dtype=np.int64), WALKS):
            d, c = part[n], codes[n]
            kept = len(c) - len(c) // 2
            step[d] = steps[0][kept] if kept < len(c) else ends[0]
            wanted = sampled_steps(np.append(ends, step[d]))
            for w in range(WALKS):
                own[d, w] = sampled(c, steps[w], wanted[w])
            half[d] = sampled(c[:kept], steps[0][:kept], wanted[WALKS])
    return own, half, step


def edited_fingerprints(half: np.ndarray, step: np.ndarray, tails: list[str]) -> np.ndarray:
    """Nibbles of the texts whose first half is known by ``half`` and ``step``, and goes on with the tail."""
    out = half.copy()
    for part in _parts([len(t) for t in tails]):
        codes = [_codes(tails[d]) for d in part]
        for n, steps, ends in walk(codes, step[part]):
            if len(codes[n]):
                wanted = sampled_steps(ends)[0]
                out[part[n]] = np.where(wanted >= step[part[n]], sampled(codes[n], steps[0], wanted), half[part[n]])
    return out


def _pack(nibbles: np.ndarray) -> list[bytes]:
    """Two nibbles a byte, a row each."""
    return [r.tobytes() for r in nibbles[:, ::2] << 4 | nibbles[:, 1::2]]


def _unpack(rows: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
    return np.stack([raw >> 4, raw & 15], axis=2).reshape(len(rows), -1)


def _text(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _h``: null texts as empty ones, and the text's hash."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_h"))


def _whole(doc_id: str = "doc_id") -> list[Column]:
    """Whether an id is known, and the id or 0: pandas would turn longs with nulls into floats."""
    return [F.col(doc_id).isNotNull(), F.coalesce(F.col(doc_id).cast("long"), F.lit(0))]


def _ranges(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ranges of ``(doc_id, _h)`` in order: the least id of each, its first range, its number of ranges; those of null ids come before.

    An id that fills several ranges (and null) is split by the hash of the text.
    """
    n, least, nulls, size = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.count_if(F.col("doc_id").isNull()), F.sum(F.octet_length("text"))).first()
    size = size or 0
    many = max(1, min(n, size // RANGE_BYTES[0], FINE + size // RANGE_BYTES[1]))
    cuts = [] if least is None else [least]
    if many > 1 and least is not None:
        shares = F.array(*[F.lit(i / many) for i in range(1, many)])
        cuts += rows.agg(F.percentile_approx("doc_id", shares, F.lit(10 * many))).first()[0]
    values, times = np.unique(np.array(cuts, dtype=np.int64), return_counts=True)
    before = -(-nulls * many // max(n, 1))
    return values, before + np.cumsum(times) - times, times, before


def _placed(known: np.ndarray, ids: np.ndarray, h: np.ndarray, ranges: tuple) -> np.ndarray:
    """The range of each row."""
    values, first, times, before = ranges
    share = h / 2.0**64 + 0.5
    out = np.minimum((share * before).astype(np.int64), max(before - 1, 0))
    if len(values):
        own = ids[known]
        at = np.searchsorted(values, own, side="right") - 1
        inside = np.minimum((share[known] * times[at]).astype(np.int64), times[at] - 1)
        out[known] = first[at] + np.where(values[at] == own, inside, times[at] - 1)
    return out


def edit_fingerprints(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Fingerprint every whole text of ``docs`` and its edited form, and group near-duplicates.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, component_id``.  The edited text has its last half replaced by the start of the next
    document's text, by ascending ``doc_id`` (nulls first, repeats by a hash of the
    text); the next of the last is the first.  A null text counts as empty, whose
    fingerprint is all zeros; a single row is its own next.  ``component_id`` is that of
    :func:`near_components`.  Other columns are ignored.

    Rows go to ranges of ids, their texts compressed; the first row of a range is also sent to the range
    before, so a document and its next always meet, and a range is read in order, row by row.  Rows that
    are equal in id and text are in one range, however many there are.
    """
    rows = _text(docs)
    ranges = _ranges(rows)
    ids = docs.sparkSession.sparkContext.broadcast(ranges)
    kind = docs.schema["doc_id"].dataType

    @F.pandas_udf("long")
    def place(known: pd.Series, doc_id: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(_placed(known.to_numpy(bool), doc_id.to_numpy(np.int64), h.to_numpy(np.int64), ids.value))

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        pack = zstandard.ZstdCompressor(level=_LEVEL).compress
        return pd.Series([pack(t.encode("utf-8", "surrogatepass")) for t in text])

    order = [F.col("doc_id").asc_nulls_first(), F.col("_h")]
    dealt = rows.withColumn("_range", place(*_whole(), "_h"))
    heads = dealt.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_h")).alias("f")).select("_range", "f.doc_id", "f._h")
    firsts = sorted((r["_range"], r["doc_id"], r["_h"]) for r in heads.collect())  # one row a range
    to = {(i, h): before for (_, i, h), before in zip(firsts, [firsts[-1][0]] + [f[0] for f in firsts], strict=False)} if firsts else {}
    sent = docs.sparkSession.sparkContext.broadcast(to)

    @F.pandas_udf("long")
    def ghost(known: pd.Series, doc_id: pd.Series, h: pd.Series) -> pd.Series:
        get = sent.value.get
        return pd.Series([get((i if k else None, x)) for k, i, x in zip(known.tolist(), doc_id.tolist(), h.tolist(), strict=True)], dtype="Int64")

    nothing = {"component_id": F.lit(None).cast(kind), **{c: F.lit(None).cast("binary") for c in ("fp", "half")}, "step": F.lit(None).cast("long")}
    found = _components_of(rows, similar).withColumn("text", F.lit(None).cast("binary"))
    found = found.withColumn("_range", place(*_whole(), "_h")).withColumn("_ghost", F.lit(0))
    texts = dealt.withColumn("text", packed("text")).withColumn("_to", ghost(*_whole(), "_h"))
    here = F.struct(F.col("_range").alias("r"), F.lit(0).alias("g"))
    copies = F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("_to").alias("r"), F.lit(1).alias("g"))))
    texts = texts.withColumn("_c", F.explode(copies)).select("doc_id", "_h", "text", F.col("_c.r").alias("_range"), F.col("_c.g").alias("_ghost"))
    # What is known of an id and text comes ahead of its rows, also where they are sent as the next ones.
    facts = found.withColumn("_to", ghost(*_whole(), "_h")).withColumn("_c", F.explode(copies))
    facts = facts.select("doc_id", "_h", "text", F.col("_c.r").alias("_range"), F.col("_c.g").alias("_ghost"), *nothing)
    both = texts.withColumns(nothing).unionByName(facts)
    both = both.repartition("_range").sortWithinPartitions("_range", "_ghost", *order, F.col("text").isNotNull())
    both = both.select("_range", "_ghost", "text", "fp", "half", "step", *[F.col(c).cast("string") for c in ("doc_id", "component_id")])
    told = both.mapInPandas(_in_order, ", ".join(_COLUMNS.values()))
    return told.select(*[F.col(c).cast(kind) if c in ("doc_id", "component_id") else F.col(c) for c in _COLUMNS])


_COLUMNS = {
    c.split()[0]: c
    for c in ("doc_id string", "n_chars long", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double", "component_id string")
}


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The result's rows from sorted ranges: each row meets the next one of its range, at the end a ghost."""
    unpack = zstandard.ZstdDecompressor().decompress
    known, carry = None, None  # what is known of the rows at hand; the last row, whose next is yet to come

    def told(rows: list[tuple]) -> pd.DataFrame:
        """All rows but the last, which is there as the next one."""
        pairs = [(r, n) for r, n in zip(rows, rows[1:], strict=False) if not r[0]]
        texts, nexts = [r[2] for r, _ in pairs], [n[2] for _, n in pairs]
        sizes = [len(t) for t in texts]
        kept = [n - n // 2 for n in sizes]
        tails = [t[: n // 2] for t, n in zip(nexts, sizes, strict=True)]
        own, after, half = (_unpack(x) for x in ([r[3] for r, _ in pairs], [n[3] for _, n in pairs], [r[4] for r, _ in pairs]))
        edited = edited_fingerprints(half, np.array([r[5] for r, _ in pairs], dtype=np.int64), tails)
        sha = [hashlib.sha256((t[:k] + tail).encode("utf-8", "surrogatepass")).hexdigest() for t, k, tail in zip(texts, kept, tails, strict=True)]
        hexed = [[x.hex() for x in prints] for prints in ([r[3] for r, _ in pairs], _pack(edited))]
        columns = [[r[1] for r, _ in pairs], sizes, sha, *hexed, likeness(own, edited), likeness(own, after), [r[6] for r, _ in pairs]]
        return pd.DataFrame(dict(zip(_COLUMNS, columns, strict=True)))

    for batch in (b.iloc[lo : lo + SLICE] for b in batches for lo in range(0, len(b), SLICE)):
        rows = [] if carry is None else [carry]
        for ghost, doc_id, text, *facts in zip(*(batch[c] for c in ("_ghost", "doc_id", "text", "fp", "half", "step", "component_id")), strict=True):
            if text is None:
                known = facts
            else:
                rows.append((ghost, doc_id, unpack(text).decode("utf-8", "surrogatepass"), *known))
        if rows:
            carry = rows[-1]
        if len(rows) > 1:
            yield told(rows)


def _prints(rows: DataFrame) -> DataFrame:
    """``doc_id, _h, node, p, bands, fp, half, step``: of every row its verifying bits and band samples by all walks, their hash, and what :func:`fingerprints` gives."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nibbles, half, step = fingerprints(list(batch["text"]))
            bits = np.packbits(nibbles[:, :, -PRINT:] & 1, axis=2).reshape(len(batch), -1)
            p, bands = [b.tobytes() for b in bits], _pack(nibbles[:, :, : BANDS * BAND].reshape(len(batch), -1))
            node = np.array([xxhash.xxh64_intdigest(x + b) for x, b in zip(p, bands, strict=True)], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"], "_h": batch["_h"], "node": node.view(np.int64), "p": p, "bands": bands, "fp": _pack(nibbles[:, 0]), "half": _pack(half), "step": step})

    told = rows.select(F.col("doc_id").cast("string").alias("id"), "_h", "text").mapInPandas(read, "id string, _h long, node long, p binary, bands binary, fp binary, half binary, step long")
    return told.select(F.col("id").cast(rows.schema["doc_id"].dataType).alias("doc_id"), *told.columns[1:])


def _links(nodes: DataFrame, similar: float, chunk: int) -> DataFrame:
    """Verified links ``a, b`` that connect what the bands find; ``nodes`` has ``node, p, bands``."""
    each, of_walk = BAND // 2, PRINT // 8
    value = lambda i: F.conv(F.hex(F.substring("bands", 1 + i * each, each)), 16, 10).cast("long")
    bands = [
        F.struct((value(w * BANDS + b) + F.lit((w * BANDS + b) << 4 * BAND)).alias("key"), F.substring("p", 1 + w * of_walk, of_walk).alias("p"))
        for w in range(WALKS)
        for b in range(BANDS)
    ]
    keyed = nodes.select("node", F.explode(F.array(*bands)).alias("k")).select("node", "k.key", "k.p")
    keyed, keys = split_buckets(keyed, ["key"], "node", chunk, nodes.count() > chunk)
    most = int((1 - similar) / 2 * PRINT)  # differing bits of two prints at that likeness

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, edges in runs(batches, keys):
            node, raw, out = frame["node"].to_numpy(np.int64), frame["p"], []
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a < 2:
                    continue
                prints = np.frombuffer(b"".join(raw.iloc[a:b]), dtype=np.uint64).reshape(b - a, -1)
                unseen = np.arange(b - a)
                while len(unseen) > 1:
                    root, front, unseen = unseen[0], unseen[:1], unseen[1:]
                    while len(front) and len(unseen):
                        near, step = np.zeros(len(unseen), dtype=bool), max(1, (1 << 18) // len(unseen))
                        for at in range(0, len(front), step):
                            left = np.flatnonzero(~near)
                            apart = np.bitwise_count(prints[front[at : at + step], None] ^ prints[unseen[left]]).sum(axis=2, dtype=np.int32)
                            near[left] = (apart <= most).any(axis=0)
                        front, unseen = unseen[near], unseen[~near]
                        out += [(node[a + root], node[a + x]) for x in front]
            yield pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])

    dealt = keyed.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(link, "a long, b long")


def _components_of(rows: DataFrame, similar: float, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, _h, fp, half, step, component_id``, once for each id and text of ``rows`` (``doc_id``, ``text``, ``_h``)."""
    told = stage(_prints(rows))
    nodes = told.groupBy("node").agg(F.first("p").alias("p"), F.first("bands").alias("bands"))
    found = components(_links(nodes, similar, chunk))
    least = told.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = ("fp", "half", "step", "node")
    owners = told.groupBy("doc_id", "_h").agg(*[F.first(c).alias(c) for c in facts])
    return owners.join(named.join(groups, "root").select("node", "component_id"), "node").drop("node")


def near_components(docs: DataFrame, similar: float = SIMILAR, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, component_id`` for every row: documents joined by walks of at least that likeness.

    Candidates agree on a band of one walk and are verified by that walk; each bucket is reduced to a
    spanning forest of its verified links.  Equal texts are one node.  ``component_id`` is the smallest
    ``doc_id`` reachable, null if none is known.
    """
    rows = _text(docs)
    found = _components_of(rows, similar, chunk)
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["_h"] == found["_h"])
    return rows.join(found, same).select(rows["doc_id"], "component_id")
