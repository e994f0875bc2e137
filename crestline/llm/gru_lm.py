"""LM scoring with a gated recurrent unit and a class-factored output softmax.

Words are counted over the whole corpus; Arrow splits texts, counts words and looks them up, a column at a time.  The ``HEAD`` most frequent words (with the end
token) have an input vector each and sit in output classes of their own; any other word
is read as its tail class, a hash of its last two letters.  The network predicts
the class of each token from its state; a second softmax on the same state picks
the word within a head class, and a smoothed count ``(c + 1) / (N + V + 1)`` the word within a
tail class, with one place for all unseen words.  The model is thus a distribution over all
words.

Training is truncated backpropagation through time in numpy over all training documents: each
of ``ROUNDS`` rounds reads one part of them, every task trains on the rows of its own partition from
the same weights, and the weights are averaged by tokens in a tree.  So what is learned from grows
with the input, and so does the number of tasks.
Scoring reads every whole text: documents advance in lockstep in windows of ``WINDOW`` tokens,
their states carried from window to window.  Counts of words among the ``HOT`` most frequent
are looked up in a broadcast table of that size; the other words go through a join, in
which, by that choice, no word is frequent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline.llm._common import stage, unstage

HEAD, HEAD_CLASSES, TAIL_CLASSES, HIDDEN = 576, 24, 16, 16
#: Words whose counts are broadcast.
HOT = 100_000
#: Parts of the training documents, one a round, and the updates that a task's tokens are laid out for where they are
#: few: then fewer streams are read side by side, so that each is longer.  Every token is read once.
ROUNDS, UPDATES = 4, 100
#: Tokens that a task lays out at a time, most streams they are cut into, and steps of a window.
TOKENS, STREAMS, WINDOW, RATE = 1 << 21, 512, 24, 0.02
#: Rows of counted words that a task holds before it hands them on, and bytes of texts that are split into words at a time.
FLUSH, BYTES = 500_000, 1 << 23
#: Rows of a slice of output logits, few enough for a processor's cache, and states that wait for the output layer at most, but for a window's.
SLICE, STATES = 2048, 1 << 16
END = ""
_CLASSES, _EACH = HEAD_CLASSES + TAIL_CLASSES, HEAD // HEAD_CLASSES


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch``, some ``BYTES`` of texts at a time or one row."""
    ends = np.cumsum(pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BYTES, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all ``texts`` end to end, and how many each has: runs of anything but ASCII white space, with A-Z in lower case."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
    if real.all():
        return words, sizes
    return words.filter(pa.array(real)), np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))


def tail_classes(words: pa.Array) -> np.ndarray:
    """Class of each word outside the head, from its last two bytes."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    words = words.cast(pa.large_binary())
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    letters, stops = np.frombuffer(words.buffers()[2], np.uint8), edges[1:]
    ahead = np.where(np.diff(edges) > 1, letters[stops - 2], 0).astype(np.int64)
    return (letters[stops - 1].astype(np.int64) * 31 + ahead * 17) % TAIL_CLASSES


def held_out(doc_id: Column) -> Column:
    """Whether a document stays out of training: CRC-32 of its id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c, seen``: places of each token in training rows and in all rows.

    ``docs`` has ``text`` and ``train``; the end token is the empty word.
    """

    def handed_on(held: list[pa.Table]) -> list[pa.RecordBatch]:
        both = pa.concat_tables(held).group_by(["word", "train"], use_threads=False).aggregate([("c", "sum")])
        return both.select(["word", "c_sum", "train"]).rename_columns(["word", "c", "train"]).combine_chunks().to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch):
                for train in (False, True):
                    texts = piece["text"].filter(pc.equal(piece["train"], train))
                    if not len(texts):
                        continue
                    found = words_of(texts)[0].value_counts()
                    words = pa.concat_arrays([found.field("values"), pa.array([END], found.field("values").type)])
                    c = pa.concat_arrays([found.field("counts"), pa.array([len(texts)], pa.int64())])
                    held.append(pa.table({"word": words, "c": c, "train": pa.array(np.full(len(c), train))}))
                    size += len(c)
                if size > FLUSH:
                    yield from handed_on(held)
                    held, size = [], 0
        if held:  # a task may get no rows
            yield from handed_on(held)

    parts = docs.mapInArrow(count, "word string, c long, train boolean")
    return parts.groupBy("word").agg(
        F.sum(F.when(F.col("train"), F.col("c")).otherwise(0)).alias("c"), F.sum("c").alias("seen")
    )


@dataclass
class GRU:
    """Weights: input table, recurrence, class softmax, word softmax of each head class."""

    params: dict[str, np.ndarray]

    @staticmethod
    def shapes() -> dict[str, tuple[int, ...]]:
        return {
            "x": (HEAD + TAIL_CLASSES + 1, 3 * HIDDEN),
            "u": (HIDDEN, 3 * HIDDEN),
            "c": (HIDDEN + 1, _CLASSES),
            "w": (HEAD_CLASSES, HIDDEN + 1, _EACH),
        }

    @classmethod
    def fresh(cls, head: np.ndarray, tails: np.ndarray) -> GRU:
        """Small random weights; output biases start at the corpus frequencies."""
        rng = np.random.default_rng(5)
        p = {k: (rng.standard_normal(s) * 0.15).astype(np.float32) for k, s in cls.shapes().items()}
        each = np.zeros(HEAD)
        each[: len(head)] = head
        mass = np.concatenate([each.reshape(HEAD_CLASSES, _EACH).sum(1), tails]) + 1
        p["c"][-1] = np.log(mass / mass.sum())
        rows = each.reshape(HEAD_CLASSES, _EACH)
        p["w"][:, -1] = np.log(np.where(np.arange(HEAD).reshape(rows.shape) < max(len(head), 1), rows + 1, 1e-30) / (rows.sum(1, keepdims=True) + _EACH))
        return cls(p)

    @classmethod
    def unpack(cls, flat: np.ndarray) -> GRU:
        out, at = {}, 0
        for k, s in cls.shapes().items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return cls(out)

    def pack(self) -> np.ndarray:
        return np.concatenate([self.params[k].ravel() for k in self.shapes()])

    def layers(self) -> tuple[np.ndarray, np.ndarray]:
        """Inputs and recurrence by gate, each gate's block in one piece: update, reset, candidate."""
        return tuple(np.ascontiguousarray(self.params[k].reshape(-1, 3, HIDDEN).swapaxes(0, 1)) for k in ("x", "u"))

    def step(self, layers: tuple[np.ndarray, np.ndarray], h: np.ndarray, token: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """State after reading ``token``, given :meth:`layers`."""
        return _moved(layers[0].take(token, axis=1), np.matmul(h, layers[1]), h, out)

    def log_probs(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural log of P(class) and, for head tokens, of P(class) P(word in class)."""
        out, kind = np.empty(len(token)), classes_of(token)
        for lo in range(0, len(token), SLICE):
            logits = h[lo : lo + SLICE] @ self.params["c"][:-1]
            logits += self.params["c"][-1]
            out[lo : lo + SLICE] = _log_softmax_at(logits, kind[lo : lo + SLICE])
        order = _by_token(token)
        edges = np.searchsorted(token[order], np.arange(0, HEAD + 1, _EACH))
        for k in np.flatnonzero(np.diff(edges)):
            w = self.params["w"][k]
            for lo in range(edges[k], edges[k + 1], SLICE):
                at = order[lo : min(lo + SLICE, edges[k + 1])]
                logits = h.take(at, axis=0) @ w[:-1]
                logits += w[-1]
                out[at] += _log_softmax_at(logits, token[at] % _EACH)
        return out


def _moved(x: np.ndarray, u: np.ndarray, h: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """The next state from inputs and recurrence by gate; ``x`` becomes the gates and the candidate."""
    gates, cand = x[:2], x[2]
    gates += u[:2]
    np.negative(gates, out=gates)
    np.minimum(gates, _TOP, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    cand += u[2] * gates[1]
    np.tanh(cand, out=cand)
    out = np.subtract(h, cand, out=out)
    out *= gates[0]
    out += cand
    return out


def _by_token(token: np.ndarray) -> np.ndarray:
    """Stable order by token; ids fit into 16 bits, which numpy sorts by digits."""
    return np.argsort(token.astype(np.int16), kind="stable")


def classes_of(token: np.ndarray) -> np.ndarray:
    return np.where(token < HEAD, token // _EACH, token - HEAD + HEAD_CLASSES)


def _across(x: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``x``, by a product, as numpy adds up short rows one by one."""
    return x @ np.ones(x.shape[1], dtype=x.dtype)


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probabilities of the places ``at``; ``logits`` is overwritten."""
    np.minimum(logits, _TOP, out=logits)
    own = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    return own - np.log(_across(logits))


def _softmax_error(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probabilities less the places ``at``, in the place of ``logits``."""
    np.minimum(logits, _TOP, out=logits)
    np.exp(logits, out=logits)
    logits *= np.reciprocal(_across(logits))[:, None]
    logits[np.arange(len(at)), at] -= 1
    return logits


_START = HEAD + TAIL_CLASSES
#: Logits above this count as this: their exponentials stay far within single precision.
_TOP = np.float32(60)


def window_gradients(model: GRU, h: np.ndarray, before: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Sums of the gradients of the log loss over one window, and the states after it.

    ``h`` are the states ahead of it, a row a stream, ``before`` the tokens read last and ``target`` the tokens
    to be told, a row a step; places beyond the last token hold -1 and count for nothing.  A stream starts afresh after
    token 0, the end of a document.
    """
    p, n, (steps, streams) = model.params, HIDDEN, target.shape
    beyond = np.flatnonzero(target.reshape(-1) < 0)
    if len(beyond):
        target = np.maximum(target, 0)
    token = np.vstack([before, target[:-1]])
    ended = token == 0
    fresh = ended.any(axis=1)
    token[ended] = _START
    x3, u3 = model.layers()
    gates = np.take(x3, token.ravel(), axis=1).reshape(3, steps, streams, n)  # in the end: z, r and the candidate
    ahead, inner, after = (np.empty((steps, streams, n), dtype=np.float32) for _ in range(3))
    u = np.empty((3, streams, n), dtype=np.float32)
    for t in range(steps):
        np.copyto(ahead[t], h)
        if fresh[t]:
            ahead[t][ended[t]] = 0
        np.matmul(ahead[t], u3, out=u)
        np.copyto(inner[t], u[2])
        h = _moved(gates[:, t], u, ahead[t], after[t])
    flat_h, flat_t = after.reshape(-1, n), target.reshape(-1)
    grad = {k: np.zeros_like(p[k]) for k in ("w", "x", "c")}
    dh, kinds, asked = np.empty_like(flat_h), classes_of(flat_t), flat_t
    for lo in range(0, len(flat_t), SLICE):
        own = flat_h[lo : lo + SLICE]
        d = own @ p["c"][:-1]
        d += p["c"][-1]
        d = _softmax_error(d, kinds[lo : lo + SLICE])
        d[beyond[np.searchsorted(beyond, lo) : np.searchsorted(beyond, lo + SLICE)] - lo] = 0
        grad["c"][:-1] += own.T @ d
        grad["c"][-1] += np.ones(len(d), dtype=d.dtype) @ d
        np.matmul(d, p["c"][:-1].T, out=dh[lo : lo + SLICE])
    if len(beyond):
        asked = flat_t.copy()
        asked[beyond] = -1
    order = _by_token(asked)
    edges = np.searchsorted(asked[order], np.arange(0, HEAD + 1, _EACH))
    for k in np.flatnonzero(np.diff(edges)):
        at, w = order[edges[k] : edges[k + 1]], p["w"][k]
        own = flat_h.take(at, axis=0)
        d = own @ w[:-1]
        d += w[-1]
        d = _softmax_error(d, flat_t[at] % _EACH)
        grad["w"][k, :-1], grad["w"][k, -1] = own.T @ d, np.ones(len(d), dtype=d.dtype) @ d
        dh[at] += d @ w[:-1].T
    z, r, cand = gates
    dh, way = dh.reshape(steps, streams, n), np.empty((3, steps, streams, n), dtype=np.float32)
    of_cand = (1 - z) * (1 - cand * cand)
    np.multiply((ahead - cand) * z, 1 - z, out=way[0])
    np.multiply(of_cand * inner * r, 1 - r, out=way[1])
    np.multiply(of_cand, r, out=way[2])
    back = np.ascontiguousarray(u3.swapaxes(1, 2))
    for t in range(steps - 1, -1, -1):
        own = way[:, t]
        own *= dh[t]
        if t:
            carry = np.matmul(own, back, out=u).sum(axis=0)
            carry += dh[t] * z[t]
            if fresh[t]:
                carry[ended[t]] = 0
            dh[t - 1] += carry
    flat_x, flat_way = token.ravel(), way.reshape(3, -1, n)
    grad["u"] = np.concatenate([ahead.reshape(-1, n).T @ w for w in flat_way], axis=1)
    np.multiply(of_cand, dh, out=way[2])
    order = _by_token(flat_x)
    ranked = flat_x[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    for k, w in enumerate(flat_way):
        grad["x"][ranked[first], k * n : (k + 1) * n] = np.add.reduceat(w.take(order, axis=0), first, axis=0)
    return grad, h


class Trainer:
    """Adam over windows of truncated backpropagation, from given weights."""

    def __init__(self, flat: np.ndarray):
        self.model, self.update, self.tokens = GRU.unpack(flat), 0, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.model.params.items()} for _ in range(2))

    def read(self, line: np.ndarray) -> None:
        """One pass over documents laid end to end, cut into streams that are read side by side; the last ones may be shorter."""
        streams = int(min(STREAMS, max(8, len(line) // (WINDOW * UPDATES))))
        steps = -(-len(line) // streams)
        whole = np.full(steps * streams, -1, dtype=line.dtype)
        whole[: len(line)] = line
        grid = np.ascontiguousarray(whole.reshape(streams, steps).T)
        h, before = np.zeros((streams, HIDDEN), dtype=np.float32), np.full(streams, _START)
        for t0 in range(0, steps, WINDOW):
            target = grid[t0 : t0 + WINDOW]
            grad, h = window_gradients(self.model, h, before, target)
            before = np.maximum(target[-1], 0)
            size = int((target >= 0).sum())
            self.tokens += size
            self.move(grad, size)

    def move(self, grad: dict[str, np.ndarray], size: int) -> None:
        self.update += 1
        for k, p in self.model.params.items():
            g = np.clip(grad[k] / np.float32(size), -0.1, 0.1)
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            p -= RATE * (self.first[k] / (1 - 0.9**self.update)) / (np.sqrt(self.second[k] / (1 - 0.999**self.update)) + 1e-6)


def train_shard(flat: np.ndarray, lines: Iterator[np.ndarray]) -> tuple[np.ndarray, int]:
    """Weights after all ``lines`` (token ids of documents, each with its end), and the tokens read.

    Some ``TOKENS`` tokens are held at a time, and every token is a target once.
    """
    trainer, held, size = Trainer(flat), [], 0
    for own in lines:
        held.append(own)
        size += len(own)
        if size >= TOKENS:
            trainer.read(np.concatenate(held))
            held, size = [], 0
    if size:
        trainer.read(np.concatenate(held))
    return trainer.model.pack(), trainer.tokens


@dataclass
class LanguageModel:
    """What scoring needs: word tables of bounded size, totals and the network."""

    hot: pa.Array  # words, in the order of the next two
    hot_count: np.ndarray
    hot_token: np.ndarray
    ends: int
    total: int
    distinct: int
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    network: np.ndarray | None = None

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Words of each text; of all their words end to end the place in the hot tables, or -1, and the token id; and the words without a place."""
        words, sizes = words_of(texts)
        at = pc.index_in(words, value_set=self.hot.cast(words.type)).fill_null(-1).to_numpy(zero_copy_only=False)
        token, without = self.hot_token[at], at < 0
        rare = words.filter(pa.array(without))
        token[without] = HEAD + tail_classes(rare)
        return sizes, at, token, rare

    @staticmethod
    def lines(sizes: np.ndarray, token: np.ndarray) -> list[np.ndarray]:
        """Token ids of each text, with its end."""
        ends = np.cumsum(sizes)
        return np.split(np.insert(token, ends, 0), (ends + np.arange(1, len(ends) + 1))[:-1])


def frequent(counts: DataFrame, most: int = HOT) -> DataFrame:
    """Words seen so often that at most ``most`` words are: a threshold, so no task sorts or sends more.

    Thresholds grow by a quarter; words are counted by the highest that each reaches.
    """
    steps = sorted({int(1.25**i) for i in range(190)})

    @F.pandas_udf("int")
    def reached(seen: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(steps, seen.to_numpy(np.int64), side="right") - 1).astype("int32")

    at = np.zeros(len(steps), dtype=np.int64)
    for r in counts.groupBy(reached("seen").alias("k")).count().collect():  # 190 rows at most
        at[r["k"]] = r["count"]
    above = at[::-1].cumsum()[::-1]
    least = next((t for t, n in zip(steps, above, strict=True) if n <= most), steps[-1])
    return counts.filter(F.col("seen") >= least)


def _averaged(parts: DataFrame) -> DataFrame:
    """One row ``weights, n`` a partition of ``parts``: the sum of weights times tokens, and the tokens."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, tokens = 0.0, 0
        for batch in batches:
            for weights, n in zip(batch["weights"], batch["n"], strict=True):
                total = total + np.frombuffer(weights, "<f4").astype(float) * n
                tokens += n
        if tokens:
            yield pd.DataFrame({"weights": [total.tobytes()], "n": [tokens]})

    return parts.mapInPandas(add, "weights binary, n long")


def _round(known: DataFrame, shared, turn: int) -> np.ndarray | None:
    """The mean of the weights that the tasks have come to on one part of the documents."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, flat = shared.value

        def lines() -> Iterator[np.ndarray]:
            for batch in batches:
                for piece in pieces(batch):
                    sizes, _, token, _ = model.read(piece["text"])
                    yield from model.lines(sizes, token)

        weights, tokens = train_shard(flat, lines())
        if tokens:
            yield pa.RecordBatch.from_pydict({"weights": [weights.astype("<f4").tobytes()], "n": [tokens]})

    part = known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn).select("text")
    parts = stage(part.mapInArrow(fit, "weights binary, n long"))
    tree = max(1, math.isqrt(parts.count()))
    sums = _averaged(parts.repartition(tree)).collect()  # the root of the number of tasks
    unstage(parts)
    if not sums:
        return None
    return (sum(np.frombuffer(r["weights"], "<f8") for r in sorted(sums, key=lambda r: bytes(r["weights"]))) / sum(r["n"] for r in sums)).astype(np.float32)


def learn(docs: DataFrame, counts: DataFrame) -> LanguageModel:
    """Word tables from ``counts`` (a table), and the network from the training rows of ``docs`` (``doc_id``, ``text``, ``train``)."""
    total, distinct = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    hot = frequent(counts.filter(F.col("word") != END)).collect()
    ends = counts.filter(F.col("word") == END).agg(F.sum("c")).first()[0] or 0
    head = sorted((r for r in hot if r["c"] > 0), key=lambda r: (-r["c"], r["word"]))[: HEAD - 1]
    ids = {r["word"]: i + 1 for i, r in enumerate(head)}
    bodies = F.encode("word", "UTF-8")

    @F.pandas_udf("int")
    def tail(words: pd.Series) -> pd.Series:
        return pd.Series(tail_classes(pa.array(words, pa.binary()))).astype("int32")

    rest = counts.filter((F.col("word") != END) & (F.col("c") > 0)).groupBy(tail(bodies).alias("k"))
    tokens, words = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in rest.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["k"]], words[r["k"]] = r["n"], r["v"]
    for r, k in zip(head, tail_classes(pa.array([r["word"] for r in head], pa.string())), strict=True):
        tokens[k] -= r["c"]
        words[k] -= 1  # what is left is outside the head
    names = pa.array([r["word"] for r in hot], pa.string())
    token = [ids.get(r["word"], HEAD + k) for r, k in zip(hot, tail_classes(names), strict=True)]
    model = LanguageModel(
        names,
        np.array([r["c"] for r in hot] + [0], dtype=np.int64),  # the last is for -1
        np.array([*token, 0], dtype=np.int16),
        ends,
        total or 0,
        distinct or 0,
        tokens,
        words,
    )
    network = GRU.fresh(np.array([ends, *(r["c"] for r in head)], dtype=float), tokens).pack()
    for turn in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast((model, network))
        told = _round(docs.filter("train"), shared, turn)
        network = network if told is None else told
        shared.unpersist()
    model.network = network
    return model


def network_scores(model: LanguageModel, docs: list[np.ndarray], most: int = 1024) -> np.ndarray:
    """Natural log probability of each token sequence under the network's part of the model.

    ``most`` documents advance side by side, the longest first; their states wait for the output
    layer until there are enough of them.
    """
    out = np.zeros(len(docs))
    if not docs:
        return out
    lengths = np.array([len(x) for x in docs])
    order = np.argsort(-lengths, kind="stable")
    sizes, line = lengths[order], np.concatenate([docs[d] for d in order])
    starts = np.cumsum(sizes) - sizes
    net = GRU.unpack(model.network)
    layers = net.layers()
    waiting, rows = [], 0

    def told() -> None:
        states, tokens, owners = (np.concatenate(x) for x in zip(*waiting, strict=True))
        out[:] += np.bincount(owners, weights=net.log_probs(states, tokens), minlength=len(out))

    for lo in range(0, len(order), most):
        size, start, owner = sizes[lo : lo + most], starts[lo : lo + most], order[lo : lo + most]
        h, before = np.zeros((len(size), HIDDEN), dtype=np.float32), np.full(len(size), _START)
        for t0 in range(0, int(size[0]), WINDOW):
            times = np.arange(t0, min(t0 + WINDOW, int(size[0])))
            live = np.searchsorted(-size, -times, side="left")  # documents longer than that
            a = int(live[0])
            block = line.take(start[:a] + times[:, None], mode="clip")
            states = np.empty((len(times), a, HIDDEN), dtype=np.float32)
            for t, b in enumerate(live.tolist()):
                h = net.step(layers, h[:b], before[:b], states[t, :b])
                before = block[t]
            own = np.arange(a) < live[:, None]
            waiting.append((states[own], block[own], np.broadcast_to(owner[:a], own.shape)[own]))
            rows += int(live.sum())
            if rows >= STATES:
                told()
                waiting, rows = [], 0
    if waiting:
        told()
    return out


def score_documents(docs: DataFrame) -> DataFrame:
    """Score every whole text of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, logs
    to base 10.  A null text counts as empty: its end token alone.  A null ``doc_id``
    is a training row; repeated rows are scored one by one; other columns are
    ignored.  Where nothing is left to train on, counts are 0 and all words share a class.
    """
    rows = docs.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("train"))
    counts = stage(word_counts(rows.select("text", "train")))
    model = learn(rows, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cold = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("times", T.LongType())]))
    schema = T.StructType(
        [T.StructField("uid", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("train", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")]
        + [T.StructField(c, T.DoubleType()) for c in ("base", "score")]
        + [T.StructField("cold", cold)]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        uid = TaskContext.get().partitionId() << 40
        log_base = np.append(np.log10(m.hot_count[:-1] + 1) - np.log10(m.total + m.distinct + 1), 0.0)  # the last is for -1
        rooms = np.log10(m.tail_tokens + m.tail_words + 1)
        log_tail = np.where(m.hot_token < HEAD, 0.0, np.log10(m.hot_count + 1) - rooms[np.maximum(m.hot_token - HEAD, 0)])
        end_base = np.log10(m.ends + 1) - np.log10(m.total + m.distinct + 1)
        met = (m.hot_count > 0).astype(float)

        def told_of(piece: pa.RecordBatch) -> tuple[list[pa.Array], np.ndarray, list[np.ndarray]]:
            """Columns but for the id and the score, the score without the network's part, and token ids."""
            sizes, at, token, rare = m.read(piece["text"])
            of = np.repeat(np.arange(len(sizes)), sizes)
            known, base, tail = (np.bincount(of, x[at], len(sizes)) for x in (met, log_base, log_tail))
            times = pa.table({"of": of[at < 0], "word": rare}).group_by(["of", "word"], use_threads=False).aggregate([([], "count_all")])
            times = times.sort_by("of").combine_chunks()
            words = times["word"].combine_chunks()
            kinds = pa.array(tail_classes(words), pa.int32())
            each = pa.StructArray.from_arrays([words, kinds, times["count_all"].combine_chunks()], ["word", "k", "times"])
            stops = np.cumsum(np.bincount(times["of"].to_numpy(), minlength=len(sizes)))
            cold = pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), each)
            counts = [pa.array(sizes + 1, pa.int64()), pa.array(known.astype(np.int64) + (m.ends > 0), pa.int64())]
            return [piece["doc_id"], piece["train"], *counts, pa.array(base + end_base), cold], tail, m.lines(sizes, token)

        for batch in batches:
            told = [told_of(piece) for piece in pieces(batch)]
            network = network_scores(m, [line for _, _, lines in told for line in lines]) / np.log(10)
            at = 0
            for columns, tail, _ in told:
                n = len(tail)
                ids = pa.array(np.arange(uid + at, uid + at + n))
                scores = pa.array(tail + network[at : at + n])
                yield pa.RecordBatch.from_arrays([ids, *columns[:-1], scores, columns[-1]], names=schema.names)
                at += n
            uid += at

    told = stage(rows.mapInArrow(score, schema))
    room = F.lit(float(model.total + model.distinct + 1))
    rooms = F.array(*[F.lit(float(a + b + 1)) for a, b in zip(model.tail_tokens, model.tail_words, strict=True)])
    rare = told.select("uid", F.explode("cold").alias("x")).select("uid", "x.*")
    c = F.coalesce("c", F.lit(0))
    extra = (
        rare.join(counts.select("word", "c"), "word", "left")
        .groupBy("uid")
        .agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
            F.sum(F.col("times") * F.log10((c + 1) / room)).alias("more_base"),
            F.sum(F.col("times") * F.log10((c + 1) / F.element_at(rooms, F.col("k") + 1))).alias("more"),
        )
    )
    return told.drop("cold").join(extra, "uid", "left").select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
