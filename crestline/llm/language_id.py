"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training documents in the executors.  The
classifier itself is fitted on a bounded hash sample of them (``SAMPLE`` rows a language, ``ROWS`` in
all) by follow-the-regularised-leader with elastic-net penalties, a fifth of the sample being held back to
calibrate one temperature.  Executors turn the sample into features; the driver gets these alone.
Every language is learned; one costs the driver half a megabyte.  Prediction reads each whole text
once; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline.llm._common import spare, uniform60

#: Hash buckets of character n-grams of 1 to 3 characters.
DIMS = 1 << 15
#: Expected training rows of a language, and of all, that the classifier is fitted on; a language has one at least.
SAMPLE, ROWS = 600, 12_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 2e-5, 1e-5
UNKNOWN = "und"

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of the lower-cased whole text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    total, gram = np.zeros(DIMS, dtype=np.int64), c
    for n in range(3):
        if n:
            if len(c) <= n:
                break
            gram = gram[:-1] * np.uint64(0x100000001B3) + c[n:]
        total += np.bincount(((gram * _MIX[n]) >> np.uint64(49)).astype(np.int64), minlength=DIMS)
    return total


@dataclass
class LanguageModel:
    """Fitted weights ``(DIMS + 1, languages)``, the last row a bias, and a temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Nonzero positions and TF-IDF values, of unit length, with the bias."""
        return tf_idf(text, self.idf)

    def logits(self, text: str) -> np.ndarray:
        at, x = self.features(text)
        return x @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 for a text without a letter."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = ngram_counts(text)
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return np.append(at, DIMS), np.append(x / norm if norm else x, 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of ``docs`` (``text``) each bucket occurs, and the number of rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                seen += ngram_counts(text or "") > 0
                rows += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"at": np.append(at, DIMS), "n": np.append(seen[at], rows)})

    parts = docs.select("text").mapInPandas(count, "at long, n long")
    df = np.zeros(DIMS + 1, dtype=np.int64)
    for row in parts.groupBy("at").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows at most
        df[row["at"]] = row["n"]
    return df[:DIMS], int(df[DIMS])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int) -> np.ndarray:
    """Weights after ``EPOCHS`` passes of FTRL-proximal over sparse rows, in order."""
    z, n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))

    def weights(at):
        pull = np.maximum(np.abs(z[at]) - L1, 0) * -np.sign(z[at])
        return pull / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for (at, x), label in zip(rows, labels, strict=True):
            w = weights(at)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of least log loss, by golden-section search of its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        top = z.max(axis=1)
        return float((np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(len(labels)), labels]).mean())

    a, b, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def features(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """``lang, h, at, x``: the sparse TF-IDF rows of ``rows`` (``text, lang, h``), as bytes of 2 and 4 a value."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [tf_idf(t or "", shared.value) for t in batch["text"]]
            at, x = [a.astype("<u2").tobytes() for a, _ in found], [v.astype("<f4").tobytes() for _, v in found]
            yield pd.DataFrame({"lang": batch["lang"], "h": batch["h"], "at": at, "x": x})

    return rows.mapInPandas(read, "lang string, h long, at binary, x binary")


def train(docs: DataFrame, seed: str = "lang-1", sample: int = SAMPLE) -> LanguageModel:
    """Learn from all rows of ``docs`` (``doc_id``, ``text``, ``lang``) with a language.

    A row is in the sample by a hash of its id and text, so null and repeated ids matter
    no more than others; of equal rows one is taken.  Without any row with a language
    the model knows none and predicts ``und`` for all.
    """
    known = docs.filter(F.col("lang").isNotNull()).select("text", F.col("lang").cast("string"), uniform60(seed, F.col("doc_id"), F.md5("text")).alias("h"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return LanguageModel([], np.zeros(DIMS), np.zeros((DIMS + 1, 0)))
    df, total = document_frequencies(known)
    idf = np.log((1 + total) / (1 + df)) + 1
    each = max(1, min(sample, ROWS // len(languages)))
    below = {r["lang"]: max(r["least"] + 1, int(2**60 * min(1.0, each / r["n"]))) for r in counts}
    limit = F.create_map(*[F.lit(x) for item in below.items() for x in item])
    picked = known.filter(F.col("h") < limit[F.col("lang")]).dropDuplicates(["lang", "h"])
    rows = sorted(features(picked, idf).collect(), key=lambda r: (r["h"] % 1_000_003, r["h"], r["lang"]))
    texts = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float)) for r in rows]
    labels = [languages.index(r["lang"]) for r in rows]
    first = {label: i for i, label in reversed([*enumerate(labels)])}
    fit = [i for i, label in enumerate(labels) if i % 5 or len(rows) < 20 or i == first[label]]  # no language is held back whole
    weights = fit_ftrl([texts[i] for i in fit], [labels[i] for i in fit], len(languages))
    held = sorted({*range(len(rows))} - {*fit})
    logits = np.array([texts[i][1] @ weights[texts[i][0]] for i in held]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, fit_temperature(logits, np.array([labels[i] for i in held], dtype=int)))


def held_out(doc_id: Column) -> Column:
    """Whether a document stays out of training: CRC-32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _predictor(docs: DataFrame, model: LanguageModel):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for texts in batches:
            yield pd.DataFrame([fitted.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict("text")


def predict_languages(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, then predict every row.

    Returns ``doc_id, held_out, lang_pred, score``.  A null ``doc_id`` is not held out;
    a null ``lang`` is not learned from; repeated rows are predicted one by one.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = train(rows.filter(~held_out(F.col("doc_id"))))
    told = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _predictor(docs, model).alias("told"))
    return told.select("doc_id", "held_out", "told.lang_pred", "told.score")


def drop_unidentified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is told with at least ``least`` certainty, all columns.

    Rejected: texts that are null or have no letter (``und``), and texts between languages.  Where no row has a
    language to learn from, only texts without a letter are rejected.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.filter(F.coalesce(F.regexp_count("text", F.lit(r"\p{L}")) > 0, F.lit(False)))
    (told,) = spare(docs.columns, "_told")
    marked = docs.withColumn(told, _predictor(docs, model))
    return marked.filter((F.col(told).lang_pred != UNKNOWN) & (F.col(told).score >= least)).drop(told)
