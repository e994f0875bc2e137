"""Whitening of embeddings by a matrix-free block Lanczos method.

The covariance V of the distinct vectors is never formed: the only use made of it is V·Q for a block Q
of a few columns, a pass over the vectors in which each task centres its rows and adds up
(x - m) (x - m)ᵀ Q, and the tasks' sums are added up by place of the block.  So the driver and every
task hold blocks of d by ``BLOCK`` numbers and the basis, whatever the number of rows.

Each new block is made orthogonal to the whole basis, twice (full reorthogonalisation).  Directions that vanish there are a
breakdown: the basis spans an invariant space, and fresh random directions orthogonal to it take
their place.  The Ritz vectors come from the basis and its images under V, so the residuals |V u - e u|
are known without another pass; the method ends when those of all wanted components are at rounding level,
or when the basis spans the whole space, where the Ritz vectors are exact.

The trace is the sum of the vectors' deviations, so the shares explained need no further eigenvalue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline.llm._common import stage

#: Components returned, and columns of a block: the spare ones speed up close eigenvalues.
COMPONENTS, BLOCK = 4, 8
#: Residual, as a share of the largest eigenvalue, at which a component counts as found.
TOLERANCE = 1e-13
#: Share of the trace below which an eigenvalue is zero: nothing can be divided by its root.
ZERO = 1e-13
SCALE = 256


def block_lanczos(
    times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 0
) -> tuple[np.ndarray, np.ndarray, int]:
    """Largest eigenvalues and unit eigenvectors of the symmetric matrix behind ``times``, and the passes made."""
    rng, block = np.random.default_rng(seed), min(block, d)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    fresh, passes = np.linalg.qr(rng.standard_normal((d, block)))[0], 0
    while True:
        image = times(fresh)
        passes += 1
        basis, images = np.hstack([basis, fresh]), np.hstack([images, image])
        ritz = basis.T @ images
        values, inner = np.linalg.eigh((ritz + ritz.T) / 2)
        values, inner = values[::-1][:wanted], inner[:, ::-1][:, :wanted]
        vectors = basis @ inner
        residual = np.linalg.norm(images @ inner - vectors * values, axis=0)
        top = max(abs(values[0]), np.finfo(float).tiny)
        if basis.shape[1] == d or (basis.shape[1] >= 2 * wanted and passes > 1 and residual.max() <= tolerance * top):
            return values, vectors / np.linalg.norm(vectors, axis=0), passes
        room = min(block, d - basis.shape[1])
        fresh = _orthogonal(image, basis, room, rng, top)


def _orthogonal(image: np.ndarray, basis: np.ndarray, room: int, rng: np.random.Generator, top: float) -> np.ndarray:
    """``room`` unit columns orthogonal to ``basis`` and each other: from ``image``, and random ones where it breaks down."""
    found = np.zeros((len(basis), 0))
    candidates = [image[:, i] for i in range(image.shape[1])]
    while found.shape[1] < room:
        drawn = not candidates
        v = rng.standard_normal(len(basis)) if drawn else candidates.pop(0)
        least = 1e-10 * np.linalg.norm(v) if drawn else 1e-12 * top
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
            v = v - found @ (found.T @ v)
        if (size := np.linalg.norm(v)) > least:
            v = v / size
            v = v - basis @ (basis.T @ v) - found @ (found.T @ v)
            found = np.hstack([found, (v / np.linalg.norm(v))[:, None]])
    return found


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Rows of a list column without nulls, all of length ``d``."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(fit: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum over all rows ``x`` of ``fit`` of what ``part`` makes of a batch of them.

    Every task adds up its own batches; the tasks' sums are added place by place.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = part(_matrix(batch.column("x"), d)).ravel()
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tolist()], pa.list_(pa.float64() if kind == "double" else pa.int64()))})

    sums = fit.select("x").mapInArrow(add, f"v array<{kind}>").select(F.posexplode("v").alias("i", "v"))
    rows = sums.groupBy("i").agg(F.sum("v").alias("v")).collect()  # one number a place
    out = np.zeros(len(rows), dtype=float if kind == "double" else np.int64)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def _finite(vector: str) -> Column:
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: entry(c.cast("double")))


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: the rows whose vector is whole and finite, as integers floor(256 c).

    All vectors of a table have one length, the commonest (ties: the longest): those of another
    length lack entries, or hold too many, and are left out like those with null entries; so are vectors without
    entries.
    """
    whole = vectors.select("vec_id", "embedding").filter(_finite("embedding") & (F.size("embedding") > 0))
    most = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = most[0]["d"] if most else 0
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long"))
    return whole.filter(F.size("embedding") == d).select("vec_id", x.alias("x"))


def _exact(rows: np.ndarray, sums: np.ndarray, n: int) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where 64 bits cannot hold it."""
    far = float(np.abs(rows).max(initial=0)) * n + float(np.abs(sums).max(initial=0))
    if far * far * rows.shape[1] < 2.0**62:
        return ((n * rows - sums) ** 2).sum(axis=1).tolist()
    big = ((n * rows.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in big]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue``.

    A row for each row of ``vectors`` (``vec_id``, ``embedding``) with a whole, finite vector, and
    each component up to ``components``.  Statistics are over distinct integer vectors (``n`` of them), so repeats
    weigh once; repeated rows and null ids are all returned.  Components with an eigenvalue of zero, as
    in a table of a few or of equal vectors, have no whitened value and are left out; an empty table gives
    no row.  Other columns are ignored.  ``deviation`` is null where it exceeds 64 bits.

    The distinct vectors are a table in the shared folder, which every pass reads again, so a lost
    executor costs its tasks of one pass.
    """
    rows = integer_vectors(vectors)
    kind = vectors.schema["vec_id"].dataType
    schema = T.StructType(
        [T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error", "eigenvalue")]
    )
    fit = stage(rows.select("x").distinct())
    n, first = fit.count(), fit.head()
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = len(first["x"])
    sums = _summed(fit, d, lambda x: x.sum(axis=0), "long")
    mean = sums / n
    trace = float(_summed(fit, d, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n

    def times(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return _summed(fit, d, part).reshape(q.shape) / n

    values, axes, _ = block_lanczos(times, d, min(components, d))
    real = values > ZERO * trace if trace > 0 else np.zeros(len(values), dtype=bool)
    values, axes = values[real], axes[:, real]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    lens = axes / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ lens
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = _summed(fit, d, moments).reshape(len(values) + 1, -1) / n
    error = float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(len(values))).max())
    shares = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            if not len(x):
                continue
            each = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n, dtype=np.int64)),
                pa.array(_exact(x, sums, n), pa.int64()).take(pa.array(each)),
                pa.array(((x - mean) @ lens).ravel()),
                pa.array(np.tile(shares, len(x))),
                pa.array(np.full(len(each), error)),
                pa.array(np.tile(values, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(project, schema)
