import math

import numpy as np
import pytest

from crestline.llm.whitening import block_lanczos, whiten

VECS = "vec_id long, embedding array<float>, component string, x string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], VECS)


def brute(rows, components=4):
    """Whitened values, deviations and shares by numpy's dense solver."""
    kept = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in kept}), dtype=float)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return [(i, n, sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, total, strict=True)), (x - total / n) @ axes / np.sqrt(values), values / np.trace(v)) for i, x in kept]


def compare(got, want, close=1e-8):
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = {}
    assert set(by) == {w[0] for w in want}
    for i, n, deviation, whitened, shares in want:
        for k, (w, share) in enumerate(zip(whitened, shares, strict=True), 1):
            r = by[i][k]
            assert r["n"] == n and r["deviation"] == deviation
            assert math.isclose(r["explained"], share, rel_tol=1e-9) and r["identity_error"] <= 1e-9
            if abs(w) > 1e-3:
                signs.setdefault(k, math.copysign(1, w * r["whitened"]))
            assert abs(r["whitened"] - signs.get(k, 1) * w) < close


def test_equals_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    spread = rng.standard_normal((24, 24)) * (0.2 / np.arange(1, 25))
    rows = [(i, v) for i, v in enumerate((rng.standard_normal((600, 24)) @ spread + 0.3).astype(np.float32).tolist())]
    rows += [(1000 + i, rows[5][1]) for i in range(300)]  # a hot vector weighs once
    rows += [(2000, None), (2001, [None] + [0.0] * 23), (2002, [float("nan")] * 24), (2003, [float("inf")] * 24), (2004, []), (2005, [1.0])]
    want = brute([r for r in rows if r[0] != 2005])
    got = whiten(vectors(spark, rows).repartition(5))
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), want)


def test_close_eigenvalues(spark):
    rng = np.random.default_rng(4)
    rows = list(enumerate((rng.standard_normal((3000, 40)) * 0.1).astype(np.float32).tolist()))
    compare(whiten(vectors(spark, rows)).collect(), brute(rows), 1e-6)


def test_ties_repeats_nulls_and_few_rows(spark):
    rows = [(None, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 0.0])]
    got = whiten(vectors(spark, rows)).collect()
    assert len(got) == 4 * 2 and {r["component"] for r in got} == {1, 2}  # three points span a plane
    assert {r["n"] for r in got} == {3} and all(math.isfinite(r["whitened"]) for r in got)
    assert whiten(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []
    assert whiten(vectors(spark, [])).collect() == []
    assert whiten(vectors(spark, [(1, None)])).collect() == []


def test_deviation_beyond_64_bits_is_null(spark):
    got = whiten(vectors(spark, [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 0.0])])).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: None, 2: None, 3: 65536}


def test_lanczos_restarts_on_breakdown():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((50, 50)))[0]
    for values in ([5.0, 5.0, 5.0, 2.0, 2.0] + [0.0] * 45, [3.0] * 50, list(np.linspace(1, 2, 50)), [1e6, 1.0, 1e-3] + [0.0] * 47):
        v = q @ np.diag(values) @ q.T
        got, axes, passes = block_lanczos(lambda b, v=v: v @ b, 50)
        assert np.allclose(got, sorted(values)[::-1][:4], rtol=0, atol=1e-12 * max(values)) and passes <= 8
        assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-12)
        assert np.abs(v @ axes - axes * got).max() < 1e-11 * max(values)


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_small_dimensions(spark, d):
    rng = np.random.default_rng(d)
    rows = list(enumerate(rng.standard_normal((50, d)).astype(np.float32).tolist()))
    compare(whiten(vectors(spark, rows)).collect(), brute(rows, min(4, d)))
