"""Whitening against plain numpy on all rows, and hard cases for the factorisation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import queries, whitening
from test_llm_queries import rows


def plain(pairs, top=4):
    """``{(vec_id, component): ..}`` from the singular values of all rows at once."""
    usable = [
        (v, [math.floor(float(np.float64(c)) * 256) for c in e])
        for v, e in pairs
        if e is not None and all(c is not None and math.isfinite(c) for c in e) and len(e)
    ]
    out = {}
    for d in {len(x) for _, x in usable}:
        own = [(v, x) for v, x in usable if len(x) == d]
        fit = sorted({tuple(x) for _, x in own})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array(fit, float) - np.array([t / n for t in s])
        _, sigma, vt = np.linalg.svd(centred, full_matrices=False)
        e, u = sigma**2 / n, vt.T
        for k in range(min(top, int((sigma > 1e-12 * sigma[0]).sum()))):
            for v, x in own:
                dev = sum((n * c - t) ** 2 for c, t in zip(x, s))
                y = (np.array(x, float) - np.array([t / n for t in s])) @ u[:, k] / math.sqrt(e[k])
                out[v, k + 1] = n, dev, y, e[k] / e.sum()
    return out


def check(got, want, tolerance=1e-7):
    assert len(got) == len(want) and {(r.vec_id, r.component) for r in got} == set(want)
    sign = {}
    for r in got:
        n, dev, y, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev if dev <= whitening.LONG else None)
        assert abs(r.explained - explained) <= 1e-9 and 0 <= r.identity_error <= 1e-9
        space = r.component, n
        if space not in sign and abs(y) > 0.05:
            sign[space] = math.copysign(1, r.whitened * y)
        assert abs(sign.get(space, 1.0) * r.whitened - y) <= tolerance or abs(y) <= 0.05


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equals_numpy_on_the_whole_table(spark, sf):
    path = f"/root/testdata/sf{sf}"
    got = queries.QUERIES["op12_whitening"](spark, path).collect()
    check(got, plain(rows(path, "embeddings", "vec_id, embedding")))


def frame(spark, pairs, ddl="vec_id long, embedding array<double>"):
    return spark.createDataFrame(pairs, ddl)


def test_unusable_rows_copies_and_widths(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, list(map(float, rng.normal(size=5)))) for i in range(40)]
    pairs += [(100 + i, pairs[0][1]) for i in range(50)]  # copies
    pairs += [(7, pairs[1][1]), (None, pairs[2][1])]  # a repeated id, no id
    pairs += [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [math.nan] * 5), (204, [math.inf] * 5)]
    pairs += [(300 + i, list(map(float, rng.normal(size=2)))) for i in range(9)]
    pairs += [(400, [1.0] * 7), (401, [1.0] * 7)]  # one distinct vector of its width
    pairs += [(500, [0.0]), (501, [2.0])]
    got = whitening.whiten(frame(spark, pairs).repartition(7)).collect()
    ids = {r.vec_id for r in got}
    assert not ids & {200, 201, 202, 203, 204, 400, 401} and {None, 149, 308, 500} <= ids
    assert {r.n for r in got} == {40, 9, 2}
    assert sum(r.vec_id == 7 for r in got) == 8
    check([r for r in got if r.vec_id != 7], {k: v for k, v in plain(pairs).items() if k[0] != 7})
    assert whitening.whiten(frame(spark, pairs).limit(0)).count() == 0
    clash = frame(spark, pairs).withColumns({c: F.lit("x") for c in ("x", "n", "component", "d")})
    assert whitening.whiten(clash).count() == len(got)


def test_dependent_and_badly_scaled_dimensions(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3000, 4)) * [1e5, 30.0, 1.0, 0.02]
    full = np.floor(np.c_[base, base[:, 0] + base[:, 1], np.full(3000, 3.0), base[:, 2]] * 256) / 256
    full[:, 4] = full[:, 0] + full[:, 1]  # exactly dependent
    pairs = [(i, list(map(float, x))) for i, x in enumerate(full)]
    got = whitening.whiten(frame(spark, pairs)).collect()
    want = plain(pairs)
    assert {k for _, k in want} == {1, 2, 3, 4}
    check(got, want, 1e-5)


def test_fit_takes_passes_until_orthonormal(spark):
    rng = np.random.default_rng(6)
    full = rng.normal(size=(2000, 6)) @ np.diag([1e6, 1e4, 1e2, 1, 0.1, 0.05])
    fit = frame(spark, [(i, list(map(float, x))) for i, x in enumerate(full)]).selectExpr(f"{whitening.grid()} AS x")
    space = whitening.fit_spaces(fit)[6]
    assert 2 <= space.passes <= whitening.PASSES and space.orthogonality <= 1e-12
    x = np.floor(full * 256)
    exact = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 2000
    assert np.allclose(space.values, exact, rtol=1e-9)  # a Gram matrix alone loses the last ones


def test_exact_deviation_beyond_a_long_is_null(spark):
    got = whitening.whiten(frame(spark, [(0, [1e12, 0.0]), (1, [-1e12, 5.0]), (2, [0.0, 1.0])])).collect()
    assert got and all(r.deviation is None or r.deviation >= 0 for r in got) and any(r.deviation is None for r in got)
    got = whitening.whiten(frame(spark, [(0, [1e300, 0.0]), (1, [-1e300, 5.0])])).collect()
    assert {r.component for r in got} == {1}
