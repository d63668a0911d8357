import math

import numpy as np
import pytest

from semtag.llm.whitening import clusters, eigen, refine, whiten


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0]
    return (q * values) @ q.T, q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 50, 40),
        np.r_[np.full(5, 7.0), np.linspace(1, 3, 20)],  # equal values
        np.r_[10 + 1e-8 * np.arange(6), 10 + 1e-4 * np.arange(5), np.linspace(1, 5, 20)],  # too close for single precision
        np.r_[3 + 1e-11 * np.arange(4), 3 + 1e-6, np.zeros(10)],
        np.geomspace(1e-9, 1e6, 30),
        np.zeros(4),
        np.array([2.0]),
    ],
)
def test_eigenvectors_to_double_precision(values):
    a, _ = symmetric(values)
    a = (a + a.T) / 2
    got, x = eigen(a)
    scale = max(np.abs(values).max(), 1e-300)
    assert np.allclose(got, np.sort(values)[::-1], rtol=0, atol=1e-13 * scale)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-13
    assert np.abs(a @ x - x * got).max() < 1e-12 * scale
    want = np.linalg.eigh(a)
    order = np.argsort(-want[0])
    gaps = np.array([np.abs(np.delete(want[0], i) - want[0][i]).min(initial=np.inf) for i in order])
    for i, gap in enumerate(gaps):
        if gap > 1e-9 * scale:  # a vector of its own
            assert np.abs(np.abs(x[:, i]) - np.abs(want[1][:, order[i]])).max() <= 1e-12 * scale / gap


def test_a_step_improves_single_precision_quadratically():
    a, _ = symmetric(np.linspace(1, 20, 12))
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    off = lambda v: np.abs((s := v.T @ a @ v) - np.diag(np.diag(s))).max()
    once = refine(a, x)[1]
    assert off(x) > 1e-7 and off(once) < 1e-11
    assert [sorted(c) for c in clusters(np.array([1, 5, 1.1, 9, 5.05]), 0.2)] == [[0, 2], [1, 4]]


def brute(rows):
    """Whole numbers, exact; the rest in long double."""
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s).astype(np.longdouble) / n
    cov = (centred.T @ centred / n).astype(float)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:4]
    return {i: (n, int(((n * np.array(v, object) - s) ** 2).sum()), ((n * np.array(v, object) - s).astype(float) / n) @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)) for i, v in x.items()}


def test_equals_brute_force(spark):
    r = np.random.default_rng(5)
    spread = np.array([5, 3, 2, 1.5, 0.4, 0.3, 0.2, 0.1])
    good = [(i, (r.normal(size=8) * spread + 2).tolist()) for i in range(300)]
    hot = [(1000 + i, good[0][1]) for i in range(150)] + [(2000, [c + 1e-6 for c in good[1][1]]), (2001, [-0.0] * 8)]
    bad = [(3000, None), (3001, [1.0, None] + [0.0] * 6), (3002, [float("nan")] * 8), (3003, [float("inf")] + [0.0] * 7), (3004, []), (3005, [1e30] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in [*good, *hot, good[3], *bad]], "vec_id long, embedding array<float>, n int, x string").repartition(7)
    got, again = whiten(df).collect(), whiten(df.repartition(3)).collect()
    want = brute([*good, *hot])
    assert len(got) == 4 * (len(good) + len(hot) + 1) and {x["vec_id"] for x in got} == set(want)
    signs = {}
    for x in got:
        n, deviation, whitened, explained = want[x["vec_id"]]
        k = x["component"] - 1
        assert (x["n"], x["deviation"]) == (n, deviation) and math.isclose(x["explained"], explained[k], rel_tol=1e-9)
        sign = signs.setdefault(k, math.copysign(1, x["whitened"] * whitened[k])) if abs(whitened[k]) > 0.1 else signs.get(k)
        assert sign is None or math.isclose(x["whitened"], sign * whitened[k], rel_tol=1e-9, abs_tol=1e-9)
    assert {x["component"] for x in got} == {1, 2, 3, 4} and len({x["identity_error"] for x in got}) == 1 and got[0]["identity_error"] < 1e-10
    key = lambda x: (x["vec_id"], x["component"], x["deviation"], x["explained"], round(x["whitened"], 9))
    assert sorted(map(key, got)) == sorted(map(key, again))  # partitions don't matter


def test_few_and_other_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    make = lambda rows: whiten(spark.createDataFrame(rows, schema))
    assert make([]).count() == 0 and make([(1, [1.0, 2.0])] * 5).count() == 0
    got = make([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0]), (4, [2.0]), (None, [1.0])]).collect()
    two = sorted((x["vec_id"], x["component"], x["n"], x["deviation"], abs(x["whitened"]), x["explained"]) for x in got if x["vec_id"] in (1, 2))
    assert two == [(1, 1, 2, 256**2, 1.0, 1.0), (2, 1, 2, 256**2, 1.0, 1.0)]
    assert sorted((x["deviation"], x["n"]) for x in got if x["vec_id"] not in (1, 2)) == sorted(((3 * v - 768) ** 2, 3) for v in (0, 512, 256))


def test_deviations_above_a_long_are_null(spark):
    got = whiten(spark.createDataFrame([(1, [1e8]), (2, [-1e8]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert {x["vec_id"]: x["deviation"] for x in got} == {1: None, 2: None, 3: 0}
