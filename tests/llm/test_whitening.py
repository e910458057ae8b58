import numpy as np
import pytest

from leakframe.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, component string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], schema)


def brute(rows):
    good = [(i, np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000) for i, v in rows]
    x = np.unique(np.array([v for _, v in good]), axis=0)
    n, total = len(x), x.sum(0)
    y = (n * x - total) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return good, n, total, values, vectors


def same_up_to_sign(rows, out, components):
    good, n, total, values, vectors = brute(rows)
    by = {}
    for r in out:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, components + 1)) and all(len(v) == len(good) for v in by.values())
    for k, found in by.items():
        want = {}
        for i, v in good:
            want[i] = float(((n * v - total) / n) @ vectors[:, k - 1] / np.sqrt(values[k - 1]))
        got = {r.vec_id: r.whitened for r in found}
        sign = 1 if sum(got[i] * want[i] for i in want) > 0 else -1
        assert max(abs(sign * got[i] - want[i]) for i in want) < 1e-8
        assert all(abs(r.explained / (values[k - 1] / values.sum()) - 1) < 1e-9 for r in found)
    exact = {i: int(((n * v - total) ** 2).sum()) for i, v in good}
    assert all(r.deviation == exact[r.vec_id] and r.n == n and r.identity_error < 1e-9 for r in out)


def test_against_the_covariance_matrix(spark):
    rnd = np.random.default_rng(1)
    spread = np.linspace(9, 0.5, 20)
    rows = [(i, (rnd.standard_normal(20) * spread).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a group of copies counts once in the fit
    out = whitening.whitened(table(spark, rows))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    same_up_to_sign(rows, out.collect(), 16)


def test_rank_below_the_dimension(spark):
    rnd = np.random.default_rng(2)
    base = rnd.integers(-9, 9, (3, 12))
    rows = [(i, (rnd.integers(-9, 9, 3) @ base).astype(float).tolist()) for i in range(80)]
    same_up_to_sign(rows, whitening.whitened(table(spark, rows)).collect(), 3)
    few = rows[:3]
    same_up_to_sign(few, whitening.whitened(table(spark, few)).collect(), 2)


def test_equal_eigenvalues_need_new_starts(spark):
    """All corners of a cube: one eigenvalue six times, so one start vector finds a single direction."""
    rows = [(i, [float((i >> b & 1) * 2 - 1) for b in range(6)]) for i in range(64)]
    out = whitening.whitened(table(spark, rows)).collect()
    assert {r.component for r in out} == set(range(1, 7))
    assert all(abs(r.explained - 1 / 6) < 1e-12 and r.identity_error < 1e-12 for r in out)
    first = [np.array([r.whitened for r in sorted(out, key=lambda r: r.vec_id) if r.component == k]) for k in range(1, 7)]
    assert np.allclose(np.array(first) @ np.array(first).T / 64, np.eye(6))


def test_steps_give_the_leading_components(spark):
    rnd = np.random.default_rng(3)
    spread = 2.0 ** -np.arange(40) * 500 + 0.1
    rows = [(i, (rnd.standard_normal(40) * spread).tolist()) for i in range(200)]
    _, _, _, values, _ = brute(rows)
    x = whitening.quantised(table(spark, rows)).select("x").distinct()
    model = whitening.fit(x, components=4, steps=14)
    assert model.steps == 14 and np.allclose(model.deviations ** 2, values[:4], rtol=1e-9)


def test_defined_results(spark):
    rows = [
        (1, [1.0, 2.0]), (2, [3.0, -1.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]), (4, None), (5, []), (6, [1.0, None]),
        (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0]),
    ]
    out = whitening.whitened(table(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2), (10, 1), (10, 2)]
    assert {r.n for r in out} == {3}
    assert whitening.whitened(table(spark, rows).limit(0)).count() == 0
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(table(spark, [(4, None), (5, [])])).count() == 0
    floats = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.7, -0.1])], "vec_id int, embedding array<float>")
    assert whitening.whitened(floats).dtypes[0] == ("vec_id", "int")


def test_huge_entries(spark):
    rows = [(i, [1e300 * (-1) ** i, float(i), -1e300]) for i in range(4)]
    out = whitening.whitened(table(spark, rows)).collect()
    assert {r.deviation for r in out} == {None} and all(np.isfinite(r.whitened) for r in out)
    near = [(i, [1e9 + i, -1e9 + 3.0 * i * i]) for i in range(5)]
    same_up_to_sign(near, whitening.whitened(table(spark, near)).collect(), 2)


@pytest.mark.parametrize("n", [3, 10 ** 9])
def test_exact_deviation(n):
    x = np.array([[5, -7], [1 << 30, 0]])
    model = whitening.Whitening(n, np.array([1, -2]), np.array([2, 1]), None, None, None, 0.0, 0)
    total = [n * 1 + 2, n * -2 + 1]
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x]
    assert whitening.deviation(x, model) == [w if w < 1 << 63 else None for w in want]
