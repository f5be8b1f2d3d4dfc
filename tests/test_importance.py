"""Importance of parameters: the tree's marginals are the direct ones on a full grid."""

import numpy as np
import pytest

from genoframe.operators import compare


def test_a_full_grid_has_the_direct_marginals():
    rng = np.random.default_rng(0)
    grid = np.array([(i, j, k) for i in range(4) for j in range(3) for k in range(2)])
    values = 3.0 * grid[:, 0] ** 2 + rng.normal(0, 1, len(grid)) * (grid[:, 1] == 2)
    n = rng.integers(1, 5, len(grid)).astype(float)
    shares = compare.variance_shares(grid, [4, 3, 2], n, values * n)
    cube = values.reshape(4, 3, 2)
    direct = [cube.mean(axis=tuple(a for a in range(3) if a != p)).var() / cube.var() for p in range(3)]
    assert shares == pytest.approx(direct)


def test_missing_combinations_and_leaves_of_a_weight():
    x = np.array([[0, 0], [1, 1], [2, 0]])
    shares = compare.variance_shares(x, [3, 2], np.ones(3), np.array([0.0, 5.0, 10.0]))
    assert shares[0] > shares[1] and shares.sum() <= 1 + 1e-9
    assert compare.variance_shares(x, [3, 2], np.ones(3), np.array([0.0, 5.0, 10.0]), least=2.0).tolist() == [0.0, 0.0]


def test_studies_numbers_and_nulls(spark):
    rng = np.random.default_rng(1)
    rows = [(s, float(x), "u" if rng.random() < 0.5 else None, None if i % 10 == 0 else float("nan") if i % 11 == 0 else float(10 * (x > 0.5) if s else 1.0)) for s in (0, 1) for i, x in enumerate(rng.random(200))]
    trials = spark.createDataFrame(rows, "study int, rate double, act string, value double")
    found = {(r["study"], r["parameter"]): r["importance"] for r in compare.functional_importance(trials, ["rate", "act"], study="study").collect()}
    assert found[1, "rate"] > 0.95 and found[0, "rate"] == found[0, "act"] == 0
    assert sum(v for (s, _), v in found.items() if s == 1) == pytest.approx(1, abs=1e-6)
    assert compare.functional_importance(trials.where("false"), ["rate", "act"]).count() == 0
