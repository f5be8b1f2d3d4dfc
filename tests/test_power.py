"""Power transform: lambda by merged sums against a search over plain arrays."""

import math

import numpy as np
import pytest

from genoframe.functions.special import power_lambdas, yeo_johnson_by_metric


def turned(x, lam):
    up = x >= 0
    out = np.empty_like(x)
    out[up] = np.log1p(x[up]) if abs(lam) < 1e-9 else ((x[up] + 1) ** lam - 1) / lam
    out[~up] = -np.log1p(-x[~up]) if abs(lam - 2) < 1e-9 else -((1 - x[~up]) ** (2 - lam) - 1) / (2 - lam)
    return out


def best(x):
    loss = lambda lam: len(x) / 2 * math.log(np.var(turned(x, lam))) - (lam - 1) * (np.sign(x) @ np.log1p(np.abs(x)))
    a, b, g = -5.0, 5.0, (math.sqrt(5) - 1) / 2
    while b - a > 1e-9:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return (a + b) / 2


def test_lambdas_and_values(spark):
    rng = np.random.default_rng(0)
    data = {"skewed": np.expm1(rng.normal(2, 0.3, 500)), "mixed": rng.normal(0.5, 2, 400), "tiny": np.abs(rng.normal(0, 1e-3, 300)), "one": np.full(20, 3.0)}
    rows = [(str(i % 2), m, float(x)) for m, xs in data.items() for i, x in enumerate(xs)] + [("0", "mixed", None), ("0", "empty", None)]
    long = spark.createDataFrame(rows, "dataset string, metric string, value double").repartition(5)
    found = {r["metric"]: r["lambda"] for r in power_lambdas(long).collect()}
    assert set(found) == set(data) and found["one"] == 1.0
    for m in ("skewed", "mixed"):
        assert found[m] == pytest.approx(best(data[m]), abs=1e-4)
    out = yeo_johnson_by_metric(long).toPandas()
    for m in ("skewed", "mixed", "tiny"):
        values = out[out["metric"] == m]["value"]
        assert len(values) == len(data[m]) and abs(values.mean()) < 1e-6 and values.std(ddof=0) == pytest.approx(1)
    assert (out[out["metric"] == "one"]["value"] == 0).all()
    assert power_lambdas(long.where("false")).count() == 0
