"""Ranks, running sums and extremes by ranges: exact, and no task holds all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoframe.operators import evaluate, relate, training


def largest_window(df):
    """The most rows that one window partition of the last running total held."""
    return df.groupBy("__range").count().agg(F.max("count")).collect()[0][0]


@pytest.mark.parametrize("share", [0.0, 0.9, 1.0])
@pytest.mark.parametrize("tie", ["id", "name"])
def test_nulls_and_one_value_are_split_by_ties(spark, share, tie, monkeypatch):
    n = 20_000
    rows = spark.range(n).withColumn("name", F.lower(F.hex(F.xxhash64("id")))).withColumn("key", F.when(F.col("id") % 100 >= share * 100, F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 7)).cast("double"))
    parts = {}
    plain = relate.Window.partitionBy

    def seen(*columns):
        parts["asked"] = columns
        return plain(*columns)

    monkeypatch.setattr(relate.Window, "partitionBy", staticmethod(seen))
    got = relate.running_total(rows, "key", F.lit(1), "place", [tie]).collect()
    order = sorted(got, key=lambda r: (r["key"] is None, r["key"] or 0, r[tie]))
    assert [r["place"] for r in order] == list(range(1, n + 1))
    assert parts["asked"] == ("__range",)


def test_ranges_stay_small(spark):
    rows = spark.range(20_000).withColumn("key", F.when(F.col("id") % 10 == 0, 1.0))
    total = relate.running_total(rows, "key", F.lit(1), "place", ["id"])
    plan = total._jdf.queryExecution().toString()
    assert "__range" in plan
    # The ranges themselves: what the window is partitioned by.
    ranged = rows.withColumn("__tie", F.col("id").cast("double"))
    cuts = sorted(set(relate._ranges(ranged, "__tie")))
    assert ranged.groupBy(relate._place(F.col("__tie"), cuts)).count().agg(F.max("count")).collect()[0][0] < 20_000 / 50


@pytest.mark.parametrize("least", [False, True])
@pytest.mark.parametrize("backwards", [False, True])
def test_running_extremes(spark, least, backwards):
    rng = np.random.default_rng(1)
    rows = [(int(i // 2), float(x) if x > 0.2 else None, int(i % 3)) for i, x in enumerate(rng.random(1500))]
    got = relate.running_extreme(spark.createDataFrame(rows, "at int, x double, k int"), "at", F.col("x"), "best", least=least, backwards=backwards, keys=["k"]).collect()
    pick = min if least else max
    for r in got[::37]:
        known = [x for at, x, k in rows if k == r["k"] and x is not None and (at >= r["at"] if backwards else at <= r["at"])]
        assert r["best"] == (pick(known) if known else None)


def test_bootstrap_is_with_replacement_and_covers(spark):
    rng = np.random.default_rng(2)
    pairs = spark.createDataFrame([(i, int(t), int(t if rng.random() < 0.7 else rng.integers(0, 3))) for i, t in enumerate(rng.integers(0, 3, 600))], "id long, y_true int, y_pred int")
    draw = lambda rep: F.pmod(F.xxhash64("id", rep), F.lit(1 << 53)) / F.lit(float(1 << 53))
    weights = pairs.select(evaluate.poisson_weight(draw(F.lit(3))).alias("w")).collect()
    assert abs(sum(r["w"] for r in weights) / 600 - 1) < 0.15 and max(r["w"] for r in weights) > 2
    reports = evaluate.bootstrap_reports(pairs, (0, 1, 2), 60, draw)
    bounds = {r["label"]: r for r in evaluate.bootstrap_interval(reports.where("metric = 'recall'")).collect()}
    whole = {r["label"]: r["recall"] for r in evaluate.class_report(evaluate.confusion(pairs, (0, 1, 2))).collect()}
    assert set(bounds) == set(whole)
    for label, b in bounds.items():
        assert b["lower"] < whole[label] < b["upper"] and b["upper"] - b["lower"] < 0.2


def test_report_of_no_pairs(spark):
    none = evaluate.confusion(spark.createDataFrame([], "y_true int, y_pred int"), (0, 1))
    rows = {r["label"]: r for r in evaluate.class_report(none).collect()}
    assert set(rows) == {"0", "1", "macro avg", "weighted avg", "accuracy"} and all(r["f1"] == 0 and r["support"] == 0 for r in rows.values())
    assert all(r["jaccard"] == 0 for r in evaluate.jaccard(none).collect())


def test_macro_curves_are_numpys(spark):
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 3, 60)
    rows = [(c, bool(t == c), float(np.round(rng.random() * 0.5 + 0.5 * (t == c), 1))) for t in truth for c in range(3)]
    got = sorted((r["curve"], r["x"], r["y"]) for r in evaluate.macro_curves(spark.createDataFrame(rows, "cls int, positive boolean, score double"), (0, 1, 2)).collect())
    want = []
    for curve in ("roc", "pr"):
        lines = []
        for c in range(3):
            own = sorted(((s, p) for k, p, s in rows if k == c), reverse=True)
            points = [(0.0, 0.0 if curve == "roc" else 1.0)]
            np_, nn = sum(p for _, p in own), sum(not p for _, p in own)
            for s in sorted({s for s, _ in own}, reverse=True):
                tp, fp = sum(p for q, p in own if q >= s), sum(not p for q, p in own if q >= s)
                points.append((fp / nn, tp / np_) if curve == "roc" else (tp / np_, tp / (tp + fp)))
            lines.append(np.array(points))
        grid = np.unique(np.concatenate([x[:, 0] for x in lines]))
        mean = sum(np.interp(grid, x[:, 0], x[:, 1]) for x in lines) / 3
        want += [(curve, round(float(a), 9), round(float(b), 9)) for a, b in zip(grid, mean, strict=True)]
    assert [(c, x) for c, x, _ in got] == [(c, x) for c, x, _ in sorted(want)]
    assert np.allclose([y for *_, y in got], [y for *_, y in sorted(want)])


def test_losses_and_schedules(spark):
    one = spark.createDataFrame([(0.5, 0), (1.0, 1), (None, 2), (0.5, -1), (0.5, None), (0.5, 3)], "p double, t int")
    loss = [r[0] for r in one.select(training.focal_loss(F.col("p"), F.col("t"), weights=(2.0, 1.0, 1.0), gamma=2.0, scale=3.0)).collect()]
    assert loss[0] == pytest.approx(3 * 2 * 0.25 * math.log(2)) and loss[1] == 0 and loss[2] == pytest.approx(-3 * math.log(1e-9), rel=1e-6) and loss[3:] == [None] * 3
    with pytest.raises(ValueError):
        training.focal_loss(F.lit(0.5), F.lit(0), weights=(1.0,))
    rows = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 0.0]), (1, [0.0, 0.0], [0.0, 0.0]), (2, [0.0], [float("nan")]), (3, [0.0], [1e9]), (4, None, None)], "k int, m array<double>, v array<double>")
    assert {r["k"]: r["kl"] for r in training.reduced_kl(rows, "m", "v", by=["k"]).collect()} == {1: 0.25, 2: 0.0, 3: 1e6, 4: 0.0}
    assert training.reduced_kl(rows.where("k = 1"), "m", "v", reduction="sum").collect()[0][0] == 0.5
    both = spark.createDataFrame([(1.0, 2.0), (float("inf"), 1.0), (None, 1.0)], "r double, k double").select(training.vae_loss(F.col("r"), F.col("k"), 0.5, 10.0))
    assert [r[0] for r in both.collect()] == [11.0, 1e6, 1e6]
    ramp = spark.range(6).select(training.annealed(F.col("id"), F.lit(2), F.lit(2), 1.0, 0.25))
    assert [r[0] for r in ramp.collect()] == [0.25, 0.25, 0.0, 0.5, 1.0, 1.0]


def test_early_stopping(spark):
    nan = float("nan")
    runs = {1: [5.0, 4.0, 4.5, 4.4, 4.3, 1.0], 2: [nan, nan, nan, nan], 3: [3.0, 2.0, 1.0], 4: [1.0, None, float("-inf"), 0.9]}
    rows = [(s, e + 1, v) for s, vs in runs.items() for e, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "study int, epoch int, value double").repartition(3)
    ends = {r["study"]: tuple(r)[1:] for r in training.early_stopping(frame, patience=2, least_epochs=3).collect()}
    assert ends == {1: (4, 2, 4.0, True), 2: (3, None, None, True), 3: (3, 3, 1.0, False), 4: (3, 1, 1.0, True)}
    assert {r["study"]: r["best"] for r in training.early_stopping(frame, patience=9, least_epochs=1, delta=0.2).collect()}[4] == 1.0
    assert {r["study"]: r["best"] for r in training.early_stopping(frame, patience=9, least_epochs=1, mode="max").collect()} == {1: 5.0, 2: None, 3: 3.0, 4: 1.0}
    with pytest.raises(ValueError):
        training.early_stopping(frame, patience=1, least_epochs=1, mode="other")
