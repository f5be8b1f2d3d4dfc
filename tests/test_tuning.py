"""Search over trials: proposals, brackets, fronts, whole studies."""

import math

import pytest
from pyspark.sql import functions as F

from genoframe.operators import tuning as T

SPACE = (T.Real("x", -4.0, 4.0), T.Real("rate", 1e-3, 1.0, log=True), T.Choice("act", ("relu", "elu", "tanh")))


def test_search_finds_better_trials_than_chance(spark):
    def objective(p):
        return -((p["x"] - 1.5) ** 2) - abs(math.log10(p["rate"]) + 2) - (p["act"] != "elu")

    trials = T.optimise(spark, objective, SPACE, rounds=5, per_round=10, seed=3)
    rows = trials.collect()
    assert sorted(r["trial_id"] for r in rows) == list(range(50)) and {r["state"] for r in rows} == {"COMPLETE"}
    assert all(-4 <= r["x"] <= 4 and 1e-3 <= r["rate"] <= 1 and r["act"] in SPACE[2].options for r in rows)
    early, late = ([r["value"] for r in rows if lo <= r["trial_id"] < hi] for lo, hi in ((0, 10), (30, 50)))
    assert sum(late) / len(late) > sum(early) / len(early)
    assert T.best_parameters(trials, SPACE)["act"] in SPACE[2].options


def test_failed_trials_and_patience(spark):
    def fails(p):
        if p["x"] > 0:
            raise ValueError("too high")
        return 0.0

    trials = T.optimise(spark, fails, SPACE[:1], rounds=6, per_round=6, patience=2)
    states = {r["state"] for r in trials.collect()}
    assert "COMPLETE" in states and any(s.startswith("FAIL: too high") for s in states)
    assert trials.count() == 18  # a first best, then two rounds without a better one
    more = T.optimise(spark, fails, SPACE[:1], rounds=1, per_round=2, history=trials)
    assert more.count() == 20
    with pytest.raises(RuntimeError):
        T.best_parameters(trials.where("value > 1"), SPACE[:1])


def test_jobs_of_their_own(spark):
    asked = spark.createDataFrame([(0, 0, 0.5), (0, 1, -0.5)], "study long, trial_id long, x double")
    done = T.run_as_jobs(asked, SPACE[:1], lambda p: spark.range(10).count() + p["x"])
    assert sorted((r["trial_id"], r["value"]) for r in done.collect()) == [(0, 10.5), (1, 9.5)]


def test_proposals_of_odd_studies(spark):
    nan = float("nan")
    rows = [(1, i, nan if i == 3 else None if i == 4 else float(i), 9.0 if i == 5 else i / 10, 0.1, "elu" if i else "none") for i in range(30)] + [(2, 0, None, 0.0, 0.1, "relu")]
    trials = spark.createDataFrame(rows, "study long, trial_id long, value double, x double, rate double, act string")
    found = T.propose(trials, SPACE, 3).collect()
    assert len(found) == 2 * 3 * 3 and all((r["number"] is None) == (r["parameter"] == "act") for r in found)
    assert all(r["gain"] == 0 for r in found if r["study"] == 2)
    best = T.best_trials(trials)
    assert sorted(r["trial_id"] for r in best.collect()) == [27, 28, 29]
    assert T.propose(trials.where("false"), SPACE).count() == 0


def test_candidates_stay_with_their_study(spark, monkeypatch):
    """Beyond few studies only trials and sums are exchanged: candidates, 48 for each parameter of a study, are not, nor sorted."""
    trials = spark.range(400).selectExpr("id % 9 AS study", "id AS trial_id", "double(id * 7 % 101) AS value", "double(id % 80) / 10 - 4 AS x", "0.001 + (id % 13) / 20D AS rate", "element_at(array('relu', 'elu', 'tanh'), int(id % 3) + 1) AS act").repartition(3)
    few = sorted(map(tuple, T.propose(trials, SPACE, 2).collect()))
    monkeypatch.setattr(T, "BROADCAST_KEYS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = T.propose(trials, SPACE, 2)
        plan = asked._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, asked.collect())) == few and len(few) == 9 * 2 * 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.index("Generate posexplode")]
    assert "Exchange" not in above and "Sort" not in above


def test_rungs_and_brackets(spark):
    assert T.rungs(1, 9, 3) == [1, 3, 9]
    for wrong in ((0, 9, 3), (5, 4, 3), (1, 9, 1)):
        with pytest.raises(ValueError):
            T.rungs(*wrong)
    rows = [(1, t, s, float(t) if s < 4 else float(t) + (10 if t == 0 else 0)) for t in range(0, 27 * 9, 9) for s in range(1, 10)]
    ends = {r["trial_id"]: r for r in T.hyperband(spark.createDataFrame(rows, "study long, trial_id long, step int, value double"), least=1, most=9, eta=3).collect()}
    assert {r["bracket"] for r in ends.values()} == {b for b in range(3)} & {r["bracket"] for r in ends.values()}
    own = sorted(t for t, r in ends.items() if r["bracket"] == 0)
    gone = [t for t in own if not ends[t]["stopped"]]
    assert len(gone) == max(1, len(own) // 3 // 3) and gone == own[-len(gone) :]


def test_patience_keeps_a_trial_that_still_rises(spark):
    rows = [(1, t * 3, s, float(-t) if t else -100.0 + s) for t in range(4) for s in (1, 2, 3, 4)]
    frame = spark.createDataFrame(rows, "study long, trial_id long, step int, value double")
    kept = lambda p: {r["trial_id"] for r in T.hyperband(frame, least=2, most=4, eta=2, patience=p).where("NOT stopped").collect()}
    assert kept(1) > kept(0)


def test_fronts(spark):
    rows = [(1, 0, 1.0, 1.0, 1.0), (1, 1, 2.0, 0.0, 0.0), (1, 2, 1.0, 1.0, 1.0), (1, 3, 0.5, 0.5, 0.9), (1, 4, None, 9.0, 9.0), (1, 5, float("nan"), 9.0, 9.0), (2, 6, 0.0, 0.0, 0.0), (1, 7, 0.0, 0.0, 2.0)]
    trials = spark.createDataFrame(rows, "study long, trial_id long, a double, b double, c double")
    ids = lambda o: sorted(r["trial_id"] for r in T.pareto_front(trials, o).collect())
    assert ids(("a",)) == [1, 6] and ids(("a", "b")) == [0, 1, 2, 6] and ids(("a", "b", "c")) == [0, 1, 2, 6, 7]
    assert T.pareto_front(trials, ("a", "b")).columns == trials.columns
    assert T.pareto_front(trials.where(F.lit(False)), ("a", "b")).count() == 0
