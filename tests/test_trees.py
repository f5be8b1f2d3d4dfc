"""Trees from merged counts: equal to a plain grower, whatever the tiles."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoframe.operators import learned
from genoframe.operators import trees as T
from genoframe.operators.popgen import correlations, nearest_loci


def plain(x, y, w, depth, score, weigh, leaf, value):
    """Recursion over rows: the first best of all features and cuts."""

    def grow(rows, d):
        if d == depth:
            return value(rows)
        best = (1e-9, None)
        for f in range(x.shape[1]):
            for c in range(2):
                low = x[rows, f] <= c
                a, b = rows[low], rows[~low]
                if weigh(a) >= leaf and weigh(b) >= leaf and score(a) + score(b) - score(rows) > best[0] + 1e-12:
                    best = (score(a) + score(b) - score(rows), (f, c, a, b))
        if best[1] is None:
            return value(rows)
        f, c, a, b = best[1]
        return (f, c, grow(a, d + 1), grow(b, d + 1))

    return grow(np.arange(len(x)), 0)


def follow(node, row):
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


@pytest.fixture(scope="module")
def toy():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 3**4, 60))
    x = T.features_of(codes, 4)
    y = np.where(x[:, 1] == 2, 2, np.where(x[:, 0] + x[:, 3] > 2, 1, 0))
    y = np.where(rng.random(len(y)) < 0.2, rng.integers(0, 3, len(y)), y)
    return codes, x, y.astype(np.int64), rng.integers(1, 9, len(y)).astype(float)


def test_patterns_are_base_three_numbers():
    assert T.features_of(np.array([0, 5, 3**38 * 2]), 39)[:, [0, 1, 38]].tolist() == [[0, 0, 0], [2, 1, 0], [0, 0, 2]]


def test_a_tree_is_the_plain_growers(toy):
    codes, x, y, w = toy
    plan = T.Plan("forest", trees=1, depth=4, features=4, leaf=2.0, bootstrap=False)
    hot = np.eye(3)[y] * w[:, None]
    total = lambda rows: hot[rows].sum(axis=0)
    score = lambda rows: (total(rows) ** 2).sum() / total(rows).sum() if len(rows) else 0.0
    tree = plain(x, y, w, 4, score, lambda rows: w[rows].sum(), 2.0, lambda rows: total(rows) / total(rows).sum())
    ours = T.fit_predict(plan, 0, 4, codes, y, w, codes)
    assert np.allclose(ours, [follow(tree, r) for r in x])


def test_boosting_is_plain_newton_boosting(toy):
    codes, x, y, w = toy
    plan = T.Plan("boosting", trees=3, depth=2, leaf=3.0, rate=0.2)
    hot, scores = np.eye(3)[y], np.tile(T.prior(np.bincount(y, w, 3)), (len(x), 1))
    for _ in range(3):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        step = np.zeros_like(scores)
        for c in range(3):
            g, h = (hot - p)[:, c] * w, (p * (1 - p))[:, c] * w
            score = lambda rows, g=g, h=h: g[rows].sum() ** 2 / max(h[rows].sum(), 1e-12)
            tree = plain(x, y, w, 2, score, lambda rows: w[rows].sum(), 3.0, lambda rows, g=g, h=h: 0.2 * g[rows].sum() / max(h[rows].sum(), 1e-12))
            step[:, c] = [follow(tree, r) for r in x]
        scores = scores + step
    assert np.allclose(T.fit_predict(plan, 0, 4, codes, y, w, codes), scores)


def test_poisson_weights():
    keys = np.arange(20_000, dtype=np.uint64)
    for mean in (1.0, 7.5, 500.0):
        drawn = T.poisson(np.full(20_000, mean), T._mix(keys))
        assert abs(drawn.mean() / mean - 1) < 0.03 and abs(drawn.var() / mean - 1) < 0.05 and (drawn >= 0).all()
    assert (T.poisson(np.zeros(5), keys[:5]) == 0).all()


@pytest.mark.parametrize("plan", [T.Plan("forest", trees=12, depth=3, seed=3), T.Plan("boosting", trees=3, depth=2, leaf=2.0)])
def test_tiles_do_not_change_the_trees(spark, plan):
    rng = np.random.default_rng(8)
    rows = []
    for locus in (3, 9, 10):
        for code in np.unique(rng.integers(0, 3**5, 70)).tolist():
            rows += [(locus, code, int(c), int(rng.integers(1, 5))) for c in {code % 3, int(rng.integers(0, 3))}]
            rows.append((locus, code, None, 2))
    rows += [(20, 1, 0, 50), (20, 2, None, 1), (21, 1, 0, 1), (21, 2, 1, 1), (21, 3, None, 1)]  # one class; too few
    counts = spark.createDataFrame(rows, "locus_id long, code long, y int, n long").repartition(4)
    whole = sorted(map(tuple, T.predict(counts, plan, 5).collect()))
    tiled = sorted(map(tuple, T.predict(counts, plan, 5, tile_patterns=30).collect()))
    assert whole == tiled and {r[0] for r in whole} == {3, 9, 10}
    assert len(whole) == len({(r[0], r[1]) for r in rows if r[2] is None and r[0] < 20})
    assert T.predict(counts.where("false"), plan, 5).count() == 0


def test_wrong_plans_are_refused(spark):
    for wrong in ({"kind": "other"}, {"trees": 0}, {"depth": 0}, {"leaf": 0.0}):
        with pytest.raises(ValueError):
            T.Plan(**wrong)
    with pytest.raises(ValueError):
        T.predict(spark.createDataFrame([], "locus_id long, code long, y int, n long"), T.Plan(), 40)


def test_a_forest_of_many_patterns_fits_a_worker():
    """Each row's class and weight are held, not three weights: 300 trees of 8,000 rows took over 100 MB."""
    rng = np.random.default_rng(3)
    codes, y = np.divmod(np.unique(rng.integers(0, 3**11, 12_000)), 3)
    tracemalloc.start()
    T.fit_predict(T.Plan("forest", trees=300, depth=1), 0, 10, codes, y, np.ones(len(y)), codes[:1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6


def test_ten_neighbours_never_take_a_job_for_each_level(spark, monkeypatch):
    """More rows than 65,536, as 300,000 samples have; boosting took hundreds of jobs for them."""
    monkeypatch.setattr(T, "_by_levels", lambda *_: 1 / 0)
    counts = spark.range(70_000).select(F.lit(0).cast("long").alias("locus_id"), F.expr("id div 3").alias("code"), F.when(F.col("id") > 0, F.col("id") % 3).cast("int").alias("y"), F.lit(1).cast("long").alias("n"))
    rows = T.predict(counts, T.Plan("boosting", trees=1, depth=1), 10).collect()
    assert [(r["locus_id"], r["code"]) for r in rows] == [(0, 0)]


@pytest.mark.parametrize("plan", [T.Plan("forest", trees=9, depth=4, seed=5), T.Plan("forest", trees=4, depth=3, leaf=2.0, bootstrap=False)])
def test_a_whole_locus_is_counted_by_joint_codes(toy, plan, monkeypatch):
    """One count by node and joint code in place of one for each feature; the trees are those of the sums by feature."""
    codes, _, y, w = toy
    asked = np.array([0, 5, 80])
    with monkeypatch.context() as patch:
        patch.setattr(T, "JOINT_BYTES", 0)
        slow = T.fit_predict(plan, 7, 4, codes, y, w, asked)
    monkeypatch.setattr(T.Stage, "sums", lambda *_: 1 / 0)
    assert np.allclose(T.fit_predict(plan, 7, 4, codes, y, w, asked), slow, atol=1e-12)


def test_draws_are_those_of_the_cumulative_law():
    mean, key = np.array([1.0, 3.0, 40.0, 64.0, 1.0]), np.arange(5, dtype=np.uint64)
    u = T._uniform(key)
    for m, x, drawn in zip(mean, u, T.poisson(mean, key), strict=True):
        total = chance = np.exp(-m)
        k = 0
        while x > total:
            k += 1
            chance *= m / k
            total += chance
        assert drawn == k


def test_chained_rounds_are_the_plain_ones(spark):
    """Absent cells, rows that are not fitted on and null keys; a round is worked out from one row a sample."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 3, 50)
    rows = [(s, j, 0, None if rng.random() < 0.2 else int(base[s] if rng.random() < 0.8 else rng.integers(0, 3)), bool(rng.random() < 0.8)) for s in range(50) for j in range(6) if rng.random() < 0.9]
    cells = spark.createDataFrame([*rows, (None, 1, 0, 1, True), (3, None, 0, None, True)], "sample_id long, locus_id long, pop_id int, g int, fit boolean")
    plan = T.Plan("forest", trees=7, depth=3, seed=2)
    ours = {(r["sample_id"], r["locus_id"]): r["imputed"] for r in learned.fill_chained(cells, plan=plan, neighbours=3, rounds=2, train="fit").collect()}
    known = {j: [r[3] for r in rows if r[1] == j and r[3] is not None] for j in range(6)}
    now = {(s, j): g if g is not None else int(np.bincount(known[j], minlength=3).argmax()) for s, j, _, g, _ in rows}
    near = {}
    for r in nearest_loci(correlations(cells.where("sample_id IS NOT NULL AND locus_id IS NOT NULL")), 3).collect():
        near.setdefault(r["locus_id"], []).append((r["neighbour"], r["rank"]))
    for _ in range(2):
        code = {(s, j): sum(now.get((s, n), 0) * 3 ** (k - 1) for n, k in near[j]) for s, j, *_ in rows if any((s, n) in now for n, _ in near[j])}
        guess = {}
        for j in range(6):
            fit = [(code[s, j], g) for s, i, _, g, f in rows if i == j and g is not None and f and (s, j) in code]
            pairs, n = np.unique(np.array(fit), axis=0, return_counts=True)
            asked = np.unique([code[s, j] for s, i, _, g, _ in rows if i == j and g is None and (s, j) in code]).astype(np.int64)
            said = np.round(T.fit_predict(plan, j, 3, pairs[:, 0], pairs[:, 1], n.astype(float), asked), 9).argmax(axis=1)
            guess |= {(s, j): int(said[np.searchsorted(asked, code[s, j])]) for s, i, _, g, _ in rows if i == j and g is None and (s, j) in code}
        now |= guess
    assert ours == now
