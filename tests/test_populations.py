"""Density clusters of samples on tables against the plain form of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoframe.operators import clusters as C
from genoframe.operators import neighbours


def plain(x):
    """Every setting of the grid, worked out over all pairs."""
    best = (-np.inf, None)
    for least in C.LEAST:
        far = C.neighbour_distances(x, least)
        for eps in np.geomspace(max(C.knee(far) * 0.5, 1e-6), max(far[-1], 1e-5), C.RADII):
            labels = C.dbscan(x, float(eps), least)
            score = len(set(labels[labels >= 0])) - 1.5 * float((labels < 0).mean()) + 0.5 * C.silhouette(x, labels)
            if score > best[0] + 1e-9:
                best = (score, labels)
    return best[1].tolist()


def made(kind):
    rng = np.random.default_rng(4)
    if kind == "noise":
        return rng.normal(size=(90, 4))
    if kind == "copies":  # lists of nearest ones end at distance zero
        return np.repeat(rng.normal(size=(7, 3)) * 5, 12, axis=0)
    dense = [rng.normal(c * 6, 0.3, (40, 2)) for c in range(3)]  # lists end inside a cluster
    return np.concatenate([*dense, rng.uniform(-4, 16, (9, 2))])


@pytest.mark.parametrize("kind", ["noise", "copies", "dense"])
def test_clusters_are_those_of_all_pairs(spark, monkeypatch, kind):
    x = made(kind)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    points = spark.createDataFrame([(i * 3, [float(v) for v in p], 0) for i, p in enumerate(x)], "id long, v array<double>, label long").repartition(3)
    grid = C._Grid(points)
    found = {r["id"] // 3: r["label"] for r in grid.labelled(grid.best()).collect()}
    names = {root: n for n, root in enumerate(sorted({v for v in found.values() if v is not None}))}
    assert [names.get(found[i], -1) for i in range(len(x))] == plain(x)


def test_links_beyond_the_lists_are_found(spark):
    """Two rows of nine copies each, nearer than the radius: no list reaches the other row."""
    x = np.array([[0.0]] * 9 + [[0.5]] * 9 + [[9.0]] * 9)
    grid = C._Grid(spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(x)], "id long, v array<double>, label long"))
    grid.settings = [C._Setting(3, 0.6, 27, 0.0, 27, 3)]
    grid._linked([0])
    assert grid.settings[0].clusters == 3 and not grid.settings[0].exact
    grid._settle(0)
    assert grid.settings[0].clusters == 2
    assert {r["id"]: r["label"] for r in grid.labelled(grid.settings[0]).collect()} == {i: 0 if i < 18 else 18 for i in range(27)}


def test_populations_from_cells(spark):
    """No task has all samples (they met in one), and the clusters are those of the singular vectors."""
    rng = np.random.default_rng(5)
    g = rng.integers(0, 3, (60, 12))
    g[:25] = np.where(rng.random((25, 12)) < 0.9, rng.integers(0, 3, 12), g[:25])
    cells = spark.createDataFrame([(s, j, 0, int(g[s, j])) for s in range(60) for j in range(12)], "sample_id long, locus_id long, pop_id int, g int")
    u, s, _ = np.linalg.svd(g - g.mean(axis=0), full_matrices=False)
    x = u[:, :10] * s[:10]
    got = C.infer_populations(cells)
    assert got.columns == ["sample_id", "cluster"] and "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    assert [r["cluster"] for r in got.orderBy("sample_id").collect()] == plain(x / x.std(axis=0))
    alone = C.infer_populations(cells.where("sample_id = 3"))
    assert [tuple(r) for r in alone.collect()] == [(3, -1)]
    assert C.infer_populations(cells.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("block_rows", [6, 4096])
def test_silhouettes_of_many_clusters(spark, block_rows):
    rng = np.random.default_rng(6)
    x, labels = rng.normal(size=(80, 3)), np.concatenate([np.arange(60) // 2, np.full(20, 30)])
    points = spark.createDataFrame([(i, p.tolist(), int(k)) for i, (p, k) in enumerate(zip(x, labels, strict=True))], "id long, v array<double>, label long")
    rows = neighbours.silhouettes(points, block_rows=block_rows).collect()
    assert len(rows) == 80 and np.mean([r["silhouette"] for r in rows]) == pytest.approx(C.silhouette(x, labels))
