"""Neighbours, knees, silhouettes and components against plain NumPy."""

import numpy as np
import pyarrow as pa
import pytest

from genoframe.operators import clusters, components, neighbours


def frame(spark, points, labels=None):
    rows = [(i, [float(x) for x in p], 0 if labels is None else int(labels[i])) for i, p in enumerate(points)]
    return neighbours.usable(spark.createDataFrame(rows, "vec_id long, v array<double>, label int").repartition(3), "vec_id", "v", "label")


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_nearest_are_all_pairs(spark, block_rows):
    points = np.random.default_rng(0).integers(0, 4, (60, 3))  # many ties and copies
    found = {}
    for r in neighbours.nearest(frame(spark, points), 4, block_rows=block_rows).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append((r["neighbour"], round(r["distance"], 9)))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    for i in range(60):
        want = sorted((round(float(d[i, j]), 9), j) for j in range(60) if j != i)[:4]
        assert found[i] == [(j, x) for x, j in want]


def test_few_points_and_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None), (None, [1.0, 1.0]), (4, [float("nan"), 0.0]), (5, [None, 1.0])]
    points = neighbours.usable(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    assert sorted(map(tuple, neighbours.nearest(points, 5).collect())) == [(1, 1, 2, 5.0), (2, 1, 1, 5.0)]
    assert neighbours.nearest(points.where("false"), 5).count() == 0
    assert neighbours.knee(neighbours.nearest(points.where("false"), 5)).collect()[0][0] is None


@pytest.mark.parametrize("values", [[1.0, 1.1, 1.2, 5.0, 5.1, 5.2], list(np.random.default_rng(1).random(300)), [2.0] * 9, [0.0, 0.0, 0.0, 1.0]])
def test_knee(spark, values):
    x = np.sort(np.array(values))
    y = (x - x[0]) / (x[-1] - x[0] + 1e-9)
    want = x[np.argmax(np.round(y - np.linspace(0, 1, len(x)), 12))]
    if np.allclose(x, x[0]):
        want = np.quantile(x, 0.9) + 1e-6
    elif want <= 0:
        want = np.quantile(x, 0.9)
    got = neighbours.knee(spark.createDataFrame([(float(v),) for v in values], "distance double")).collect()[0][0]
    assert got == pytest.approx(float(want))


def test_silhouettes(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(0, 1, (30, 2)), rng.normal(3, 1, (25, 2)), [[9.0, 9.0]], rng.normal(0, 5, (4, 2))])
    labels = np.array([0] * 30 + [1] * 25 + [2] + [-1] * 4)
    for block_rows in (11, 4096):
        rows = neighbours.silhouettes(frame(spark, points, labels), block_rows=block_rows).collect()
        assert len(rows) == 56 and [r["silhouette"] for r in rows if r["label"] == 2] == [0.0]
        assert np.mean([r["silhouette"] for r in rows]) == pytest.approx(clusters.silhouette(points, labels))
    assert {r["silhouette"] for r in neighbours.silhouettes(frame(spark, points[:5])).collect()} == {None}


def test_components_are_the_svds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    factors = rng.normal(size=(70, 4)) * [9, 5, 3, 1]
    g = np.clip(np.round(factors @ rng.normal(size=(4, 40)) / 8 + 1), 0, 2)
    missing = rng.random(g.shape) < 0.1
    missing[:, 7] = True
    missing[5] = True
    rows = [(s * 2, j * 3, None if missing[s, j] else int(g[s, j]), s % 4 > 0) for s in range(70) for j in range(40)]
    cells = spark.createDataFrame(rows, "sample_id long, locus_id long, g int, learn boolean").repartition(4)
    monkeypatch.setattr(components, "TILE_LOCI", 16)
    monkeypatch.setattr(components, "TILE_SAMPLES", 32)
    fit = np.arange(70) % 4 > 0
    filled = np.where(missing, np.nan, g)
    means = np.array([np.nanmean(filled[fit, j]) if (~missing[fit, j]).any() else 0.0 for j in range(40)])
    centred = np.where(missing, 0.0, filled - means)
    u, s, v = np.linalg.svd(centred[fit], full_matrices=False)
    found = components.principal_components(cells, 3, train="learn", rounds=12)
    assert found.singular == pytest.approx(s[:3], rel=1e-6)
    places = {r["sample_id"] // 2: r["places"] for r in found.places.collect()}
    assert len(places) == 70 and places[5] == [0.0] * 3
    ours = np.array([places[i] for i in range(70)])
    assert np.allclose(np.abs(ours), np.abs(centred @ v[:3].T), atol=1e-4)
    assert all(ours[np.abs(ours[:, k]).argmax(), k] > 0 for k in range(3))


def test_components_of_little(spark):
    cells = spark.createDataFrame([(s, j, s % 2 if j else 1) for s in range(4) for j in range(3)], "sample_id long, locus_id long, g int")
    found = components.principal_components(cells, 5)
    assert len(found.singular) == 1 and found.singular[0] == pytest.approx(2**0.5)
    still = components.principal_components(cells.withColumn("g", cells["g"] * 0), 2)
    assert len(still.singular) == 0 and still.places.count() == 0


def test_few_distances_are_held_at_once(spark):
    """Two tiles of 3,000 points: nine million distances, which were one array."""

    def size(ids, _, c_ids, __, squares) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([squares.size])], names=["n"])

    points = spark.range(6_000).selectExpr("id", "array(double(id % 7), double(id % 11)) AS v", "0L AS label")
    sizes = [r["n"] for r in neighbours._meet(points, size, "n long", 4096).collect()]
    assert sum(sizes) == 6_000**2 and max(sizes) <= neighbours.SQUARES


def test_components_do_not_depend_on_tiles_which_are_small(spark, monkeypatch):
    """A task holds one tile beside its factors: a quarter of a million cells at most, and the places are the same for other tiles."""
    assert components.TILE_LOCI * components.TILE_SAMPLES <= 1 << 18
    cells = spark.range(60 * 20).selectExpr("floor(id / 20) sample_id", "id % 20 locus_id", "CAST(pmod(xxhash64(id), 3) AS INT) g")
    found = []
    for samples in (512, 7):
        monkeypatch.setattr(components, "TILE_SAMPLES", samples)
        got = components.principal_components(cells, 2, oversample=18)
        found.append([p for r in got.places.orderBy("sample_id").collect() for p in r["places"]])
    assert found[0] == pytest.approx(found[1], abs=1e-7)
