"""Principal components of samples x loci by a randomised range finder over tiles.

The matrix stays in tiles of samples x loci. A round multiplies it by a thin factor of
the loci and its transpose by the result; both products add up over tiles as arrays.
Thin factors are orthonormalised through their small Gram matrix, which is all that
comes to the driver (width x width numbers).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.session import cut, drop_cut, ship_package, tidy

#: Loci and samples of a tile.
TILE_LOCI, TILE_SAMPLES = 512, 512
#: Directions beside those asked for.
OVERSAMPLE = 10
_FACTOR = "block long, names binary, rows binary"


@dataclass
class Components:
    """Singular values of the centred training matrix, and every sample's places along its components."""

    singular: np.ndarray
    places: DataFrame


def _factor(names: np.ndarray, rows: np.ndarray, block: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.ascontiguousarray(names).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(rows).tobytes()], pa.binary())], names=["block", "names", "rows"])


def _opened(row: dict, names: str = "names", rows: str = "rows") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[names], np.int64)
    return ids, np.frombuffer(row[rows], np.float64).reshape(len(ids), -1)


def _tiles(cells: DataFrame) -> DataFrame:
    """Tiles of centred values; a missing or absent cell is at its locus's training mean, so it adds nothing."""
    block = lambda c, n: F.floor(F.col(c) / F.lit(float(n)))
    placed = cells.select(block("sample_id", TILE_SAMPLES).alias("sb"), block("locus_id", TILE_LOCI).alias("lb"), "sample_id", "locus_id", "x", "fit")

    def pack(table: pa.Table) -> pa.Table:
        data = [np.asarray(table[c].to_numpy(zero_copy_only=False)).astype(t) for c, t in (("sample_id", np.int64), ("locus_id", np.int64), ("x", np.float64), ("fit", np.uint8))]
        return pa.table([table["sb"][:1], table["lb"][:1], *(pa.array([d.tobytes()], pa.binary()) for d in data)], names=["sb", "lb", "s", "l", "x", "fit"])

    return placed.groupBy("sb", "lb").applyInArrow(lambda t: pack(t), "sb long, lb long, s binary, l binary, x binary, fit binary")


def _product(tiles: DataFrame, factor: DataFrame, by_loci: bool, fit_only: bool) -> DataFrame:
    """The matrix times a factor of the loci (``by_loci``), or its transpose times one of the samples; sums over tiles first inside a task, then between tasks."""
    here, there = ("lb", "sb") if by_loci else ("sb", "lb")
    joined = tiles.join(factor, tiles[here] == factor["block"]).drop("block")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s, l, x, fit = (np.frombuffer(row[c], t) for c, t in (("s", np.int64), ("l", np.int64), ("x", np.float64), ("fit", np.uint8)))
                if fit_only:
                    s, l, x = s[fit > 0], l[fit > 0], x[fit > 0]
                names, rows = _opened(row)
                inner, outer = (l, s) if by_loci else (s, l)
                at = np.searchsorted(names, inner)
                known = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == inner)
                out = np.unique(outer)
                dense = np.zeros((len(out), len(names)))
                np.add.at(dense, (np.searchsorted(out, outer[known]), at[known]), x[known])
                yield _factor(out, dense @ rows, row[there])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, total = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                own, rows = _opened(row)
                if row["block"] != now:
                    if now is not None:
                        yield _factor(names, total, now)
                    now, names, total = row["block"], own, rows.copy()
                    continue
                every = np.union1d(names, own)
                summed = np.zeros((len(every), rows.shape[1]))
                summed[np.searchsorted(every, names)] += total
                summed[np.searchsorted(every, own)] += rows
                names, total = every, summed
        if now is not None:
            yield _factor(names, total, now)

    partial = joined.mapInArrow(tidy(multiply), _FACTOR).sortWithinPartitions("block").mapInArrow(tidy(add), _FACTOR)
    return partial.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(add), _FACTOR)


def _gram(factor: DataFrame) -> np.ndarray:
    """The small matrix of a factor's inner products: one array for each task, then one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                _, rows = _opened(row)
                total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    parts = [np.frombuffer(r["g"]) for r in factor.mapInArrow(tidy(run), "g binary").collect()]
    if not parts:
        return np.zeros((0, 0))
    width = int(round(len(parts[0]) ** 0.5))
    return sum(parts).reshape(width, width)


def _times(factor: DataFrame, small: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, rows = _opened(row)
                yield _factor(names, rows @ small, row["block"])

    return factor.mapInArrow(tidy(run), _FACTOR)


def _orthonormal(factor: DataFrame) -> DataFrame:
    """The same span with orthonormal columns; directions that are not there are dropped. Twice, as once squares the condition."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(_gram(factor))
        sound = values > values.max() * 1e-13
        before, factor = factor, cut(_times(factor, vectors[:, sound] / np.sqrt(values[sound])))
        drop_cut(before)
    return factor


def principal_components(cells: DataFrame, components: int, *, train: str | None = None, oversample: int = OVERSAMPLE, rounds: int = 4, tolerance: float = 1e-9, seed: int = 0) -> Components:
    """Components of the training samples, and all samples' places along them.

    ``cells``: ``sample_id``, ``locus_id``, ``g`` (null: at the locus's training mean; a
    locus without a training call is 0) and, if named, a boolean column ``train``. Rounds
    of multiplication go on until the singular values change by less than ``tolerance`` of
    the largest, ``rounds`` at most. Fewer components than asked are returned where the
    matrix has fewer, and no rows where it has none. Signs are so that the place of greatest size is positive.
    """
    spark = cells.sparkSession
    ship_package(spark)
    fit = F.col(train) if train else F.lit(True)
    g = F.col("g").cast("double")
    means = cells.groupBy("locus_id").agg(F.avg(F.when(fit, g)).alias("mean"))
    centred = cells.join(means, "locus_id").where("g IS NOT NULL AND mean IS NOT NULL").select("sample_id", "locus_id", (g - F.col("mean")).alias("x"), fit.alias("fit"))
    nothing = Components(np.zeros(0), spark.createDataFrame([], "sample_id long, places array<double>"))
    if not (centred.where("fit").agg(F.sum(F.col("x") * F.col("x"))).collect()[0][0] or 0):
        return nothing
    tiles = cut(_tiles(centred))
    wide = components + oversample

    def drawn(table: pa.Table) -> pa.Table:
        names = np.sort(np.asarray(table["locus_id"].to_numpy()).astype(np.int64))
        # A locus's row comes from its own number, so no dealing of tasks changes it.
        rows = np.stack([np.random.default_rng([seed, int(n)]).standard_normal(wide) for n in names])
        return pa.Table.from_batches([_factor(names, rows, table["block"][0].as_py())])

    loci = means.select(F.floor(F.col("locus_id") / F.lit(float(TILE_LOCI))).alias("block"), "locus_id")
    q = _orthonormal(cut(loci.groupBy("block").applyInArrow(lambda t: drawn(t), _FACTOR)))
    singular = None
    for _ in range(rounds + 1):
        y = cut(_product(tiles, q, True, True))
        values, vectors = np.linalg.eigh(_gram(y)) if not y.isEmpty() else (np.zeros(0), np.zeros((0, 0)))
        now = np.sqrt(np.maximum(values[::-1], 0.0))
        settled = singular is not None and len(now) == len(singular) and np.abs(now - singular)[:components].max(initial=0.0) <= tolerance * max(now.max(initial=0.0), 1e-300)
        singular = now
        if settled or not len(now):
            break
        before, q = q, _orthonormal(cut(_product(tiles, y, False, True)))
        drop_cut(before)
        drop_cut(y)
    if not len(singular) or singular[0] == 0:
        return nothing
    # The last factor belongs to one product more.
    values, vectors = np.linalg.eigh(_gram(cut(_product(tiles, q, True, True))))
    order = np.argsort(-values)[:components]
    order = order[values[order] > values.max() * 1e-12]
    said = _product(tiles, _times(q, vectors[:, order]), True, False)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, places = _opened(row)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(places), pa.list_(pa.float64()))], names=["sample_id", "places"])

    placed = cut(said.mapInArrow(tidy(rows), "sample_id long, places array<double>"))
    sign = [F.max_by(F.signum(F.col("places")[i]), F.struct(F.round(F.abs(F.col("places")[i]), 9), -F.col("sample_id"))).alias(f"s{i}") for i in range(len(order))]
    signs = placed.agg(*sign).select(F.array(*[f"s{i}" for i in range(len(order))]).alias("signs"))
    turned = placed.crossJoin(F.broadcast(signs)).select("sample_id", F.zip_with("places", "signs", lambda p, s: p * s).alias("places"))
    # A sample without a call has no cell in any tile: it is at the mean.
    everyone = cells.select("sample_id").distinct().join(turned, "sample_id", "left").select("sample_id", F.coalesce("places", F.array(*[F.lit(0.0)] * len(order))).alias("places"))
    return Components(np.sqrt(values[order]), everyone)


def exact_components(cells: DataFrame, components: int) -> Components:
    """The same of all samples where loci are few, from the loci's inner products (loci x loci numbers come to the driver), to rounding; signs are open. Samples with no call are rows too."""
    ship_package(cells.sparkSession)
    means = {r["locus_id"]: r["mean"] for r in cells.groupBy("locus_id").agg(F.avg("g").alias("mean")).where("mean IS NOT NULL").collect()}
    loci = np.array(sorted(means), np.int64)
    centre = np.array([means[n] for n in loci.tolist()], np.float64)

    def pack(table: pa.Table) -> pa.Table:
        names, at = np.unique(table["sample_id"].to_numpy(), return_inverse=True)
        known = table["g"].is_valid().to_numpy()
        to = np.searchsorted(loci, table["locus_id"].to_numpy()[known])
        rows = np.zeros((len(names), len(loci)))
        rows[at[known], to] = table["g"].drop_null().to_numpy() - centre[to]
        return pa.Table.from_batches([_factor(names.astype(np.int64), rows, table["block"][0].as_py())])

    block = F.floor(F.col("sample_id") / F.lit(float(TILE_SAMPLES))).alias("block")
    factor = cut(cells.select(block, F.col("sample_id").cast("long").alias("sample_id"), F.col("locus_id").cast("long").alias("locus_id"), F.col("g").cast("double").alias("g")).groupBy("block").applyInArrow(lambda t: pack(t), _FACTOR))
    values, vectors = np.linalg.eigh(_gram(factor))
    order = np.argsort(-values)[:components]
    order = order[values[order] > values.max(initial=0.0) * 1e-12]
    turn = vectors[:, order]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, own = _opened(row)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(own @ turn), pa.list_(pa.float64()))], names=["sample_id", "places"])

    return Components(np.sqrt(values[order]), factor.mapInArrow(tidy(rows), "sample_id long, places array<double>"))
