"""Nearest neighbours, knees and silhouettes of points, by products of tiles.

Points are dealt over blocks by hash, and a block's points are one tile. Every pair of
blocks is a task: a tile is copied twice for each block, so copies grow with the root of
the number of tasks, and no array is larger than two tiles. What leaves a task is the k
nearest of each point, or its sums of distances to each cluster; both merge.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.operators.relate import running_total
from genoframe.session import cut, ship_package

#: Points of a tile, on average.
BLOCK_ROWS = 4096
#: Distances that a task holds at once.
SQUARES = 1 << 20
#: Digits to which squared distances are compared, so that equal ones are ties whatever the order of sums.
DIGITS = 9
_TILE = "block int, ids binary, labels binary, points binary"


def _tiles(points: DataFrame, blocks: int) -> DataFrame:
    def pack(table: pa.Table) -> pa.Table:
        vectors = table["v"].combine_chunks()
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        return pa.table([table["block"][:1], *(pa.array([np.ascontiguousarray(x[order]).tobytes()], pa.binary()) for x in (table["id"].to_numpy(), table["label"].to_numpy().astype(np.int64), matrix))], names=["block", "ids", "labels", "points"])

    dealt = F.coalesce("home", "id") if "home" in points.columns else F.col("id")
    placed = points.select(F.pmod(F.xxhash64(dealt), F.lit(blocks)).cast("int").alias("block"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"))
    return placed.groupBy("block").applyInArrow(lambda t: pack(t), _TILE)


def _meet(points: DataFrame, function: Callable[..., pa.RecordBatch], schema: str, block_rows: int) -> DataFrame:
    """``function`` of every two tiles: ids, labels and squared distances of rows (of the first) to columns (of the second)."""
    ship_package(points.sparkSession)
    blocks = max(1, -(-points.count() // block_rows))
    # Small tables are dealt over all cores too.
    blocks = max(blocks, math.isqrt(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tiles = cut(_tiles(points, blocks))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    asked = tiles.select("*", other).select(F.col("block").alias("a"), F.col("other").alias("b"), F.lit(1).alias("side"), "ids", "labels", "points")
    given = tiles.select("*", other).select(F.col("other").alias("a"), F.col("block").alias("b"), F.lit(0).alias("side"), "ids", "labels", "points")
    dealt = asked.unionByName(given).repartition(blocks * blocks, "a", "b").sortWithinPartitions("a", "b", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                matrix = np.frombuffer(row["points"], np.float64).reshape(len(ids), -1)
                if row["side"] == 0:
                    held, at = (ids, labels, matrix), (row["a"], row["b"])
                elif at == (row["a"], row["b"]):
                    c_ids, c_labels, c = held
                    lengths, step = (c**2).sum(axis=1)[None, :], max(1, SQUARES // max(1, len(c)))
                    for first in range(0, len(ids), step):  # a tile meets the other in slices: few distances are held at once
                        part = matrix[first : first + step]
                        squares = np.maximum((part**2).sum(axis=1)[:, None] + lengths - 2 * part @ c.T, 0.0)
                        yield function(ids[first : first + step], labels[first : first + step], c_ids, c_labels, squares)

    return dealt.mapInArrow(run, schema)


def usable(points: DataFrame, key: str, vector: str, label: str | None = None) -> DataFrame:
    """``id``, ``v``, ``label`` (0 without one) of rows whose key, vector and components are there and finite. All vectors must be of one length."""
    v = F.col(vector).cast("array<double>")
    kept = points.select(F.col(key).cast("long").alias("id"), v.alias("v"), (F.col(label).cast("long") if label else F.lit(0).cast("long")).alias("label"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & sound)


def nearest(points: DataFrame, k: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest other points of each by Euclidean distance: ``id``, ``rank`` from 1, ``neighbour``, ``distance``; ties to the smaller id.

    Exact. Fewer than k others: all of them. Points of equal id are not each other's
    neighbours.
    """

    def first(ids, _, c_ids, __, squares) -> pa.RecordBatch:
        d = np.where(ids[:, None] == c_ids[None, :], np.inf, np.round(squares, DIGITS))
        width = min(k, d.shape[1])
        edge = np.partition(d, width - 1, axis=1)[:, width - 1]
        at, to = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
        order = np.lexsort((c_ids[to], d[at, to], at))
        at, to = at[order], to[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        at, to = at[keep], to[keep]
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(c_ids[to]), pa.array(d[at, to])], names=["id", "neighbour", "d2"])

    found = _meet(points, first, "id long, neighbour long, d2 double", block_rows)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "neighbour", F.sqrt("d2").alias("distance"))


def knee(distances: DataFrame, column: str = "distance") -> DataFrame:
    """``knee``: of the sorted values, the one whose scaled height is farthest above its scaled place; ties to the lowest place.

    Values that are all nearly alike have no knee: their 0.9 quantile and a millionth is
    taken. Places are running counts of distinct values by ranges; the first of equal
    values is the farthest. No values: null.
    """
    counts = cut(distances.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("d")).agg(F.count(F.lit(1)).alias("n")))
    span = counts.agg(F.min("d").alias("low"), F.max("d").alias("high"), F.sum("n").alias("rows"), F.expr("percentile(d, 0.9D, n)").alias("late"))
    upto = running_total(counts, "d", F.col("n"), "upto").crossJoin(F.broadcast(span))
    place = (F.col("upto") - F.col("n")) / F.greatest(F.col("rows") - 1, F.lit(1))
    height = (F.col("d") - F.col("low")) / (F.col("high") - F.col("low") + F.lit(1e-9))
    best = upto.agg(F.max_by("d", F.struct(F.round(height - place, 12), -F.col("upto"))).alias("at"), F.any_value("low").alias("low"), F.any_value("high").alias("high"), F.any_value("late").alias("late"))
    flat = F.col("high") - F.col("low") <= 1e-8 + 1e-5 * F.abs("low")
    return best.select(F.when(flat | (F.col("at") <= 0), F.col("late") + F.when(flat, 1e-6).otherwise(0.0)).otherwise(F.col("at")).alias("knee"))


def silhouettes(points: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id``, ``label``, ``silhouette`` of points with a label of 0 or more; 0 in a cluster of one, null where there is one cluster only.

    A cluster that fits a tile is dealt whole to one, so its sums are done there, and of
    all such clusters of a tile a point needs its own and the nearest one.
    """

    def sums(ids, labels, _, c_labels, squares) -> pa.RecordBatch:
        order = np.argsort(c_labels, kind="stable")
        names, first, n = np.unique(c_labels[order], return_index=True, return_counts=True)
        codes = names >> 1
        total = np.add.reduceat(np.sqrt(squares)[:, order], first, axis=1)
        whole, own = (names & 1) > 0, codes[None, :] == (labels >> 1)[:, None]
        keep = own | ~whole[None, :]
        if whole.any():
            mean = np.where(own | ~whole[None, :], np.inf, total / n)
            nearest_one = mean.argmin(axis=1)
            at = np.arange(len(ids))
            keep[at, nearest_one] |= np.isfinite(mean[at, nearest_one])
        at, to = np.nonzero(keep)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(labels[at] >> 1), pa.array(codes[to]), pa.array(total[at, to]), pa.array(n[to])], names=["id", "label", "other", "total", "n"])

    known = points.where("label >= 0")
    sizes = known.groupBy("label").agg((F.count(F.lit(1)) <= block_rows).alias("whole"))
    # The lowest bit of a label says whether its cluster is whole in its tile.
    marked = known.join(sizes, "label").select("id", "v", (F.col("label") * 2 + F.col("whole").cast("long")).alias("label"), F.when(F.col("whole"), F.col("label")).alias("home"))
    met = _meet(marked, sums, "id long, label long, other long, total double, n long", block_rows)
    merged = met.groupBy("id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("label") == F.col("other")
    sides = merged.groupBy("id", "label").agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, F.col("total") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    score = F.when(F.col("b").isNull(), None).when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return sides.select("id", "label", score.alias("silhouette"))
