"""Exact top-k search by tiled matrix products.

Query vectors and candidate vectors are packed into tiles (a few thousand rows as one
binary matrix). Candidate tiles are dealt over groups, every query tile is sent to
every group once, and a task multiplies the query tiles it received by its candidate
tiles, keeping the k best of each product. The lists then merge as a tree: inside the
task, and between groups by a window that Spark limits before the exchange. Nothing
is sampled and no index approximates: every query meets every candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.session import ship_package

#: Rows in a candidate tile and in a query tile: 4096 vectors of 64 doubles are 2 MB.
TILE_ROWS = 4096
QUERY_ROWS = 1024
#: Candidates that one group holds on average.
GROUP_ROWS = 262_144
#: Float products are exact while every partial sum stays below this.
EXACT = 2**53


def _pack(scale: float, id_column: str, rows: int):
    """Batches of (id, vector) to tiles of quantised vectors; vectors of one length share a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            parts = waiting.pop(dim)
            ids, matrix = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            for dim in np.unique(lengths):
                take = np.nonzero(lengths == dim)[0]
                matrix = np.floor(flat[starts[take][:, None] + np.arange(dim)] * scale)
                for at in range(0, len(take), rows):
                    waiting.setdefault(int(dim), []).append((ids[take[at : at + rows]], matrix[at : at + rows]))
                    if sum(len(p[0]) for p in waiting[int(dim)]) >= rows:
                        yield flush(int(dim))
        for dim in list(waiting):
            yield flush(dim)

    return run


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products; through BLAS while that is exact, else in Python integers held to 64 bits."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), np.int64)
    if np.abs(queries).max() * np.abs(candidates).max() * queries.shape[1] < EXACT:
        return np.rint(queries @ candidates.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in queries], object), np.array([[int(x) for x in row] for row in candidates], object)
    return np.clip(whole[0].dot(whole[1].T), -(2**63), 2**63 - 1).astype(np.int64)


def best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query row how many candidates are its k best, and their positions one after another; the own id is left out.

    Partial selection first: everything at or above the k-th score is kept, then only that is sorted.
    """
    rows = []
    own = query_ids[:, None] == ids[None, :]
    low = np.iinfo(np.int64).min
    masked = np.where(own, low, scores)
    width = masked.shape[1]
    cut = np.partition(masked, width - k, axis=1)[:, width - k] if width > k else np.full(len(masked), low)
    for i in range(len(masked)):
        at = np.nonzero((masked[i] >= cut[i]) & ~own[i])[0]
        order = at[np.lexsort((ids[at], -masked[i, at]))][:k]
        rows.append(order)
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return lengths, flat


def _merged(q_ids: np.ndarray, q: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], k: int) -> pa.RecordBatch:
    """The k best of each query over all held tiles: the lists of two tiles merge, then those of the merged ones."""
    empty = np.zeros(0, np.int64)
    row = ids = score = empty
    for c_ids, c in held:
        scores = _scores(q, c)
        lengths, flat = best(q_ids, c_ids, scores, k)
        more = np.repeat(np.arange(len(q_ids)), lengths)
        row, ids, score = np.concatenate([row, more]), np.concatenate([ids, c_ids[flat]]), np.concatenate([score, scores[more, flat]])
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
        row, ids, score = row[keep], ids[keep], score[keep]
    return pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int, *, id_column: str = "vec_id", vector: str = "embedding", scale: float = 256.0, groups: int | None = None, tile_rows: int = TILE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For every query its k candidates of the highest integer inner product, the query's own id left out.

    Returns ``query_id`` long, ``rank`` int from 1, ``vec_id`` long, ``score`` long.
    Components become floor(scale * x). Vectors that are null or hold a null, NaN or
    infinite component take no part on either side, nor do null ids. Only vectors of
    equal length are compared; empty vectors score 0. Ties go to the smaller id.
    Repeated ids: a candidate row with the query's id is never returned, other repeats
    count once for each row. Fewer than k candidates: all are returned. Empty tables
    give no rows. Other columns are not read.
    """
    spark = candidates.sparkSession
    ship_package(spark)

    def usable(df: DataFrame) -> DataFrame:
        kept = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return kept.where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)

    tile = "dim int, ids binary, vectors binary"
    right = usable(candidates).mapInArrow(_pack(scale, "id", tile_rows), tile)
    left = usable(queries).mapInArrow(_pack(scale, "id", query_rows), tile)
    # Groups so many that the candidates of one (GROUP_ROWS on average) fit a worker's memory.
    groups = groups or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-candidates.count() // GROUP_ROWS))
    # A candidate tile goes to one group, dealt by its content; a query tile goes to every group once.
    right = right.select(F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("g"), "dim", F.lit(0).alias("side"), "ids", "vectors")
    left = left.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "dim", F.lit(1).alias("side"), "ids", "vectors")
    dealt = right.unionByName(left).repartition(groups, "g").sortWithinPartitions("g", "dim", "side")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Candidate tiles of a group come first and stay; then its query tiles pass by one at a time.
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for batch in batches:
            for g, dim, side, i, v in zip(*(batch.column(c).to_pylist() for c in ("g", "dim", "side", "ids", "vectors")), strict=True):
                if (g, dim) != now:
                    now, held = (g, dim), []
                ids = np.frombuffer(i, np.int64)
                matrix = np.frombuffer(v, np.float64).reshape(len(ids), dim)
                if side == 0:
                    held.append((ids, matrix))
                elif held:
                    yield _merged(ids, matrix, held, k)

    merged = dealt.mapInArrow(multiply, "query_id long, vec_id long, score long")
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(frame: pd.DataFrame, k: int, every: int = 50, scale: float = 256.0) -> list[tuple[int, int, int, int]]:
    """Plain reference for tests: every query row against every other row."""
    usable = [(int(i), [int(np.floor(float(np.float64(x)) * scale)) for x in v]) for i, v in zip(frame["vec_id"], frame["embedding"], strict=True) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in usable if c != q))
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)
