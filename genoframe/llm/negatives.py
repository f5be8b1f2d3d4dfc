"""Hard negatives: a full sort of an anchor's scores, and a search of it for each positive.

Candidates are dealt over groups as tiles of vectors; every tile of anchors is sent to
every group once. In a group, a tile of anchors meets all candidates: integer scores
of each anchor are sorted by score and id. Two passes do this. The first reads each
anchor's first rows of its own label, and the lists of the groups merge into the
anchor's positives. In the second, anchors bring their positives' scores: a binary
search in the sorted scores of other labels finds where the window of each positive
begins, and the first entries from there are read until the lower limit. Those lists
merge by rank. So no task sees more than one group's candidates, no pair of an anchor
and a candidate leaves its task, and every anchor still sees every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.llm.topk import _scores
from genoframe.session import cut, ship_package

#: Candidates that one group holds on average.
GROUP_ROWS = 131_072
#: Rows in a tile of candidates and of anchors.
TILE_ROWS, ANCHOR_ROWS = 4096, 256
#: Scores of so many anchors and candidates are in memory at once, in cells.
SORTED_CELLS = 1 << 22

_TILE = "dim int, ids binary, labels binary, vectors binary, positives binary"


def usable(embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """``id``, ``label``, ``v`` (components as floor(scale * x), exact in doubles) of the rows that take part.

    A null key, label or vector, and a component that is null, NaN or infinite, leave a
    row out.
    """
    kept = embeddings.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & sound)
    return kept.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")))


def _pack(rows: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, label, v) or (id, label, v, positives) to tiles; vectors of one length share a tile. Positives: ``width`` scores and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*waiting.pop(dim), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=["dim", "ids", "labels", "vectors", "positives"])

        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            vectors = batch.column(2)
            lengths = np.diff(vectors.offsets.to_numpy(zero_copy_only=False))
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            positives = np.zeros((len(ids), width + 1), np.int64)
            if width:
                for i, scores in enumerate(batch.column(3).to_pylist()):
                    positives[i, : len(scores)] = scores
                    positives[i, width] = len(scores)
            for dim in np.unique(lengths):
                take = np.nonzero(lengths == dim)[0]
                matrix = flat[starts[take][:, None] + np.arange(dim)]
                for at in range(0, len(take), rows):
                    part = take[at : at + rows]
                    waiting.setdefault(int(dim), []).append((ids[part], labels[part], matrix[at : at + rows], positives[part]))
                    if sum(len(p[0]) for p in waiting[int(dim)]) >= rows:
                        yield flush(int(dim))
        for dim in list(waiting):
            yield flush(dim)

    return run


def ranked(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places by score, the highest first, then id."""
    return np.lexsort((ids, -scores))


def read_positives(order: np.ndarray, labels: np.ndarray, ids: np.ndarray, anchor: int, label: int, k: int) -> np.ndarray:
    """The first ``k`` places of the anchor's label that are not the anchor itself."""
    own = order[(labels[order] == label) & (ids[order] != anchor)]
    return own[:k]


def read_negatives(order: np.ndarray, labels: np.ndarray, scores: np.ndarray, label: int, positives: np.ndarray, k: int, low: int, high: int, whole: int) -> list[np.ndarray]:
    """For each positive's score the first ``k`` places of another label with low * positive <= whole * score <= high * positive."""
    other = order[labels[order] != label]
    falling = -scores[other]  # ascending, for the search
    out = []
    for p in positives.tolist():
        upper, lower = (high * p) // whole, -((-low * p) // whole)  # floor and ceiling, in Python's integers
        if lower > upper or not len(other):
            out.append(other[:0])
            continue
        start = int(np.searchsorted(falling, -upper, side="left"))
        stop = int(np.searchsorted(falling, -lower, side="right"))
        out.append(other[start : min(stop, start + k)])
    return out


def _groups(candidates: DataFrame, groups: int | None) -> int:
    """So many that the candidates of one (GROUP_ROWS on average) fit a worker's memory."""
    return groups or max(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-candidates.count() // GROUP_ROWS))


def _meet(anchors: DataFrame, candidates: DataFrame, groups: int, width: int, schema: str, read: Callable[..., pa.RecordBatch | None], tile_rows: int, anchor_rows: int) -> DataFrame:
    """``read`` for every tile of anchors and every group, with all the group's candidates of that dimension."""
    right = candidates.select("id", "label", "v").mapInArrow(_pack(tile_rows, 0), _TILE)
    left = anchors.mapInArrow(_pack(anchor_rows, width), _TILE)
    right = right.select(F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("side"), "*")
    left = left.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("side"), "*")
    dealt = right.unionByName(left).repartition(groups, "g").sortWithinPartitions("g", "dim", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        now = None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["g"], row["dim"]) != now:
                    now, held = (row["g"], row["dim"]), []
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                matrix = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["dim"])
                if row["side"] == 0:
                    held.append((ids, labels, matrix))
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(c) for c in zip(*held, strict=True))]
                c_ids, c_labels, c = held[0]
                positives = np.frombuffer(row["positives"], np.int64).reshape(len(ids), width + 1)
                step = max(1, SORTED_CELLS // len(c_ids))
                for at in range(0, len(ids), step):
                    part = slice(at, at + step)
                    found = read(ids[part], labels[part], positives[part], _scores(matrix[part], c), c_ids, c_labels)
                    if found is not None:
                        yield found

    return dealt.mapInArrow(run, schema)


def mine(anchors: DataFrame, candidates: DataFrame, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, whole: int = 100, groups: int | None = None, tile_rows: int = TILE_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """For each anchor and each of its positives the first negatives in the positive's window of scores.

    Both tables are what ``usable`` returns. Higher inner products come first, ties by
    smaller id. Positives: the anchor's first ``positives`` other rows of its label.
    Negatives: rows of another label with low * p <= whole * score <= high * p for the
    positive's score p, so a negative p has none and p = 0 only rows of score 0.
    Returns ``anchor_id``, ``positive_id``, ``rank`` int from 1, ``negative_id``,
    ``positive_score``, ``negative_score``; anchors and positives without a negative
    have no row. A repeated anchor id is one anchor, the one of least label and vector;
    a repeated candidate counts for each row, so a repeated positive is searched twice.
    Only vectors of equal length meet. Empty tables give no rows.
    """
    ship_package(candidates.sparkSession)
    anchors = anchors.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    dealt = _groups(candidates, groups)

    def firsts(ids, labels, _, scores, c_ids, c_labels) -> pa.RecordBatch | None:
        rows = []
        for i in range(len(ids)):
            at = read_positives(ranked(c_ids, scores[i]), c_labels, c_ids, ids[i], labels[i], positives)
            rows.append((np.full(len(at), ids[i]), c_ids[at], scores[i, at]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["id", "positive_id", "score"]) if rows else None

    found = _meet(anchors, candidates, dealt, 0, "id long, positive_id long, score long", firsts, tile_rows, anchor_rows)
    best = Window.partitionBy("id").orderBy(F.desc("score"), "positive_id")
    # At most ``positives`` rows of an anchor are gathered into its list.
    chosen = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= positives)
    lists = cut(chosen.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "positive_id", "score"))).alias("p")))
    armed = anchors.join(lists, "id").select("id", "label", "v", F.col("p.score").alias("positives"))

    def windows(ids, labels, scored, scores, c_ids, c_labels) -> pa.RecordBatch | None:
        rows = []
        for i in range(len(ids)):
            mine_scores = scored[i, : scored[i, positives]]
            places = read_negatives(ranked(c_ids, scores[i]), c_labels, scores[i], labels[i], mine_scores, negatives, low, high, whole)
            for at, places_of in enumerate(places):
                rows.append((np.full(len(places_of), ids[i]), np.full(len(places_of), at), c_ids[places_of], scores[i, places_of]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows, strict=True)], names=["id", "at", "negative_id", "score"]) if rows else None

    seen = _meet(armed, candidates, dealt, positives, "id long, at long, negative_id long, score long", windows, tile_rows, anchor_rows)
    order = Window.partitionBy("id", "at").orderBy(F.desc("score"), "negative_id")
    top = seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    p = F.col("p")[F.col("at").cast("int")]
    return top.join(lists, "id").select(F.col("id").alias("anchor_id"), p["positive_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", p["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def brute_force(frame: pd.DataFrame, anchors: set[int], positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, whole: int = 100) -> list[tuple[int, ...]]:
    """Plain reference for tests, over rows of ``id``, ``label``, ``v``."""
    rows = [(int(i), int(t), [int(x) for x in v]) for i, t, v in zip(frame["id"], frame["label"], frame["v"], strict=True)]
    out = []
    for a, label, v in rows:
        if a not in anchors:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, t) for i, t, w in rows if len(w) == len(v))
        for s, i, _ in [x for x in scored if x[2] == label and x[1] != a][:positives]:
            fit = [(n, j) for n, j, t in scored if t != label and low * -s <= whole * -n <= high * -s]
            out += [(a, i, r + 1, j, -s, -n) for r, (n, j) in enumerate(fit[:negatives])]
    return sorted(out)
