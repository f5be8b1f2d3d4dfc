"""Uniform global shuffle into shards of exact size, by a hypergeometric communication matrix.

A row's destination is not drawn on its own. For every input partition the number
of its rows that go to every shard is drawn first, from the multivariate
hypergeometric law that a uniform permutation of all rows induces: rows of the
matrix sum to the partitions' row counts and columns to the shards' exact sizes. Each
partition then deals a random permutation of those labels to its rows, the rows are
exchanged, and each shard permutes what it received. The composition is a uniform
permutation, and every shard has its exact size.

A shard of any size is permuted by many tasks: every row draws a 64-bit number, equal
ranges of the numbers are bins of about ROWS_PER_BIN rows, and a bin's first slot is
the number of rows in the shard's bins before it. So no task sees more than a bin,
and the driver holds partitions x shards counts, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoframe.session import cut, ship_package

#: Rows of a bin, on average; a bin is what one task permutes.
ROWS_PER_BIN = 65_536
#: numpy draws the hypergeometric law of populations below this.
POPULATION = 10**9


def shard_sizes(total: int, shards: int) -> list[int]:
    """Sizes that differ by one at most; the first shards take what is left over."""
    base, rest = divmod(total, shards)
    return [base + (s < rest) for s in range(shards)]


def communication_matrix(partition_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """One draw of the partition-to-shard counts."""
    rng = np.random.default_rng(seed)
    left = list(shard_rows)
    rows = np.zeros((len(partition_rows), len(left)), np.int64)
    for p, n in enumerate(partition_rows):
        total = sum(left)
        for s in range(len(left)):
            total -= left[s]
            rows[p, s] = drawn = hypergeometric(rng, left[s], total, n)
            n -= drawn
            left[s] -= drawn
    return rows


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn from ``good`` and ``bad`` are good: exact for populations of any size.

    Beyond numpy's bound two binomials of one probability are drawn until they add up
    to n: given their sum they follow this law, whatever the probability. One of about
    2.5 times the root of n does, and n is the smaller of the drawn and the rest.
    """
    if good + bad < POPULATION:
        return int(rng.hypergeometric(good, bad, n))
    few = min(n, good + bad - n)
    tries = int(4 * few**0.5) + 64
    while True:
        both = rng.binomial(good, few / (good + bad), tries), rng.binomial(bad, few / (good + bad), tries)
        met = np.nonzero(both[0] + both[1] == few)[0]
        if len(met):
            drawn = int(both[0][met[0]])
            return drawn if few == n else good - drawn


def shuffle_into_shards(df: DataFrame, shards: int, *, seed: int = 42, rows_per_bin: int = ROWS_PER_BIN, stable_input: bool = False) -> DataFrame:
    """All rows of ``df``, each with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    ``stable_input`` says that the plan yields the same rows in the same order in the
    same partitions whenever it runs (a scan of files with narrow operations). Any
    other plan is written to the shared folder first, since a recomputed partition
    must deal the same labels to the same rows. The number of splits is held, so that
    executors that come or go do not change them.

    Nulls, ties and repeated rows are rows like any other. An empty table gives no
    rows. Other columns pass through; columns named ``shard`` or ``slot`` are replaced.
    Driver memory: a count for each input partition and shard.
    """
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    df = df.drop("shard", "slot")
    if not stable_input:
        df = cut(df)
    counted = df.groupBy(F.spark_partition_id().alias("__p")).agg(F.count(F.lit(1)).alias("__n")).collect()
    counts = {r["__p"]: r["__n"] for r in counted}
    sizes = shard_sizes(sum(counts.values()), shards)
    ids = sorted(counts)
    matrix = dict(zip(ids, communication_matrix([counts[p] for p in ids], sizes, seed), strict=True))
    bins = np.array([max(1, -(-n // rows_per_bin)) for n in sizes], np.uint64)
    shared = spark.sparkContext.broadcast((matrix, bins))
    extra_names = ["shard", "__bin", "__order", "__source"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        matrix, bins = shared.value
        labels = order = None
        at = 0
        for batch in batches:
            if labels is None:
                labels = np.random.default_rng([seed, 1, partition]).permutation(np.repeat(np.arange(shards, dtype=np.int32), matrix[partition]))
                order = np.random.default_rng([seed, 2, partition])
            n = batch.num_rows
            if at + n > len(labels):
                raise RuntimeError("the input's partitions have changed")
            shard, drawn = labels[at : at + n], order.integers(0, 2**64, n, np.uint64)
            # The bin by the upper half of the number, the order inside it by all of it.
            place = ((drawn >> np.uint64(32)) * bins[shard]) >> np.uint64(32)
            extra = [pa.array(shard), pa.array(place.astype(np.int64)), pa.array(drawn.view(np.int64) ^ np.int64(-(2**63))), pa.array((partition << 40) + np.arange(at, at + n, dtype=np.int64))]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *extra_names])

    added = [T.StructField("shard", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in extra_names[1:])]
    # Bins' sizes first, from the draws alone: no column is read for them.
    alone = df.select(F.lit(0).alias("__no")).mapInArrow(deal, T.StructType([T.StructField("__no", T.IntegerType()), *added]))
    filled = alone.groupBy("shard", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    firsts = cut(filled.select("shard", "__bin", F.coalesce(before, F.lit(0)).alias("__first")))
    dealt = df.mapInArrow(deal, T.StructType([*df.schema.fields, *added]))
    # The exchange carries every row once; the window permutes inside a bin.
    within = Window.partitionBy("shard", "__bin").orderBy("__order", "__source")
    placed = dealt.withColumn("__rank", F.row_number().over(within)).join(F.broadcast(firsts) if int(bins.sum()) <= 100_000 else firsts, ["shard", "__bin"])
    return placed.select(*df.columns, "shard", (F.col("__first") + F.col("__rank") - 1).alias("slot"))
