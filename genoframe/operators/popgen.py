"""Population-genetic statistics from mergeable genotype counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.session import cut, ship_package


def _over(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def genotype_counts(cells: DataFrame, by_population: bool = False) -> DataFrame:
    """``pop_id`` (null: Total), ``locus_id``, ``n_tot``, ``n``, ``c0``, ``c1``, ``c2``. One pass; grouping sets give populations and the total."""
    g = F.col("g")
    aggs = [F.count(F.lit(1)).alias("n_tot"), F.count_if(g.isin(0, 1, 2)).alias("n"), *[F.count_if(g == k).alias(f"c{k}") for k in (0, 1, 2)]]
    if not by_population:
        return cells.groupBy("locus_id").agg(*aggs).select(F.lit(None).cast("int").alias("pop_id"), "locus_id", "n_tot", "n", "c0", "c1", "c2")
    # Populations first: their counts add up to the total, so cells are read and exchanged once.
    own = cells.groupBy("pop_id", "locus_id").agg(*aggs)
    total = own.groupBy("locus_id").agg(*[F.sum(c).alias(c) for c in ("n_tot", "n", "c0", "c1", "c2")])
    return own.unionByName(total.select(F.lit(None).cast("int").alias("pop_id"), "locus_id", "n_tot", "n", "c0", "c1", "c2"))


def harmonic(n: Column, power: int = 1) -> Column:
    """Sum of 1/i^power for 0 < i < n; 0 for n of one or less."""
    term = lambda s, i: s + F.lit(1.0) / F.pow(i.cast("double"), F.lit(float(power)))
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n - 1, F.lit(1).cast("long"))), F.lit(0.0), term)).otherwise(0.0)


def locus_statistics(counts: DataFrame, *, older_hd: bool = False, digits: int = 9) -> DataFrame:
    """The statistics of each row of counts; null where undefined.

    Values are rounded to ``digits``, diversity of haplotypes and Tajima's D to one less.
    ``older_hd`` takes the older script's 2n/(2n-1) in haplotype diversity.
    """
    c = {k: F.col(k).cast("double") for k in ("n_tot", "n", "c0", "c1", "c2")}
    n, big = F.col("n"), F.col("big")
    s = counts.withColumn("alt", F.col("c1") + 2 * F.col("c2")).withColumn("big", 2 * n)
    s = s.withColumn("p", _over(F.col("alt"), big))
    s = s.withColumn("ho", _over(F.col("c1"), n)).withColumn("he", F.when(big > 1, 2 * F.col("p") * (1 - F.col("p")) * big / (big - 1)))
    s = s.withColumn("seg", F.coalesce(((F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)).cast("int"), F.lit(0)))
    # Harmonic sums depend on the number of calls only: computed once for each distinct number.
    sums = s.select("big").distinct().withColumn("a1", harmonic(big)).withColumn("a2", harmonic(big, 2))
    s = s.join(sums, "big")
    a1, a2 = F.col("a1"), F.col("a2")
    s = s.withColumn("theta", F.when((F.col("seg") == 1) & (a1 > 0), 1 / a1).otherwise(0.0))
    b1, b2 = (big + 1) / (3 * (big - 1)), 2 * (big * big + big + 3) / (9 * big * (big - 1))
    e1 = (b1 - 1 / a1) / a1
    s = s.withColumn("var", F.when((F.col("seg") == 1) & (big > 2), e1)).withColumn("b2", F.when(big > 1, b2))
    hap = sum(((F.col(f"c{k}") > 0).cast("int") for k in (0, 1, 2)), F.lit(0))
    squares = sum((F.pow(_over(F.col(f"c{k}"), n), F.lit(2.0)) for k in (0, 1, 2)), F.lit(0.0))
    factor = _over(2 * n, 2 * n - 1) if older_hd else _over(n, n - 1)
    hd = F.when(n > 1, (1 - squares) * factor).when(n == 1, F.lit(0.0))
    r = lambda x, k=digits: F.round(x, k) + F.lit(0.0)  # noqa: E731  adding 0 turns -0.0 into 0.0
    return s.select(
        "pop_id", "locus_id", n.alias("sample_size"), r(1 - c["n"] / c["n_tot"]).alias("missingness"), F.col("seg").alias("seg_sites"),
        F.when(n > 0, (F.least("alt", big - F.col("alt")) == 1).cast("int")).otherwise(0).alias("singletons"), r(F.least(F.col("p"), 1 - F.col("p"))).alias("maf"), r(F.col("ho")).alias("ho"), r(F.col("he")).alias("he"),
        r(F.when(F.col("he") > 1e-9, 1 - F.col("ho") / F.col("he"))).alias("f_inbreeding"), F.col("c1").alias("hetz_positions"), hap.alias("hap"), r(hd, digits - 1).alias("hd"), r(F.col("he")).alias("pi"), r(F.col("theta")).alias("theta_watt"),
        r(F.when(F.col("var") > 0, (F.col("he") - F.col("theta")) / F.sqrt(F.col("var"))), digits - 1).alias("tajima_d"), F.lit(1).alias("total_pos"), F.lit(0).alias("net_seg_sites"),
    )


def dataset_summary(stats: DataFrame, digits: int = 8) -> DataFrame:
    """Means, variances (ddof 1), deviations, sums and N of each population's loci, missing left out."""
    means = ("missingness", "maf", "ho", "he", "f_inbreeding", "hd", "pi", "theta_watt", "tajima_d")
    aggs = [F.count(F.lit(1)).alias("n_loci"), F.sum("seg_sites").alias("seg_sites"), F.sum("singletons").alias("singletons")]
    for m in means:
        aggs += [F.round(F.avg(m), digits).alias(f"{m}_mean"), F.round(F.var_samp(m), digits).alias(f"{m}_var"), F.round(F.stddev_samp(m), digits).alias(f"{m}_sd")]
    return stats.groupBy("pop_id").agg(*aggs)


#: Loci of a tile at least, and samples of one on average: 64 x 4096 calls are 2 MB.
TILE_LOCI, TILE_SAMPLES = 64, 4096
#: Blocks of loci that are aimed at, as a tile is copied once for each, and the most loci of a block, as a task holds their products.
BLOCKS, MOST_LOCI = 512, 4096


def tile_loci(cells: DataFrame) -> int:
    """Loci of a block for ids of this range."""
    low, high = cells.agg(F.min("locus_id"), F.max("locus_id")).collect()[0]
    return min(MOST_LOCI, max(TILE_LOCI, -(-(high - low + 1) // BLOCKS))) if low is not None else TILE_LOCI


def pair_sums(cells: DataFrame, value: str, *, loci: int | None = None, samples: int = TILE_SAMPLES) -> DataFrame:
    """``l1`` < ``l2``, ``n`` samples that have rows of both loci, ``s`` the sum of the products of ``value``, for every pair of loci that occur.

    Cells are packed into tiles of loci x samples. A tile goes to each pair of locus
    blocks that it is part of, a task multiplies the two tiles of a part of the samples
    as matrices and adds up over the parts, and only pairs of loci leave it: no row is
    made for a sample of a pair.
    """
    ship_package(cells.sparkSession)
    loci = loci or tile_loci(cells)
    parts = max(1, -(-cells.agg(F.approx_count_distinct("sample_id")).collect()[0][0] // samples))
    narrow = cells.select(F.floor(F.col("locus_id") / F.lit(float(loci))).alias("block"), F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("long").alias("part"), "locus_id", "sample_id", F.col(value).cast("double").alias("x"))

    def pack(table: pa.Table) -> pa.Table:
        binary = [pa.array([table.column(c).to_numpy().astype(t).tobytes()], pa.binary()) for c, t in (("locus_id", np.int64), ("sample_id", np.int64), ("x", np.float64))]
        return pa.table([table.column("block")[:1], table.column("part")[:1], *binary], names=["block", "part", "l", "p", "x"])

    tiles = cut(narrow.groupBy("block", "part").applyInArrow(lambda t: pack(t), "block long, part long, l binary, p binary, x binary"))
    blocks = [r[0] for r in tiles.select("block").distinct().collect()]  # some hundreds, see tile_loci
    other = F.explode(F.array(*map(F.lit, blocks))) if blocks else F.explode(F.array().cast("array<long>"))
    paired = tiles.withColumn("other", other)
    paired = paired.select(F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "part", (F.col("block") > F.col("other")).alias("second"), "l", "p", "x")
    dealt = paired.repartition("b1", "b2").sortWithinPartitions("b1", "b2", "part", "second")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, first = None, None, None
        sums = counts = np.zeros((loci, loci))
        met = [np.zeros(loci, bool), np.zeros(loci, bool)]

        def product(a: tuple, b: tuple) -> None:
            people = np.unique(np.concatenate([a[1], b[1]]))
            dense = []
            for l, p, x in (a, b):
                at = (l % loci, np.searchsorted(people, p))
                tile, here = np.zeros((loci, len(people))), np.zeros((loci, len(people)))
                tile[at], here[at] = x, 1.0
                dense.append((tile, here))
            np.add(sums, dense[0][0] @ dense[1][0].T, out=sums)
            np.add(counts, dense[0][1] @ dense[1][1].T, out=counts)

        def said() -> pa.RecordBatch:
            i, j = np.nonzero(met[0][:, None] & met[1][None, :])
            l1, l2 = now[0] * loci + i, now[1] * loci + j
            keep = l1 < l2
            return pa.RecordBatch.from_arrays([pa.array(l1[keep]), pa.array(l2[keep]), pa.array(counts[i, j][keep].astype(np.int64)), pa.array(sums[i, j][keep])], names=["l1", "l2", "n", "s"])

        for batch in batches:
            for b1, b2, at, second, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b1, b2) != now:
                    if now is not None:
                        yield said()
                    now, part, sums, counts, met = (b1, b2), None, np.zeros((loci, loci)), np.zeros((loci, loci)), [np.zeros(loci, bool), np.zeros(loci, bool)]
                tile = tuple(np.frombuffer(x, t) for x, t in zip(raw, (np.int64, np.int64, np.float64), strict=True))
                met[int(second)][tile[0] % loci] = True
                if b1 == b2:
                    met[1][tile[0] % loci] = True
                    product(tile, tile)
                elif not second:
                    part, first = at, tile
                elif part == at:
                    product(first, tile)
        if now is not None:
            yield said()

    return dealt.mapInArrow(multiply, "l1 long, l2 long, n long, s double")


def standardised(cells: DataFrame) -> DataFrame:
    """Called cells of varying loci with ``z``, the deviation over the root of the locus's sum of squares; missing calls are at the mean and add nothing."""
    g = F.col("g").cast("double")
    moments = cells.where("g IS NOT NULL").groupBy("locus_id").agg(F.avg(g).alias("mean"), (F.sum(g * g) - F.sum(g) * F.sum(g) / F.count(g)).alias("ss")).where("ss > 1e-12")
    return cells.where("g IS NOT NULL").join(moments, "locus_id").select("sample_id", "locus_id", ((g - F.col("mean")) / F.sqrt("ss")).alias("z"))


def kelly_zns(cells: DataFrame, *, block: int | None = None, max_loci: int | None = None) -> DataFrame:
    """``pairs``, ``zns``: mean squared correlation over pairs of varying loci, missing calls at their locus's mean.

    The squares of all products of loci add up to those of all products of samples: with
    fewer samples than loci these are multiplied, so the work is linear in loci.
    ``max_loci`` gives null above it, as the reference does; by default there is no
    bound.
    """
    varying = standardised(cells)
    n, samples = varying.agg(F.count_distinct("locus_id"), F.count_distinct("sample_id")).collect()[0]
    if max_loci is not None and n > max_loci:
        return cells.sparkSession.createDataFrame([(None, None)], "pairs long, zns double")
    if samples >= n:
        return pair_sums(varying, "z", loci=block).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("s") * F.col("s")), 8).alias("zns"))
    turned = varying.select(F.col("sample_id").alias("locus_id"), F.col("locus_id").alias("sample_id"), "z")
    apart = pair_sums(turned, "z", loci=block).agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("apart"))
    own = varying.groupBy("sample_id").agg(F.sum(F.col("z") * F.col("z")).alias("g")).agg(F.sum(F.col("g") * F.col("g")).alias("own"))
    pairs = F.lit(n * (n - 1) // 2)
    squares = (F.col("own") + 2 * F.col("apart") - F.lit(float(n))) / 2
    return apart.crossJoin(F.broadcast(own)).select(pairs.cast("long").alias("pairs"), F.round(F.when(pairs > 0, squares / pairs), 8).alias("zns"))


def correlations(cells: DataFrame, digits: int = 8) -> DataFrame:
    """``l1`` < ``l2``, ``r`` for every pair of varying loci, missing calls at their locus's mean."""
    return pair_sums(standardised(cells), "z").select("l1", "l2", (F.round("s", digits) + F.lit(0.0)).alias("r"))  # adding 0 turns -0.0 into 0.0


def locus_pairs(cells: DataFrame) -> DataFrame:
    """``l1`` < ``l2``, ``n`` samples with both calls, ``sxy`` sum of products, for loci that share a sample."""
    return pair_sums(cells.where("g IS NOT NULL"), "g").where("n > 0").select("l1", "l2", "n", F.col("s").cast("long").alias("sxy"))


def nearest_loci(pairs: DataFrame, k: int) -> DataFrame:
    """The k loci of greatest absolute correlation to each, ties to the lower id. The reference samples them by correlation; ours are the top."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("l1").alias("locus_id"), F.col("l2").alias("neighbour"), F.abs("r").alias("r")), F.struct(F.col("l2").alias("locus_id"), F.col("l1").alias("neighbour"), F.abs("r").alias("r")))).alias("e")).select("e.*")
    rank = F.row_number().over(Window.partitionBy("locus_id").orderBy(F.desc("r"), "neighbour"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("locus_id", "neighbour", F.col("rank").cast("int").alias("rank"))
