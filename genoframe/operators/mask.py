"""Simulated missingness and splits.

All randomness is a draw in [0, 1) that depends on ids and a seed only: ``draw`` hashes
them, ``residue_draw`` is a plain arithmetic residue that SQL engines agree on. Every
function takes the draw as a column, so a caller chooses. Masks are boolean
columns; a missing call is never masked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.operators.relate import running_total

PRIME = 1_000_003


def draw(seed: int, *ids: str) -> Column:
    """Uniform in [0, 1) from a 64-bit hash of the ids and the seed."""
    return F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def residue_draw(seed: int, sample: str = "sample_id", locus: str = "locus_id") -> Column:
    mixed = F.col(sample) * 7919 + F.col(locus) * 104729 + F.lit(seed * 1299709)
    return (mixed % PRIME).cast("double") / F.lit(float(PRIME))


def sample_draw(seed: int, sample: str = "sample_id") -> Column:
    return ((F.col(sample) * 7919 + F.lit(seed * 1299709)) % PRIME).cast("double") / F.lit(float(PRIME))


def mask_random(cells: DataFrame, prop: float, u: Column) -> DataFrame:
    """Each observed cell on its own, with probability ``prop``."""
    return cells.withColumn("simulated", F.col("g").isNotNull() & (u < prop))


def class_probabilities(cells: DataFrame, prop: float, inverse: bool = False) -> DataFrame:
    """``locus_id``, ``g``, ``prob``: probability that a cell of a class is masked.

    A class weighs the fourth root of its frequency (or of its inverse), weights
    summing to one in a locus; a locus's probabilities are scaled so that their mean over its observed
    cells is ``prop``, and clipped to one. A locus of one class masks nothing.
    """
    counts = cells.where(F.col("g").isNotNull()).groupBy("locus_id", "g").agg(F.count(F.lit(1)).alias("n"))
    locus = Window.partitionBy("locus_id")
    p = F.col("n").cast("double") / F.sum("n").over(locus)
    base = F.pow(1 / p if inverse else p, F.lit(0.25))
    weighed = counts.withColumn("w", base).withColumn("w", F.col("w") / F.sum("w").over(locus))
    mean = F.sum(F.col("w") * F.col("n")).over(locus) / F.sum("n").over(locus)
    return weighed.withColumn("classes", F.count(F.lit(1)).over(locus)).withColumn("mean", mean).select("locus_id", "g", F.when(F.col("classes") > 1, F.least(F.lit(1.0), F.col("w") * F.lit(prop) / F.col("mean"))).otherwise(F.lit(0.0)).alias("prob"))


def mask_weighted(cells: DataFrame, prop: float, u: Column, inverse: bool = False) -> DataFrame:
    """Class-weighted masking; the join is on locus and class, three rows for each locus at most."""
    joined = cells.withColumn("u", u).join(class_probabilities(cells, prop, inverse), ["locus_id", "g"], "left")
    return joined.withColumn("simulated", F.col("g").isNotNull() & (F.col("u") < F.coalesce("prob", F.lit(0.0)))).drop("u", "prob")


def mask_exact(cells: DataFrame, n: Column | int, u: Column, eligible: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Exactly ``n`` eligible cells, those of the lowest draws; ids break ties.

    ``n`` may use ``known``, the number of eligible cells. Only draws near the bound
    need an order: an exact rank needs one sort of (draw, ids), which Spark limits to
    the rows that count.
    """
    eligible = F.col("g").isNotNull() if eligible is None else eligible
    marked = cells.withColumn("eligible", eligible).withColumn("u", u)
    if by:
        order = Window.partitionBy(*by, "eligible").orderBy("u", "sample_id", "locus_id")
        total = F.count(F.lit(1)).over(Window.partitionBy(*by, "eligible"))
        ranked = marked.withColumn("known", total).withColumn("rank", F.row_number().over(order))
        return ranked.withColumn("simulated", F.col("eligible") & (F.col("rank") <= n)).drop("eligible", "u", "known", "rank")
    # A global rank without one big window: rank inside buckets of the draw, after counts of the buckets before.
    buckets = 1024
    bucketed = marked.withColumn("bucket", F.floor(F.col("u") * buckets).cast("int"))
    sizes = bucketed.where("eligible").groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).withColumn("known", F.sum("size").over(Window.partitionBy(F.lit(0))))
    order = Window.partitionBy("bucket", "eligible").orderBy("u", "sample_id", "locus_id")
    ranked = bucketed.join(F.broadcast(before.select("bucket", "before", "known")), "bucket", "left").withColumn("rank", F.row_number().over(order) + F.col("before"))
    return ranked.withColumn("simulated", F.col("eligible") & F.coalesce(F.col("rank") <= n, F.lit(False))).drop("eligible", "u", "bucket", "before", "known", "rank")


def mask_inverse_genotype(cells: DataFrame, prop: float, u: Column, het_boost: float = 1.0) -> DataFrame:
    """Exactly floor(prop * known) cells, weighted by inverse global genotype frequency; heterozygotes (1) times ``het_boost``.

    Weighted sampling without replacement by exponential keys: the largest
    ln(u)/weight stay. The reference boosts codes that 0/1/2 data lacks; here it is code 1.
    """
    freq = cells.where(F.col("g").isNotNull()).groupBy("g").agg(F.count(F.lit(1)).alias("n_g"))
    weighed = cells.join(F.broadcast(freq), "g", "left").withColumn("w", F.when(F.col("g") == 1, het_boost).otherwise(1.0) / F.col("n_g"))
    known = cells.where(F.col("g").isNotNull()).agg(F.count(F.lit(1)).alias("known"))
    keyed = weighed.crossJoin(F.broadcast(known)).withColumn("key", F.when(F.col("g").isNotNull(), -F.log(F.greatest(u, F.lit(1e-12))) / F.col("w")))
    # Missing calls have no key and need no rank.
    ranked = running_total(keyed.where(F.col("g").isNotNull()), "key", F.lit(1), "rank", ["sample_id", "locus_id"])
    ranked = ranked.unionByName(keyed.where(F.col("g").isNull()).withColumn("rank", F.lit(None)))
    return ranked.withColumn("simulated", F.col("g").isNotNull() & F.coalesce(F.col("rank") <= F.floor(F.lit(prop) * F.col("known")), F.lit(False))).drop("n_g", "w", "known", "key", "rank")


def guard(masked: DataFrame, *, per: str = "locus_id", other: str = "sample_id") -> DataFrame:
    """A locus (or sample) whose observed cells are all masked gets its first one back."""
    own = Window.partitionBy(per)
    seen = F.sum(F.col("g").isNotNull().cast("int")).over(own)
    hidden = F.sum(F.col("simulated").cast("int")).over(own)
    first = F.row_number().over(Window.partitionBy(per, "simulated").orderBy(other))
    marked = masked.withColumn("__all", (seen > 0) & (seen == hidden)).withColumn("__first", first)
    return marked.withColumn("simulated", F.col("simulated") & ~(F.col("__all") & (F.col("__first") == 1))).drop("__all", "__first")


def apply_mask(masked: DataFrame) -> DataFrame:
    """Simulated cells become missing, in ``g_masked``."""
    return masked.withColumn("g_masked", F.when(~F.col("simulated"), F.col("g")))


def evaluation_cells(masked: DataFrame, simulated_on: bool = True) -> DataFrame:
    """Masked cells of test rows; with simulation off, every observed cell of them."""
    return masked.withColumn("evaluated", F.col("is_test") & (F.col("simulated") if simulated_on else F.col("g").isNotNull()))


def mask_summary(masked: DataFrame, warn_below: int = 100) -> DataFrame:
    """One row of counts; overlapping masks fail the query, few evaluable cells are only flagged."""
    checked = masked.withColumn("ok", F.assert_true(~(F.col("simulated") & F.col("g").isNull()), F.lit("original and simulated masks overlap")))
    counts = checked.where(F.col("ok").isNull()).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("g").isNull()).alias("n_original"), F.count_if(F.col("simulated")).alias("n_simulated"))
    return counts.withColumn("n_missing", F.col("n_original") + F.col("n_simulated")).withColumn("prop_masked", F.round(F.col("n_simulated").cast("double") / F.col("n_cells"), 9)).withColumn("few", F.col("n_simulated") < warn_below)


def split_rows(samples: DataFrame, test_size: float, u: Column, *, by: str | None = None, at_least_one: bool = True) -> DataFrame:
    """``is_test`` for max(1, bround(test_size * n)) samples, of all or of each population (null is one of its own)."""
    drawn = samples.withColumn("u", u)
    n = F.count(F.lit(1)).over(Window.partitionBy(by)) if by else F.lit(samples.count())
    size = F.rint(F.lit(test_size) * n)
    size = F.greatest(F.lit(1.0), size) if at_least_one else size
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("u", "sample_id"))) if by else running_total(drawn, "u", F.lit(1), "rank", ["sample_id"])
    return ranked.withColumn("is_test", F.col("rank") <= size).drop("u", "rank")


def split_explicit(samples: DataFrame, test_ids: list[int]) -> DataFrame:
    """H01 with explicit ids; ids that are no samples fail."""
    known = {r[0] for r in samples.where(F.col("sample_id").isin(test_ids)).select("sample_id").distinct().collect()}
    if wrong := sorted(set(test_ids) - known):
        raise IndexError(f"no such samples: {wrong}")
    return samples.withColumn("is_test", F.col("sample_id").isin(test_ids))


def split_three(samples: DataFrame, validation_split: float, u: Column) -> DataFrame:
    """``part`` train, val or test; what is held out is halved. Needs three samples and four held out."""
    n = samples.count()
    held = math.ceil(validation_split * n)
    if n < 3 or held < 4:
        raise ValueError("too few samples for three parts")
    ranked = running_total(samples.withColumn("u", u), "u", F.lit(1), "rank", ["sample_id"])
    return ranked.withColumn("part", F.when(F.col("rank") > held, "train").when(F.col("rank") > held // 2, "test").otherwise("val")).drop("u", "rank")
