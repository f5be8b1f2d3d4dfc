"""Deterministic imputers over long cells. Only missing cells are ever filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def locus_mode(cells: DataFrame, default: int = 0) -> DataFrame:
    """``locus_id``, ``mode``; ties go to the lowest code, a locus with no call gets ``default``."""
    return cells.groupBy("locus_id").agg(F.coalesce(F.mode("g", True), F.lit(default)).alias("mode"))


def population_mode(cells: DataFrame) -> DataFrame:
    """``pop_id``, ``locus_id``, ``mode`` where a population has calls."""
    return cells.groupBy("pop_id", "locus_id").agg(F.mode("g", True).alias("mode")).where(F.col("mode").isNotNull())


def fill_reference(cells: DataFrame, value: str = "g") -> DataFrame:
    """Missing calls are homozygous reference."""
    return cells.withColumn("imputed", F.coalesce(value, F.lit(0)))


def fill_mode(cells: DataFrame, modes: DataFrame, default: int = 0, value: str = "g") -> DataFrame:
    """Missing calls take their locus's mode."""
    joined = cells.join(modes.select("locus_id", F.col("mode").alias("__mode")), "locus_id", "left")
    return joined.withColumn("imputed", F.coalesce(value, "__mode", F.lit(default))).drop("__mode")


def fill_population_mode(cells: DataFrame, by_population: DataFrame, modes: DataFrame, default: int = 0, value: str = "g") -> DataFrame:
    """The population's mode, then the locus's, then ``default``. A null population matches its own modes.

    Mode tables grow with loci times populations, so nothing is forced to broadcast.
    """
    own = by_population.select(F.col("pop_id").alias("__pop"), F.col("locus_id").alias("__locus"), F.col("mode").alias("__own"))
    joined = cells.join(own, (F.col("locus_id") == F.col("__locus")) & F.col("pop_id").eqNullSafe(F.col("__pop")), "left")
    joined = joined.join(modes.select(F.col("locus_id").alias("__all"), F.col("mode").alias("__mode")), F.col("locus_id") == F.col("__all"), "left")
    return joined.withColumn("imputed", F.coalesce(value, "__own", "__mode", F.lit(default))).drop("__pop", "__locus", "__own", "__all", "__mode")


def distribution(cells: DataFrame, by_population: bool = False) -> DataFrame:
    """``state``, ``prob``, ``cum_lo``, ``cum_hi`` of each locus (and population), states in order."""
    keys = ["pop_id", "locus_id"] if by_population else ["locus_id"]
    counts = cells.where(F.col("g").isNotNull()).groupBy(*keys, F.col("g").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*keys)
    running = F.sum("n").over(own.orderBy("state"))
    total = F.sum("n").over(own).cast("double")
    return counts.select(*keys, "state", (F.col("n") / total).alias("prob"), ((running - F.col("n")) / total).alias("cum_lo"), (running / total).alias("cum_hi"))


def fill_frequency(cells: DataFrame, dist: DataFrame, u: Column, default: int = 0, value: str = "g") -> DataFrame:
    """A missing call takes the state whose stretch of the cumulative distribution holds its draw.

    The stretches of a locus are gathered into one row (a state each), so the lookup is
    an equi-join on the locus and no range join.
    """
    keys = [c for c in ("pop_id", "locus_id") if c in dist.columns]
    rows = dist.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cum_hi", "state"))).alias("__states"))
    drawn = cells.withColumn("__u", u).join(rows, keys, "left")
    at = F.element_at(F.filter("__states", lambda s: F.col("__u") < s["cum_hi"]), 1)["state"]
    picked = F.when(F.exists("__states", lambda s: F.col("__u") < s["cum_hi"]), at)
    return drawn.withColumn("imputed", F.coalesce(value, picked, F.lit(default))).drop("__u", "__states")


def predictions(filled: DataFrame) -> DataFrame:
    """``sample_id``, ``locus_id``, ``pop_id``, ``y_true``, ``y_pred`` of the evaluated cells."""
    return filled.where("evaluated").select("sample_id", "locus_id", "pop_id", F.col("g").alias("y_true"), F.col("imputed").alias("y_pred"))
