"""Special functions that Spark lacks: over Arrow batches, or as columns and merged sums."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.session import cut, drop_cut, ship_package


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / (c if abs(c) > tiny else tiny)
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h / a


def f_survival(f: float, df1: float, df2: float) -> float:
    """Chance that an F variable exceeds ``f``."""
    return 1.0 if f <= 0 else incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def with_p_value(tests: DataFrame) -> DataFrame:
    """Adds ``p`` to ``f``, ``df1``, ``df2``; a p of 0 becomes the least positive double."""
    ship_package(tests.sparkSession)

    @F.pandas_udf("double")
    def survival(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        return pd.Series([max(f_survival(x, a, b), 5e-324) for x, a, b in zip(f, df1, df2, strict=True)])

    return tests.withColumn("p", survival("f", F.col("df1").cast("double"), "df2"))


#: Values of lambda that one pass weighs, and passes: each leaves two parts of GRID - 1.
GRID, PASSES = 33, 6
LOWEST, HIGHEST = -5.0, 5.0


def power_transform(x: Column, lam: Column) -> Column:
    """The Yeo-Johnson transform of a value, for any lambda."""
    up, down = F.log1p(F.greatest(x, F.lit(0.0))), F.log1p(F.greatest(F.lit(0.0) - x, F.lit(0.0)))
    # expm1 and log1p keep their digits where lambda is near the ends of the two branches.
    high = F.when(F.abs(lam) < 1e-9, up).otherwise(F.expm1(lam * up) / lam)
    low = F.when(F.abs(lam - 2) < 1e-9, F.lit(0.0) - down).otherwise(F.expm1((2 - lam) * down) / (lam - 2))
    return F.when(x >= 0, high).otherwise(low)


def power_lambdas(long: DataFrame, by: str = "metric", value: str = "value") -> DataFrame:
    """``lambda`` of greatest likelihood in [-5, 5] for each metric, to about 1e-6.

    A pass weighs a grid of lambdas by sums over the values: their number, the transformed
    ones and their squares, the logarithms. Sums merge, so no metric's values meet. The
    best lambda's neighbours are the next pass's ends. A metric of one value has 1.
    Squares are taken about the transform of the metric's mean, so that they do not
    drown the variance.
    """
    rows = cut(long.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(by).alias("by"), F.col(value).cast("double").alias("x")))
    start = rows.groupBy("by").agg(F.avg("x").alias("mean"), (F.min("x") < F.max("x")).alias("varies"))
    ends = cut(start.select("by", "mean", "varies", F.lit(LOWEST).alias("a"), F.lit(HIGHEST).alias("b")))
    at = F.col("a") + (F.col("b") - F.col("a")) * F.col("k") / F.lit(GRID - 1)
    for _ in range(PASSES):
        grid = ends.where("varies").select("by", "mean", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("k")).withColumn("lam", at)
        grid = grid.withColumn("centre", power_transform(F.col("mean"), F.col("lam")))
        y = power_transform(F.col("x"), F.col("lam")) - F.col("centre")
        sums = rows.join(grid, "by").groupBy("by", "k", "lam").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"), F.sum(F.signum("x") * F.log1p(F.abs("x"))).alias("spread"))
        variance = F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0))
        gain = -F.col("n") / 2 * F.log(F.greatest(variance, F.lit(1e-300))) + (F.col("lam") - 1) * F.col("spread")
        best = sums.groupBy("by").agg(F.max_by("k", F.struct(gain, -F.col("k"))).alias("k"))
        width = (F.col("b") - F.col("a")) / F.lit(GRID - 1)
        low, high = F.greatest(F.lit(LOWEST), F.col("a") + width * (F.col("k") - 1)), F.least(F.lit(HIGHEST), F.col("a") + width * (F.col("k") + 1))
        before, ends = ends, cut(ends.join(best, "by", "left").select("by", "mean", "varies", F.coalesce(low, "a").alias("a"), F.coalesce(high, "b").alias("b")))
        drop_cut(before)
    return ends.select(F.col("by").alias(by), F.when(F.col("varies"), (F.col("a") + F.col("b")) / 2).otherwise(1.0).alias("lambda"))


def standardised_power(long: DataFrame, lambdas: DataFrame, by: str = "metric", value: str = "value") -> DataFrame:
    """``value`` transformed by its metric's lambda, then to mean 0 and deviation 1 (of n); a metric of one value becomes 0."""
    turned = long.where(F.col(value).isNotNull()).join(lambdas, by).withColumn(value, power_transform(F.col(value).cast("double"), F.col("lambda")))
    moments = turned.groupBy(by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), (F.min(value) < F.max(value)).alias("__varies"))
    return turned.join(moments, by).withColumn(value, F.when(F.col("__varies"), F.coalesce(F.try_divide(F.col(value) - F.col("__m"), "__s"), F.lit(0.0))).otherwise(0.0)).drop("__m", "__s", "__varies")


def yeo_johnson_by_metric(long: DataFrame) -> DataFrame:
    """``dataset``, ``metric``, ``value`` transformed and standardised, ``lambda``."""
    kept = long.select("dataset", "metric", "value")
    return standardised_power(kept, power_lambdas(kept)).select("dataset", "metric", "value", "lambda")
