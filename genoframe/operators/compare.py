"""Comparison of datasets: descriptives, outliers, completeness, tests, adjustment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from genoframe.operators.relate import running_extreme, running_total
from genoframe.session import cut, ship_package


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``metric``, ``value`` rows of wide metrics."""
    return df.unpivot([F.col(c) for c in ids], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def descriptives(long: DataFrame, by: Sequence[str], digits: int = 8) -> DataFrame:
    """Mean, variance, deviation (ddof 1), exact median, and count of ``value``."""
    r = lambda x: F.round(x, digits)
    return long.where("value IS NOT NULL").groupBy(*by).agg(r(F.avg("value")).alias("mean"), r(F.var_samp("value")).alias("var"), r(F.stddev_samp("value")).alias("sd"), r(F.percentile("value", F.lit(0.5))).alias("median"), F.count("value").alias("count"))


def describe(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """Count, mean, sd, min, exact quartiles, max."""
    r = lambda x: F.round(x, digits)
    q = lambda p: r(F.percentile(column, F.lit(p)))
    return df.agg(F.count(column).alias("count"), r(F.avg(column)).alias("mean"), r(F.stddev_samp(column)).alias("sd"), r(F.min(column)).alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), r(F.max(column)).alias("max"))


def outliers(means: DataFrame, digits: int = 8) -> DataFrame:
    """Z-scores of dataset means within each metric; metrics without spread are dropped; flags at two and three."""
    metric = Window.partitionBy("metric")
    spread = means.withColumn("mu", F.avg("value").over(metric)).withColumn("sd", F.stddev_samp("value").over(metric)).where("sd > 1e-12")
    scored = spread.withColumn("z", (F.col("value") - F.col("mu")) / F.col("sd"))
    return scored.select("dataset", "metric", F.round("z", digits).alias("z"), (F.abs("z") > 2).alias("over_2"), (F.abs("z") > 3).alias("over_3"))


def heatmap_z(means: DataFrame, digits: int = 8) -> DataFrame:
    """Z-scores within each metric, a spread of 0 taken as 1."""
    metric = Window.partitionBy("metric")
    sd = F.stddev_pop("value").over(metric)
    return means.select("dataset", "metric", F.round((F.col("value") - F.avg("value").over(metric)) / F.when(sd > 1e-12, sd).otherwise(1.0), digits).alias("z"))


def completeness_gate(observed: DataFrame, key: str, required: DataFrame) -> DataFrame:
    """Keys whose observed pairs cover every required one (relational division). ``required`` is a short list, counted once."""
    pairs = required.distinct()
    met = observed.join(F.broadcast(pairs), pairs.columns, "left_semi").groupBy(key).agg(F.count_distinct(*[F.col(c) for c in pairs.columns]).alias("n"))
    need = pairs.agg(F.count(F.lit(1)).alias("need"))
    return met.crossJoin(F.broadcast(need)).where(F.col("n") == F.col("need")).select(key)


def largest_per_key(datasets: DataFrame, key: str, size: str, name: str) -> DataFrame:
    """The row of the greatest size for each key, the least name on ties."""
    order = Window.partitionBy(key).orderBy(F.desc(size), name)
    return datasets.withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__row")


def welch(groups: DataFrame, digits: int = 6) -> DataFrame:
    """Welch F, degrees of freedom and eta squared of ``value`` by ``metric`` over ``dataset`` groups, from moments. No jitter is added."""
    m = groups.where("value IS NOT NULL").groupBy("metric", "dataset").agg(F.count("value").cast("double").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("v")).where("n > 1 AND v > 1e-12")
    m = m.withColumn("w", F.col("n") / F.col("v"))
    metric = Window.partitionBy("metric")
    m = m.withColumn("ws", F.sum("w").over(metric)).withColumn("k", F.count(F.lit(1)).over(metric).cast("double")).withColumn("grand", F.sum(F.col("w") * F.col("mean")).over(metric) / F.sum("w").over(metric))
    m = m.withColumn("plain", F.sum(F.col("n") * F.col("mean")).over(metric) / F.sum("n").over(metric))
    s = m.where("k > 1").groupBy("metric").agg(
        F.max("k").alias("k"),
        (F.sum(F.col("w") * F.pow(F.col("mean") - F.col("grand"), F.lit(2.0))) / (F.max("k") - 1)).alias("a"),
        F.sum(F.pow(1 - F.col("w") / F.col("ws"), F.lit(2.0)) / (F.col("n") - 1)).alias("lam"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("plain"), F.lit(2.0))).alias("between"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
    )
    kk = F.col("k") * F.col("k") - 1
    r = lambda x: F.round(x, digits)
    return s.select("metric", r(F.col("a") / (1 + 2 * (F.col("k") - 2) * F.col("lam") / kk)).alias("f"), (F.col("k") - 1).cast("long").alias("df1"), r(kk / (3 * F.col("lam"))).alias("df2"), r(F.col("between") / (F.col("between") + F.col("within"))).alias("eta_sq"))


def adjust_bh(tests: DataFrame, p: str = "p", digits: int = 12) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values as ``p_bh``; missing stay missing and are not counted.

    Ranks and the minima over all larger p are running totals and minima by ranges of
    the distinct p-values, so no task holds all tests.
    """
    known = tests.where(F.col(p).isNotNull())
    counts = cut(known.groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n").alias("__m"))
    # Of equal p-values the last rank gives the least product, and it holds for all of them.
    ranked = running_total(counts, "__p", F.col("__n"), "__rank").crossJoin(F.broadcast(total))
    raw = ranked.withColumn("__raw", F.col("__p") * F.col("__m").cast("double") / F.col("__rank"))
    least = running_extreme(raw, "__p", F.col("__raw"), "__least", least=True, backwards=True)
    found = least.select("__p", F.round(F.least(F.lit(1.0), F.col("__least")), digits).alias("p_bh"))
    return known.join(found, known[p] == found["__p"]).drop("__p").unionByName(tests.where(F.col(p).isNull()).withColumn("p_bh", F.lit(None).cast("double")))


def order_by_q(tests: DataFrame, q: str = "p_bh", tie: str = "metric") -> DataFrame:
    """``place`` from 1 of each test with an adjusted p-value, ties by name; ranks by ranges."""
    return running_total(tests.where(F.col(q).isNotNull()), q, F.lit(1), "place", [tie]).withColumn("place", F.col("place").cast("int"))


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin`` (from 0), ``n`` over equal bins from the least to the greatest value; the last bin holds the greatest."""
    span = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / F.when(width > 0, width).otherwise(1.0)))
    return values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def trial_statistics(trials: DataFrame) -> DataFrame:
    """Counts by state, mean, population deviation, least and greatest duration, percent of all."""
    total = Window.partitionBy(F.lit(0))
    return trials.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 6).alias("mean"), F.round(F.stddev_pop("duration"), 6).alias("sd"), F.min("duration").alias("least"), F.max("duration").alias("greatest")).withColumn("percent", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(total), 9))


def best_so_far(trials: DataFrame) -> DataFrame:
    """Running best of ``value`` by trial and how many trials since it last rose; no best and 0 before the first value. By ranges of trials."""
    key = F.struct(F.col("value").alias("value"), (-F.col("trial_id")).alias("first"))
    best = running_extreme(trials, "trial_id", F.when(F.col("value").isNotNull(), key), "top")
    return best.select("trial_id", F.col("top.value").alias("best"), F.coalesce(F.col("trial_id") + F.col("top.first"), F.lit(0)).alias("stale"))


def trial_distribution(trials: DataFrame) -> DataFrame:
    """``value``, ``share``: the part of trials whose value is at most this one, for each distinct value; trials without a value are not counted."""
    counts = trials.where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(counts, "value", F.col("n"), "upto")
    total = counts.agg(F.sum("n").alias("total"))
    return upto.crossJoin(F.broadcast(total)).select("value", F.round(F.col("upto") / F.col("total"), 9).alias("share"))


def trial_timeline(trials: DataFrame) -> DataFrame:
    """``trial_id``, ``state``, ``start`` and ``end`` seconds from the first start on; a trial that has not ended has no end."""
    first = trials.agg(F.min("began").alias("first"))
    return trials.crossJoin(F.broadcast(first)).select("trial_id", "state", (F.col("began") - F.col("first")).alias("start"), (F.col("ended") - F.col("first")).alias("end"))


def parameter_importance(trials: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """``parameter``, ``importance``: the share of the values' variance that lies between a parameter's settings, scaled to sum to 1 over parameters.

    This one-way share of variance needs sums only; ``functional_importance`` asks a tree, as the reference asks a forest.
    """
    settings = trials.where("value IS NOT NULL").unpivot(["value"], [F.col(p).cast("string").alias(p) for p in parameters], "parameter", "setting")
    cells = settings.groupBy("parameter", "setting").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    own = Window.partitionBy("parameter")
    grand = F.sum(F.col("n") * F.col("mean")).over(own) / F.sum("n").over(own)
    between = cells.withColumn("b", F.col("n") * F.pow(F.col("mean") - grand, F.lit(2.0))).groupBy("parameter").agg(F.sum("b").alias("b"))
    total = between.agg(F.sum("b").alias("t"))  # a row for each parameter
    return between.crossJoin(F.broadcast(total)).select("parameter", F.round(F.coalesce(F.try_divide("b", "t"), F.lit(0.0)), 9).alias("importance"))


#: Settings that a numeric parameter is cut into.
SETTINGS = 8


def _leaves(x: np.ndarray, sizes: list[int], n: np.ndarray, s: np.ndarray, least: float) -> list[tuple[list[np.ndarray], float]]:
    """Boxes of a regression tree over cells of settings: for each parameter the settings of a box, and its mean. ``x``: cells x parameters."""
    out, open_boxes = [], [(np.arange(len(x)), [np.arange(k) for k in sizes])]
    while open_boxes:
        rows, box = open_boxes.pop()
        total, weight = s[rows].sum(), n[rows].sum()
        best = (1e-12 * max(1.0, abs(total * total / weight)), None)
        for p in range(x.shape[1]):
            # Settings in the order of their means: the best cut of them is one of that order.
            own_n, own_s = np.bincount(x[rows, p], n[rows], sizes[p]), np.bincount(x[rows, p], s[rows], sizes[p])
            seen = np.nonzero(own_n)[0]
            order = seen[np.lexsort((seen, own_s[seen] / own_n[seen]))]
            low_n, low_s = np.cumsum(own_n[order])[:-1], np.cumsum(own_s[order])[:-1]
            gain = low_s**2 / low_n + (total - low_s) ** 2 / (weight - low_n) - total**2 / weight
            gain = np.where((low_n >= least) & (weight - low_n >= least), gain, -np.inf)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (p, order[: int(gain.argmax()) + 1]))
        if best[1] is None:
            out.append((box, total / weight))
            continue
        p, low = best[1]
        below = np.isin(x[rows, p], low)
        # Settings that these cells lack go with the larger side.
        inside = np.isin(box[p], low) | (~np.isin(box[p], x[rows, p]) & (n[rows][below].sum() >= weight / 2))
        for side, part in ((rows[below], inside), (rows[~below], ~inside)):
            open_boxes.append((side, [*box[:p], box[p][part], *box[p + 1 :]]))
    return out


def variance_shares(x: np.ndarray, sizes: list[int], n: np.ndarray, s: np.ndarray, least: float = 1.0) -> np.ndarray:
    """Of each parameter the variance of its marginal means over the whole variance of the tree, every setting counting alike."""
    leaves = _leaves(x, sizes, n, s, least)
    volume = np.array([np.prod([len(b) / k for b, k in zip(box, sizes, strict=True)]) for box, _ in leaves])
    value = np.array([v for _, v in leaves])
    mean = (volume * value).sum()
    whole = (volume * (value - mean) ** 2).sum()
    shares = np.zeros(len(sizes))
    for p, k in enumerate(sizes):
        marginal = np.zeros(k)
        for (box, v), part in zip(leaves, volume, strict=True):
            marginal[box[p]] += v * part / (len(box[p]) / k)
        shares[p] = ((marginal - mean) ** 2).mean() / whole if whole > 1e-300 else 0.0
    return shares


def functional_importance(trials: DataFrame, parameters: Sequence[str], *, study: str | None = None, least: float = 1.0) -> DataFrame:
    """``parameter``, ``importance`` (of each ``study``): the part of the variance of the values that a parameter alone explains, scaled to sum to 1.

    Spark counts and adds up the values of each combination of settings; strings are
    settings themselves, numbers of more than SETTINGS values are cut at quantiles into
    that many. A regression tree is grown over the combinations, whatever the number of
    trials, and its boxes give every parameter's marginal means with the others evenly
    spread. Trials without a value are left out; a null setting is one of its own.
    Nothing varies: all importances are 0.
    """
    ship_package(trials.sparkSession)
    done = trials.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    settings = []
    for p in parameters:
        cell = F.col(p).cast("string")
        if not isinstance(done.schema[p].dataType, StringType) and done.select(p).distinct().limit(SETTINGS + 1).count() > SETTINGS:
            cuts = sorted(set(done.where(F.col(p).isNotNull()).approxQuantile(p, [i / SETTINGS for i in range(1, SETTINGS)], 1 / (4 * SETTINGS))))
            number = F.col(p).cast("double")
            cell = F.when(number.isNotNull(), F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= number)).cast("string"))  # noqa: B023  called at once
        settings.append(F.coalesce(cell, F.lit("\0")).alias(p))
    island = F.col(study) if study else F.lit(0)
    cells = done.select(island.alias("__study"), *settings, F.col("value").cast("double").alias("__v")).groupBy("__study", *parameters).agg(F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__s"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(parameters))
        coded = [np.unique(frame[p].to_numpy(str), return_inverse=True) for p in parameters]
        shares = variance_shares(np.stack([c for _, c in coded], axis=1), [len(u) for u, _ in coded], frame["__n"].to_numpy(float), frame["__s"].to_numpy(float), least)
        total = shares.sum()
        return pd.DataFrame({"__study": frame["__study"].iloc[0], "parameter": list(parameters), "importance": np.round(shares / total if total > 0 else shares, 9)})

    kind = cells.schema["__study"].dataType.simpleString()
    found = cells.groupBy("__study").applyInPandas(lambda frame: run(frame), f"__study {kind}, parameter string, importance double")
    return found.withColumnRenamed("__study", study) if study else found.drop("__study")
