"""Evaluation of predictions: confusion counts, class reports, ranking metrics, distributions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.operators.relate import running_extreme
from genoframe.session import cut


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(pairs: DataFrame, labels: Sequence[int]) -> DataFrame:
    """``y_true``, ``y_pred``, ``n`` for every pair of labels, zeros included. Labels are a fixed, short list."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "y_true int, y_pred int")
    counts = pairs.where(F.col("y_true").isin(list(labels)) & F.col("y_pred").isin(list(labels))).groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("c"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("c", F.lit(0)).alias("n"))


def class_counts(matrix: DataFrame) -> DataFrame:
    """``label``, ``tp``, ``fp``, ``fn`` from a confusion matrix."""
    sides = F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn"))))
    return matrix.select(sides.alias("s")).groupBy("s.label").agg(*[F.sum(f"s.{k}").alias(k) for k in ("tp", "fp", "fn")])


def _one_row(counts: DataFrame, *by: str) -> DataFrame:
    """All labels' counts as one array ``c``: reports are made of it, so what is counted is read once. Labels are a fixed, short list."""
    return counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("label", "tp", "fp", "fn"))).alias("c"))


def _total(of: Callable[[Column], Column]) -> Column:
    return F.aggregate("c", F.lit(0.0), lambda a, x: a + of(x).cast("double"))


_MEASURES: dict[str, Callable[[Column], Column]] = {
    "precision": lambda x: _ratio(x["tp"], x["tp"] + x["fp"]),
    "recall": lambda x: _ratio(x["tp"], x["tp"] + x["fn"]),
    "f1": lambda x: _ratio(2 * x["tp"], 2 * x["tp"] + x["fp"] + x["fn"]),
    "jaccard": lambda x: _ratio(x["tp"], x["tp"] + x["fp"] + x["fn"]),
}


def _report_rows(measures: Sequence[str], names: Sequence[str], accuracy: bool) -> Column:
    """Rows for each label and then the averages, from the array ``c``; ``names`` are those of the two averages."""
    support = lambda x: x["tp"] + x["fn"]
    every = _total(support)
    own = F.transform("c", lambda x: F.struct(x["label"].cast("string").alias("label"), *[_MEASURES[m](x).alias(m) for m in measures], support(x).cast("long").alias("support")))
    size = F.size("c").cast("double")
    more = [
        F.struct(F.lit(names[0]).alias("label"), *[(_total(_MEASURES[m]) / size).alias(m) for m in measures], every.cast("long").alias("support")),
        F.struct(F.lit(names[1]).alias("label"), *[_ratio(_total(lambda x, m=m: _MEASURES[m](x) * support(x)), every).alias(m) for m in measures], every.cast("long").alias("support")),
    ]
    if accuracy:
        right = _ratio(_total(lambda x: x["tp"]), every)
        more.append(F.struct(F.lit("accuracy").alias("label"), *[right.alias(m) for m in measures], every.cast("long").alias("support")))
    return F.inline(F.concat(own, F.array(*more)))


def class_report(matrix: DataFrame) -> DataFrame:
    """``label`` (class, ``accuracy``, ``macro avg``, ``weighted avg``), ``precision``, ``recall``, ``f1``, ``support``."""
    m = ("precision", "recall", "f1")
    rows = _one_row(class_counts(matrix)).select(_report_rows(m, ("macro avg", "weighted avg"), True))
    return rows.select("label", *[F.round(k, 9).alias(k) for k in m], "support")


def jaccard(matrix: DataFrame) -> DataFrame:
    """TP / (TP + FP + FN) of each class, macro and weighted; 0 on zero division."""
    rows = _one_row(class_counts(matrix)).select(_report_rows(("jaccard",), ("macro", "weighted"), False))
    return rows.select("label", F.round("jaccard", 9).alias("jaccard"))


def matthews(matrix: DataFrame) -> DataFrame:
    """Multi-class correlation from the marginals; 0 if undefined."""
    c = class_counts(matrix).select(F.col("tp").cast("double").alias("tp"), (F.col("tp") + F.col("fn")).cast("double").alias("t"), (F.col("tp") + F.col("fp")).cast("double").alias("p"))
    s = c.agg(F.sum("tp").alias("c"), F.sum("t").alias("s"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    top = F.col("c") * F.col("s") - F.col("tp")
    bottom = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return s.select(F.round(_ratio(top, bottom), 9).alias("mcc"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """One-vs-rest area by rank sums, ties given average ranks. Input ``cls``, ``positive`` (boolean), ``score``.

    Scores are counted first, so what is ranked is distinct scores and not rows. A
    class with no positive or no negative has no row.
    """
    tied = scores.groupBy("cls", "score").agg(F.count_if("positive").alias("pos"), F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("cls").orderBy("score")
    ranked = tied.withColumn("rank", F.sum("n").over(running) - (F.col("n") - 1) / F.lit(2.0))
    sums = ranked.groupBy("cls").agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("np"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("nn"))
    both = sums.where((F.col("np") > 0) & (F.col("nn") > 0))
    return both.select("cls", F.round((F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn")), 9).alias("auc"), F.col("np").cast("long").alias("positives"))


def macro_roc_auc(scores: DataFrame, *, single_class: str = "raise") -> DataFrame:
    """``auc``, the mean of the classes' areas. Where a class has no positive or no negative: "raise" fails the query, "drop" leaves it out."""
    areas = roc_auc(scores)
    found = areas.agg(F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("have"))
    if single_class == "drop":
        return found.select(F.round("auc", 9).alias("auc"))
    need = scores.agg(F.count_distinct("cls").alias("need"))
    failed = F.raise_error(F.lit("a class is without positive or without negative cells")).cast("double")
    return found.crossJoin(F.broadcast(need)).select(F.when(F.col("have") == F.col("need"), F.round("auc", 9)).otherwise(failed).alias("auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """Sum of precision times recall gained, over falling distinct scores. Input as ``roc_auc``."""
    tied = scores.groupBy("cls", "score").agg(F.count_if("positive").alias("pos"), F.count(F.lit(1)).alias("n"))
    falling = Window.partitionBy("cls").orderBy(F.desc("score"))
    steps = tied.withColumn("tp", F.sum("pos").over(falling)).withColumn("seen", F.sum("n").over(falling)).withColumn("np", F.sum("pos").over(Window.partitionBy("cls")))
    return steps.where("np > 0").groupBy("cls").agg(F.round(F.sum(F.col("pos").cast("double") / F.col("np") * F.col("tp") / F.col("seen")), 9).alias("ap"))


def curve_points(scores: DataFrame) -> DataFrame:
    """Points of the ROC and precision-recall curves at each distinct score."""
    tied = scores.groupBy("cls", "score").agg(F.count_if("positive").alias("pos"), F.count(F.lit(1)).alias("n"))
    falling = Window.partitionBy("cls").orderBy(F.desc("score"))
    own = Window.partitionBy("cls")
    steps = tied.withColumn("tp", F.sum("pos").over(falling)).withColumn("fp", F.sum(F.col("n") - F.col("pos")).over(falling)).withColumn("np", F.sum("pos").over(own)).withColumn("nn", F.sum(F.col("n") - F.col("pos")).over(own))
    return steps.select("cls", "score", F.round(_ratio(F.col("tp"), F.col("np")), 9).alias("tpr"), F.round(_ratio(F.col("fp"), F.col("nn")), 9).alias("fpr"), F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 9).alias("precision"))


def class_weights(counts: DataFrame, *, power: float = 1.0, max_ratio: float | None = None, inverse: bool = False) -> DataFrame:
    """``g``, ``weight`` from ``g``, ``n``: N/(K n) or N/n, to a power, capped at a multiple of the least, scaled to mean one; 0 for a class with no rows."""
    n, k = F.sum("n").over(Window.partitionBy(F.lit(0))), F.count_if(F.col("n") > 0).over(Window.partitionBy(F.lit(0)))
    raw = F.when(F.col("n") > 0, F.pow(n.cast("double") / (F.col("n") if inverse else F.col("n") * k), F.lit(power)))
    weighed = counts.withColumn("w", raw)
    everything = Window.partitionBy(F.lit(0))
    if max_ratio is not None:
        weighed = weighed.withColumn("w", F.least(F.col("w"), F.min("w").over(everything) * max_ratio))
    return weighed.withColumn("mean", F.avg("w").over(everything)).select("g", F.round(F.coalesce(F.col("w") / F.col("mean"), F.lit(0.0)), 9).alias("weight"))


def genotype_distribution(calls: DataFrame) -> DataFrame:
    """``dataset``, ``symbol``, ``n``, ``percent``."""
    counts = calls.groupBy("dataset", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy("dataset")), 9))


def js_distance(dist: DataFrame, a: str, b: str) -> DataFrame:
    """Jensen-Shannon distance, base 2, between two datasets' symbol distributions, N left out."""
    known = dist.where("symbol != 'N'")
    share = known.withColumn("p", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("dataset")))
    wide = share.groupBy("symbol").agg(F.coalesce(F.max(F.when(F.col("dataset") == a, F.col("p"))), F.lit(0.0)).alias("p"), F.coalesce(F.max(F.when(F.col("dataset") == b, F.col("p"))), F.lit(0.0)).alias("q"))
    half = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / half)).otherwise(0.0)
    return wide.agg(F.round(F.sqrt(F.greatest(F.sum(term(F.col("p")) + term(F.col("q"))) / 2, F.lit(0.0))), 9).alias("js_distance"))


#: Chances that a Poisson draw of mean 1 is at most k; beyond these it is under 1e-12.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(15)]


def poisson_weight(u: Column) -> Column:
    """A Poisson draw of mean 1 from a uniform one: how often a row is drawn where rows are drawn with replacement."""
    return sum(((u >= F.lit(p)).cast("int") for p in POISSON), F.lit(0))


def bootstrap_reports(pairs: DataFrame, labels: Sequence[int], replicates: int, draw: Callable[[Column], Column]) -> DataFrame:
    """The class report of every replicate: ``rep``, ``label``, ``metric`` (precision, recall, f1), ``value``.

    Each row weighs a Poisson draw in each replicate, so replicates are with replacement
    and rows need not meet: one aggregation adds up the weights of all replicates.
    ``draw`` gives a row's uniform draw for a replicate.
    """
    rows = pairs.where(F.col("y_true").isin(list(labels)) & F.col("y_pred").isin(list(labels)))
    drawn = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", poisson_weight(draw(F.col("rep")))).where("w > 0")
    matrix = drawn.groupBy("rep", "y_true", "y_pred").agg(F.sum("w").alias("n"))
    zero, hit = F.lit(0).cast("long"), F.col("y_true") == F.col("y_pred")
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.when(hit, F.col("n")).otherwise(zero).alias("tp"), zero.alias("fp"), F.when(~hit, F.col("n")).otherwise(zero).alias("fn")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("tp"), F.when(~hit, F.col("n")).otherwise(zero).alias("fp"), zero.alias("fn")),
        *[F.struct(F.lit(label).alias("label"), zero.alias("tp"), zero.alias("fp"), zero.alias("fn")) for label in labels],
    )
    counts = matrix.select("rep", F.inline(sides)).groupBy("rep", "label").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    m = ("precision", "recall", "f1")
    reports = _one_row(counts, "rep").select("rep", _report_rows(m, ("macro avg", "weighted avg"), True))
    return reports.unpivot(["rep", "label"], list(m), "metric", "value")


def bootstrap_interval(reports: DataFrame, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval of ``value`` by ``label`` and ``metric`` over replicates; null and NaN values are left out."""
    low = (1 - level) / 2
    known = reports.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return known.groupBy("label", "metric").agg(F.round(F.avg("value"), 9).alias("mean"), F.round(F.percentile("value", F.lit(low)), 9).alias("lower"), F.round(F.percentile("value", F.lit(1 - low)), 9).alias("upper"))


def macro_curves(scores: DataFrame, classes: Sequence[int]) -> DataFrame:
    """The classes' mean ROC and precision-recall curves: ``curve`` (roc, pr), ``x``, ``y`` at every x that some class's curve has.

    Between its own points a class's curve is linear; before the first and after the last
    it keeps their values. Several points at one x count by the last that a falling
    threshold reaches: the greatest true positive rate, the least precision. A class
    without positives or negatives has rates of 0. Input as ``roc_auc``.
    """
    tied = scores.groupBy("cls", "score").agg(F.count_if("positive").alias("pos"), F.count(F.lit(1)).alias("n"))
    falling, own = Window.partitionBy("cls").orderBy(F.desc("score")), Window.partitionBy("cls")
    steps = tied.withColumn("tp", F.sum("pos").over(falling)).withColumn("fp", F.sum(F.col("n") - F.col("pos")).over(falling)).withColumn("np", F.sum("pos").over(own)).withColumn("nn", F.sum(F.col("n") - F.col("pos")).over(own))
    tpr, fpr, precision = _ratio(F.col("tp"), F.col("np")), _ratio(F.col("fp"), F.col("nn")), _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    starts = scores.sparkSession.createDataFrame([(c, k, 0.0, y) for c in classes for k, y in (("roc", 0.0), ("pr", 1.0))], "cls int, curve string, x double, y double")
    both = steps.select(F.col("cls").cast("int").alias("cls"), F.inline(F.array(F.struct(F.lit("roc").alias("curve"), fpr.alias("x"), tpr.alias("y")), F.struct(F.lit("pr").alias("curve"), tpr.alias("x"), precision.alias("y")))))
    points = cut(both.unionByName(starts).groupBy("cls", "curve", "x").agg(F.min("y").alias("low"), F.max("y").alias("high")))
    # What a line comes from is the last point at an x, what it goes to is the first one.
    rising = F.col("curve") == "roc"
    points = points.select("cls", "curve", "x", F.when(rising, F.col("high")).otherwise(F.col("low")).alias("y"), F.when(rising, F.col("low")).otherwise(F.col("high")).alias("first"))
    grid = points.select("curve", "x").distinct().withColumn("cls", F.explode(F.array(*map(F.lit, classes))))
    marked = grid.join(points, ["cls", "curve", "x"], "left")
    here = lambda y: F.when(F.col("y").isNotNull(), F.struct("x", F.col(y).alias("y")))
    left = running_extreme(marked, "x", here("y"), "left", keys=("cls", "curve"))
    ends = running_extreme(left, "x", here("first"), "right", least=True, backwards=True, keys=("cls", "curve"))
    a, b = F.col("left"), F.col("right")
    between = a["y"] + (b["y"] - a["y"]) / (b["x"] - a["x"]) * (F.col("x") - a["x"])
    value = F.when(F.col("y").isNotNull(), F.col("y")).when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(between)
    return ends.groupBy("curve", "x").agg(F.avg(value).alias("y")).select("curve", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))
