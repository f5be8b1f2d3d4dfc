"""What a training run is made of, as columns and tables: losses, schedules, early stopping. Many runs are one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least probability that a loss takes the logarithm of.
LEAST = 1e-9


def focal_loss(probability: Column, target: Column, *, classes: int = 3, weights: Sequence[float] | None = None, gamma: float = 2.0, scale: float = 1.0) -> Column:
    """Focal cross entropy of a call, from the probability of its true class: -w (1 - p)^gamma ln p, times ``scale``.

    Null where the target is null, negative or no class, so means and sums over it are
    over valid targets. Probabilities under LEAST count as that; a null one does too.
    """
    if weights is not None and len(weights) < classes:
        raise ValueError(f"{len(weights)} weights for {classes} classes")
    p = F.least(F.lit(1.0), F.greatest(F.coalesce(probability, F.lit(0.0)), F.lit(LEAST)))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), target.cast("int") + 1) if weights is not None else F.lit(1.0)
    valid = target.isNotNull() & (target >= 0) & (target < classes)
    return F.when(valid, -F.when(valid, weight) * F.pow(1 - p, F.lit(float(gamma))) * F.ln(p) * F.lit(float(scale)))


def _sound(x: Column, bad: float, high: float, low: float) -> Column:
    """NaN and null, +infinity and -infinity as numbers."""
    return F.when(x.isNull() | F.isnan(x), bad).when(x == float("inf"), high).when(x == float("-inf"), low).otherwise(x)


def kl_to_unit(mean: Column, log_var: Column) -> Column:
    """Divergence of a diagonal Gaussian (arrays of means and log variances) to the unit one; a row's, not yet guarded."""
    terms = F.zip_with(mean, log_var, lambda m, v: (1 + v - m * m - F.exp(v)) * -0.5)
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def reduced_kl(rows: DataFrame, mean: str, log_var: str, *, by: Sequence[str] = (), reduction: str = "mean") -> DataFrame:
    """``kl`` over rows (of each group), ``mean`` or ``sum``; NaN becomes 0, infinity a million, minus infinity 0."""
    if reduction not in ("mean", "sum"):
        raise ValueError(f"no such reduction: {reduction}")
    own = kl_to_unit(F.col(mean).cast("array<double>"), F.col(log_var).cast("array<double>"))
    kl = F.avg(own) if reduction == "mean" else F.sum(own)
    return rows.groupBy(*by).agg(_sound(kl, 0.0, 1e6, 0.0).alias("kl"))


def vae_loss(reconstruction: Column, kl: Column, beta: Column | float, scale: Column | float = 1.0) -> Column:
    """Reconstruction times its scale, and the weighted divergence; what is no finite number becomes a million."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return _sound(reconstruction * as_column(scale) + as_column(beta) * kl, 1e6, 1e6, 1e6)


def anneal_plan(epochs: Column) -> tuple[Column, Column]:
    """Epochs of warming and of the ramp for a run of so many: a tenth, 50 at most, and a fifth, 100 at most."""
    return F.least(F.floor(epochs * F.lit(0.1)), F.lit(50)), F.least(F.floor(epochs * F.lit(0.2)), F.lit(100))


def annealed(epoch: Column, warm: Column, ramp: Column, final: float, initial: float = 0.0) -> Column:
    """``initial`` while warm, then ``final`` times the part of the ramp that is done, then ``final``."""
    return F.when(epoch < warm, F.lit(float(initial))).when(epoch < warm + ramp, F.lit(float(final)) * (epoch - warm) / ramp).otherwise(F.lit(float(final)))


def early_stopping(history: DataFrame, *, patience: int, least_epochs: int, delta: float = 0.0, mode: str = "min") -> DataFrame:
    """How each study's run ends: ``study``, ``epochs_run``, ``best_epoch``, ``best``, ``stopped``, from ``study``, ``epoch``, ``value``.

    A run stops at the first epoch, not under ``least_epochs``, at which ``patience``
    epochs in a row brought no gain of more than ``delta``. Null, NaN and infinite values
    are no gain. With "max" the first best is 0, so nothing below counts as one. Later
    epochs are not looked at. A study without a gain has no best. A study's epochs, the
    length of a run, are folded in one row; studies are dealt over tasks.
    """
    if mode not in ("min", "max"):
        raise ValueError(f"no such mode: {mode}")
    epochs = F.array_sort(F.collect_list(F.struct("epoch", F.col("value").cast("double").alias("value"))))
    start = F.struct(F.lit(float("inf") if mode == "min" else 0.0).alias("best"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("count"), F.lit(0).cast("long").alias("run"), F.lit(False).alias("stopped"))

    def step(s: Column, e: Column) -> Column:
        v = e["value"]
        finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        gain = finite & ((v < s["best"] - delta) if mode == "min" else (v > s["best"] + delta))
        count = F.when(gain, 0).otherwise(s["count"] + 1)
        state = F.struct(F.when(gain, v).otherwise(s["best"]).alias("best"), F.when(gain, e["epoch"].cast("long")).otherwise(s["at"]).alias("at"), count.alias("count"), e["epoch"].cast("long").alias("run"), (~gain & (count >= patience) & (e["epoch"] >= least_epochs)).alias("stopped"))
        return F.when(s["stopped"], s).otherwise(state)

    ends = history.groupBy("study").agg(epochs.alias("e")).select("study", F.aggregate("e", start, step).alias("s"))
    return ends.select("study", F.col("s.run").alias("epochs_run"), F.col("s.at").alias("best_epoch"), F.when(F.col("s.at").isNotNull(), F.col("s.best")).alias("best"), F.col("s.stopped").alias("stopped"))
