"""Losses over class frequencies, schedules and early stopping over orders as epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoframe.model import CELLS_SQL
from genoframe.operators import impute, training
from genoframe.plans.genotypes import DIST_SQL, TR_SQL
from genoframe.plans.genotypes import training as training_cells
from genoframe.plans.registry import query
from genoframe.session import read_table

WEIGHTS, GAMMA, SCALE, BETA = (0.5, 1.5, 2.0), 2.0, 40.0, 0.25


def true_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated calls with the probability that their locus gives their class: a null one is a class not seen in training."""
    cells = training_cells(spark, sf_dir)
    dist = impute.distribution(cells.where("NOT is_test"))
    return cells.where("evaluated").select("locus_id", "g").join(dist.select("locus_id", F.col("state").alias("g"), "prob"), ["locus_id", "g"], "left")


FOCAL_SQL = f"""WITH {CELLS_SQL}, {TR_SQL}, d AS ({DIST_SQL}),
p AS (SELECT t.g, least(1.0::DOUBLE, greatest(coalesce(d.prob, 0), 1e-9::DOUBLE)) AS p FROM tr t LEFT JOIN d ON d.locus_id = t.locus_id AND d.state = t.g WHERE evaluated),
f AS (SELECT g, -([0.5, 1.5, 2.0]::DOUBLE[])[g + 1] * pow(1 - p, 2.0::DOUBLE) * ln(p) AS loss FROM p)"""


def focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return true_class(spark, sf_dir).select("g", training.focal_loss(F.col("prob"), F.col("g"), weights=WEIGHTS, gamma=GAMMA).alias("loss"))


@query("v01_focal_loss", f"{FOCAL_SQL} SELECT g, count(*) AS n, round(avg(loss), 9) AS mean, round(sum(loss), 6) AS total FROM f GROUP BY g")
def v01(spark, sf_dir):
    return focal(spark, sf_dir).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 9).alias("mean"), F.round(F.sum("loss"), 6).alias("total"))


KL_SQL = """e AS (SELECT label, embedding[1:len(embedding) // 2]::DOUBLE[] AS mu, embedding[len(embedding) // 2 + 1:len(embedding) // 2 * 2]::DOUBLE[] AS lv FROM embeddings),
k AS (SELECT label, avg(coalesce(list_sum(list_transform(range(1, len(mu) + 1), lambda i: -0.5 * (1 + lv[i] - mu[i] * mu[i] - exp(lv[i])))), 0)) AS kl FROM e GROUP BY label)"""


def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of each embedding as means and log variances, by label."""
    half = F.floor(F.size("embedding") / F.lit(2)).cast("int")
    rows = read_table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", F.lit(1), half).alias("mu"), F.slice("embedding", half + 1, half).alias("lv"))
    return training.reduced_kl(rows, "mu", "lv", by=["label"])


@query("v02_kl_divergence", f"WITH {KL_SQL} SELECT label, round(kl, 8) AS kl FROM k")
def v02(spark, sf_dir):
    return divergence(spark, sf_dir).select("label", F.round("kl", 8).alias("kl"))


@query("v03_vae_loss", f"{FOCAL_SQL}, {KL_SQL} SELECT label, round((SELECT avg(loss) FROM f) * 40.0::DOUBLE + 0.25::DOUBLE * kl, 7) AS loss FROM k")
def v03(spark, sf_dir):
    mean = focal(spark, sf_dir).agg(F.avg("loss").alias("rec"))  # one row
    return divergence(spark, sf_dir).crossJoin(F.broadcast(mean)).select("label", F.round(training.vae_loss(F.col("rec"), F.col("kl"), BETA, SCALE), 7).alias("loss"))


def epochs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders in order as the epochs of a run; open ones report no number."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    value = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(((F.col("o_orderkey") * 7919) % 1009).cast("double"))
    return read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("study"), F.row_number().over(own).alias("epoch"), value.alias("value"))


EPOCHS_SQL = "h AS (SELECT o_custkey AS study, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch, CASE WHEN o_orderstatus <> 'P' THEN CAST((o_orderkey * 7919) % 1009 AS DOUBLE) END AS value FROM orders)"


@query("w09_annealing", f"WITH {EPOCHS_SQL}, n AS (SELECT study, epoch, least(floor(m * 0.1::DOUBLE), 50) AS warm, least(floor(m * 0.2::DOUBLE), 100) AS ramp FROM (SELECT *, count(*) OVER (PARTITION BY study) AS m FROM h)) SELECT study, epoch, round(CASE WHEN epoch < warm THEN 0.1 WHEN epoch < warm + ramp THEN 2.0 * (epoch - warm) / CAST(ramp AS DOUBLE) ELSE 2.0 END, 9) AS value FROM n")
def w09(spark, sf_dir):
    runs = epochs_of(spark, sf_dir).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("study")))
    warm, ramp = training.anneal_plan(F.col("m"))
    return runs.select("study", "epoch", F.round(training.annealed(F.col("epoch"), warm, ramp, 2.0, 0.1), 9).alias("value"))


@query("w10_early_stopping", f"""WITH {EPOCHS_SQL}, b AS (SELECT *, min(value) OVER (PARTITION BY study ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
g AS (SELECT *, value IS NOT NULL AND (before IS NULL OR value < before) AS gain FROM b),
c AS (SELECT *, epoch - coalesce(max(epoch) FILTER (WHERE gain) OVER (PARTITION BY study ORDER BY epoch), 0) AS stale FROM g),
s AS (SELECT *, min(epoch) FILTER (WHERE stale >= 3 AND epoch >= 5) OVER (PARTITION BY study) AS stop_at FROM c)
SELECT study, max(epoch) AS epochs_run, max(epoch) FILTER (WHERE gain) AS best_epoch, min(value) AS best, any_value(stop_at IS NOT NULL) AS stopped FROM s WHERE stop_at IS NULL OR epoch <= stop_at GROUP BY study""")
def w10(spark, sf_dir):
    return training.early_stopping(epochs_of(spark, sf_dir), patience=3, least_epochs=5)
