"""Cross-dataset analytics: populations are the datasets, locus statistics the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.operators import compare
from genoframe.plans.registry import query
from genoframe.plans.statistics import CANONICAL, POPS, statistics
from genoframe.session import read_table

METRICS = ("maf", "ho", "he", "hd")
LONG_SQL = f"{POPS}, {CANONICAL}, lg AS (SELECT CAST(pop_id AS VARCHAR) AS dataset, metric, value FROM (SELECT pop_id, maf, ho, he, hd FROM st WHERE pop_id IS NOT NULL) UNPIVOT (value FOR metric IN (maf, ho, he, hd)))"


def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = statistics(spark, sf_dir, by_population=True).where("pop_id IS NOT NULL").withColumn("dataset", F.col("pop_id").cast("string"))
    return compare.unpivot_metrics(stats.select("dataset", *METRICS), ["dataset"], METRICS)


@query("a13_dataset_descriptives", f"{LONG_SQL} SELECT dataset, metric, round(avg(value), 8) AS mean, round(var_samp(value), 8) AS var, round(stddev_samp(value), 8) AS sd, round(quantile_cont(value, 0.5), 8) AS median, count(value) AS count FROM lg WHERE value IS NOT NULL GROUP BY dataset, metric")
def a13(spark, sf_dir):
    return compare.descriptives(long_metrics(spark, sf_dir), ["dataset", "metric"])


@query("a14_describe", "SELECT count(p_retailprice) AS count, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd, min(p_retailprice) AS min, round(quantile_cont(p_retailprice, 0.25), 6) AS q25, round(quantile_cont(p_retailprice, 0.5), 6) AS q50, round(quantile_cont(p_retailprice, 0.75), 6) AS q75, max(p_retailprice) AS max FROM part")
def a14(spark, sf_dir):
    return compare.describe(read_table(spark, sf_dir, "part"), "p_retailprice")


MEANS_SQL = f"{LONG_SQL}, mn AS (SELECT dataset, metric, avg(value) AS value FROM lg GROUP BY dataset, metric)"


def dataset_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_metrics(spark, sf_dir).groupBy("dataset", "metric").agg(F.avg("value").alias("value"))


@query("w04_outlier_z", f"{MEANS_SQL}, z AS (SELECT dataset, metric, (value - avg(value) OVER (PARTITION BY metric)) / nullif(stddev_samp(value) OVER (PARTITION BY metric), 0) AS z, stddev_samp(value) OVER (PARTITION BY metric) AS sd FROM mn) SELECT dataset, metric, round(z, 8) AS z, abs(z) > 2 AS over_2, abs(z) > 3 AS over_3 FROM z WHERE sd > 1e-12")
def w04(spark, sf_dir):
    return compare.outliers(dataset_means(spark, sf_dir))


@query("w03_group_transform", f"{MEANS_SQL} SELECT dataset, metric, round(avg(value) OVER (PARTITION BY metric), 9) AS mu, round(stddev_samp(value) OVER (PARTITION BY metric), 9) AS sd FROM mn")
def w03(spark, sf_dir):
    from pyspark.sql import Window

    metric = Window.partitionBy("metric")
    return dataset_means(spark, sf_dir).select("dataset", "metric", F.round(F.avg("value").over(metric), 9).alias("mu"), F.round(F.stddev_samp("value").over(metric), 9).alias("sd"))


@query("w05_heatmap_z", f"{MEANS_SQL}, z AS (SELECT dataset, metric, value - avg(value) OVER (PARTITION BY metric) AS d, stddev_pop(value) OVER (PARTITION BY metric) AS sd FROM mn) SELECT dataset, metric, round(d / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 8) AS z FROM z")
def w05(spark, sf_dir):
    return compare.heatmap_z(dataset_means(spark, sf_dir))


WELCH_SQL = f"""{LONG_SQL}, m AS (SELECT metric, dataset, CAST(count(value) AS DOUBLE) AS n, avg(value) AS mean, var_samp(value) AS v FROM lg WHERE value IS NOT NULL GROUP BY metric, dataset HAVING count(value) > 1 AND var_samp(value) > 1e-12),
w AS (SELECT *, n / v AS w, sum(n / v) OVER g AS ws, CAST(count(*) OVER g AS DOUBLE) AS k, sum(n / v * mean) OVER g / sum(n / v) OVER g AS grand, sum(n * mean) OVER g / sum(n) OVER g AS plain FROM m WINDOW g AS (PARTITION BY metric)),
s AS (SELECT metric, max(k) AS k, sum(w * pow(mean - grand, 2)) / (max(k) - 1) AS a, sum(pow(1 - w / ws, 2) / (n - 1)) AS lam, sum(n * pow(mean - plain, 2)) AS b, sum((n - 1) * v) AS wi FROM w WHERE k > 1 GROUP BY metric),
wf AS (SELECT metric, round(a / (1 + 2 * (k - 2) * lam / (k * k - 1)), 6) AS f, CAST(k - 1 AS BIGINT) AS df1, round((k * k - 1) / (3 * lam), 6) AS df2, round(b / (b + wi), 6) AS eta_sq FROM s)"""


@query("a27_welch_f", f"{WELCH_SQL} SELECT metric, f, df1, df2, eta_sq FROM wf")
def a27(spark, sf_dir):
    return compare.welch(long_metrics(spark, sf_dir))


@query("t02_top_metrics", f"{WELCH_SQL} SELECT metric, eta_sq FROM wf ORDER BY eta_sq DESC, metric LIMIT 10")
def t02(spark, sf_dir):
    return compare.welch(long_metrics(spark, sf_dir)).orderBy(F.desc("eta_sq"), "metric").limit(10).select("metric", "eta_sq")


P_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS metric, CASE WHEN p_partkey % 17 <> 0 THEN ((p_partkey * 7919) % 1009) / CAST(1009 AS DOUBLE) END AS p FROM part"


@query("a29_bh_adjust", f"WITH t AS ({P_SQL}), r AS (SELECT metric, p, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw, row_number() OVER (ORDER BY p) AS rn FROM t WHERE p IS NOT NULL) SELECT metric, p, round(least(1, min(raw) OVER (ORDER BY rn DESC)), 12) AS p_bh FROM r UNION ALL SELECT metric, p, NULL FROM t WHERE p IS NULL")
def a29(spark, sf_dir):
    key = F.col("p_partkey")
    tests = read_table(spark, sf_dir, "part").select(key.cast("string").alias("metric"), F.when(key % 17 != 0, ((key * 7919) % 1009).cast("double") / F.lit(1009.0)).alias("p"))
    return compare.adjust_bh(tests)


@query("t01_order_by_q", f"WITH t AS ({P_SQL}), r AS (SELECT metric, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw, row_number() OVER (ORDER BY p) AS rn FROM t WHERE p IS NOT NULL) SELECT metric, CAST(row_number() OVER (ORDER BY q, metric) AS INT) AS place FROM (SELECT metric, round(least(1, min(raw) OVER (ORDER BY rn DESC)), 12) AS q FROM r)")
def t01(spark, sf_dir):
    return compare.order_by_q(a29(spark, sf_dir)).select("metric", "place")


@query("a31_trial_statistics", "WITH t AS (SELECT o_orderstatus AS state, CAST((o_orderkey * 37) % 900 AS DOUBLE) AS duration FROM orders) SELECT state, count(*) AS n, round(avg(duration), 6) AS mean, round(stddev_pop(duration), 6) AS sd, min(duration) AS least, max(duration) AS greatest, round(count(*) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS percent FROM t GROUP BY state")
def a31(spark, sf_dir):
    return compare.trial_statistics(read_table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("state"), ((F.col("o_orderkey") * 37) % 900).cast("double").alias("duration")))


@query("a34_histogram", "WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(29, floor((l_extendedprice - lo) / ((hi - lo) / CAST(30 AS DOUBLE)))) AS BIGINT) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1")
def a34(spark, sf_dir):
    return compare.histogram(read_table(spark, sf_dir, "lineitem").select("l_extendedprice"), "l_extendedprice", 30)


@query("a35_best_so_far", "SELECT p_partkey AS trial_id, max(v) OVER (ORDER BY p_partkey) AS best, p_partkey - max(p_partkey) FILTER (WHERE rose) OVER (ORDER BY p_partkey) AS stale FROM (SELECT p_partkey, v, coalesce(v > max(v) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS rose FROM (SELECT p_partkey, (p_partkey * 7919) % 1009 AS v FROM part))")
def a35(spark, sf_dir):
    trials = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial_id"), ((F.col("p_partkey") * 7919) % 1009).alias("value"))
    return compare.best_so_far(trials)


TRIALS_SQL = "WITH t AS (SELECT o_orderkey AS trial_id, o_orderstatus AS state, o_orderpriority AS a, o_custkey % 5 AS b, CASE WHEN o_orderstatus <> 'P' THEN CAST((o_orderkey * 7919) % 1009 AS DOUBLE) END AS value, (o_orderkey * 37) % 900 AS began, CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey * 37) % 900 + o_orderkey % 60 END AS ended FROM orders)"


def order_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trials: pending ones have no value and no end."""
    key, done = F.col("o_orderkey"), F.col("o_orderstatus") != "P"
    began = (key * 37) % 900
    return read_table(spark, sf_dir, "orders").select(key.alias("trial_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("a"), (F.col("o_custkey") % 5).alias("b"), F.when(done, ((key * 7919) % 1009).cast("double")).alias("value"), began.alias("began"), F.when(done, began + key % 60).alias("ended"))


@query("a35_trial_distribution", f"{TRIALS_SQL} SELECT DISTINCT value, round(cume_dist() OVER (ORDER BY value), 9) AS share FROM t WHERE value IS NOT NULL")
def a35_distribution(spark, sf_dir):
    return compare.trial_distribution(order_trials(spark, sf_dir))


@query("a35_trial_timeline", f'{TRIALS_SQL} SELECT trial_id, state, began - (SELECT min(began) FROM t) AS start, ended - (SELECT min(began) FROM t) AS "end" FROM t')
def a35_timeline(spark, sf_dir):
    return compare.trial_timeline(order_trials(spark, sf_dir))


@query("a35_parameter_importance", f"{TRIALS_SQL}, u AS (SELECT 'a' AS parameter, CAST(a AS VARCHAR) AS setting, value FROM t WHERE value IS NOT NULL UNION ALL SELECT 'b', CAST(b AS VARCHAR), value FROM t WHERE value IS NOT NULL), c AS (SELECT parameter, setting, count(*) AS n, avg(value) AS mean FROM u GROUP BY ALL), g AS (SELECT avg(value) AS grand FROM t), s AS (SELECT parameter, sum(n * (mean - grand) * (mean - grand)) AS b FROM c, g GROUP BY parameter) SELECT parameter, round(coalesce(b / nullif((SELECT sum(b) FROM s), 0), 0), 9) AS importance FROM s")
def a35_importance(spark, sf_dir):
    return compare.parameter_importance(order_trials(spark, sf_dir), ["a", "b"])


@query("a35_functional_importance", f"""{TRIALS_SQL}, c AS (SELECT o.a, o.b, avg(o.value) AS m FROM t o WHERE value IS NOT NULL GROUP BY o.a, o.b), g AS (SELECT avg(m) AS grand FROM c),
v AS (SELECT 'a' AS parameter, avg((m - grand) * (m - grand)) AS v FROM (SELECT avg(m) AS m FROM c GROUP BY a), g UNION ALL SELECT 'b', avg((m - grand) * (m - grand)) FROM (SELECT avg(m) AS m FROM c GROUP BY b), g)
SELECT parameter, round(v / (SELECT sum(v) FROM v), 9) AS importance FROM v""")
def a35_functional(spark, sf_dir):
    # Every combination of the two occurs, so the tree's boxes are the combinations and its marginals their plain means.
    return compare.functional_importance(order_trials(spark, sf_dir), ["a", "b"])
