"""Population-genetic statistics over the derived cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.model import CELLS_SQL, cells_from_tables
from genoframe.operators import popgen
from genoframe.plans.registry import query

#: Statistics of the counts in ``cc`` (pop_id, locus_id, n_tot, n, c0, c1, c2).
STATS_SQL = """
h AS (SELECT i, sum(1.0::DOUBLE / i) OVER (ORDER BY i) AS a1, sum(1.0::DOUBLE / (i * i)) OVER (ORDER BY i) AS a2 FROM (SELECT unnest(range(1, 2 * CAST((SELECT max(n) FROM cc) AS BIGINT) + 1)) AS i)),
s1 AS (SELECT *, c1 + 2 * c2 AS alt, 2 * n AS big, CASE WHEN n > 0 THEN (c1 + 2 * c2) / CAST(2 * n AS DOUBLE) END AS p FROM cc),
s2 AS (SELECT s1.*, CASE WHEN n > 0 THEN c1 / CAST(n AS DOUBLE) END AS ho, CASE WHEN big > 1 THEN 2 * p * (1 - p) * big / (big - 1) END AS he, CASE WHEN p > 1e-9 AND p < 1 - 1e-9 THEN 1 ELSE 0 END AS seg, coalesce(h.a1, 0) AS a1, coalesce(h.a2, 0) AS a2 FROM s1 LEFT JOIN h ON h.i = big - 1),
s3 AS (SELECT *, CASE WHEN seg = 1 AND a1 > 0 THEN 1 / a1 ELSE 0 END AS theta, CASE WHEN seg = 1 AND big > 2 THEN ((big + 1) / CAST(3 * (big - 1) AS DOUBLE) - 1 / a1) / a1 END AS var FROM s2),
st AS (SELECT pop_id, locus_id, n AS sample_size, round(1 - n / CAST(n_tot AS DOUBLE), 9) AS missingness, seg AS seg_sites, CASE WHEN n > 0 AND least(alt, big - alt) = 1 THEN 1 ELSE 0 END AS singletons,
  round(least(p, 1 - p), 9) AS maf, round(ho, 9) AS ho, round(he, 9) AS he, round(CASE WHEN he > 1e-9 THEN 1 - ho / he END, 9) + 0.0 AS f_inbreeding, c1 AS hetz_positions,
  CAST(c0 > 0 AS INT) + CAST(c1 > 0 AS INT) + CAST(c2 > 0 AS INT) AS hap,
  round(CASE WHEN n > 1 THEN (1 - (pow(c0 / CAST(n AS DOUBLE), 2) + pow(c1 / CAST(n AS DOUBLE), 2) + pow(c2 / CAST(n AS DOUBLE), 2))) * HDFACTOR WHEN n = 1 THEN 0 END, 8) AS hd,
  round(he, 9) AS pi, round(theta, 9) AS theta_watt, round(CASE WHEN var > 0 THEN (he - theta) / sqrt(var) END, 8) + 0.0 AS tajima_d, 1 AS total_pos, 0 AS net_seg_sites FROM s3)"""
CANONICAL = STATS_SQL.replace("HDFACTOR", "n / CAST(n - 1 AS DOUBLE)")
OLDER = STATS_SQL.replace("HDFACTOR", "CAST(2 * n AS DOUBLE) / (2 * n - 1)")
COUNTS = "count(*) AS n_tot, count(g) AS n, count(*) FILTER (WHERE g = 0) AS c0, count(*) FILTER (WHERE g = 1) AS c1, count(*) FILTER (WHERE g = 2) AS c2"
TOTAL = f"WITH {CELLS_SQL}, cc AS (SELECT CAST(NULL AS INT) AS pop_id, locus_id, {COUNTS} FROM cells GROUP BY locus_id)"
POPS = f"WITH {CELLS_SQL}, cc AS (SELECT pop_id, locus_id, {COUNTS} FROM cells GROUP BY GROUPING SETS ((pop_id, locus_id), (locus_id)))"


def statistics(spark: SparkSession, sf_dir: str, by_population: bool = False, older_hd: bool = False) -> DataFrame:
    return popgen.locus_statistics(popgen.genotype_counts(cells_from_tables(spark, sf_dir), by_population), older_hd=older_hd)


@query("a06_locus_stats", f"{TOTAL}, {CANONICAL} SELECT * FROM st")
def a06(spark, sf_dir):
    return statistics(spark, sf_dir)


@query("a07_locus_stats_older", f"{TOTAL}, {OLDER} SELECT locus_id, hd FROM st")
def a07(spark, sf_dir):
    return statistics(spark, sf_dir, older_hd=True).select("locus_id", "hd")


@query("a08_locus_stats_by_population", f"{POPS}, {CANONICAL} SELECT * FROM st")
def a08(spark, sf_dir):
    return statistics(spark, sf_dir, by_population=True)


def _summary_sql() -> str:
    means = ("missingness", "maf", "ho", "he", "f_inbreeding", "hd", "pi", "theta_watt", "tajima_d")
    each = ", ".join(f"round(avg({m}), 7) AS {m}_mean, round(var_samp({m}), 7) AS {m}_var, round(stddev_samp({m}), 7) AS {m}_sd" for m in means)
    return f"{POPS}, {CANONICAL} SELECT pop_id, count(*) AS n_loci, CAST(sum(seg_sites) AS BIGINT) AS seg_sites, CAST(sum(singletons) AS BIGINT) AS singletons, {each} FROM st GROUP BY pop_id"


@query("a09_dataset_summary", _summary_sql())
def a09(spark, sf_dir):
    return popgen.dataset_summary(statistics(spark, sf_dir, by_population=True), digits=7)


@query("w06_harmonic_sums", f"WITH {CELLS_SQL}, n AS (SELECT DISTINCT 2 * n AS big FROM (SELECT locus_id, count(g) AS n FROM cells GROUP BY locus_id)), h AS (SELECT i, sum(1.0::DOUBLE / i) OVER (ORDER BY i) AS a1, sum(1.0::DOUBLE / (i * i)) OVER (ORDER BY i) AS a2 FROM (SELECT unnest(range(1, 1 + (SELECT max(big) FROM n))) AS i)) SELECT big, round(a1, 9) AS a1, round(a2, 9) AS a2 FROM n JOIN h ON h.i = big - 1")
def w06(spark, sf_dir):
    big = cells_from_tables(spark, sf_dir).groupBy("locus_id").agg((2 * F.count("g")).alias("big")).select("big").distinct()
    return big.select("big", F.round(popgen.harmonic(F.col("big")), 9).alias("a1"), F.round(popgen.harmonic(F.col("big"), 2), 9).alias("a2"))


DEV_SQL = f"WITH {CELLS_SQL}, m AS (SELECT sample_id, locus_id, coalesce(g - avg(g) OVER (PARTITION BY locus_id), 0) AS d FROM cells), v AS (SELECT locus_id, sum(d * d) AS ss FROM m GROUP BY locus_id HAVING sum(d * d) > 1e-12), pr AS (SELECT a.locus_id AS l1, b.locus_id AS l2, sum(a.d * b.d) AS sxy FROM m a JOIN m b ON a.sample_id = b.sample_id AND a.locus_id < b.locus_id GROUP BY a.locus_id, b.locus_id), al AS (SELECT x.locus_id AS l1, y.locus_id AS l2, x.ss * y.ss AS ss FROM v x JOIN v y ON x.locus_id < y.locus_id)"


@query("a11_kelly_zns", f"{DEV_SQL} SELECT count(*) AS pairs, round(avg(coalesce(sxy, 0) * coalesce(sxy, 0) / ss), 8) AS zns FROM al LEFT JOIN pr ON pr.l1 = al.l1 AND pr.l2 = al.l2")
def a11(spark, sf_dir):
    return popgen.kelly_zns(cells_from_tables(spark, sf_dir))


@query("a12_correlations", f"{DEV_SQL} SELECT al.l1, al.l2, round(coalesce(sxy, 0) / sqrt(ss), 8) + 0.0 AS r FROM al LEFT JOIN pr ON pr.l1 = al.l1 AND pr.l2 = al.l2")
def a12(spark, sf_dir):
    return popgen.correlations(cells_from_tables(spark, sf_dir))


@query("j09_locus_pairs", f"WITH {CELLS_SQL} SELECT a.locus_id AS l1, b.locus_id AS l2, count(*) AS n, CAST(sum(a.g * b.g) AS BIGINT) AS sxy FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.locus_id < b.locus_id WHERE a.g IS NOT NULL AND b.g IS NOT NULL GROUP BY a.locus_id, b.locus_id")
def j09(spark, sf_dir):
    return popgen.locus_pairs(cells_from_tables(spark, sf_dir))


@query("t07_nearest_features", f"{DEV_SQL}, r AS (SELECT al.l1, al.l2, round(abs(coalesce(sxy, 0)) / sqrt(ss), 8) AS r FROM al LEFT JOIN pr ON pr.l1 = al.l1 AND pr.l2 = al.l2), b AS (SELECT l1 AS locus_id, l2 AS neighbour, r FROM r UNION ALL SELECT l2, l1, r FROM r) SELECT locus_id, neighbour, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY r DESC, neighbour) AS rank FROM b) WHERE rank <= 5")
def t07(spark, sf_dir):
    return popgen.nearest_loci(popgen.correlations(cells_from_tables(spark, sf_dir)), 5)
