"""Queries that SQL cannot express: iterative imputers, clade masks, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe import imputers
from genoframe.functions.special import power_transform, with_p_value, yeo_johnson_by_metric
from genoframe.model import cells_from_tables, loci_of, samples_from_tables
from genoframe.operators import clusters, compare, learned, phylo
from genoframe.plans.comparisons import LONG_SQL, long_metrics
from genoframe.plans.registry import query
from genoframe.sources.tree import Tree

#: Of a skewed stationary law: the four bases are not alike.
RATES = np.array([[-1.0, 0.2, 0.6, 0.2], [0.1, -0.8, 0.1, 0.6], [0.3, 0.1, -0.6, 0.2], [0.4, 0.8, 0.4, -1.6]])


def sample_tree(spark: SparkSession, sf_dir: str) -> Tree:
    """A tree of the samples: the root, a node for each population, tips. Names are a table of samples, read to the driver as a tree file is."""
    rows = sorted((r["pop_id"], r["sample_name"]) for r in samples_from_tables(spark, sf_dir).collect())
    parent, name, length = [-1], [""], [0.0]
    at = {}
    for pop, sample in rows:
        if pop not in at:
            at[pop] = len(parent)
            parent.append(0)
            name.append("")
            length.append(0.5)
        parent.append(at[pop])
        name.append(sample)
        length.append(0.1)
    return Tree(tuple(parent), tuple(name), tuple(length))


def named_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cells_from_tables(spark, sf_dir)
    return cells.join(samples_from_tables(spark, sf_dir).select("sample_id", "sample_name"), "sample_id").join(loci_of(cells).select("locus_id", "ref", "alt"), "locus_id")


@query("m04_mask_clades")
def m04(spark, sf_dir):
    return phylo.mask_clades(spark, named_cells(spark, sf_dir), sample_tree(spark, sf_dir), 0.2).select("sample_name", "locus_id", "simulated")


@query("m05_mask_clades_weighted")
def m05(spark, sf_dir):
    return phylo.mask_clades(spark, named_cells(spark, sf_dir), sample_tree(spark, sf_dir), 0.2, weighted=True).select("sample_name", "locus_id", "simulated")


@query("i05_impute_factors")
def i05(spark, sf_dir):
    return learned.fill_factors(cells_from_tables(spark, sf_dir)).select("sample_id", "locus_id", "imputed")


@query("i06_impute_phylogeny")
def i06(spark, sf_dir):
    return phylo.impute_phylogeny(named_cells(spark, sf_dir), sample_tree(spark, sf_dir), RATES)


@query("i07_impute_forest")
def i07(spark, sf_dir):
    return imputers.make("RandomForest", rounds=3).fit_transform(cells_from_tables(spark, sf_dir)).select("sample_id", "locus_id", "imputed")


@query("i08_impute_boosting")
def i08(spark, sf_dir):
    return imputers.make("GradientBoosting").fit_transform(cells_from_tables(spark, sf_dir)).select("sample_id", "locus_id", "imputed")


def _neural(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return learned.fill_neural(cells_from_tables(spark, sf_dir), learned.NeuralConfig(kind, epochs=30)).select("sample_id", "locus_id", "imputed")

    return run


for _id, _kind in (("i09", "autoencoder"), ("i10", "vae"), ("i11", "nlpca"), ("i12", "ubp")):
    query(f"{_id}_impute_{_kind}")(_neural(_kind))


@query("v08_infer_populations")
def v08(spark, sf_dir):
    return clusters.infer_populations(cells_from_tables(spark, sf_dir))


@query("a27_welch_p")
def a27_p(spark, sf_dir):
    return compare.adjust_bh(with_p_value(compare.welch(long_metrics(spark, sf_dir))).select("metric", "p"))


@query("a28_yeo_johnson")
def a28(spark, sf_dir):
    return yeo_johnson_by_metric(long_metrics(spark, sf_dir)).select("dataset", "metric", F.round("value", 9).alias("value"), F.round("lambda", 6).alias("lambda"))


@query("a28_power_transform", f"{LONG_SQL}, y AS (SELECT dataset, metric, CAST(value AS DOUBLE) AS x, (length(metric) % 4) * 0.7::DOUBLE - 0.55::DOUBLE AS lam FROM lg WHERE value IS NOT NULL) SELECT dataset, metric, round(lam, 6) AS lambda, round(CASE WHEN x >= 0 THEN CASE WHEN lam = 0 THEN ln(1 + x) ELSE (pow(1 + x, lam) - 1) / lam END ELSE CASE WHEN lam = 2 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END END, 7) AS value FROM y")
def a28_given(spark, sf_dir):
    lam = F.length("metric") % 4 * F.lit(0.7) - F.lit(0.55)
    return long_metrics(spark, sf_dir).where("value IS NOT NULL").select("dataset", "metric", F.round(lam, 6).alias("lambda"), F.round(power_transform(F.col("value").cast("double"), lam), 7).alias("value"))
