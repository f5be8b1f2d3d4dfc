"""Extension, not in the reference: locus counts that grow as sample files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.model import CELLS
from genoframe.operators.popgen import locus_statistics


def stream_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming aggregate of mergeable genotype counts by locus, from Parquet files of cells. State is one row for each locus."""
    cells = spark.readStream.schema(CELLS).parquet(folder)
    g = F.col("g")
    return cells.groupBy("locus_id").agg(F.count(F.lit(1)).alias("n_tot"), F.count_if(g.isin(0, 1, 2)).alias("n"), *[F.count_if(g == k).alias(f"c{k}") for k in (0, 1, 2)])


def statistics_of(counts: DataFrame) -> DataFrame:
    """Locus statistics of the counts so far, as a batch over the sink's table."""
    return locus_statistics(counts.withColumn("pop_id", F.lit(None).cast("int")))
