"""Population maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_popmap(spark: SparkSession, path: str) -> DataFrame:
    """``sample_name``, ``population`` from two columns parted by white space; empty lines are skipped, a line of one column fails."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.element_at("p", 1) != "")
    second = F.when(F.size("p") >= 2, F.get("p", F.lit(1))).otherwise(F.raise_error(F.lit("popmap line of one column")).cast("string"))
    return parts.select(F.get("p", F.lit(0)).alias("sample_name"), second.alias("population"))


def single_pool_popmap(samples: DataFrame, name: str = "Pop1") -> DataFrame:
    """Every sample in one population."""
    return samples.select("sample_name", F.lit(name).alias("population"))


def restrict(samples: DataFrame, popmap: DataFrame, include: list[str] | None = None, force: bool = False) -> DataFrame:
    """Samples with their population; ``include`` keeps the named ones, ``force`` drops samples that the map lacks, which otherwise fail."""
    joined = samples.join(popmap, "sample_name", "inner" if force else "left")
    if not force and not joined.where("population IS NULL").isEmpty():
        raise ValueError("samples are missing from the population map")
    return joined.where(F.col("population").isin(include)) if include else joined
