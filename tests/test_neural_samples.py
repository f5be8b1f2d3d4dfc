"""Neural imputers are fitted on all samples, in lanes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoframe.operators import learned


@pytest.mark.parametrize("kind", ["autoencoder", "vae", "nlpca", "ubp"])
def test_no_sample_is_left_out_of_the_fit(spark, kind):
    """Class 2 is had by the 2,000 samples of the highest hashes alone, which a fit on the 20,000 of the lowest never saw."""
    ranked = spark.range(22_000).select(F.col("id").alias("sample_id")).orderBy(F.xxhash64("sample_id")).limit(20_000).withColumn("low", F.lit(True))
    samples = spark.range(22_000).withColumnRenamed("id", "sample_id").join(ranked, "sample_id", "left").withColumn("own", F.when(F.col("low"), F.col("sample_id") % 2).otherwise(F.lit(2)))
    missing = (F.xxhash64("sample_id", "locus_id") % 10 == 0) & (F.col("locus_id") > 2)
    cells = samples.crossJoin(spark.range(8).withColumnRenamed("id", "locus_id")).select("sample_id", "locus_id", F.lit(0).alias("pop_id"), F.when(~missing, F.col("own")).cast("int").alias("g"), "own")
    filled = learned.fill_neural(cells, learned.NeuralConfig(kind, epochs=12)).where("g IS NULL AND own = 2")
    asked, right = filled.agg(F.count("*"), F.sum((F.col("imputed") == 2).cast("int"))).collect()[0]
    assert asked > 500 and right / asked > 0.9


def test_a_training_is_what_it_was_after_an_exchange():
    training = learned.Training(learned.NeuralConfig("vae"), 50, 4, np.ones(3))
    g = np.random.default_rng(0).integers(-1, 3, (50, 4)).astype(np.int8)
    training.epoch(0, g, g, None, np.random.default_rng(1))
    other = learned.Training(learned.NeuralConfig("vae", seed=3), 50, 4, np.ones(3))
    other.take(training.flat())
    other.adam.step = training.adam.step
    losses = [t.epoch(1, g, g, None, np.random.default_rng(2)) for t in (training, other)]
    assert losses[0] == losses[1] and np.array_equal(training.flat(), other.flat())


def test_no_calls_at_all(spark):
    cells = spark.createDataFrame([(None, 1, 0, 1)], "sample_id long, locus_id long, pop_id int, g int")
    assert learned.fill_neural(cells, learned.NeuralConfig()).count() == 0
