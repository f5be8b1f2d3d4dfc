import tracemalloc

from pyspark.sql import functions as F

from genoframe.operators import learned


def test_the_sample_reaches_the_driver_as_bytes(spark):
    """160,000 calls of the sample: as rows they are over 50 MB of the driver."""
    cells = spark.range(160_000).select((F.col("id") % 4000).alias("sample_id"), F.expr("id div 4000").alias("locus_id"), F.lit(0).alias("pop_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).cast("int").alias("g"))
    tracemalloc.start()
    filled = learned.fill_neural(cells, learned.NeuralConfig("autoencoder", epochs=1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    assert filled.count() == 160_000 and filled.where("imputed IS NULL OR imputed != g").count() == 0
