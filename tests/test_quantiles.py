import numpy as np

from genoframe.plans import catalog


def test_quantiles_come_from_counted_prices(spark, tmp_path):
    """Equal prices go to a group's task once; a group of nulls has a row. Every price went three times."""
    prices = [float(i % 40) ** 2 for i in range(1000)]
    spark.createDataFrame([("A", p) for p in prices] + [("N", None)], "l_returnflag string, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.QUERIES["f06_quantiles"](spark, str(tmp_path))
    rows = {r["l_returnflag"]: tuple(r)[1:] for r in found.collect()}
    assert np.allclose(rows["A"], np.quantile(prices, [0.05, 0.5, 0.95])) and rows["N"] == (None, None, None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile(") == 1 and plan.count("Aggregate") == 2
