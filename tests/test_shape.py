import time

from pyspark.sql import functions as F

from genoframe.operators import shape


def test_wide_long_and_back(spark):
    cells = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), ("b", 1, None), ("b", 2, 7), ("b", 2, 8)], "r string, c int, v int")
    wide = shape.to_wide(cells, "r", "c", "v")
    assert {r["r"]: r["values"] for r in wide.collect()} == {"a": [5, None, 6], "b": [None, 8, None]}
    assert {r["c"]: r["values"] for r in shape.transpose(wide, "r", "c").collect()} == {0: [5, None], 1: [None, 8], 2: [6, None]}
    long = shape.to_long(wide, "r", "c", "v", labels=[1, 2, 3])
    assert {(r["r"], r["c"]): r["v"] for r in long.collect() if r["v"] is not None} == {("a", 1): 5, ("a", 3): 6, ("b", 2): 8}
    assert shape.to_wide(cells.where("false"), "r", "c", "v").count() == 0


def test_masks_and_shapes(spark):
    lines = spark.createDataFrame([([1.0, float("nan"), None],)], "values array<double>")
    assert shape.missing_mask(lines).collect()[0]["missing"] == [False, True, True]
    assert len(shape.at_least_2d(lines, "values").collect()[0]["lines"]) == 1
    nested = spark.createDataFrame([([[1], [2, 3]],)], "values array<array<int>>")
    assert shape.at_least_2d(nested, "values").collect()[0]["lines"] == [[1], [2, 3]] and shape.flat(nested, "values").collect()[0]["flat"] == [1, 2, 3]


def test_lines_are_walked_once(spark):
    """Gaps at the ends and between, and no look-up of each place in a whole line."""
    cells = spark.createDataFrame([("a", 3, 7), ("a", 5, None), ("b", 1, 1), ("b", 9, 2), ("b", 9, 4), ("c", 5, 0), (None, 2, 3)], "line string, place int, v int")
    wide = shape.to_wide(cells, "line", "place", "v")
    assert {r["line"]: r["values"] for r in wide.collect()} == {"a": [None, None, 7, None, None], "b": [1, None, None, None, 4], "c": [None, None, None, 0, None], None: [None, 3, None, None, None]}
    assert "map_from_entries" not in wide._jdf.queryExecution().toString()
    long = spark.range(60_000).select(F.col("id").alias("place"), (F.col("id") % 2).alias("line"), F.col("id").alias("v"))
    begun = time.time()
    assert shape.to_wide(long, "line", "place", "v").select(F.sum(F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))))).collect()[0][0] == 60_000 * 59_999 // 2
    assert time.time() - begun < 20
