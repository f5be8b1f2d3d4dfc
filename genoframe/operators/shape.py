"""Between long cells and wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_wide(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A line for each ``row`` with ``values``, an array in order of ``column`` and of equal length everywhere: null where there is no cell.

    Columns' places come from their distinct values, which are as many as a line is
    long. Swapping ``row`` and ``column`` transposes. Of repeated cells the greatest stays.
    """
    names = cells.select(column).distinct().agg(F.array_sort(F.collect_list(column)).alias("__columns"))
    places = names.select(F.posexplode("__columns").alias("__place", column))
    kept = cells.groupBy(row, column).agg(F.max(value).alias("__v")).join(places, column)
    lines = kept.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("__place", "__v"))).alias("__e"))
    # A line is walked once: before each cell as many nulls as places were passed over, so the work is linear in its length.
    nothing = F.lit(None).cast(cells.schema[value].dataType)
    last = F.coalesce(F.try_element_at("__e", F.lit(-1))["__place"], F.lit(-1))
    walked = F.flatten(F.transform("__e", lambda e, i: F.concat(F.array_repeat(nothing, e["__place"] - F.coalesce(F.get("__e", i - 1)["__place"], F.lit(-1)) - 1), F.array(e["__v"]))))
    width = names.select(F.size("__columns").alias("__width"))
    return lines.crossJoin(F.broadcast(width)).select(row, F.concat(walked, F.array_repeat(nothing, F.col("__width") - last - 1)).alias("values"))


def to_long(wide: DataFrame, row: str, column: str, value: str, *, values: str = "values", labels: Sequence | None = None) -> DataFrame:
    """A cell for each place of ``values``; ``column`` is its label, or its place from 0."""
    long = wide.select(row, F.posexplode(values).alias("__at", value))
    label = F.get(F.array(*map(F.lit, labels)), F.col("__at")) if labels else F.col("__at").cast("long")
    return long.select(row, label.alias(column), value)


def transpose(wide: DataFrame, row: str, column: str, *, values: str = "values") -> DataFrame:
    """Lines of columns from columns of lines: ``column`` (its place from 0) and ``values`` in order of ``row``."""
    return to_wide(to_long(wide, row, column, "__value", values=values), column, row, "__value")


def missing_mask(wide: DataFrame, values: str = "values") -> DataFrame:
    """``missing``: which places of a line are null or not a number."""
    lacks = lambda x: x.isNull() | F.isnan(x.cast("double"))
    return wide.withColumn("missing", F.transform(values, lacks))


def at_least_2d(df: DataFrame, values: Column | str) -> DataFrame:
    """An array column as lines of arrays: an array of arrays stays, a plain one becomes its only line."""
    kind = df.select(values).schema[0].dataType.simpleString()
    column = F.col(values) if isinstance(values, str) else values
    return df.withColumn("lines", column if kind.startswith("array<array") else F.array(column))


def flat(df: DataFrame, values: str) -> DataFrame:
    """An array of arrays as one array, in order; a plain one stays."""
    return df.withColumn("flat", F.flatten(values) if df.schema[values].dataType.simpleString().startswith("array<array") else F.col(values))
