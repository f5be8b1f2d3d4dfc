"""Join-shaped, set-shaped and window-shaped steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def left_with_indicator(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """A left join that says where each row was found, in ``indicator``."""
    marked = right.withColumn("__there", F.lit(True))
    return left.join(marked, list(on), "left").withColumn("indicator", F.when(F.col("__there"), "both").otherwise("left_only")).drop("__there")


def unmatched(data: DataFrame, popmap: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the ``side``."""
    only_data = data.join(popmap, key, "left_anti").select(F.lit("data").alias("side"), key)
    return only_data.unionByName(popmap.join(data, key, "left_anti").select(F.lit("popmap").alias("side"), key))


def shared_or_fail(samples: DataFrame, tips: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; none at all fails."""
    shared = samples.select(key).distinct().join(tips, key, "left_semi")
    if shared.isEmpty():
        raise ValueError("tree and samples share no names")
    return shared


def align_sequences(samples: DataFrame, sequences: DataFrame, lengths: DataFrame, missing: str = "N") -> DataFrame:
    """Every sample in every alignment; a missing sequence is ``missing`` repeated to the alignment's length.

    ``lengths`` has a row for each alignment: a list of files, small by its nature.
    """
    grid = samples.crossJoin(F.broadcast(lengths))
    joined = grid.join(sequences, ["sample_name", "alignment"], "left")
    return joined.select("sample_name", "alignment", F.coalesce("sequence", F.repeat(F.lit(missing), F.col("length"))).alias("sequence"))


#: Ranges that a running total over a whole table is cut into.
RANGES = 200


def _ranges(df: DataFrame, order: str) -> list[float]:
    """Approximate quantiles of a numeric column, repeated where a value is frequent."""
    return df.where(F.col(order).isNotNull()).approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 1 / (2 * RANGES))


def _place(at: Column, cuts: Sequence[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= at)) if cuts else F.lit(0)


def _as_number(df: DataFrame, column: str) -> Column:
    """A number that never falls where the column rises: of a string, its first six bytes."""
    if isinstance(df.schema[column].dataType, StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(column).cast("double")


def running_total(df: DataFrame, order: str, value: Column, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """``name``: the sum of ``value`` over a whole table up to and with each row, by a numeric column, then ``ties``; no task sorts the whole table.

    The column's approximate quantiles cut it into ranges; a range's rows are summed in
    its own window, after the totals of the ranges before. However rough the quantiles,
    sums are exact. Nulls come last. A value that fills several ranges, and the nulls,
    are cut again by the first of the ``ties``, a number or a string.
    """
    found = _ranges(df, order)
    cuts = sorted(set(found))
    at = F.col(order).cast("double")
    place = F.when(at.isNull(), len(cuts) + 1).otherwise(_place(at, cuts))
    part: Column = F.lit(RANGES + 1)
    if ties:
        df = df.withColumn("__tie", _as_number(df, ties[0]))
        frequent = sorted(v for v in cuts if found.count(v) > 1)
        tied = at.isNull() | at.isin(frequent) if frequent else at.isNull()
        # Rows of a frequent value are the first of their range; the others there follow, in one part.
        part = F.when(tied, _place(F.col("__tie"), sorted(set(_ranges(df, "__tie"))))).otherwise(part)
    ranged = df.withColumn("__range", place * (RANGES + 2) + part).withColumn("__value", value)
    before = F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # over the ranges, a fixed number at most
    totals = ranged.groupBy("__range").agg(F.sum("__value").alias("__sum")).select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum("__value").over(Window.partitionBy("__range").orderBy(F.asc_nulls_last(order), *ties).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__inside", inside).join(F.broadcast(totals), "__range").withColumn(name, F.col("__inside") + F.col("__before")).drop("__tie", "__range", "__value", "__inside", "__before")


def running_extreme(df: DataFrame, order: str, value: Column, name: str, *, least: bool = False, backwards: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """``name``: the greatest (``least``: the least) non-null ``value`` up to and with each row by a numeric column, equal ones included; ``backwards``: from each row on.

    By ranges, as ``running_total``. ``keys`` are few: a short list of classes, each
    with a run of its own. Rows whose order is null are left out.
    """
    known = df.where(F.col(order).isNotNull())
    place = _place(F.col(order).cast("double"), sorted(set(_ranges(known, order))))
    pick, join = (F.min, F.least) if least else (F.max, F.greatest)
    ranged = known.withColumn("__range", -place if backwards else place).withColumn("__value", value)
    along = F.desc(order) if backwards else F.asc(order)
    inside = pick("__value").over(Window.partitionBy(*keys, "__range").orderBy(along).rangeBetween(Window.unboundedPreceding, 0))
    before = pick("__best").over(Window.partitionBy(*keys, F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # over the ranges of a key
    totals = ranged.groupBy(*keys, "__range").agg(pick("__value").alias("__best")).select(*keys, "__range", before.alias("__before"))
    return ranged.withColumn("__inside", inside).join(F.broadcast(totals), [*keys, "__range"]).withColumn(name, join("__inside", "__before")).drop("__range", "__value", "__inside", "__before")


def average_rank(df: DataFrame, column: str) -> DataFrame:
    """``rank`` with ties at their average, from a running total of the distinct values' counts."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    upto = running_total(counts, column, F.col("__n"), "__upto")
    ranks = upto.select(column, (F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)).alias("rank"))
    return df.join(ranks, column)


def offsets(df: DataFrame, order: str, length: str) -> DataFrame:
    """1-based ``first`` and ``last`` position of each part of a concatenation."""
    upto = running_total(df, order, F.col(length).cast("long"), "last")
    return upto.withColumn("first", F.col("last") - F.col(length) + 1)


def deduplicate_by_first(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each first non-null of the columns, in ``key``."""
    return df.withColumn("key", F.coalesce(*columns)).dropDuplicates(["key"])


def sample_variable_loci(cells: DataFrame, k: int, draw: Column) -> DataFrame:
    """K loci of the lowest draws among those with more than one call value."""
    varying = cells.where("g IS NOT NULL").groupBy("locus_id").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi")
    return varying.orderBy(draw, "locus_id").limit(k).select("locus_id")


def introgress(cells: DataFrame, target: Column, source: DataFrame, fraction: float, u: Column) -> DataFrame:
    """Calls of target samples take the source sample's call where the draw is below the fraction and the source has the locus."""
    donor = source.select(F.col("locus_id").alias("__l"), F.col("g").alias("__g"), F.lit(True).alias("__there"))
    joined = cells.withColumn("__u", u).join(donor, (F.col("locus_id") == F.col("__l")) & target, "left")
    return joined.withColumn("g", F.when(F.col("__there") & (F.col("__u") < fraction), F.col("__g")).otherwise(F.col("g"))).drop("__u", "__l", "__g", "__there")


def long_enough(df: DataFrame, least: int, column: str = "sequence") -> DataFrame:
    """Sequences of at least ``least`` characters."""
    return df.where(F.length(column) >= least)
