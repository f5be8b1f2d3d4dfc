"""The data model: long genotype cells, dimension tables, code tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.session import read_table

CELLS = "sample_id BIGINT, locus_id BIGINT, pop_id INT, g INT"
SAMPLES = "sample_id BIGINT, sample_name STRING, pop_id STRING"
LOCI = "locus_id BIGINT, locus_name STRING, ref STRING, alt ARRAY<STRING>"

# The unambiguous and two-base IUPAC codes, in code order 0 to 9, and their bases.
IUPAC = "ACGTWRMKYS"
IUPAC_BASES = {"A": "A", "C": "C", "G": "G", "T": "T", "W": "AT", "R": "AG", "M": "AC", "K": "GT", "Y": "CT", "S": "CG"}
# Codes of three and four bases, read but never written.
WIDE_BASES = {"B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
BASES = "ACGT"


def literal_map(values: dict) -> Column:
    """A map literal; looked up with ``element_at``."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def code_of(bases: Column) -> Column:
    """IUPAC code of a sorted string of one or two bases; null for anything else."""
    return F.try_element_at(literal_map({b: c for c, b in IUPAC_BASES.items()}), bases)


def bases_of(code: Column) -> Column:
    """Sorted bases that a code stands for, as a string; null for what is no code."""
    return F.try_element_at(literal_map(IUPAC_BASES), code)


def iupac_dimension(spark: SparkSession) -> DataFrame:
    """``code``, ``base``, ``weight``: each code's bases, a lone base counted twice. 16 rows."""
    return spark.createDataFrame([(c, b, 2 if len(bs) == 1 else 1) for c, bs in IUPAC_BASES.items() for b in bs], "code string, base string, weight int")


def cells_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype cells derived from the driver's order lines: suppliers are samples, parts fold to 200 loci, regions are populations."""
    lines = read_table(spark, sf_dir, "lineitem")
    summed = lines.groupBy(F.col("l_suppkey").alias("sample_id"), (F.col("l_partkey") % 200).alias("locus_id")).agg(F.sum(F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber") * 5).alias("s"))
    v = F.col("s") % 7
    g = F.when(v < 3, 0).when(v < 5, 1).when(v < 6, 2)
    return summed.join(samples_from_tables(spark, sf_dir), "sample_id").select("sample_id", "locus_id", "pop_id", g.alias("g"))


def samples_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id``, ``sample_name``, ``pop_id`` of the derived samples."""
    suppliers = read_table(spark, sf_dir, "supplier")
    nations = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("pop_id"))
    return suppliers.join(nations, suppliers["s_nationkey"] == nations["n_nationkey"]).select(F.col("s_suppkey").alias("sample_id"), F.col("s_name").alias("sample_name"), "pop_id")


def loci_of(cells: DataFrame) -> DataFrame:
    """Loci of the derived cells: ``locus_id``, ``locus_name``, ``ref`` and ``alt`` (another base than ``ref``)."""
    base = lambda at: F.substring(F.lit(BASES), at.cast("int") + 1, 1)
    at = F.col("locus_id")
    offset = 1 + F.floor(at / F.lit(4.0)) % 3
    return cells.select("locus_id").distinct().select("locus_id", F.concat(F.lit("Locus_"), (at + 1).cast("string")).alias("locus_name"), base(at % 4).alias("ref"), base((at + offset) % 4).alias("alt"))


CELLS_SQL = """
cells AS (
  SELECT c.sample_id, c.locus_id, n_regionkey AS pop_id,
         CASE WHEN v < 3 THEN 0 WHEN v < 5 THEN 1 WHEN v < 6 THEN 2 END AS g
  FROM (SELECT l_suppkey AS sample_id, l_partkey % 200 AS locus_id,
               CAST(sum(l_orderkey * 7 + l_partkey * 3 + l_linenumber * 5) AS BIGINT) % 7 AS v
        FROM lineitem GROUP BY l_suppkey, l_partkey % 200) c
  JOIN supplier ON s_suppkey = sample_id JOIN nation ON n_nationkey = s_nationkey)"""

LOCI_SQL = """
loci AS (
  SELECT locus_id, 'Locus_' || CAST(locus_id + 1 AS VARCHAR) AS locus_name,
         substr('ACGT', CAST(locus_id % 4 AS INT) + 1, 1) AS ref,
         substr('ACGT', CAST((locus_id + 1 + CAST(floor(locus_id / 4.0) AS INT) % 3) % 4 AS INT) + 1, 1) AS alt
  FROM (SELECT DISTINCT locus_id FROM cells))"""
