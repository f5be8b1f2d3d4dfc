"""Genotype readers: VCF, PHYLIP, GENEPOP and STRUCTURE text to long cells, and format inference.

Every reader gives ``sample_name``, ``locus_id`` (from 0) and what the format says of
the call. Lines are split by Spark; where a format counts lines (sample order,
population separators), lines are numbered by file and place in one pass of counts,
so no file is read by one task. Gzip cannot be split and costs one task for each file.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoframe.model import bases_of, literal_map
from genoframe.operators.encode import normalise_symbol

# Suffixes of each format.
SUFFIXES = {"vcf": (".vcf", ".vcf.gz"), "phylip": (".phy", ".phylip"), "genepop": (".genepop", ".gen"), "structure": (".str", ".stru", ".structure")}
ALIASES = {"vcf": "vcf", "vcf.gz": "vcf", "phy": "phylip", "phylip": "phylip", "gen": "genepop", "genepop": "genepop", "str": "structure", "stru": "structure", "structure": "structure"}


def infer_format(path: str) -> str:
    """The format by suffix; unknown suffixes fail."""
    low = path.lower()
    for name, suffixes in SUFFIXES.items():
        if low.endswith(suffixes):
            return name
    raise ValueError(f"no genotype format has the suffix of {path}")


def normalise_format(name: str) -> str:
    """The canonical name of a format alias."""
    key = name.lower().lstrip(".")
    if key not in ALIASES:
        raise ValueError(f"no such format: {name}")
    return ALIASES[key]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` (from 0) and ``value``. Ids grow with file and place; partition counts make them gapless without one big window."""
    raw = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    parts = raw.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # A row for each input split.
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = raw.withColumn("part", F.shiftright("id", 33)).join(F.broadcast(before.select("part", "before")), "part")
    return joined.select((F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("line"), "value")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """``sample_name``, ``locus_id``, ``locus_name``, ``ref``, ``alt`` (comma-joined), ``allele_1``, ``allele_2``, ``g``.

    ``g`` is the number of alleles that are not the reference, null if any is missing.
    Loci are numbered in file order; a haploid call has no second allele and counts as twice its one.
    """
    lines = numbered_lines(spark, path).where(~F.startswith("value", F.lit("##")) & (F.trim("value") != ""))
    header = lines.where(F.startswith("value", F.lit("#"))).select(F.slice(F.split("value", "\t"), 10, 1_000_000).alias("names"))
    body = lines.where(~F.startswith("value", F.lit("#"))).withColumn("f", F.split("value", "\t"))
    first = body.agg(F.min("line").alias("first"))
    fields = body.crossJoin(F.broadcast(header)).crossJoin(F.broadcast(first))
    at = F.array_position(F.split(F.get("f", F.lit(8)), ":"), "GT").cast("int") - 1
    sited = fields.select((F.col("line") - F.col("first")).alias("locus_id"), F.concat_ws(":", F.get("f", F.lit(0)), F.get("f", F.lit(1))).alias("locus_name"), F.get("f", F.lit(3)).alias("ref"), F.get("f", F.lit(4)).alias("alt"), at.alias("at"), F.posexplode(F.arrays_zip(F.col("names"), F.slice("f", 10, 1_000_000).alias("calls"))).alias("i", "z"))
    alleles = sited.withColumn("a", F.split(F.get(F.split("z.calls", ":"), F.col("at")), r"[/|]"))
    number = lambda x: F.when(x.rlike(r"^\d+$"), x).cast("int")
    one, two = number(F.get("a", F.lit(0))), number(F.get("a", F.lit(1)))
    call = F.when(F.size("a") == 1, (one > 0).cast("int") * 2).otherwise((one > 0).cast("int") + (two > 0).cast("int"))
    return alleles.select(F.col("z.names").alias("sample_name"), "locus_id", "locus_name", "ref", "alt", one.alias("allele_1"), two.alias("allele_2"), call.alias("g"))


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """``sample_name``, ``locus_id``, ``iupac``; gaps and question marks are N. A sequence of another length than the header's fails."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    length = lines.where("line = 0").select(F.element_at(F.split(F.trim("value"), r"\s+"), 2).cast("int").alias("length"))
    named = lines.where("line > 0").select(F.regexp_extract("value", r"^\s*(\S+)\s+(.*)$", 1).alias("sample_name"), F.regexp_replace(F.regexp_extract("value", r"^\s*(\S+)\s+(.*)$", 2), r"\s", "").alias("s"))
    checked = named.crossJoin(F.broadcast(length)).withColumn("s", F.when(F.length("s") == F.col("length"), F.col("s")).otherwise(F.raise_error(F.lit("sequence length differs from the header")).cast("string")))
    return checked.select("sample_name", F.posexplode(F.split("s", "")).alias("locus_id", "c")).select("sample_name", F.col("locus_id").cast("long").alias("locus_id"), normalise_symbol(F.col("c")).alias("iupac"))


def read_genepop(spark: SparkSession, path: str) -> DataFrame:
    """``sample_name``, ``pop_id`` (Pop1, ...), ``locus_id``, ``locus_name``, ``allele_1``, ``allele_2`` (null for 0).

    The title line is dropped; locus names stand one to a line or comma-parted before the first POP.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("pop", F.upper(F.trim("value")) == "POP")
    # Separators are as few as populations.
    marks = lines.where("pop").select(F.col("line").alias("at"))
    first = marks.agg(F.min("at").alias("first"))
    names = lines.crossJoin(F.broadcast(first)).where("line > 0 AND line < first").groupBy().agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("l"))
    names = names.select(F.flatten(F.transform("l", lambda x: F.transform(F.split(x["value"], ","), lambda n: F.trim(n)))).alias("names"))
    data = lines.where(~F.col("pop")).join(F.broadcast(marks), F.col("at") < F.col("line")).groupBy("line", "value").agg(F.count(F.lit(1)).alias("k"))
    parted = data.select(F.concat(F.lit("Pop"), F.col("k").cast("string")).alias("pop_id"), F.trim(F.substring_index("value", ",", 1)).alias("sample_name"), F.posexplode(F.split(F.trim(F.regexp_replace("value", r"^[^,]*,", "")), r"\s+")).alias("i", "c"))
    half = F.floor(F.length("c") / F.lit(2.0)).cast("int")
    code = lambda x: F.nullif(x.cast("int"), F.lit(0))
    return parted.crossJoin(F.broadcast(names)).select("sample_name", "pop_id", F.col("i").cast("long").alias("locus_id"), F.get("names", F.col("i")).alias("locus_name"), code(F.substring(F.col("c"), F.lit(1), half)).alias("allele_1"), code(F.substring(F.col("c"), half + 1, half)).alias("allele_2"))


def read_structure(spark: SparkSession, path: str, *, rows: int = 1, has_popids: bool = False, has_marker_names: bool = False, first_allele: int | None = None, codes: Mapping[str, str] | None = None) -> DataFrame:
    """``sample_name``, ``pop_id``, ``locus_id``, ``allele_1``, ``allele_2`` (strings; null for -9 or what ``codes`` maps to N).

    ``rows`` lines stand for a sample: with one, adjacent columns pair up; with two,
    equal columns do. ``first_allele`` is the place of the first allele column, from 0.
    """
    start = first_allele if first_allele is not None else 1 + has_popids
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    if has_marker_names:
        lines = lines.where("line > 0")
    offset = 1 if has_marker_names else 0
    parted = lines.withColumn("f", F.split(F.trim("value"), r"\s+"))
    pop = F.get("f", F.lit(1)) if has_popids else F.lit(None).cast("string")
    rest = F.slice("f", start + 1, 1_000_000)
    cells = parted.select(F.floor((F.col("line") - offset) / F.lit(float(rows))).alias("s"), ((F.col("line") - offset) % rows).alias("r"), F.get("f", F.lit(0)).alias("sample_name"), pop.alias("pop_id"), F.posexplode(rest).alias("i", "a"))
    allele = F.coalesce(F.try_element_at(literal_map(dict(codes)), F.col("a")), F.col("a")) if codes else F.col("a")
    cells = cells.withColumn("a", F.when(~allele.isin("-9", "N"), allele))
    if rows == 1:
        cells = cells.withColumn("r", (F.col("i") % 2).cast("long")).withColumn("i", F.floor(F.col("i") / F.lit(2.0)).cast("int"))
    return cells.groupBy("s", "sample_name", "pop_id", F.col("i").cast("long").alias("locus_id")).agg(F.max(F.when(F.col("r") == 0, F.col("a"))).alias("allele_1"), F.max(F.when(F.col("r") == 1, F.col("a"))).alias("allele_2")).drop("s")


def read_nexus(spark: SparkSession, path: str) -> DataFrame:
    """``sample_name``, ``sequence`` of the MATRIX block, quotes dropped."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    low = F.upper(F.trim("value"))
    begin = lines.where(F.startswith(low, F.lit("MATRIX"))).agg(F.min("line").alias("begin"))
    ends = lines.crossJoin(F.broadcast(begin)).where((F.col("line") > F.col("begin")) & (F.startswith(low, F.lit(";")) | F.startswith(low, F.lit("END;")))).agg(F.min("line").alias("end"))
    inside = lines.crossJoin(F.broadcast(begin)).crossJoin(F.broadcast(ends)).where("line > begin AND (end IS NULL OR line < end)")
    clean = F.trim(F.translate("value", "'\"", ""))
    return inside.select(F.regexp_extract(clean, r"^(\S+)\s+(.*)$", 1).alias("sample_name"), F.regexp_replace(F.regexp_extract(clean, r"^(\S+)\s+(.*)$", 2), r"[\s;]", "").alias("sequence"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``sample_name``, ``sequence`` of records of any number of lines."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    return records.select(F.regexp_extract("value", r"^(\S+)", 1).alias("sample_name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"))


def read_genotypes(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Cells of any format, dispatched by name or suffix."""
    readers = {"vcf": read_vcf, "phylip": read_phylip, "genepop": read_genepop, "structure": read_structure}
    return readers[normalise_format(fmt) if fmt else infer_format(path)](spark, path, **options)


def calls_from_iupac(cells: DataFrame, ref: Column) -> DataFrame:
    """012 calls of PHYLIP cells against a reference base column."""
    bases = bases_of(F.col("iupac"))
    return cells.withColumn("g", F.when(bases == ref, 0).when(F.length(bases) == 2, 1).when(F.length(bases) == 1, 2))


def read_locus_stats(spark: SparkSession, root: str) -> DataFrame:
    """All ``Total_LocusStats.csv`` under a root, with ``dataset``, the folder relative to it."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "Total_LocusStats.csv").csv(root, header=True, inferSchema=True)
    # The name is a URI: what is no plain character there is escaped, but for the plus sign.
    name = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_replace(F.regexp_replace(name, r"/[^/]*$", ""), "^.*" + root.rstrip("/").rsplit("/", 1)[-1] + "/?", "")
    return read.withColumn("dataset", folder)


def file_census(spark: SparkSession, root: str) -> DataFrame:
    """``ext``, ``n``: files under a root by canonical extension; only metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    # Extensions that are one kind.
    alias = literal_map({"phy": "phylip", "str": "structure", "nex": "nexus"})
    return files.select(F.coalesce(F.try_element_at(alias, ext), ext).alias("ext")).groupBy("ext").agg(F.count(F.lit(1)).alias("n"))
