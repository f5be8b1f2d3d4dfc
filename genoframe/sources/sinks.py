"""Writers: alignments in the input format, FASTA, 012 tables, reports, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequences(cells: DataFrame, call: str = "iupac") -> DataFrame:
    """``sample_name``, ``sequence`` in locus order; a sample's calls meet in one row, as a line of the file is."""
    gathered = cells.groupBy("sample_name").agg(F.array_sort(F.collect_list(F.struct("locus_id", F.coalesce(call, F.lit("N")).alias("c")))).alias("l"))
    return gathered.select("sample_name", F.concat_ws("", F.transform("l", lambda x: x["c"])).alias("sequence"))


def phylip_lines(seqs: DataFrame) -> DataFrame:
    """Header and a line for each sample, as ``value`` in order of ``line``; unequal lengths fail."""
    shape = seqs.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("sequence")).alias("l"), F.min(F.length("sequence")).alias("least"))
    header = shape.select(F.lit("").alias("line"), F.when(F.col("l") == F.col("least"), F.concat_ws(" ", F.col("n").cast("string"), F.col("l").cast("string"))).otherwise(F.raise_error(F.lit("sequences of unequal length")).cast("string")).alias("value"))
    return header.unionByName(seqs.select(F.col("sample_name").alias("line"), F.concat_ws("\t", "sample_name", "sequence").alias("value")))


def fasta_lines(seqs: DataFrame) -> DataFrame:
    """S17."""
    return seqs.select(F.col("sample_name").alias("line"), F.concat(F.lit(">"), "sample_name", F.lit("\n"), "sequence").alias("value"))


def vcf_lines(cells: DataFrame) -> DataFrame:
    """VCF body and header from ``sample_name``, ``locus_id``, ``ref``, ``alt``, ``g``; lines grouped by locus."""
    gt = F.when(F.col("g") == 0, "0/0").when(F.col("g") == 1, "0/1").when(F.col("g") == 2, "1/1").otherwise("./.")
    lines = cells.groupBy("locus_id", "ref", "alt").agg(F.array_sort(F.collect_list(F.struct("sample_name", gt.alias("gt")))).alias("l"))
    body = lines.select(F.format_string("1%019d", "locus_id").alias("line"), F.concat_ws("\t", F.lit("1"), (F.col("locus_id") + 1).cast("string"), F.concat(F.lit("Locus_"), (F.col("locus_id") + 1).cast("string")), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.concat_ws("\t", F.transform("l", lambda x: x["gt"]))).alias("value"))
    names = cells.select("sample_name").distinct().agg(F.array_sort(F.collect_list("sample_name")).alias("s"))
    header = names.select(F.lit("0").alias("line"), F.concat_ws("\t", F.lit("##fileformat=VCFv4.2\n#CHROM"), *[F.lit(c) for c in ("POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")], F.concat_ws("\t", "s")).alias("value"))
    return header.unionByName(body)


def genepop_lines(cells: DataFrame) -> DataFrame:
    """GENEPOP from ``sample_name``, ``pop_id``, ``locus_id``, ``allele_1``, ``allele_2`` (ints; null is 00)."""
    names = cells.select("locus_id").distinct().agg(F.array_sort(F.collect_list("locus_id")).alias("l"))
    title = names.select(F.lit("0").alias("line"), F.concat(F.lit("genotypes\n"), F.array_join(F.transform("l", lambda i: F.concat(F.lit("Locus_"), (i + 1).cast("string"))), "\n")).alias("value"))
    two = lambda x: F.lpad(F.coalesce(F.col(x), F.lit(0)).cast("string"), 2, "0")
    body = cells.groupBy("pop_id", "sample_name").agg(F.array_sort(F.collect_list(F.struct("locus_id", F.concat(two("allele_1"), two("allele_2")).alias("c")))).alias("l"))
    lines = body.select(F.concat(F.lit("1"), "pop_id", F.lit("\x01"), "sample_name").alias("line"), F.concat("sample_name", F.lit(" ,  "), F.array_join(F.transform("l", lambda x: x["c"]), " ")).alias("value"))
    marks = cells.select("pop_id").distinct().select(F.concat(F.lit("1"), "pop_id").alias("line"), F.lit("POP").alias("value"))
    return title.unionByName(marks).unionByName(lines)


def write_lines(lines: DataFrame, path: str, files: int = 1) -> None:
    """Text in the order of ``line``; more files than one are parts in that order."""
    if files == 1:
        ordered = lines.coalesce(1).sortWithinPartitions("line")
    else:
        ordered = lines.repartitionByRange(files, "line").sortWithinPartitions("line")
    ordered.select("value").write.mode("overwrite").text(path)


def write_012(cells: DataFrame, path: str, missing: str = "-9") -> None:
    """Comma-joined calls, a line for each sample, no header."""
    rows = cells.groupBy("sample_name").agg(F.array_sort(F.collect_list(F.struct("locus_id", F.coalesce(F.col("g").cast("string"), F.lit(missing)).alias("c")))).alias("l"))
    write_lines(rows.select(F.col("sample_name").alias("line"), F.array_join(F.transform("l", lambda x: x["c"]), ",").alias("value")), path)


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """Reports and per-locus tables as JSON lines or CSV with a header."""
    writer = report.coalesce(1).write.mode("overwrite")
    writer.json(path) if fmt == "json" else writer.csv(path, header=True)


def write_single_file(table: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header at this very path, in any store that Spark writes."""
    spark = table.sparkSession
    parts = f"{path}.parts"
    write_report(table, parts, "csv")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder, target = hadoop.Path(parts), hadoop.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(target, True)
    for file in store.globStatus(hadoop.Path(f"{parts}/part-*")):
        store.rename(file.getPath(), target)
    store.delete(folder, True)


def write_mask(masked: DataFrame, path: str) -> None:
    """S15."""
    masked.select("sample_id", "locus_id", F.col("g").isNull().alias("original"), "simulated").write.mode("overwrite").parquet(path)


def read_mask(spark, path: str) -> DataFrame:
    return spark.read.schema("sample_id BIGINT, locus_id BIGINT, original BOOLEAN, simulated BOOLEAN").parquet(path)


def vcf_to_phylip(cells: DataFrame) -> DataFrame:
    """Lines of a PHYLIP file from VCF cells; no bound on the number of loci."""
    from genoframe.operators.encode import decode_012

    return phylip_lines(sequences(cells.withColumn("iupac", decode_012(F.col("g"), F.col("ref"), F.element_at(F.split("alt", ","), 1)))))
