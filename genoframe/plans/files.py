"""Readers and writers over files that a query writes first: what is read must be what the tables say."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.model import CELLS_SQL, LOCI_SQL, cells_from_tables, loci_of, samples_from_tables
from genoframe.operators import encode, shape
from genoframe.plans.registry import query
from genoframe.session import cut, read_table, shared_dir
from genoframe.sources import newick, popmap, readers, sinks

#: Every sample at every locus, missing where the tables have no cell.
GRID_SQL = f"WITH {CELLS_SQL}, {LOCI_SQL}, sm AS (SELECT DISTINCT sample_id FROM cells), grid AS (SELECT s_name AS sample_name, n_regionkey AS pop_id, l.locus_id, l.ref, l.alt, c.g FROM sm JOIN supplier ON s_suppkey = sm.sample_id JOIN nation ON n_nationkey = s_nationkey CROSS JOIN loci l LEFT JOIN cells c ON c.sample_id = sm.sample_id AND c.locus_id = l.locus_id)"
# The IUPAC code of two bases.
CODE_SQL = "CASE least(ref, alt) || greatest(ref, alt) WHEN 'AT' THEN 'W' WHEN 'AG' THEN 'R' WHEN 'AC' THEN 'M' WHEN 'GT' THEN 'K' WHEN 'CT' THEN 'Y' WHEN 'CG' THEN 'S' END"
IUPAC_SQL = f"CASE g WHEN 0 THEN ref WHEN 1 THEN {CODE_SQL} WHEN 2 THEN alt ELSE 'N' END"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of every sample at every locus, as files of these formats have them."""
    cells = cells_from_tables(spark, sf_dir)
    samples = cells.select("sample_id").distinct().join(samples_from_tables(spark, sf_dir), "sample_id")
    every = samples.crossJoin(loci_of(cells).select("locus_id", "ref", "alt"))  # what a file of both is: a call for each
    return every.join(cells.select("sample_id", "locus_id", "g"), ["sample_id", "locus_id"], "left")


def written(spark: SparkSession, lines: DataFrame, suffix: str) -> str:
    """A new file (a folder of parts) in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/file-{uuid.uuid4().hex}{suffix}"
    sinks.write_lines(lines, path)
    return path


@query("s02_read_vcf", f"{GRID_SQL} SELECT sample_name, locus_id, ref, alt, g FROM grid")
def s02(spark, sf_dir):
    return readers.read_genotypes(spark, written(spark, sinks.vcf_lines(grid(spark, sf_dir)), ".vcf")).select("sample_name", "locus_id", "ref", "alt", "g")


@query("s03_read_phylip", f"{GRID_SQL} SELECT sample_name, locus_id, {IUPAC_SQL} AS iupac FROM grid")
def s03(spark, sf_dir):
    coded = grid(spark, sf_dir).withColumn("iupac", encode.decode_012(F.col("g"), F.col("ref"), F.col("alt")))
    return readers.read_genotypes(spark, written(spark, sinks.phylip_lines(sinks.sequences(coded)), ".phy")).select("sample_name", "locus_id", "iupac")


PAIR_SQL = "CASE WHEN g IS NULL THEN NULL WHEN g = 2 THEN 3 ELSE 1 END AS allele_1, CASE WHEN g IS NULL THEN NULL WHEN g = 0 THEN 1 ELSE 3 END AS allele_2"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered alleles: 1 for the reference, 3 for the other."""
    g = F.col("g")
    return grid(spark, sf_dir).withColumn("allele_1", F.when(g == 2, 3).when(g.isNotNull(), 1)).withColumn("allele_2", F.when(g == 0, 1).when(g.isNotNull(), 3))


@query("s04_read_genepop", f"{GRID_SQL}, p AS (SELECT pop_id, 'Pop' || row_number() OVER (ORDER BY pop_id) AS pop FROM (SELECT DISTINCT pop_id FROM grid)) SELECT sample_name, p.pop AS pop_id, locus_id, 'Locus_' || (locus_id + 1) AS locus_name, {PAIR_SQL} FROM grid JOIN p USING (pop_id)")
def s04(spark, sf_dir):
    return readers.read_genotypes(spark, written(spark, sinks.genepop_lines(paired(spark, sf_dir)), ".gen"))


@query("s05_read_structure", f"{GRID_SQL} SELECT sample_name, CAST(pop_id AS VARCHAR) AS pop_id, locus_id, CAST(a1 AS VARCHAR) AS allele_1, CAST(a2 AS VARCHAR) AS allele_2 FROM (SELECT *, CASE WHEN g IS NULL THEN NULL WHEN g = 2 THEN 3 ELSE 1 END AS a1, CASE WHEN g IS NULL THEN NULL WHEN g = 0 THEN 1 ELSE 3 END AS a2 FROM grid)")
def s05(spark, sf_dir):
    text = F.concat_ws("\t", F.coalesce(F.col("allele_1").cast("string"), F.lit("-9")), F.coalesce(F.col("allele_2").cast("string"), F.lit("-9")))
    lines = paired(spark, sf_dir).groupBy("sample_name", "pop_id").agg(F.array_sort(F.collect_list(F.struct("locus_id", text.alias("c")))).alias("l"))
    lines = lines.select(F.col("sample_name").alias("line"), F.concat_ws("\t", F.regexp_replace("sample_name", "#", "_"), F.col("pop_id").cast("string"), F.array_join(F.transform("l", lambda x: x["c"]), "\t")).alias("value"))
    read = readers.read_genotypes(spark, written(spark, lines, ".str"), rows=1, has_popids=True)
    return read.withColumn("sample_name", F.regexp_replace("sample_name", "_", "#"))


SEQUENCE_SQL = f"{GRID_SQL} SELECT sample_name, string_agg({IUPAC_SQL}, '' ORDER BY locus_id) AS sequence FROM grid GROUP BY sample_name"


@query("s13_read_fasta", SEQUENCE_SQL)
def s13(spark, sf_dir):
    coded = grid(spark, sf_dir).withColumn("iupac", encode.decode_012(F.col("g"), F.col("ref"), F.col("alt")))
    return readers.read_fasta(spark, written(spark, sinks.fasta_lines(sinks.sequences(coded)), ".fasta"))


@query("s12_read_nexus", SEQUENCE_SQL)
def s12(spark, sf_dir):
    coded = grid(spark, sf_dir).withColumn("iupac", encode.decode_012(F.col("g"), F.col("ref"), F.col("alt")))
    lines = sinks.sequences(coded).select(F.concat(F.lit("1"), "sample_name").alias("line"), F.concat_ws(" ", F.concat(F.lit("'"), "sample_name", F.lit("'")), "sequence").alias("value"))
    ends = spark.createDataFrame([("0", "#NEXUS\nBEGIN DATA;\nMATRIX"), ("2", ";\nEND;")], "line string, value string")
    return readers.read_nexus(spark, written(spark, lines.unionByName(ends), ".nex"))


@query("s20_vcf_to_phylip", f"{GRID_SQL} SELECT sample_name, locus_id, {IUPAC_SQL} AS iupac FROM grid")
def s20(spark, sf_dir):
    vcf = readers.read_vcf(spark, written(spark, sinks.vcf_lines(grid(spark, sf_dir)), ".vcf"))
    return readers.read_phylip(spark, written(spark, sinks.vcf_to_phylip(vcf), ".phy")).select("sample_name", "locus_id", "iupac")


@query("s19_write_012", f"{GRID_SQL} SELECT string_agg(coalesce(CAST(g AS VARCHAR), '-9'), ',' ORDER BY locus_id) AS value FROM grid GROUP BY sample_name")
def s19(spark, sf_dir):
    path = f"{shared_dir(spark).rstrip('/')}/file-{uuid.uuid4().hex}.012.csv"
    sinks.write_012(grid(spark, sf_dir), path)
    return spark.read.text(path)


@query("s15_mask_round_trip", f"WITH {CELLS_SQL} SELECT sample_id, locus_id, g IS NULL AS original, g IS NOT NULL AND sample_id % 3 = locus_id % 3 AS simulated FROM cells")
def s15(spark, sf_dir):
    path = f"{shared_dir(spark).rstrip('/')}/mask-{uuid.uuid4().hex}"
    sinks.write_mask(cells_from_tables(spark, sf_dir).withColumn("simulated", F.col("g").isNotNull() & (F.col("sample_id") % 3 == F.col("locus_id") % 3)), path)
    return sinks.read_mask(spark, path)


@query("s08_read_popmap", f"WITH {CELLS_SQL} SELECT DISTINCT s_name AS sample_name, CAST(pop_id AS VARCHAR) AS pop_id FROM cells JOIN supplier ON s_suppkey = sample_id")
def s08(spark, sf_dir):
    samples = cells_from_tables(spark, sf_dir).select("sample_id").distinct().join(samples_from_tables(spark, sf_dir), "sample_id")
    lines = samples.select(F.col("sample_name").alias("line"), F.concat_ws("\t", "sample_name", F.col("pop_id").cast("string")).alias("value"))
    return popmap.read_popmap(spark, written(spark, lines, ".popmap")).toDF("sample_name", "pop_id")


@query("p26_wide_and_back", f"{GRID_SQL} SELECT sample_name, locus_id, g FROM grid")
def p26(spark, sf_dir):
    loci = cells_from_tables(spark, sf_dir).select("locus_id").distinct().orderBy("locus_id")
    wide = shape.to_wide(grid(spark, sf_dir), "sample_name", "locus_id", "g")
    return shape.to_long(wide, "sample_name", "locus_id", "g", labels=[r[0] for r in loci.collect()])  # a line's own header


@query("p26_transpose", f"{GRID_SQL}, lp AS (SELECT locus_id, row_number() OVER (ORDER BY locus_id) - 1 AS place FROM loci) SELECT place AS locus, string_agg(coalesce(CAST(g AS VARCHAR), '-'), '' ORDER BY sample_name) AS calls FROM grid JOIN lp USING (locus_id) GROUP BY place")
def p26_transpose(spark, sf_dir):
    wide = shape.to_wide(grid(spark, sf_dir), "sample_name", "locus_id", "g")
    turned = shape.transpose(wide, "sample_name", "locus")
    return turned.select("locus", F.array_join(F.transform("values", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), "").alias("calls"))


@query("j10_tree_closure", f"WITH RECURSIVE pops AS (SELECT n_regionkey AS pop, s_name AS tip FROM supplier JOIN nation ON n_nationkey = s_nationkey), numbered AS (SELECT tip, pop, row_number() OVER (ORDER BY pop, tip) + dense_rank() OVER (ORDER BY pop) AS node_id FROM pops), nodes AS (SELECT 0 AS node_id, NULL::BIGINT AS parent_id, NULL::VARCHAR AS tip UNION ALL SELECT min(node_id) - 1, 0, NULL::VARCHAR FROM numbered GROUP BY pop UNION ALL SELECT node_id, min(node_id) OVER (PARTITION BY pop) - 1, tip FROM numbered), up AS (SELECT node_id, parent_id, tip FROM nodes WHERE tip IS NOT NULL UNION ALL SELECT n.node_id, n.parent_id, up.tip FROM up JOIN nodes n ON n.node_id = up.parent_id) SELECT CAST(node_id AS INT) AS node_id, tip FROM up")
def j10(spark, sf_dir):
    nodes = newick.parse(spark.read.text(written(spark, nested_lines(spark, sf_dir).select("line", "newick").toDF("line", "value"), ".tre")).select(F.lit(0).alias("tree_id"), F.col("value").alias("newick")))
    return newick.tips_below(nodes).select("node_id", "tip")


def nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree of all samples: the root, a node for each population, tips in order of their names."""
    samples = samples_from_tables(spark, sf_dir)
    stars = newick.star_lines(samples.withColumn("length", F.lit(0.1)), ["pop_id"], "sample_name", "length")
    inner = stars.select("pop_id", F.concat(F.regexp_replace("newick", ";$", ""), F.lit(":0.5")).alias("t"))
    whole = inner.agg(F.array_sort(F.collect_list(F.struct("pop_id", "t"))).alias("p"))  # a text for each population
    return whole.select(F.lit("0").alias("line"), F.concat(F.lit("("), F.array_join(F.transform("p", lambda x: x["t"]), ","), F.lit(");")).alias("newick"))


@query("s11_read_trees", """WITH s AS (SELECT r_name AS tree, n_name AS parent, s_name AS name, (s_suppkey % 7 + 1) / 8.0::DOUBLE AS branch_len FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
n AS (SELECT tree, parent AS name, count(*) AS tips FROM s GROUP BY tree, parent)
SELECT tree, tree AS name, NULL AS parent, 0.0::DOUBLE AS branch_len, false AS is_leaf, 0 AS depth, CAST(sum(tips) AS BIGINT) AS tips FROM n GROUP BY tree
UNION ALL SELECT tree, name, tree, length(name) / 4.0::DOUBLE, false, 1, tips FROM n UNION ALL SELECT tree, name, parent, branch_len, true, 2, 1 FROM s""")
def s11(spark, sf_dir):
    nations = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read_table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("l", (F.col("s_suppkey") % 7 + 1) / F.lit(8.0))
    stars = newick.star_lines(rows, ["r_name", "n_name"], "s_name", "l")
    label = lambda c: F.concat(F.lit("'"), F.regexp_replace(c, "'", "''"), F.lit("'"))
    inner = F.concat(F.regexp_replace("newick", ";$", ""), label("n_name"), F.lit(":"), (F.length("n_name") / F.lit(4.0)).cast("string"))
    trees = stars.groupBy("r_name").agg(F.array_sort(F.collect_list(inner)).alias("t"))
    lines = trees.select(F.col("r_name").alias("line"), F.concat(F.lit("("), F.array_join("t", ","), F.lit(")"), label("r_name"), F.lit(";")).alias("value"))
    read = spark.read.text(written(spark, lines, ".tre")).select(F.xxhash64("value").alias("tree_id"), F.col("value").alias("newick"))
    nodes = cut(newick.parse(read))
    up = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("name").alias("parent"))
    root = nodes.where("parent_id IS NULL").select("tree_id", F.col("name").alias("tree"))
    return nodes.join(root, "tree_id").join(up, ["tree_id", "parent_id"], "left").select("tree", "name", "parent", "branch_len", "is_leaf", "depth", (F.col("last") - F.col("first") + 1).cast("long").alias("tips"))


@query("s14_read_locus_stats", "SELECT 'pop' || (n_regionkey % 3) || '/' || r_name AS dataset, s_suppkey AS locus, round(s_acctbal / 7, 6) AS ho FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def s14(spark, sf_dir):
    return readers.read_locus_stats(spark, stats_folder(spark, sf_dir)).select("dataset", F.col("locus").cast("long").alias("locus"), F.col("ho").cast("double").alias("ho"))


def stats_folder(spark: SparkSession, sf_dir: str) -> str:
    """Per-locus tables of suppliers as data sets: a file in a folder of its own for each region, beside files of other names."""
    nations = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read_table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select("r_name", (F.col("n_regionkey") % 3).alias("part"), F.col("s_suppkey").alias("locus"), F.round(F.col("s_acctbal") / 7, 6).alias("ho"))
    root = f"{shared_dir(spark).rstrip('/')}/stats-{uuid.uuid4().hex}"
    for name, part in sorted((r[0], r[1]) for r in rows.select("r_name", "part").distinct().collect()):  # five regions
        own = rows.where(F.col("r_name") == name).select("locus", "ho")
        sinks.write_single_file(own, f"{root}/pop{part}/{name}/Total_LocusStats.csv")
        sinks.write_single_file(own, f"{root}/pop{part}/{name}/Other.csv")
    return root


@query("s18_write_report", f"WITH {CELLS_SQL} SELECT locus_id, count(g) AS n, round(avg(g), 9) AS mean FROM cells GROUP BY locus_id")
def s18(spark, sf_dir):
    stats = cells_from_tables(spark, sf_dir).groupBy("locus_id").agg(F.count("g").alias("n"), F.round(F.avg("g"), 9).alias("mean"))
    path = f"{shared_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}.json"
    sinks.write_report(stats, path)
    return spark.read.schema("locus_id BIGINT, n BIGINT, mean DOUBLE").json(path)


@query("s21_file_census", "SELECT 'csv' AS ext, CAST(2 * count(DISTINCT r_name) AS BIGINT) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def s21(spark, sf_dir):
    return readers.file_census(spark, stats_folder(spark, sf_dir))


@query("p23_missing_mask", f"{GRID_SQL} SELECT sample_name, string_agg(CASE WHEN g IS NULL THEN '1' ELSE '0' END, '' ORDER BY locus_id) AS missing FROM grid GROUP BY sample_name")
def p23(spark, sf_dir):
    lines = shape.flat(shape.at_least_2d(shape.missing_mask(shape.to_wide(grid(spark, sf_dir), "sample_name", "locus_id", "g")), "missing"), "lines")
    return lines.select("sample_name", F.array_join(F.transform("flat", lambda x: x.cast("int").cast("string")), "").alias("missing"))
