"""Encoding, masking, splitting, joining and imputing over the derived genotype cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.model import CELLS_SQL, LOCI_SQL, cells_from_tables, loci_of, samples_from_tables
from genoframe.operators import encode, impute, mask
from genoframe.plans.registry import query
from genoframe.session import read_table

PROP, SEED = 0.2, 1
MASKED = "((sample_id * 7919 + locus_id * 104729 + 1299709) % 1000003) / CAST(1000003 AS DOUBLE)"
TEST = "(sample_id * 7919) % 5 = 0"
TR_SQL = f"""
tr AS (SELECT *, {TEST} AS is_test, {TEST} AND g IS NOT NULL AND {MASKED} < 0.2 AS evaluated FROM cells)"""
MODES_SQL = """
lm AS (SELECT locus_id, g AS m FROM (
  SELECT locus_id, g, row_number() OVER (PARTITION BY locus_id ORDER BY count(*) DESC, g) AS rn
  FROM tr WHERE NOT is_test AND g IS NOT NULL GROUP BY locus_id, g) WHERE rn = 1),
pm AS (SELECT pop_id, locus_id, g AS m FROM (
  SELECT pop_id, locus_id, g, row_number() OVER (PARTITION BY pop_id, locus_id ORDER BY count(*) DESC, g) AS rn
  FROM tr WHERE NOT is_test AND g IS NOT NULL GROUP BY pop_id, locus_id, g) WHERE rn = 1)"""
PREDS_SQL = """
preds AS (SELECT t.sample_id, t.locus_id, t.pop_id, t.g AS y_true, coalesce(pm.m, lm.m, 0) AS y_pred
  FROM tr t LEFT JOIN pm ON pm.pop_id = t.pop_id AND pm.locus_id = t.locus_id LEFT JOIN lm ON lm.locus_id = t.locus_id
  WHERE evaluated)"""
ALL_SQL = f"WITH {CELLS_SQL}, {TR_SQL}, {MODES_SQL}, {PREDS_SQL}"


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with ``is_test`` by sample and ``evaluated``: the simulated mask on test rows."""
    cells = cells_from_tables(spark, sf_dir).withColumn("is_test", (F.col("sample_id") * 7919) % 5 == 0)
    return mask.evaluation_cells(mask.mask_random(cells, PROP, mask.residue_draw(SEED)))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship up to predictions: population modes of training rows fill the evaluated cells."""
    cells = training(spark, sf_dir)
    train = cells.where("NOT is_test")
    hidden = cells.where("evaluated").withColumn("hidden", F.lit(None).cast("int"))
    return impute.predictions(impute.fill_population_mode(hidden, impute.population_mode(train), impute.locus_mode(train), value="hidden"))


def with_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cells_from_tables(spark, sf_dir)
    # Loci are as many as the table's, so the join is left to Spark.
    return cells.join(loci_of(cells), "locus_id")


@query("s08_popmap", "SELECT s_name AS sample_name, r_name AS population FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def popmap(spark, sf_dir):
    samples = samples_from_tables(spark, sf_dir)
    regions = read_table(spark, sf_dir, "region")
    return samples.join(regions, samples["pop_id"] == regions["r_regionkey"]).select("sample_name", F.col("r_name").alias("population"))


@query("s09_popmap_subset", "SELECT s_name AS sample_name, r_name AS population FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def popmap_subset(spark, sf_dir):
    return popmap(spark, sf_dir).where(F.col("population").isin("ASIA", "EUROPE"))


@query("s10_single_pool", "SELECT s_name AS sample_name, 'Pop1' AS population FROM supplier")
def single_pool(spark, sf_dir):
    from genoframe.sources.popmap import single_pool_popmap

    return single_pool_popmap(read_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("sample_name")))


@query("p01_normalise_missing", "SELECT l_orderkey, l_linenumber, CASE WHEN v >= 0 THEN v END AS g FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 5 - 2 AS v FROM lineitem)")
def p01(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", encode.normalise_missing(F.col("l_quantity").cast("int") % 5 - 2).alias("g"))


@query("p02_clean_calls", "SELECT l_orderkey, l_linenumber, CASE WHEN v IN (0, 1, 2) THEN v END AS g FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 6 - 1 AS v FROM lineitem)")
def p02(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", encode.clean_calls(F.col("l_quantity").cast("int") % 6 - 1).alias("g"))


ALLELES_SQL = f"WITH {CELLS_SQL}, {LOCI_SQL}, x AS (SELECT c.*, l.ref, l.alt, CASE WHEN ref < alt THEN ref || alt ELSE alt || ref END AS pair FROM cells c JOIN loci l ON l.locus_id = c.locus_id), d AS (SELECT *, CASE g WHEN 0 THEN ref WHEN 2 THEN alt WHEN 1 THEN CASE pair WHEN 'AT' THEN 'W' WHEN 'AG' THEN 'R' WHEN 'AC' THEN 'M' WHEN 'GT' THEN 'K' WHEN 'CT' THEN 'Y' WHEN 'CG' THEN 'S' END ELSE 'N' END AS iupac FROM x)"


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_alleles(spark, sf_dir).withColumn("iupac", encode.decode_012(F.col("g"), F.col("ref"), F.col("alt")))


@query("p04_decode_iupac", f"{ALLELES_SQL} SELECT sample_id, locus_id, iupac FROM d")
def p04(spark, sf_dir):
    return decoded(spark, sf_dir).select("sample_id", "locus_id", "iupac")


@query("p03_encode_012", f"{ALLELES_SQL} SELECT sample_id, locus_id, CASE WHEN iupac = 'N' THEN NULL WHEN iupac = ref THEN 0 WHEN iupac IN ('A', 'C', 'G', 'T') THEN 2 ELSE 1 END AS g FROM d")
def p03(spark, sf_dir):
    return decoded(spark, sf_dir).select("sample_id", "locus_id", encode.encode_iupac_012(F.col("iupac"), F.col("ref")).alias("g"))


@query("p05_decode_codes", "SELECT l_orderkey, l_linenumber, CASE WHEN v BETWEEN 0 AND 9 THEN substr('ACGTWRMKYS', v + 1, 1) ELSE 'N' END AS iupac FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 12 - 1 AS v FROM lineitem)")
def p05(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", encode.decode_code(F.col("l_quantity").cast("int") % 12 - 1).alias("iupac"))


@query("p06_iupac_to_int", f"{ALLELES_SQL} SELECT sample_id, locus_id, CAST(instr('ACGTWRMKYS', iupac) - 1 AS INT) AS code FROM d")
def p06(spark, sf_dir):
    return decoded(spark, sf_dir).select("sample_id", "locus_id", encode.iupac_to_int(F.col("iupac")).alias("code"))


@query("p07_collapse_haploid", f"{ALLELES_SQL} SELECT sample_id, locus_id, CASE WHEN iupac IN ('A', 'C', 'G', 'T', 'N') THEN iupac ELSE ref END AS base, CASE WHEN iupac IN ('W', 'R', 'M') THEN 'A' WHEN iupac = 'K' THEN 'G' WHEN iupac IN ('S', 'Y') THEN 'C' ELSE iupac END AS first_base FROM d")
def p07(spark, sf_dir):
    d = decoded(spark, sf_dir)
    return d.select("sample_id", "locus_id", encode.collapse_haploid(F.col("iupac"), F.col("ref"), F.col("alt")).alias("base"), encode.collapse_haploid(F.col("iupac"), F.col("ref"), F.col("alt"), "first_base").alias("first_base"))


@query("p08_haploid_fold", f"WITH {CELLS_SQL} SELECT sample_id, locus_id, CASE WHEN g > 0 THEN 1 ELSE g END AS scored, CASE WHEN g > 0 THEN 2 ELSE g END AS decoded FROM cells")
def p08(spark, sf_dir):
    return cells_from_tables(spark, sf_dir).select("sample_id", "locus_id", encode.haploid_fold(F.col("g")).alias("scored"), encode.haploid_fold(F.col("g"), 2).alias("decoded"))


@query("p09_one_hot", f"WITH {CELLS_SQL} SELECT sample_id, locus_id, CASE WHEN g IS NULL THEN '-1,-1,-1' ELSE CAST(CAST(g = 0 AS INT) AS VARCHAR) || ',' || CAST(CAST(g = 1 AS INT) AS VARCHAR) || ',' || CAST(CAST(g = 2 AS INT) AS VARCHAR) END AS one_hot FROM cells")
def p09(spark, sf_dir):
    return cells_from_tables(spark, sf_dir).select("sample_id", "locus_id", F.array_join(encode.one_hot(F.col("g")).cast("array<string>"), ",").alias("one_hot"))


@query("p17_base_to_int", f"{ALLELES_SQL} SELECT sample_id, locus_id, CAST(instr('ACGT', iupac) - 1 AS INT) AS code FROM d")
def p17(spark, sf_dir):
    return decoded(spark, sf_dir).select("sample_id", "locus_id", encode.base_to_int(F.col("iupac")).cast("int").alias("code"))


@query("p18_alt_mask", f"WITH {CELLS_SQL}, {LOCI_SQL} SELECT locus_id, CAST(CAST(alt = 'A' OR ref = 'A' AS INT) AS VARCHAR) || CAST(CAST(alt = 'C' OR ref = 'C' AS INT) AS VARCHAR) || CAST(CAST(alt = 'G' OR ref = 'G' AS INT) AS VARCHAR) || CAST(CAST(alt = 'T' OR ref = 'T' AS INT) AS VARCHAR) AS mask FROM loci")
def p18(spark, sf_dir):
    both = F.concat_ws(",", "alt", "ref")  # a multi-allelic list
    return loci_of(cells_from_tables(spark, sf_dir)).select("locus_id", F.array_join(encode.alt_mask(both).cast("array<int>").cast("array<string>"), "").alias("mask"))


@query("p19_zygosity", f"{ALLELES_SQL} SELECT sample_id, locus_id, g AS zygosity FROM d")
def p19(spark, sf_dir):
    return decoded(spark, sf_dir).select("sample_id", "locus_id", encode.zygosity(F.col("iupac"), F.col("ref"), F.col("alt")).alias("zygosity"))


@query("p20_locus_names", f"WITH {CELLS_SQL} SELECT DISTINCT locus_id, CASE WHEN locus_id % 3 = 0 THEN 'named' || CAST(locus_id AS VARCHAR) ELSE 'Locus_' || CAST(locus_id + 1 AS VARCHAR) END AS locus_name FROM cells")
def p20(spark, sf_dir):
    given = F.when(F.col("locus_id") % 3 == 0, F.concat(F.lit("named"), F.col("locus_id").cast("string")))
    return cells_from_tables(spark, sf_dir).select("locus_id").distinct().select("locus_id", encode.locus_name(given, F.col("locus_id")).alias("locus_name"))


@query("p21_normalise_symbols", "SELECT p_partkey, translate(upper(substr('acgt-.?n', CAST(p_partkey % 8 AS INT) + 1, 1)), '-.?', 'NNN') AS symbol FROM part")
def p21(spark, sf_dir):
    raw = F.substring(F.lit("acgt-.?n"), (F.col("p_partkey") % 8).cast("int") + 1, F.lit(1))
    return read_table(spark, sf_dir, "part").select("p_partkey", encode.normalise_symbol(raw).alias("symbol"))


@query("a10_base_counts", f"{ALLELES_SQL} SELECT locus_id, base, CAST(sum(n) AS BIGINT) AS n FROM (SELECT locus_id, ref AS base, sum(CASE g WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS n FROM d GROUP BY locus_id, ref UNION ALL SELECT locus_id, alt, sum(CASE g WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END) FROM d GROUP BY locus_id, alt) WHERE n > 0 GROUP BY locus_id, base")
def a10(spark, sf_dir):
    return encode.base_counts(decoded(spark, sf_dir))


@query("t03_repaired_alleles", f"{ALLELES_SQL}, b AS (SELECT locus_id, ref, alt, sum(CASE g WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS nr, sum(CASE g WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS na FROM d GROUP BY locus_id, ref, alt) SELECT locus_id, CASE WHEN nr > na OR (nr = na AND ref < alt) THEN ref ELSE alt END AS ref, CASE WHEN nr > na OR (nr = na AND ref < alt) THEN CASE WHEN na > 0 THEN alt ELSE ref END ELSE CASE WHEN nr > 0 THEN ref ELSE alt END END AS alt FROM b")
def t03(spark, sf_dir):
    d = decoded(spark, sf_dir)
    unknown = loci_of(cells_from_tables(spark, sf_dir)).select("locus_id", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("alt"))
    return encode.repair_alleles(unknown, encode.base_counts(d))


@query("h01_split_by_population", "SELECT sample_id, pop_id, rn <= greatest(1, n_test) AS is_test FROM (SELECT *, row_number() OVER (PARTITION BY pop_id ORDER BY u, sample_id) AS rn, round_even(0.2 * count(*) OVER (PARTITION BY pop_id), 0) AS n_test FROM (SELECT s_suppkey AS sample_id, n_regionkey AS pop_id, ((s_suppkey * 7919 + 1299709) % 1000003) / CAST(1000003 AS DOUBLE) AS u FROM supplier JOIN nation ON n_nationkey = s_nationkey))")
def h01(spark, sf_dir):
    return mask.split_rows(samples_from_tables(spark, sf_dir).select("sample_id", "pop_id"), 0.2, mask.sample_draw(SEED), by="pop_id")


@query("h02_split_all", "SELECT sample_id, rn <= n_test AS is_test FROM (SELECT *, row_number() OVER (ORDER BY u, sample_id) AS rn, round_even(0.25 * count(*) OVER (), 0) AS n_test FROM (SELECT s_suppkey AS sample_id, ((s_suppkey * 7919 + 1299709) % 1000003) / CAST(1000003 AS DOUBLE) AS u FROM supplier))")
def h02(spark, sf_dir):
    return mask.split_rows(samples_from_tables(spark, sf_dir).select("sample_id"), 0.25, mask.sample_draw(SEED), at_least_one=False)


@query("h03_split_shuffled", "SELECT sample_id, rn <= greatest(1, n_test) AS is_test FROM (SELECT *, row_number() OVER (ORDER BY u, sample_id) AS rn, round_even(0.3 * count(*) OVER (), 0) AS n_test FROM (SELECT s_suppkey AS sample_id, ((s_suppkey * 7919 + 3 * 1299709) % 1000003) / CAST(1000003 AS DOUBLE) AS u FROM supplier))")
def h03(spark, sf_dir):
    return mask.split_rows(samples_from_tables(spark, sf_dir).select("sample_id"), 0.3, mask.sample_draw(3))


@query("h04_split_three", "SELECT sample_id, CASE WHEN rn > held THEN 'train' WHEN rn > CAST(floor(held / 2.0) AS INT) THEN 'test' ELSE 'val' END AS part FROM (SELECT *, row_number() OVER (ORDER BY u, sample_id) AS rn, CAST(ceil(0.4 * count(*) OVER ()) AS INT) AS held FROM (SELECT s_suppkey AS sample_id, ((s_suppkey * 7919 + 1299709) % 1000003) / CAST(1000003 AS DOUBLE) AS u FROM supplier))")
def h04(spark, sf_dir):
    return mask.split_three(samples_from_tables(spark, sf_dir).select("sample_id"), 0.4, mask.sample_draw(SEED))


@query("u03_train_rows", f"SELECT s_suppkey AS sample_id FROM supplier WHERE NOT ((s_suppkey * 7919) % 5 = 0)")
def u03(spark, sf_dir):
    samples = samples_from_tables(spark, sf_dir).select("sample_id")
    return samples.exceptAll(samples.where((F.col("sample_id") * 7919) % 5 == 0))


@query("m01_mask_random", f"WITH {CELLS_SQL} SELECT sample_id, locus_id, g IS NOT NULL AND {MASKED} < 0.2 AS simulated FROM cells")
def m01(spark, sf_dir):
    return mask.mask_random(cells_from_tables(spark, sf_dir), PROP, mask.residue_draw(SEED)).select("sample_id", "locus_id", "simulated")


def _weighted_sql(base: str) -> str:
    return f"""WITH {CELLS_SQL},
n AS (SELECT locus_id, g, count(*) AS n FROM cells WHERE g IS NOT NULL GROUP BY locus_id, g),
w AS (SELECT *, pow({base}, 0.25) AS w0 FROM (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY locus_id) AS p, count(*) OVER (PARTITION BY locus_id) AS k FROM n)),
v AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY locus_id) AS w FROM w),
q AS (SELECT locus_id, g, CASE WHEN k > 1 THEN least(1.0, w * 0.2 / (sum(w * n) OVER (PARTITION BY locus_id) / sum(n) OVER (PARTITION BY locus_id))) ELSE 0 END AS prob FROM v)
SELECT c.sample_id, c.locus_id, c.g IS NOT NULL AND {MASKED.replace('sample_id', 'c.sample_id').replace('locus_id', 'c.locus_id')} < coalesce(prob, 0) AS simulated FROM cells c LEFT JOIN q ON q.locus_id = c.locus_id AND q.g = c.g"""


@query("m02_mask_weighted", _weighted_sql("p"))
def m02(spark, sf_dir):
    return mask.mask_weighted(cells_from_tables(spark, sf_dir), PROP, mask.residue_draw(SEED)).select("sample_id", "locus_id", "simulated")


@query("m03_mask_weighted_inverse", _weighted_sql("1 / p"))
def m03(spark, sf_dir):
    return mask.mask_weighted(cells_from_tables(spark, sf_dir), PROP, mask.residue_draw(SEED), inverse=True).select("sample_id", "locus_id", "simulated")


@query("m06_mask_exact", f"WITH {CELLS_SQL} SELECT sample_id, locus_id, g IS NOT NULL AND rn <= floor(0.2 * known) AS simulated FROM (SELECT *, row_number() OVER (PARTITION BY g IS NOT NULL ORDER BY {MASKED}, sample_id, locus_id) AS rn, count(g) OVER () AS known FROM cells)")
def m06(spark, sf_dir):
    cells = cells_from_tables(spark, sf_dir)
    return mask.mask_exact(cells, F.floor(F.lit(PROP) * F.col("known")), mask.residue_draw(SEED)).select("sample_id", "locus_id", "simulated")


@query("m07_mask_inverse_genotype", f"WITH {CELLS_SQL}, f AS (SELECT g, count(*) AS n FROM cells WHERE g IS NOT NULL GROUP BY g), k AS (SELECT c.*, -ln(greatest({MASKED.replace('sample_id', 'c.sample_id').replace('locus_id', 'c.locus_id')}, 1e-12)) / ((CASE WHEN c.g = 1 THEN CAST(2.0 AS DOUBLE) ELSE 1.0 END) / f.n) AS key FROM cells c JOIN f ON f.g = c.g) SELECT CAST(count(*) AS BIGINT) AS n_simulated, CAST(count(*) FILTER (WHERE g = 0) AS BIGINT) AS n0, CAST(count(*) FILTER (WHERE g = 1) AS BIGINT) AS n1, CAST(count(*) FILTER (WHERE g = 2) AS BIGINT) AS n2 FROM (SELECT *, row_number() OVER (ORDER BY key, sample_id, locus_id) AS rn, count(*) OVER () AS known FROM k) WHERE rn <= floor(0.2 * known)")
def m07(spark, sf_dir):
    hidden = mask.mask_inverse_genotype(cells_from_tables(spark, sf_dir), PROP, mask.residue_draw(SEED), het_boost=2.0).where("simulated")
    return hidden.agg(F.count(F.lit(1)).alias("n_simulated"), *[F.count_if(F.col("g") == k).alias(f"n{k}") for k in (0, 1, 2)])


GUARD_SQL = f"""WITH {CELLS_SQL}, m AS (SELECT *, g IS NOT NULL AND {MASKED} < 0.97 AS s FROM cells),
a AS (SELECT *, count(g) OVER (PARTITION BY locus_id) AS seen, sum(CAST(s AS INT)) OVER (PARTITION BY locus_id) AS hid, row_number() OVER (PARTITION BY locus_id, s ORDER BY sample_id) AS rn FROM m)
SELECT sample_id, locus_id, s AND NOT (seen > 0 AND seen = hid AND rn = 1) AS simulated FROM a"""


@query("m08_mask_guard", GUARD_SQL)
def m08(spark, sf_dir):
    return mask.guard(mask.mask_random(cells_from_tables(spark, sf_dir), 0.97, mask.residue_draw(SEED))).select("sample_id", "locus_id", "simulated")


@query("m09_apply_mask", f"WITH {CELLS_SQL} SELECT sample_id, locus_id, CASE WHEN NOT (g IS NOT NULL AND {MASKED} < 0.2) THEN g END AS g_masked FROM cells")
def m09(spark, sf_dir):
    return mask.apply_mask(mask.mask_random(cells_from_tables(spark, sf_dir), PROP, mask.residue_draw(SEED))).select("sample_id", "locus_id", "g_masked")


@query("m10_test_mask", f"WITH {CELLS_SQL}, {TR_SQL} SELECT sample_id, locus_id, evaluated FROM tr")
def m10(spark, sf_dir):
    return training(spark, sf_dir).select("sample_id", "locus_id", "evaluated")


@query("m11_mask_exact_test_rows", f"WITH {CELLS_SQL} SELECT sample_id, locus_id, ok AND rn <= round_even(0.25 * known, 0) AS simulated FROM (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY {MASKED}, sample_id, locus_id) AS rn, count(*) FILTER (WHERE ok) OVER () AS known FROM (SELECT *, g IS NOT NULL AND {TEST} AS ok FROM cells))")
def m11(spark, sf_dir):
    cells = cells_from_tables(spark, sf_dir)
    ok = F.col("g").isNotNull() & ((F.col("sample_id") * 7919) % 5 == 0)
    return mask.mask_exact(cells, F.rint(F.lit(0.25) * F.col("known")), mask.residue_draw(SEED), ok).select("sample_id", "locus_id", "simulated")


@query("m12_sample_known", f"WITH {CELLS_SQL} SELECT sample_id, locus_id FROM (SELECT *, row_number() OVER (ORDER BY {MASKED}, sample_id, locus_id) AS rn, count(*) OVER () AS known FROM cells WHERE g IS NOT NULL) WHERE rn <= floor(known * 0.1)")
def m12(spark, sf_dir):
    return mask.mask_exact(cells_from_tables(spark, sf_dir), F.floor(F.col("known") * F.lit(0.1)), mask.residue_draw(SEED)).where("simulated").select("sample_id", "locus_id")


@query("m13_mask_summary", f"WITH {CELLS_SQL} SELECT count(*) AS n_cells, count(*) - count(g) AS n_original, count(*) FILTER (WHERE s) AS n_simulated, count(*) - count(g) + count(*) FILTER (WHERE s) AS n_missing, round(count(*) FILTER (WHERE s) / CAST(count(*) AS DOUBLE), 9) AS prop_masked, count(*) FILTER (WHERE s) < 100 AS few FROM (SELECT *, g IS NOT NULL AND {MASKED} < 0.2 AS s FROM cells)")
def m13(spark, sf_dir):
    return mask.mask_summary(mask.mask_random(cells_from_tables(spark, sf_dir), PROP, mask.residue_draw(SEED)))


@query("u04_mask_union", f"WITH {CELLS_SQL} SELECT sample_id, locus_id, g IS NULL AS original, g IS NOT NULL AND {MASKED} < 0.2 AS simulated, g IS NULL OR {MASKED} < 0.2 AS all_missing FROM cells")
def u04(spark, sf_dir):
    masked = mask.mask_random(cells_from_tables(spark, sf_dir), PROP, mask.residue_draw(SEED))
    return masked.select("sample_id", "locus_id", F.col("g").isNull().alias("original"), "simulated", (F.col("g").isNull() | F.col("simulated")).alias("all_missing"))


@query("a01_locus_mode", f"WITH {CELLS_SQL}, {TR_SQL}, {MODES_SQL} SELECT locus_id, m AS mode FROM lm")
def a01(spark, sf_dir):
    return impute.locus_mode(training(spark, sf_dir).where("NOT is_test"))


@query("a02_population_mode", f"WITH {CELLS_SQL}, {TR_SQL}, {MODES_SQL} SELECT pop_id, locus_id, m AS mode FROM pm")
def a02(spark, sf_dir):
    return impute.population_mode(training(spark, sf_dir).where("NOT is_test"))


@query("a03_prefill_mode", f"WITH {CELLS_SQL}, m AS (SELECT locus_id, g AS m FROM (SELECT locus_id, g, row_number() OVER (PARTITION BY locus_id ORDER BY count(*) DESC, g) AS rn FROM cells WHERE g IS NOT NULL GROUP BY locus_id, g) WHERE rn = 1) SELECT c.sample_id, c.locus_id, coalesce(g, m, 0) AS imputed FROM cells c LEFT JOIN m ON m.locus_id = c.locus_id")
def a03(spark, sf_dir):
    cells = cells_from_tables(spark, sf_dir)
    return impute.fill_mode(cells, impute.locus_mode(cells)).select("sample_id", "locus_id", "imputed")


DIST_SQL = "SELECT locus_id, g AS state, n / CAST(sum(n) OVER (PARTITION BY locus_id) AS DOUBLE) AS prob, (sum(n) OVER (PARTITION BY locus_id ORDER BY g) - n) / CAST(sum(n) OVER (PARTITION BY locus_id) AS DOUBLE) AS cum_lo, sum(n) OVER (PARTITION BY locus_id ORDER BY g) / CAST(sum(n) OVER (PARTITION BY locus_id) AS DOUBLE) AS cum_hi FROM (SELECT locus_id, g, count(*) AS n FROM tr WHERE NOT is_test AND g IS NOT NULL GROUP BY locus_id, g)"


@query("a04_locus_distribution", f"WITH {CELLS_SQL}, {TR_SQL}, d AS ({DIST_SQL}) SELECT locus_id, state, round(prob, 9) AS prob, round(cum_hi, 9) AS cum_hi FROM d")
def a04(spark, sf_dir):
    return impute.distribution(training(spark, sf_dir).where("NOT is_test")).select("locus_id", "state", F.round("prob", 9).alias("prob"), F.round("cum_hi", 9).alias("cum_hi"))


@query("a05_genotype_frequencies", f"WITH {CELLS_SQL} SELECT g, count(*) AS n FROM cells WHERE g IS NOT NULL GROUP BY g")
def a05(spark, sf_dir):
    return cells_from_tables(spark, sf_dir).where("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("a30_missing_counts", f"WITH {CELLS_SQL} SELECT locus_id, count(*) - count(g) AS n_missing, round((count(*) - count(g)) / CAST(count(*) AS DOUBLE), 9) AS prop_missing FROM cells GROUP BY locus_id")
def a30(spark, sf_dir):
    missing = F.count_if(F.col("g").isNull())
    return cells_from_tables(spark, sf_dir).groupBy("locus_id").agg(missing.alias("n_missing"), F.round(missing.cast("double") / F.count(F.lit(1)), 9).alias("prop_missing"))


@query("a32_column_means", f"WITH {CELLS_SQL} SELECT locus_id, round(avg(g), 9) AS mean FROM cells GROUP BY locus_id")
def a32(spark, sf_dir):
    return cells_from_tables(spark, sf_dir).groupBy("locus_id").agg(F.round(F.avg("g"), 9).alias("mean"))


@query("i01_impute_reference", f"WITH {CELLS_SQL} SELECT sample_id, locus_id, coalesce(g, 0) AS imputed FROM cells")
def i01(spark, sf_dir):
    return impute.fill_reference(cells_from_tables(spark, sf_dir)).select("sample_id", "locus_id", "imputed")


@query("i02_impute_mode", f"WITH {CELLS_SQL}, {TR_SQL}, {MODES_SQL} SELECT t.sample_id, t.locus_id, coalesce(t.g, lm.m, 0) AS imputed FROM tr t LEFT JOIN lm ON lm.locus_id = t.locus_id")
def i02(spark, sf_dir):
    cells = training(spark, sf_dir)
    return impute.fill_mode(cells, impute.locus_mode(cells.where("NOT is_test"))).select("sample_id", "locus_id", "imputed")


@query("j07_impute_population_mode", f"WITH {CELLS_SQL}, {TR_SQL}, {MODES_SQL} SELECT t.sample_id, t.locus_id, coalesce(t.g, pm.m, lm.m, 0) AS imputed FROM tr t LEFT JOIN pm ON pm.pop_id = t.pop_id AND pm.locus_id = t.locus_id LEFT JOIN lm ON lm.locus_id = t.locus_id")
def j07(spark, sf_dir):
    cells = training(spark, sf_dir)
    train = cells.where("NOT is_test")
    return impute.fill_population_mode(cells, impute.population_mode(train), impute.locus_mode(train)).select("sample_id", "locus_id", "imputed")


@query("i04_impute_frequency", f"WITH {CELLS_SQL}, {TR_SQL}, d AS ({DIST_SQL}), u AS (SELECT *, ((sample_id * 7919 + locus_id * 104729 + 5 * 1299709) % 1000003) / CAST(1000003 AS DOUBLE) AS u FROM tr) SELECT u.sample_id, u.locus_id, coalesce(u.g, d.state, 0) AS imputed FROM u LEFT JOIN d ON d.locus_id = u.locus_id AND u.u >= d.cum_lo AND u.u < d.cum_hi")
def i04(spark, sf_dir):
    cells = training(spark, sf_dir)
    return impute.fill_frequency(cells, impute.distribution(cells.where("NOT is_test")), mask.residue_draw(5)).select("sample_id", "locus_id", "imputed")


@query("i03_population_predictions", f"{ALL_SQL} SELECT sample_id, locus_id, pop_id, y_true, y_pred FROM preds")
def i03(spark, sf_dir):
    return predicted(spark, sf_dir)


@query("j08_fill_locus_value", f"WITH {CELLS_SQL}, v AS (SELECT locus_id, CAST(round_even(avg(g), 0) AS INT) AS v FROM cells GROUP BY locus_id) SELECT c.sample_id, c.locus_id, coalesce(c.g, v.v, 0) AS imputed FROM cells c LEFT JOIN v ON v.locus_id = c.locus_id")
def j08(spark, sf_dir):
    cells = cells_from_tables(spark, sf_dir)
    return impute.fill_mode(cells, cells.groupBy("locus_id").agg(F.rint(F.avg("g")).cast("int").alias("mode"))).select("sample_id", "locus_id", "imputed")
