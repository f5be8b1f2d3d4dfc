"""Projection, joins, set operations and scalar functions over the driver's records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from genoframe.functions import text
from genoframe.model import CELLS_SQL, cells_from_tables
from genoframe.operators import compare, encode, relate
from genoframe.plans.genotypes import MASKED
from genoframe.plans.registry import query
from genoframe.session import read_table


@query("p10_flatten_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def p10(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


TERMS = "|".join(text.GENOMIC_TERMS)


@query("p11_keyword_filter", f"SELECT p_partkey FROM part WHERE regexp_matches(lower(concat_ws(' ', p_name, p_brand, p_type)), '{TERMS}|1')")
def p11(spark, sf_dir):
    return read_table(spark, sf_dir, "part").where(text.is_genomic(F.col("p_name"), F.col("p_brand"), F.col("p_type"), terms=(*text.GENOMIC_TERMS, "1"))).select("p_partkey")


FILE_SQL = "CAST(p_partkey AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN '.vcf' WHEN 1 THEN '.phy' WHEN 2 THEN '' ELSE '.doc' END"


@query("p12_file_predicate", f"SELECT p_partkey, reason <> '' AS skip, reason FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 'No Extension' WHEN p_partkey % 4 = 3 THEN 'Bad Extension (.doc)' WHEN p_size * 200000 / 1048576.0 > 5 THEN 'Too Large (' || printf('%.2f', CAST(p_size * 200000 / 1048576.0 AS DOUBLE)) || ' MB)' ELSE '' END AS reason FROM part)")
def p12(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    name = F.concat(F.col("p_partkey").cast("string"), F.when(k == 0, ".vcf").when(k == 1, ".phy").when(k == 2, "").otherwise(".doc"))
    said = parts.select("p_partkey", text.skip_file(name, F.col("p_size") * 200000, (".vcf", ".phy"), 5.0).alias("s"))
    return said.select("p_partkey", "s.skip", "s.reason")


@query("p13_dataset_key", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'results' WHEN 1 THEN 'sim' END || CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey % 50 AS VARCHAR) END AS dataset_key FROM orders")
def p13(spark, sf_dir):
    n, k = (F.col("o_orderkey") % 50).cast("string"), F.col("o_orderkey") % 3
    label = F.when(k == 0, F.concat(F.lit("x/Results_"), n)).when(k == 1, F.concat(F.lit("SIM"), n, F.lit(".csv"))).otherwise("none")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", text.dataset_key(label).alias("dataset_key"))


@query("p14_model_name", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'VAE' WHEN 1 THEN 'MostFrequent' WHEN 2 THEN 'RefAllele' WHEN 3 THEN 'NLPCA' WHEN 4 THEN 'Autoencoder' ELSE 'UnknownModel' END AS model FROM part")
def p14(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in ("Impute-VAE", "most_frequent", "Ref Allele", "nlpca", "ImputeAutoencoder", "forest")]), (F.col("p_partkey") % 6).cast("int"))
    return read_table(spark, sf_dir, "part").select("p_partkey", text.model_name(raw).alias("model"))


@query("p15_strategy_name", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Random' WHEN 1 THEN 'Random Weighted Inv' WHEN 2 THEN 'Nonrandom' ELSE 'Unknown' END AS strategy FROM part")
def p15(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in (" RANDOM ", "random weighted inv", "NonRandom", "other")]), (F.col("p_partkey") % 4).cast("int"))
    return read_table(spark, sf_dir, "part").select("p_partkey", text.strategy_name(raw).alias("strategy"))


@query("p16_metadata_columns", "SELECT 's' || CAST(p_partkey AS VARCHAR) AS dataset, CAST(p_size AS INT) AS n_samples, CAST(round_even(p_retailprice, 0) AS INT) AS n_sites FROM part")
def p16(spark, sf_dir):
    raw = read_table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string"), F.lit(".phy")).alias("filename"), F.col("p_size").cast("string").alias("n_samples"), F.rint("p_retailprice").alias("n_sites"))
    return raw.withColumn("filename", F.regexp_replace("filename", r"\.phy$", "")).withColumnRenamed("filename", "dataset").withColumn("n_samples", F.col("n_samples").cast("int")).withColumn("n_sites", F.col("n_sites").cast("int"))


@query("p22_flatten_metrics", "SELECT l_returnflag AS model, metric, value FROM (SELECT l_returnflag, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY l_returnflag) UNPIVOT (value FOR metric IN (discount, tax))")
def p22(spark, sf_dir):
    means = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.create_map(F.lit("discount"), F.round(F.avg("l_discount"), 6), F.lit("tax"), F.round(F.avg("l_tax"), 6)).alias("metrics"))
    return encode.flatten_metrics(means, ["model"])


@query("p24_unpivot_metrics", "SELECT s_suppkey, metric, CAST(value AS DOUBLE) AS value FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS s_nationkey, s_acctbal FROM supplier) UNPIVOT (value FOR metric IN (s_nationkey, s_acctbal))")
def p24(spark, sf_dir):
    return compare.unpivot_metrics(read_table(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_nationkey", "s_acctbal"])


@query("p25_filters", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL AND isfinite(o_totalprice) AND o_orderstatus IN ('F', 'O') AND regexp_matches(o_orderpriority, '^[1-3]') GROUP BY o_custkey HAVING count(*) >= 3")
def p25(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").na.drop(subset=["o_totalprice"])
    kept = orders.where(~F.isnan("o_totalprice") & F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").rlike("^[1-3]"))
    return kept.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("j01_inner_two_keys", "SELECT l.l_orderkey, l.l_linenumber, l.l_quantity FROM lineitem l JOIN (SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey) k ON k.l_orderkey = l.l_orderkey AND k.l_linenumber = l.l_linenumber")
def j01(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    keep = lines.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    return lines.join(keep, ["l_orderkey", "l_linenumber"])


@query("j02_left_indicator", "SELECT c_custkey, CASE WHEN o.o_custkey IS NULL THEN 'left_only' ELSE 'both' END AS indicator FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) o ON o.o_custkey = c_custkey")
def j02(spark, sf_dir):
    rich = read_table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return relate.left_with_indicator(read_table(spark, sf_dir, "customer").select("c_custkey"), rich, ["c_custkey"])


@query("j03_semi_join", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45 GROUP BY l_suppkey HAVING count(*) >= 10)")
def j03(spark, sf_dir):
    busy = read_table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_suppkey").count().where("count >= 10")
    suppliers = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    return suppliers.join(busy, suppliers["s_suppkey"] == busy["l_suppkey"], "left_semi")


@query("j04_anti_join", "SELECT 'data' AS side, s_suppkey AS sample_id FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'popmap', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def j04(spark, sf_dir):
    samples = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_id"))
    mapped = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"))
    return relate.unmatched(samples, mapped, "sample_id")


@query("j05_intersection", "SELECT s_suppkey AS sample_id FROM supplier INTERSECT SELECT c_custkey FROM customer")
def j05(spark, sf_dir):
    tips = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"))
    return relate.shared_or_fail(read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_id")), tips, "sample_id")


GATE_SQL = "SELECT l_suppkey FROM lineitem WHERE l_quantity > 40 GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag || l_linestatus) = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)"


@query("j06_completeness_gate", GATE_SQL)
def j06(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem")
    required = lines.select("l_returnflag", "l_linestatus").distinct()
    return compare.completeness_gate(lines.where("l_quantity > 40"), "l_suppkey", required)


@query("d01_subset_test", "SELECT o_custkey, count(DISTINCT o_orderstatus) FILTER (WHERE o_orderstatus IN ('F', 'O')) = 2 AS complete FROM orders GROUP BY o_custkey")
def d01(spark, sf_dir):
    seen = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return seen.select("o_custkey", (F.size(F.array_except(F.array(F.lit("F"), F.lit("O")), "s")) == 0).alias("complete"))


@query("j11_alignment_union", "SELECT s_name AS sample_name, a.alignment, coalesce(CASE WHEN (s_suppkey + a.alignment) % 3 <> 0 THEN repeat(substr('ACGT', CAST((s_suppkey + a.alignment) % 4 AS INT) + 1, 1), a.alignment + 3) END, repeat('N', a.alignment + 3)) AS sequence FROM supplier CROSS JOIN (SELECT unnest([0, 1, 2]) AS alignment) a")
def j11(spark, sf_dir):
    samples = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("sample_name"))
    placed = samples.select("id", "sample_name", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("alignment"))
    base = F.substring(F.lit("ACGT"), ((F.col("id") + F.col("alignment")) % 4).cast("int") + 1, F.lit(1))
    sequences = placed.where((F.col("id") + F.col("alignment")) % 3 != 0).select("sample_name", "alignment", F.repeat(base, F.col("alignment") + 3).alias("sequence"))
    lengths = spark.createDataFrame([(0, 3), (1, 4), (2, 5)], "alignment int, length int")
    return relate.align_sequences(samples.select("sample_name"), sequences, lengths)


@query("w01_largest_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def w01(spark, sf_dir):
    return compare.largest_per_key(read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query("a33_group_sizes", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def a33(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("w02_average_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / CAST(2 AS DOUBLE) AS rank FROM part")
def w02(spark, sf_dir):
    return relate.average_rank(read_table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "rank")


@query("w08_sequence_offsets", "SELECT p_partkey, CAST(sum(p_size) OVER (ORDER BY p_partkey) - p_size + 1 AS BIGINT) AS first, CAST(sum(p_size) OVER (ORDER BY p_partkey) AS BIGINT) AS last FROM part")
def w08(spark, sf_dir):
    return relate.offsets(read_table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", "p_size").select("p_partkey", "first", "last")


@query("u01_union_frames", "SELECT 'supplier' AS dataset, s_suppkey AS id, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT 'customer', c_custkey, c_acctbal, c_mktsegment FROM customer")
def u01(spark, sf_dir):
    suppliers = read_table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("dataset"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    customers = read_table(spark, sf_dir, "customer").select(F.lit("customer").alias("dataset"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return suppliers.unionByName(customers, allowMissingColumns=True)


@query("u02_key_intersection", "SELECT (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_quantity > 49) AS before_keys, count(*) AS after_keys FROM (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def u02(spark, sf_dir):
    keys = read_table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("k")).distinct()
    kept = keys.intersect(read_table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")))
    return keys.agg(F.count(F.lit(1)).alias("before_keys")).crossJoin(kept.agg(F.count(F.lit(1)).alias("after_keys")))


@query("u05_deduplicate", "SELECT DISTINCT coalesce(CASE WHEN event_id % 3 = 0 THEN 'id' || CAST(user_id AS VARCHAR) END, CASE WHEN event_id % 3 = 1 THEN 'name' || event_type END, 'href') AS key FROM events")
def u05(spark, sf_dir):
    k = F.col("event_id") % 3
    raw = read_table(spark, sf_dir, "events").select(F.when(k == 0, F.concat(F.lit("id"), F.col("user_id").cast("string"))).alias("id"), F.when(k == 1, F.concat(F.lit("name"), F.col("event_type"))).alias("identifier"), F.lit("href").alias("href"))
    return relate.deduplicate_by_first(raw, ["id", "identifier", "href"]).select("key")


@query("f01_string_functions", "SELECT p_partkey, upper(trim(p_name)) AS upper_name, split_part(p_type, ' ', 1) AS first_word, replace(p_brand, 'Brand', 'B') AS brand, regexp_extract(p_brand, '([0-9]+)', 1) AS digits FROM part")
def f01(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", F.upper(F.trim("p_name")).alias("upper_name"), F.element_at(F.split("p_type", " "), 1).alias("first_word"), F.regexp_replace("p_brand", "Brand", "B").alias("brand"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"))


@query("f04_durations", "SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%dh %dm %05.2fs', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s - floor(s / 3600) * 3600) / 60) AS BIGINT), s - floor(s / 3600) * 3600 - floor((s - floor(s / 3600) * 3600) / 60) * 60) WHEN s >= 60 THEN printf('%dm %05.2fs', CAST(floor(s / 60) AS BIGINT), s - floor(s / 60) * 60) ELSE printf('%.3fs', s) END AS duration FROM (SELECT o_orderkey, CAST((o_orderkey * 37) % 9000 AS DOUBLE) AS s FROM orders)")
def f04(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", text.duration(((F.col("o_orderkey") * 37) % 9000).cast("double")).alias("duration"))


@query("f05_math", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 9) AS root, round(exp(l_discount), 9) AS e, round(ln(1 + l_tax), 9) AS log1p, ceil(l_extendedprice) AS up, floor(l_extendedprice) AS down, round_even(l_quantity / 4, 0) AS even, least(greatest(l_quantity, 5), 40) AS clipped FROM lineitem")
def f05(spark, sf_dir):
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sqrt(q), 9).alias("root"), F.round(F.exp("l_discount"), 9).alias("e"), F.round(F.log1p("l_tax"), 9).alias("log1p"), F.ceil(price).cast("double").alias("up"), F.floor(price).cast("double").alias("down"), F.rint(q / 4).alias("even"), F.least(F.greatest(q, F.lit(5.0)), F.lit(40.0)).alias("clipped"))


@query("f06_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS q05, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.95), 6) AS q95 FROM lineitem GROUP BY l_returnflag")
def f06(spark, sf_dir):
    # Equal prices are counted first, and all three quantiles come from one list of the distinct ones.
    counts = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.count(F.lit(1)).alias("n"))
    asked = counts.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(*map(F.lit, (0.05, 0.5, 0.95))), F.col("n")).alias("q"))
    return asked.select("l_returnflag", *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("q05", "q50", "q95"))])


@query("f07_null_handling", f"WITH {CELLS_SQL} SELECT sample_id, locus_id, coalesce(g, -1) AS filled, nullif(g, 1) AS no_het FROM cells")
def f07(spark, sf_dir):
    return cells_from_tables(spark, sf_dir).select("sample_id", "locus_id", F.coalesce("g", F.lit(-1)).alias("filled"), F.nullif(F.col("g"), F.lit(1)).alias("no_het"))


@query("f08_arrays", "SELECT o_custkey, list_aggregate(list_sort(list(o_orderstatus)), 'string_agg', ',') AS statuses, count(*) AS n, count(DISTINCT o_orderstatus) AS n_distinct FROM orders GROUP BY o_custkey")
def f08(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderstatus")), ",").alias("statuses"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderstatus").alias("n_distinct"))


@query("f09_json", "SELECT event_id, '{\"k\":' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) || ',\"type\":\"' || event_type || '\"}' AS json FROM events")
def f09(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.from_json("props", "k BIGINT")["k"].alias("k"), F.col("event_type").alias("type"))).alias("json"))


@query("v09_variable_sites", f"WITH {CELLS_SQL} SELECT locus_id FROM cells WHERE g IS NOT NULL GROUP BY locus_id HAVING count(DISTINCT g) > 1 ORDER BY (locus_id * 104729 + 1299709) % 1000003, locus_id LIMIT 50")
def v09(spark, sf_dir):
    return relate.sample_variable_loci(cells_from_tables(spark, sf_dir), 50, (F.col("locus_id") * 104729 + 1299709) % 1000003)


@query("v10_introgression", f"WITH {CELLS_SQL} SELECT t.sample_id, t.locus_id, CASE WHEN s.sample_id IS NOT NULL AND {MASKED.replace('sample_id', 't.sample_id').replace('locus_id', 't.locus_id')} < 0.1 THEN s.g ELSE t.g END AS g FROM cells t LEFT JOIN cells s ON s.sample_id = 1 AND s.locus_id = t.locus_id AND t.sample_id % 2 = 0")
def v10(spark, sf_dir):
    from genoframe.operators.mask import residue_draw

    cells = cells_from_tables(spark, sf_dir)
    return relate.introgress(cells, F.col("sample_id") % 2 == 0, cells.where("sample_id = 1"), 0.1, residue_draw(1)).select("sample_id", "locus_id", "g")


@query("v12_length_filter", "SELECT p_partkey FROM part WHERE length(p_name) >= 10")
def v12(spark, sf_dir):
    return relate.long_enough(read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("sequence")), 10).select("p_partkey")
