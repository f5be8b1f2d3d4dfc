"""Evaluation metrics over the flagship's predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.model import CELLS_SQL, cells_from_tables
from genoframe.operators import encode, evaluate, impute
from genoframe.plans.genotypes import ALL_SQL, ALLELES_SQL, DIST_SQL, TR_SQL, decoded, predicted, training
from genoframe.plans.registry import query

MATRIX_SQL = f"""{ALL_SQL}, l AS (SELECT unnest([0, 1, 2]) AS c),
m AS (SELECT a.c AS y_true, b.c AS y_pred, count(p.y_true) AS n FROM l a CROSS JOIN l b LEFT JOIN preds p ON p.y_true = a.c AND p.y_pred = b.c GROUP BY a.c, b.c),
k AS (SELECT c AS label, CAST(coalesce(sum(n) FILTER (WHERE y_true = c AND y_pred = c), 0) AS DOUBLE) AS tp, CAST(coalesce(sum(n) FILTER (WHERE y_true <> c AND y_pred = c), 0) AS DOUBLE) AS fp, CAST(coalesce(sum(n) FILTER (WHERE y_true = c AND y_pred <> c), 0) AS DOUBLE) AS fn FROM l CROSS JOIN m GROUP BY c)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(predicted(spark, sf_dir), (0, 1, 2))


@query("a15_confusion_matrix", f"{MATRIX_SQL} SELECT y_true, y_pred, n FROM m")
def a15(spark, sf_dir):
    return matrix(spark, sf_dir)


REPORT_SQL = f"""{MATRIX_SQL}, r AS (SELECT label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CAST(tp + fn AS BIGINT) AS support, tp FROM k),
e AS (SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1, support FROM r
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM r)"""


@query("a16_class_report", f"{REPORT_SQL} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM e")
def a16(spark, sf_dir):
    return evaluate.class_report(matrix(spark, sf_dir))


@query("a17_macro_scores", f"{REPORT_SQL} SELECT label, round(f1, 9) AS f1 FROM e WHERE label IN ('macro avg', 'weighted avg', 'accuracy')")
def a17(spark, sf_dir):
    return evaluate.class_report(matrix(spark, sf_dir)).where(F.col("label").isin("macro avg", "weighted avg", "accuracy")).select("label", "f1")


@query("a18_jaccard", f"{MATRIX_SQL}, j AS (SELECT label, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END AS j, tp + fn AS s FROM k) SELECT label, round(jaccard, 9) AS jaccard FROM (SELECT CAST(label AS VARCHAR) AS label, j AS jaccard FROM j UNION ALL SELECT 'macro', avg(j) FROM j UNION ALL SELECT 'weighted', sum(j * s) / sum(s) FROM j)")
def a18(spark, sf_dir):
    return evaluate.jaccard(matrix(spark, sf_dir))


@query("a19_mcc", f"{MATRIX_SQL}, x AS (SELECT sum(tp) AS c, sum(tp + fn) AS s, sum((tp + fn) * (tp + fp)) AS tp, sum((tp + fn) * (tp + fn)) AS tt, sum((tp + fp) * (tp + fp)) AS pp FROM k) SELECT round(CASE WHEN (s * s - pp) * (s * s - tt) > 0 THEN (c * s - tp) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0 END, 9) AS mcc FROM x")
def a19(spark, sf_dir):
    return evaluate.matthews(matrix(spark, sf_dir))


SCORES_SQL = f"""WITH {CELLS_SQL}, {TR_SQL}, d AS ({DIST_SQL}), l AS (SELECT unnest([0, 1, 2]) AS cls),
sc AS (SELECT l.cls, t.g = l.cls AS positive, coalesce(d.prob, 0) AS score FROM tr t CROSS JOIN l LEFT JOIN d ON d.locus_id = t.locus_id AND d.state = l.cls WHERE evaluated)"""


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cls``, ``positive``, ``score``: training frequencies of each class at the evaluated cells' loci."""
    cells = training(spark, sf_dir)
    dist = impute.distribution(cells.where("NOT is_test"))
    rows = cells.where("evaluated").select("locus_id", "g", F.explode(F.array(*[F.lit(k) for k in (0, 1, 2)])).alias("cls"))
    joined = rows.join(dist.select("locus_id", F.col("state").alias("cls"), "prob"), ["locus_id", "cls"], "left")
    return joined.select("cls", (F.col("g") == F.col("cls")).alias("positive"), F.coalesce("prob", F.lit(0.0)).alias("score"))


TIES_SQL = f"{SCORES_SQL}, t AS (SELECT cls, score, count(*) FILTER (WHERE positive) AS pos, count(*) AS n FROM sc GROUP BY cls, score)"


@query("a20_roc_auc", f"{TIES_SQL}, r AS (SELECT *, sum(n) OVER (PARTITION BY cls ORDER BY score) - (n - 1) / CAST(2 AS DOUBLE) AS rank FROM t), s AS (SELECT cls, sum(rank * pos) AS r, CAST(sum(pos) AS DOUBLE) AS np, CAST(sum(n - pos) AS DOUBLE) AS nn FROM r GROUP BY cls) SELECT cls, round((r - np * (np + 1) / 2) / (np * nn), 9) AS auc, CAST(np AS BIGINT) AS positives FROM s WHERE np > 0 AND nn > 0")
def a20(spark, sf_dir):
    return evaluate.roc_auc(class_scores(spark, sf_dir))


@query("a21_average_precision", f"{TIES_SQL}, r AS (SELECT *, sum(pos) OVER f AS tp, sum(n) OVER f AS seen, sum(pos) OVER (PARTITION BY cls) AS np FROM t WINDOW f AS (PARTITION BY cls ORDER BY score DESC)) SELECT cls, round(sum(CAST(pos AS DOUBLE) / np * tp / seen), 9) AS ap FROM r WHERE np > 0 GROUP BY cls")
def a21(spark, sf_dir):
    return evaluate.average_precision(class_scores(spark, sf_dir))


@query("a22_curve_points", f"{TIES_SQL}, r AS (SELECT *, sum(pos) OVER f AS tp, sum(n - pos) OVER f AS fp, sum(pos) OVER (PARTITION BY cls) AS np, sum(n - pos) OVER (PARTITION BY cls) AS nn FROM t WINDOW f AS (PARTITION BY cls ORDER BY score DESC)) SELECT cls, score, round(tp / CAST(np AS DOUBLE), 9) AS tpr, round(fp / CAST(nn AS DOUBLE), 9) AS fpr, round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision FROM r")
def a22(spark, sf_dir):
    return evaluate.curve_points(class_scores(spark, sf_dir))


REPLICATES = 40
_POISSON_SQL = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in evaluate.POISSON)
BOOTSTRAP_SQL = f"""{ALL_SQL}, reps AS (SELECT unnest(range({REPLICATES})) AS rep),
b0 AS (SELECT rep, y_true, y_pred, (((sample_id * 7919 + locus_id * 104729 + 17) % 1000003) * (rep * 7919 + 13) % 1000003)::DOUBLE / 1000003.0::DOUBLE AS u FROM preds CROSS JOIN reps),
bm AS (SELECT rep, y_true, y_pred, sum({_POISSON_SQL}) AS n FROM b0 GROUP BY ALL), bl AS (SELECT unnest([0, 1, 2]) AS label),
bk AS (SELECT rep, label, coalesce(sum(n) FILTER (WHERE y_true = label AND y_pred = label), 0)::DOUBLE AS tp, coalesce(sum(n) FILTER (WHERE y_true <> label AND y_pred = label), 0)::DOUBLE AS fp, coalesce(sum(n) FILTER (WHERE y_true = label AND y_pred <> label), 0)::DOUBLE AS fn FROM bm CROSS JOIN bl GROUP BY rep, label),
br AS (SELECT rep, label, tp, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM bk),
be AS (SELECT rep, CAST(label AS VARCHAR) AS label, precision, recall, f1 FROM br
UNION ALL SELECT rep, 'macro avg', avg(precision), avg(recall), avg(f1) FROM br GROUP BY rep
UNION ALL SELECT rep, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM br GROUP BY rep
UNION ALL SELECT rep, 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support) FROM br GROUP BY rep),
bu AS (SELECT label, unnest(['precision', 'recall', 'f1']) AS metric, unnest([precision, recall, f1]) AS value FROM be)
SELECT label, metric, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.025), 9) AS lower, round(quantile_cont(value, 0.975), 9) AS upper FROM bu GROUP BY label, metric"""


@query("a23_bootstrap_interval", BOOTSTRAP_SQL)
def a23(spark, sf_dir):
    draw = lambda rep: ((F.col("sample_id") * 7919 + F.col("locus_id") * 104729 + 17) % 1000003 * (rep.cast("long") * 7919 + 13) % 1000003).cast("double") / F.lit(1000003.0)
    return evaluate.bootstrap_interval(evaluate.bootstrap_reports(predicted(spark, sf_dir), (0, 1, 2), REPLICATES, draw))


MACRO_SQL = f"""{TIES_SQL}, r AS (SELECT *, sum(pos) OVER f AS tp, sum(n - pos) OVER f AS fp, sum(pos) OVER (PARTITION BY cls) AS np, sum(n - pos) OVER (PARTITION BY cls) AS nn FROM t WINDOW f AS (PARTITION BY cls ORDER BY score DESC)),
z AS (SELECT cls, CASE WHEN nn > 0 THEN fp / CAST(nn AS DOUBLE) ELSE 0 END AS fpr, CASE WHEN np > 0 THEN tp / CAST(np AS DOUBLE) ELSE 0 END AS tpr, tp / CAST(tp + fp AS DOUBLE) AS precision FROM r),
q AS (SELECT cls, 'roc' AS curve, fpr AS x, tpr AS y FROM z UNION ALL SELECT cls, 'pr', tpr, precision FROM z UNION ALL SELECT cls, 'roc', 0, 0 FROM l UNION ALL SELECT cls, 'pr', 0, 1 FROM l),
o AS (SELECT cls, curve, x, CASE WHEN curve = 'roc' THEN max(y) ELSE min(y) END AS y, CASE WHEN curve = 'roc' THEN min(y) ELSE max(y) END AS first FROM q GROUP BY cls, curve, x),
g AS (SELECT l.cls, d.curve, d.x, o.y, o.first, CASE WHEN o.y IS NOT NULL THEN d.x END AS own FROM (SELECT DISTINCT curve, x FROM o) d CROSS JOIN l LEFT JOIN o ON o.cls = l.cls AND o.curve = d.curve AND o.x = d.x),
w AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS ya, last_value(own IGNORE NULLS) OVER b AS xa, first_value(first IGNORE NULLS) OVER a AS yb, first_value(own IGNORE NULLS) OVER a AS xb FROM g
  WINDOW b AS (PARTITION BY cls, curve ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY cls, curve ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT curve, round(x, 9) AS x, round(avg(CASE WHEN y IS NOT NULL THEN y WHEN xa IS NULL THEN yb WHEN xb IS NULL THEN ya ELSE ya + (yb - ya) / (xb - xa) * (x - xa) END), 9) AS y FROM w GROUP BY curve, x"""


@query("a22_macro_curve", MACRO_SQL)
def a22_macro(spark, sf_dir):
    return evaluate.macro_curves(class_scores(spark, sf_dir), (0, 1, 2))


@query("a24_class_weights", f"WITH {CELLS_SQL}, n AS (SELECT g, count(*) AS n FROM cells WHERE g IS NOT NULL GROUP BY g), w AS (SELECT g, pow(CAST(sum(n) OVER () AS DOUBLE) / (n * count(*) OVER ()), 0.5) AS w FROM n), c AS (SELECT g, least(w, min(w) OVER () * 1.5) AS w FROM w) SELECT g, round(w / avg(w) OVER (), 9) AS weight FROM c")
def a24(spark, sf_dir):
    counts = cells_from_tables(spark, sf_dir).where("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return evaluate.class_weights(counts, power=0.5, max_ratio=1.5)


CALLS_SQL = f"{ALLELES_SQL}, s AS (SELECT CASE WHEN pop_id < 2 THEN 'before' ELSE 'after' END AS dataset, iupac AS symbol FROM d), n AS (SELECT dataset, symbol, count(*) AS n FROM s GROUP BY dataset, symbol)"


def two_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = decoded(spark, sf_dir).select(F.when(F.col("pop_id") < 2, "before").otherwise("after").alias("dataset"), encode.normalise_symbol(F.col("iupac")).alias("symbol"))
    return evaluate.genotype_distribution(calls)


@query("a25_genotype_distribution", f"{CALLS_SQL} SELECT dataset, symbol, n, round(n * 100.0 / CAST(sum(n) OVER (PARTITION BY dataset) AS DOUBLE), 9) AS percent FROM n")
def a25(spark, sf_dir):
    return two_datasets(spark, sf_dir)


@query("a26_js_distance", f"{CALLS_SQL}, p AS (SELECT dataset, symbol, n / CAST(sum(n) OVER (PARTITION BY dataset) AS DOUBLE) AS p FROM n WHERE symbol <> 'N'), w AS (SELECT symbol, coalesce(max(p) FILTER (WHERE dataset = 'before'), 0) AS p, coalesce(max(p) FILTER (WHERE dataset = 'after'), 0) AS q FROM p GROUP BY symbol) SELECT round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 9) AS js_distance FROM w")
def a26(spark, sf_dir):
    return evaluate.js_distance(two_datasets(spark, sf_dir), "before", "after")


@query("t04_report_order", f"{REPORT_SQL}, o AS (SELECT label, CASE label WHEN 'accuracy' THEN 100 WHEN 'macro avg' THEN 101 WHEN 'weighted avg' THEN 102 ELSE CAST(label AS INT) END AS k FROM (SELECT label FROM e)) SELECT label, CAST(row_number() OVER (ORDER BY k) AS INT) AS place FROM o")
def t04(spark, sf_dir):
    from genoframe.functions.text import report_order

    return report_order(evaluate.class_report(matrix(spark, sf_dir)).select("label"))
