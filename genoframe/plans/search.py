"""Hyper-parameter search over orders as trials: every customer is a study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.operators import tuning
from genoframe.plans.registry import query
from genoframe.session import read_table

SPACE = (tuning.Real("rate", 1e-4, 1e-1, log=True), tuning.Real("layers", 1.0, 8.0, whole=True), tuning.Choice("activation", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
STARTUP, PROPOSALS, SEED = 5, 2, 7


def trials_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    value = F.when(F.col("o_orderstatus") != "P", ((key * 7919) % 1009).cast("double"))
    other = ((key * 104729) % 997).cast("double")
    rate = F.pow(F.lit(10.0), -4 + 3 * ((key * 31) % 1000) / F.lit(1000.0))
    return read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("study"), key.alias("trial_id"), value.alias("value"), other.alias("other"), rate.alias("rate"), (1 + (key * 17) % 8).alias("layers"), F.col("o_orderpriority").alias("activation"))


TRIALS_SQL = """t AS (SELECT o_custkey AS study, o_orderkey AS trial_id, CASE WHEN o_orderstatus <> 'P' THEN CAST((o_orderkey * 7919) % 1009 AS DOUBLE) END AS value, CAST((o_orderkey * 104729) % 997 AS DOUBLE) AS other,
  pow(10.0::DOUBLE, -4 + 3 * ((o_orderkey * 31) % 1000) / 1000.0::DOUBLE) AS rate, 1 + (o_orderkey * 17) % 8 AS layers, o_orderpriority AS activation FROM orders)"""

_LOGISTIC = lambda u: f"(1 / (1 + exp(-({u}))))"


def _kernel_sql(x: str, c: str, w: str) -> str:
    f = _LOGISTIC(f"(({x}) - ({c})) / ({w})")
    return f"({f} * (1 - {f}) / ({w}) / ({_LOGISTIC(f'(1 - ({c})) / ({w})')} - {_LOGISTIC(f'-({c}) / ({w})')}))"


def _scale_sql(n: str, s: str, q: str) -> str:
    c = f"greatest({n}, 1)::DOUBLE"
    return f"(0.5513288954217921::DOUBLE * greatest(sqrt(greatest(({q}) / ({c}) - (({s}) / ({c})) * (({s}) / ({c})), 0.0::DOUBLE)) * pow({c}, -0.2::DOUBLE), 1 / least(100.0::DOUBLE, {c} + 2)))"


def _draw_sql(need: int) -> str:
    return f"(((study * 7919 + slot * 15485863 + proposal * 104729 + candidate * 1299709 + {SEED * 611953 + need * 32452843}) % 1000003)::DOUBLE / 1000003.0::DOUBLE)"


_PICK = f"CAST(floor({_draw_sql(0)} * (k + greatest(options, 1))) AS INT)"
_LOW, _HIGH = _LOGISTIC("-centre / w"), _LOGISTIC("(1 - centre) / w")
PROPOSE_SQL = f"""WITH {TRIALS_SQL}, d AS (SELECT * FROM t WHERE value IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value DESC, trial_id) AS place, count(*) OVER (PARTITION BY study) AS done FROM d),
obs AS (SELECT study, place, done, 0 AS slot, (ln(rate) - ln(1e-4::DOUBLE)) / (ln(1e-1::DOUBLE) - ln(1e-4::DOUBLE)) AS x FROM ranked WHERE rate BETWEEN 1e-4::DOUBLE AND 1e-1::DOUBLE
  UNION ALL SELECT study, place, done, 1, (layers - 1)::DOUBLE / 7 FROM ranked
  UNION ALL SELECT study, place, done, 2, (CAST(left(activation, 1) AS INT) - 1)::DOUBLE FROM ranked),
sums AS (SELECT study, slot, count(*) AS n, sum(x) AS s, sum(x * x) AS q,
  coalesce(list(x ORDER BY place) FILTER (WHERE place <= least(25, ceil(done * 0.1::DOUBLE)) AND done >= {STARTUP}), []) AS good FROM obs GROUP BY study, slot),
keys AS (SELECT s.study, p.slot, p.parameter, p.options, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(q, 0) AS q, coalesce(good, []) AS good
  FROM (SELECT DISTINCT study FROM t) s CROSS JOIN (VALUES (0, 'rate', 0), (1, 'layers', 0), (2, 'activation', 5)) p(slot, parameter, options) LEFT JOIN sums ON sums.study = s.study AND sums.slot = p.slot),
more AS (SELECT *, len(good) AS k, coalesce(list_sum(good), 0) AS gs, coalesce(list_sum(list_transform(good, lambda g: g * g)), 0) AS gq FROM keys),
wide AS (SELECT *, {_scale_sql('k', 'gs', 'gq')} AS w, {_scale_sql('n - k', 's - gs', 'q - gq')} AS v FROM more),
cand AS (SELECT *, c // 24 AS proposal, c % 24 AS candidate FROM wide, (SELECT unnest(range({PROPOSALS * tuning.CANDIDATES})) AS c)),
pick AS (SELECT *, {_PICK} AS pick, good[{_PICK} + 1] AS centre FROM cand),
drawn AS (SELECT *, CASE WHEN options = 0 THEN CASE WHEN pick < k THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, centre + w * ln(({_LOW} + {_draw_sql(1)} * ({_HIGH} - {_LOW})) / (1 - ({_LOW} + {_draw_sql(1)} * ({_HIGH} - {_LOW})))))) ELSE {_draw_sql(1)} END
  ELSE CASE WHEN pick < k THEN centre ELSE (pick - k)::DOUBLE END END AS x FROM pick),
every AS (SELECT d.study, d.slot, d.c, sum(CASE WHEN d.options = 0 THEN {_kernel_sql('d.x', 'o.x', 'd.v')} ELSE (d.x = o.x)::INT::DOUBLE END) AS everywhere FROM drawn d JOIN obs o ON o.study = d.study AND o.slot = d.slot GROUP BY d.study, d.slot, d.c),
gain AS (SELECT d.*, CASE WHEN k = 0 THEN 0 ELSE
  ln((1 + coalesce(list_sum(list_transform(good, lambda g: CASE WHEN options = 0 THEN {_kernel_sql('x', 'g', 'w')} ELSE (x = g)::INT::DOUBLE END)), 0)) / (k + greatest(options, 1)))
  - ln((1 + greatest(coalesce(everywhere, 0) - coalesce(list_sum(list_transform(good, lambda g: CASE WHEN options = 0 THEN {_kernel_sql('x', 'g', 'v')} ELSE (x = g)::INT::DOUBLE END)), 0), 0)) / (n - k + greatest(options, 1))) END AS gain
  FROM drawn d LEFT JOIN every e ON e.study = d.study AND e.slot = d.slot AND e.c = d.c),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study, proposal, slot ORDER BY round(gain, 6) DESC, candidate) AS r FROM gain) WHERE r = 1)
SELECT study, CAST(proposal AS INT) AS proposal, parameter, round(CASE slot WHEN 0 THEN exp(ln(1e-4::DOUBLE) + x * (ln(1e-1::DOUBLE) - ln(1e-4::DOUBLE))) WHEN 1 THEN round_even(1 + x * 7, 0) END, 8) AS number,
  CASE WHEN slot = 2 THEN ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][CAST(x AS INT) + 1] END AS option, round(gain, 6) AS gain FROM best"""


@query("v06_tpe_proposals", PROPOSE_SQL)
def v06_proposals(spark, sf_dir):
    asked = tuning.propose(trials_of(spark, sf_dir), SPACE, PROPOSALS, draw=tuning.residue_draw(SEED), startup=STARTUP)
    return asked.withColumn("number", F.round("number", 8))


FRONT_SQL = f"WITH {TRIALS_SQL} SELECT study, trial_id, value, other FROM t a WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t b WHERE b.study = a.study AND b.value >= a.value AND b.other >= a.other AND (b.value > a.value OR b.other > a.other))"


@query("v06_pareto_front", FRONT_SQL)
def v06_front(spark, sf_dir):
    return tuning.pareto_front(trials_of(spark, sf_dir), ("value", "other")).select("study", "trial_id", "value", "other")


FRONT3_SQL = FRONT_SQL.replace("SELECT study, trial_id, value, other FROM", "SELECT study, trial_id, value, other, layers FROM").replace("AND (b.value", "AND b.layers >= a.layers AND (b.layers > a.layers OR b.value")


@query("v06_pareto_front_three", FRONT3_SQL)
def v06_front_three(spark, sf_dir):
    return tuning.pareto_front(trials_of(spark, sf_dir), ("value", "other", "layers")).select("study", "trial_id", "value", "other", "layers")


def reports_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as what trials report: the order is the trial, the line the step, the customer the study."""
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trial_id"), F.col("l_linenumber").alias("step"), ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber") * 5) % 101).cast("double").alias("value"))
    # Lines of one order and number are summed, as a trial reports a step once.
    once = lines.groupBy("trial_id", "step").agg(F.sum("value").alias("value"))
    return once.join(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_custkey").alias("study")), "trial_id")


_BUDGETS = tuning._budgets(3, 2)


def _band_sql() -> str:
    edges = [sum(_BUDGETS[: i + 1]) for i in range(3)]
    base = f"""WITH s AS (SELECT l_orderkey AS trial_id, l_linenumber AS step, sum(CAST((l_partkey * 7 + l_suppkey * 13 + l_linenumber * 5) % 101 AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2),
r AS (SELECT o_custkey AS study, s.* FROM s JOIN orders ON o_orderkey = trial_id),
x0 AS (SELECT study, trial_id, max(step) AS reached, {', '.join(f'max_by(value, step) FILTER (WHERE step <= {k}) AS v{i}, first(step ORDER BY value DESC, step) FILTER (WHERE step <= {k}) AS rose{i}' for i, k in enumerate((1, 2, 4)))},
  CASE WHEN trial_id % {edges[2]} >= {edges[1]} THEN 2 WHEN trial_id % {edges[2]} >= {edges[0]} THEN 1 ELSE 0 END AS bracket, true AS alive, 0 AS rungs, CAST(NULL AS INT) AS last_step, false AS stopped FROM r GROUP BY study, trial_id)"""
    for i, k in enumerate((1, 2, 4)):
        base += f""", y{i} AS (SELECT *, alive AND bracket <= {i} AND reached >= {k} AS here FROM x{i}),
z{i} AS (SELECT *, row_number() OVER (PARTITION BY study, bracket, here ORDER BY v{i} DESC NULLS LAST, trial_id) <= greatest(1, floor(count(*) OVER (PARTITION BY study, bracket, here) / 2::DOUBLE)) OR {k} - rose{i} < 1 AS goes FROM y{i}),
x{i + 1} AS (SELECT * EXCLUDE (here, goes, alive, rungs, last_step, stopped), alive AND NOT (here AND NOT goes AND {i} < 2) AND reached >= {k} AS alive, rungs + here::INT AS rungs, CASE WHEN here THEN {k} ELSE last_step END AS last_step, stopped OR (here AND NOT goes AND {i} < 2) AS stopped FROM z{i})"""
    return base + " SELECT study, trial_id, CAST(bracket AS INT) AS bracket, CAST(rungs AS INT) AS rungs, CAST(last_step AS INT) AS last_step, stopped FROM x3"


@query("v06_hyperband", _band_sql())
def v06_hyperband(spark, sf_dir):
    return tuning.hyperband(reports_of(spark, sf_dir), least=1, most=4, eta=2, patience=1)
