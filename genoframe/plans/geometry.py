"""Neighbours, knees, silhouettes and components over embeddings and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.operators import components, neighbours
from genoframe.plans.genotypes import training
from genoframe.plans.registry import query
from genoframe.session import read_table

#: Components are taken as multiples of 1/256, so that sums are exact in any order.
POINTS_SQL = "e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)) / 256) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours.usable(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(256.0)) / F.lit(256.0)))


NEAR_SQL = f"WITH {POINTS_SQL}, d AS (SELECT a.id, b.id AS neighbour, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM e a JOIN e b ON a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d2, 9), neighbour) AS rank FROM d)"


@query("t06_nearest_neighbours", f"{NEAR_SQL} SELECT id, CAST(rank AS INT) AS rank, neighbour, round(sqrt(round(d2, 9)), 6) AS distance FROM k WHERE rank <= 5")
def t06(spark, sf_dir):
    return neighbours.nearest(points_of(spark, sf_dir), 5).select("id", F.col("rank").cast("int").alias("rank"), "neighbour", F.round("distance", 6).alias("distance"))


@query("w07_knee", f"""{NEAR_SQL}, s AS (SELECT sqrt(round(d2, 9)) AS d FROM k WHERE rank = 4), r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos, count(*) OVER () AS n, min(d) OVER () AS low, max(d) OVER () AS high FROM s),
h AS (SELECT d, pos, round((d - low) / (high - low + 1e-9::DOUBLE) - pos / greatest(n - 1, 1)::DOUBLE, 12) AS above FROM r) SELECT round(d, 9) AS knee FROM h ORDER BY above DESC, pos LIMIT 1""")
def w07(spark, sf_dir):
    return neighbours.knee(neighbours.nearest(points_of(spark, sf_dir), 4).where("rank = 4")).select(F.round("knee", 9).alias("knee"))


@query("f11_silhouette", f"""WITH {POINTS_SQL}, d AS (SELECT a.id, a.label, b.label AS other, sum(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS total, count(*) AS n FROM e a CROSS JOIN e b GROUP BY a.id, a.label, b.label),
s AS (SELECT id, label, max(n) FILTER (WHERE label = other) AS n, max(total / greatest(n - 1, 1)) FILTER (WHERE label = other) AS a, min(total / n) FILTER (WHERE label <> other) AS b FROM d GROUP BY id, label)
SELECT label, count(*) AS n, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette FROM s GROUP BY label""")
def f11(spark, sf_dir):
    scored = neighbours.silhouettes(points_of(spark, sf_dir))
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("silhouette"), 9).alias("silhouette"))


@query("v05_principal_components")
def v05(spark, sf_dir):
    cells = training(spark, sf_dir)
    found = components.principal_components(cells.withColumn("learn", ~F.col("is_test")), 3, train="learn", oversample=60, rounds=12)
    return found.places.select("sample_id", *[F.round(F.col("places")[i], 5).alias(f"pc{i + 1}") for i in range(len(found.singular))])
