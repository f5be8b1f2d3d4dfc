import duckdb
import numpy as np
import pandas as pd

from genoframe.llm import negatives as N
from genoframe.llm import queries

FIELDS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def got(frame):
    return sorted(tuple(r[f] for f in FIELDS) for r in frame.collect())


def test_against_brute_force_over_many_groups_and_tiles(spark):
    rng = np.random.default_rng(5)
    # Small whole numbers: many ties, zero and negative scores.
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in rng.integers(-3, 6, 4)]) for i in range(400)]
    table = N.usable(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5), scale=1.0)
    for groups in (1, 7):
        mined = N.mine(table.where("id % 9 = 0"), table, groups=groups, tile_rows=16, anchor_rows=8)
        assert got(mined) == N.brute_force(table.toPandas(), set(range(0, 400, 9)))


def test_blocks_of_scores_do_not_change_the_result(spark, monkeypatch):
    rows = [(i, i % 3, [float(i % 11), float(i % 7)]) for i in range(120)]
    table = N.usable(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), scale=1.0)
    whole = got(N.mine(table, table))
    monkeypatch.setattr(N, "SORTED_CELLS", 50)
    assert got(N.mine(table, table)) == whole == N.brute_force(table.toPandas(), set(range(120)))


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5]), (3, 2, [0.25, 0.25]), (4, None, [1.0, 1.0]), (5, 1, None), (6, 1, [None, 1.0]), (7, 1, [nan, 1.0]), (8, 1, [inf, 1.0]), (None, 1, [1.0, 1.0]), (9, 1, []), (10, 2, []), (11, 1, [1.0]), (2, 2, [0.5, 0.5]), (0, 1, [1.0, 1.0])]
    table = N.usable(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "'x' AS id", "1 AS v", "2 AS positives"))
    found = got(N.mine(table.where("id = 0"), table))
    # One anchor for the repeated id, its copy no positive of it; the repeated negative twice.
    assert found == [(0, 1, 1, 2, 98304, 65536), (0, 1, 2, 2, 98304, 65536), (0, 1, 3, 3, 98304, 32768)]
    assert got(N.mine(table.where("id = 11"), table)) == []
    assert got(N.mine(table.where("id = 9"), table)) == []
    assert N.mine(table.where("false"), table).count() == 0 == N.mine(table, table.where("false")).count()


def test_query_agrees_with_sql_and_brute_force(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    theirs = con.execute(queries.OP13_SQL).df()
    ours = got(queries.op13_hard_negatives(spark, sf))
    assert ours == sorted(map(tuple, theirs[list(FIELDS)].values.tolist()))
    frame = N.usable(spark.read.parquet(f"{sf}/embeddings.parquet")).toPandas()
    frame["label"] = np.where(frame["id"] % 7 == 0, (frame["label"] + 1) % 10, frame["label"])
    assert ours == N.brute_force(pd.DataFrame(frame), {int(i) for i in frame["id"] if i % 100 == 0})
