import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from genoframe.llm import exactdedup as X
from genoframe.llm import queries


def expected(rows):
    """(key, keep_id, group_size, kept, digest) of (key, text) rows; one row of a group is kept."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()].append(key)
    out = []
    for sha, keys in groups.items():
        order = sorted(keys, key=lambda k: (k is None, k or 0))
        out += [(k, order[0], len(keys), at == 0, sha) for at, k in enumerate(order)]
    return sorted(out, key=str)


def got(frame, key="doc_id"):
    return sorted(((r[key], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 20_000])
def test_hash_is_perfect_and_minimal(n):
    words = np.random.default_rng(n).integers(0, 2**63, (n, 4)).astype(np.uint64)
    built = X.PerfectHash.build(words)
    assert sorted(built.slots(words)) == list(range(n)) and built.n == n
    again = X.PerfectHash.load(*built.dump())
    assert (again.slots(words) == built.slots(words)).all()
    strangers = again.slots(words + np.uint64(1))
    assert ((strangers >= -1) & (strangers < max(n, 1))).all()


def test_hash_parts_digests_that_share_most_words():
    words = np.zeros((50, 4), np.uint64)
    words[:, 3] = np.arange(50)
    assert sorted(X.PerfectHash.build(words).slots(words)) == list(range(50))


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_edge_cases_wherever_history_ends(spark, odd_documents, share):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert got(X.duplicates(odd_documents, history_share=share)) == expected(rows)
    assert sum(r[3] for r in expected(rows)) == len({r[4] for r in expected(rows)})


def test_empty_table_and_clashing_names(spark, odd_documents, no_documents):
    assert X.duplicates(no_documents).count() == 0
    clashing = odd_documents.selectExpr("doc_id", "text", "1 AS key", "2 AS row", "3 AS digest", "4 AS whole", "5 AS winner", "6 AS keep", "7 AS shard", "8 AS group_size")
    kept = X.unique(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == len({e[4] for e in expected([(r["doc_id"], r["text"]) for r in odd_documents.collect()])})


def test_hot_text_and_the_joined_rest(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT_SHARE", 4)
    monkeypatch.setattr(X, "SHARD_ROWS", 16)
    rows = [(i, "the same" if i % 3 else f"text {i % 100}") for i in range(600)]
    assert got(X.duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == expected(rows)


def test_arrivals_against_an_index_of_earlier_documents(spark):
    old = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    index = X.build_index(X._staged(old, "doc_id", "text", False), 8)
    assert index.count() <= 8 and sum(r["n"] for r in index.collect()) == 100
    new = spark.createDataFrame([(1000 + i, f"text\t {i // 2}") for i in range(180, 220)], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in X.arrivals(new, index, 8).collect())
    assert kept == [1200 + 2 * i for i in range(10)]


def test_query_over_the_table(spark, sf):
    documents = pd.read_parquet(f"{sf}/documents.parquet")
    assert got(queries.op11_exact_dedup(spark, sf)) == expected(list(zip(documents["doc_id"].tolist(), documents["text"].tolist(), strict=True)))


def test_query_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    theirs = con.execute(queries.OP11_SQL).df()
    ours = queries.op11_exact_dedup(spark, sf).toPandas()[theirs.columns.tolist()]
    assert sorted(map(tuple, ours.values.tolist())) == sorted(map(tuple, theirs.values.tolist()))
