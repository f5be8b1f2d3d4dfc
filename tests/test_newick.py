"""Trees parsed in Spark against the plain parser."""

import pytest

from genoframe.sources import newick
from genoframe.sources.tree import parse_newick

TEXTS = ["(A:0.1,B:0.2,(C:0.3,D:0.4)E:0.5)F;", "A;", "A:0.5;", "('x y':1,'it''s':2)'r o';", "(,);", "(:0.1,:0.2)r;", "((a,b),(c,d),(e,(f,g)h:3)):7;", "(a[note (,)]:1 , b : 2e-3 ) ;", "((((a))))root;", "(A,B)C; (D,E)F;"]


def rows(frame):
    return {(r["tree_id"], r["node_id"]): r for r in frame.collect()}


def test_nodes_are_the_plain_parsers(spark):
    nodes = rows(newick.parse(spark.createDataFrame(list(enumerate(TEXTS)), "tree_id int, newick string").repartition(3)))
    for i, text in enumerate(TEXTS):
        plain = parse_newick(text)
        own = [nodes[i, n] for n in range(len(plain.parent))]
        assert (i, len(plain.parent)) not in nodes
        assert [r["parent_id"] if r["parent_id"] is not None else -1 for r in own] == list(plain.parent), text
        assert [r["name"] for r in own] == list(plain.name) and [r["branch_len"] for r in own] == list(plain.length), text
        leaves = plain.leaves
        assert [n for n in range(len(own)) if own[n]["is_leaf"]] == leaves
        for n, below in enumerate(plain.tips_below()):
            assert sorted(plain.name[x] for x in leaves[own[n]["first"] : own[n]["last"] + 1]) == sorted(below)


def test_tips_below(spark):
    nodes = newick.parse(spark.createDataFrame([(1, "((a,b)x,(c)y)r;"), (2, "(a,q)z;")], "tree_id int, newick string"))
    named = {(r["tree_id"], r["node_id"]): r["name"] for r in nodes.collect()}
    found = sorted((r["tree_id"], named[r["tree_id"], r["node_id"]], r["tip"]) for r in newick.tips_below(nodes).collect())
    assert found == sorted([(1, "r", "a"), (1, "r", "b"), (1, "r", "c"), (1, "x", "a"), (1, "x", "b"), (1, "y", "c"), (1, "a", "a"), (1, "b", "b"), (1, "c", "c"), (2, "z", "a"), (2, "z", "q"), (2, "a", "a"), (2, "q", "q")])
    some = spark.createDataFrame([(1, 0)], "tree_id int, node_id int")
    assert sorted(r["tip"] for r in newick.tips_below(nodes, some).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("text", ["((a,b);", "(a,b));", "a)(b;"])
def test_wrong_brackets_fail(spark, text):
    with pytest.raises(Exception, match="unbalanced Newick"):
        newick.parse(spark.createDataFrame([(1, text)], "tree_id int, newick string")).collect()


def test_nothing_to_parse(spark):
    assert newick.parse(spark.createDataFrame([(1, None), (2, ""), (3, "  ")], "tree_id int, newick string")).count() == 0


def test_a_caterpillar_of_a_hundred_thousand_tips(spark):
    n = 100_000
    text = "(" * (n - 1) + "t0" + "".join(f",t{i})" for i in range(1, n)) + ";"
    nodes = newick.parse(spark.createDataFrame([(1, text)], "tree_id int, newick string")).cache()
    assert nodes.count() == 2 * n - 1
    assert nodes.selectExpr("max(depth)", "sum(CAST(last - first + 1 AS BIGINT))").collect()[0][:] == (n - 1, n + sum(range(2, n + 1)))
