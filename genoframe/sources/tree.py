"""Trees, rate matrices and site rates. A tree is small: it is parsed on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node_id INT, parent_id INT, name STRING, branch_len DOUBLE, is_leaf BOOLEAN, depth INT"


@dataclass(frozen=True)
class Tree:
    """Nodes in an order in which parents precede children: parent (-1 for the root), name, branch length."""

    parent: tuple[int, ...]
    name: tuple[str, ...]
    length: tuple[float, ...]

    @property
    def leaves(self) -> list[int]:
        inner = set(self.parent)
        return [i for i in range(len(self.parent)) if i not in inner]

    def tips_below(self) -> list[list[str]]:
        """Tip names under each node."""
        below: list[list[str]] = [[] for _ in self.parent]
        for leaf in self.leaves:
            at = leaf
            while at >= 0:
                below[at].append(self.name[leaf])
                at = self.parent[at]
        return below

    def intervals(self) -> tuple[list[int], list[tuple[int, int]]]:
        """Tips in an order in which those below any node stand together, and each node's first and last place in it. Linear in nodes."""
        children: list[list[int]] = [[] for _ in self.parent]
        for i, up in enumerate(self.parent):
            if up >= 0:
                children[up].append(i)
        order, ends, stack = [], [(0, 0)] * len(self.parent), [(i, False) for i, up in enumerate(self.parent) if up < 0]
        first = [0] * len(self.parent)
        while stack:
            node, done = stack.pop()
            if done:
                ends[node] = (first[node], len(order) - 1)
                continue
            first[node] = len(order)
            stack.append((node, True))
            if children[node]:
                stack += [(c, False) for c in reversed(children[node])]
            else:
                order.append(node)
        return order, ends


def parse_newick(text: str) -> Tree:
    """Newick, names quoted or not, lengths optional; comments in brackets are dropped."""
    tokens = re.findall(r"'(?:[^']|'')*'|[(),;:]|[^\s(),;:']+", re.sub(r"\[[^\]]*\]", "", text.strip()))
    parent, name, length = [-1], [""], [0.0]
    at, expect_length = 0, False
    for token in tokens:
        if token == "(":
            parent.append(at)
            name.append("")
            length.append(0.0)
            at = len(parent) - 1
        elif token == ",":
            parent.append(parent[at])
            name.append("")
            length.append(0.0)
            at = len(parent) - 1
        elif token == ")":
            at = parent[at]
            if at < 0:
                raise ValueError("unbalanced Newick")
        elif token == ";":
            break
        elif token == ":":
            expect_length = True
        elif expect_length:
            length[at], expect_length = float(token), False
        else:
            name[at] = token.strip("'").replace("''", "'")
    if at != 0:
        raise ValueError("unbalanced Newick")
    return Tree(tuple(parent), tuple(name), tuple(length))


def tree_nodes(spark: SparkSession, tree: Tree) -> DataFrame:
    """The tree as a table."""
    leaves, depth = set(tree.leaves), []
    for p in tree.parent:
        depth.append(0 if p < 0 else depth[p] + 1)
    return spark.createDataFrame([(i, p if p >= 0 else None, n, float(b), i in leaves, d) for i, (p, n, b, d) in enumerate(zip(tree.parent, tree.name, tree.length, depth, strict=True))], NODES)


def tree_tips(nodes: DataFrame) -> DataFrame:
    """``node_id``, ``tip``: every node with the tips below it, by joins up one level a round."""
    depth = nodes.agg(F.max("depth")).collect()[0][0] or 0
    parents = nodes.select(F.col("node_id").alias("n"), "parent_id")
    level = nodes.where("is_leaf").select("node_id", F.col("name").alias("tip"))
    found = level
    for _ in range(depth):
        level = level.join(parents, F.col("node_id") == F.col("n")).where("parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id"), "tip")
        found = found.unionByName(level)
    return found


def parse_qmatrix(text: str) -> np.ndarray:
    """A 4 x 4 rate matrix in the order A, C, G, T: a program's report (after "Rate matrix Q:") or a table with a header."""
    if "Rate matrix Q:" in text:
        rows = [line.split() for line in text.split("Rate matrix Q:", 1)[1].splitlines() if line.strip()][:4]
        order, values = [r[0] for r in rows], [[float(x) for x in r[1:5]] for r in rows]
    else:
        rows = [line.split() for line in text.splitlines() if line.strip()]
        order = rows[0][-4:]
        values = [[float(x) for x in r[-4:]] for r in rows[1:5]]
    at = [order.index(b) for b in "ACGT"]
    return np.array(values)[np.ix_(at, at)]


def parse_rates(text: str) -> list[float]:
    """Site rates, one to a line, or the second column of a table with comments."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    rows = [r for r in rows if r[0] != "Site"]
    return [float(r[1] if len(r) > 1 else r[0]) for r in rows]


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small file, from any store that Spark reads."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def read_tree(spark: SparkSession, tree: str | None, qmatrix: str | None, rates: str | None) -> tuple[Tree, np.ndarray, list[float]] | None:
    """All three files or none."""
    given = [x is not None for x in (tree, qmatrix, rates)]
    if not any(given):
        return None
    if not all(given):
        raise ValueError("tree, rate matrix and site rates come together")
    return parse_newick(read_text(spark, tree)), parse_qmatrix(read_text(spark, qmatrix)), parse_rates(read_text(spark, rates))
