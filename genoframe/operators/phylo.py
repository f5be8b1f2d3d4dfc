"""Phylogenetic imputation and clade masking."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.operators.relate import running_total
from genoframe.session import ship_package
from genoframe.sources.tree import Tree

#: The ten unordered genotypes of four bases, in order AA, AC, AG, AT, CC, CG, CT, GG, GT, TT.
GENOTYPES = [(i, j) for i in range(4) for j in range(i, 4)]
STATE = {pair: k for k, pair in enumerate(GENOTYPES)}
#: Loci that one task call handles together, at most, and their number times the tree's nodes (or one locus).
LOCUS_BLOCK, LOCUS_NODES = 64, 1 << 17


#: Ordered pairs of bases to genotypes: a row for each of AA, AC, AG, AT, CA, ... TT, a column for each genotype.
UNORDERED = np.array([[float(STATE[min(i, j), max(i, j)] == k) for k in range(len(GENOTYPES))] for i in range(4) for j in range(4)])


def stationary(q: np.ndarray) -> np.ndarray:
    """The law that a rate matrix leaves as it is: the solution of pi Q = 0 that sums to 1."""
    n = len(q)
    solved = np.linalg.lstsq(np.vstack([q.T, np.ones(n)]), np.append(np.zeros(n), 1.0), rcond=None)[0]
    solved = np.maximum(solved, 0.0)
    return solved / solved.sum() if solved.sum() > 0 else np.full(n, 1 / n)


def repair_rates(q: np.ndarray) -> np.ndarray:
    """A proper rate matrix: negative rates are 0, rows sum to 0, a state without exits leaves at 1e-8 in all, and the mean rate under the stationary law is 1."""
    rates = np.nan_to_num(np.array(q, float), posinf=0.0, neginf=0.0).clip(min=0.0)
    others = 1.0 - np.eye(len(rates))
    rates *= others
    stuck = rates.sum(axis=1) == 0
    rates[stuck] = 1e-8 * others[stuck] / (len(rates) - 1)
    generator = rates - np.diag(rates.sum(axis=1))
    mean = float(stationary(generator) @ rates.sum(axis=1))
    return generator / mean if mean > 0 else generator


def transitions(q: np.ndarray, times: np.ndarray, haploid: bool = False) -> np.ndarray:
    """Transition matrices of a proper rate matrix at each time: of four bases, or of ten genotypes whose two alleles change on their own.

    All times at once, from one decomposition. Genotypes average over the orders of
    their source and add up those of their target.
    """
    values, right = np.linalg.eig(q)
    bases = np.einsum("ik,tk,kj->tij", right, np.exp(np.multiply.outer(np.asarray(times, float), values)), np.linalg.inv(right)).real.clip(min=0.0)
    bases /= bases.sum(axis=2, keepdims=True)
    if haploid:
        return bases
    pairs = np.einsum("tik,tjl->tijkl", bases, bases).reshape(len(bases), 16, 16)
    return (UNORDERED / UNORDERED.sum(axis=0)).T @ pairs @ UNORDERED


def root_law(q: np.ndarray, haploid: bool = False) -> np.ndarray:
    """The stationary law of bases, or of genotypes of two independent bases."""
    bases = stationary(q)
    return bases if haploid else np.outer(bases, bases).reshape(-1) @ UNORDERED


def posteriors(tree: Tree, emissions: np.ndarray, moves: np.ndarray, root: np.ndarray, branch: np.ndarray | None = None) -> np.ndarray:
    """Posterior of each node's state before its own emission (for tips, what the rest of the tree says).

    ``emissions``: loci x nodes x states, ones where nothing is observed. ``moves``: nodes
    x loci x states x states, along the branch above each node; with ``branch``, the row of
    ``moves`` for each node, so that equal branches share one. What children say is
    summed as logarithms, and a child's siblings are the sum without its own: linear in
    children, and no product of many underflows.
    """
    loci, nodes, states = emissions.shape
    branch = np.arange(nodes) if branch is None else branch
    heard = np.zeros((loci, nodes, states))  # logarithms of what each node's children say
    said = np.zeros((loci, nodes, states))
    for i in range(nodes - 1, -1, -1):  # children come after their parents
        below = np.exp(heard[:, i] - heard[:, i].max(axis=1, keepdims=True)) * emissions[:, i]
        below /= np.maximum(below.sum(axis=1, keepdims=True), 1e-300)
        said[:, i] = np.log(np.maximum(np.einsum("lab,lb->la", moves[branch[i]], below), 1e-300))
        if tree.parent[i] >= 0:
            heard[:, tree.parent[i]] += said[:, i]
    above = np.empty((loci, nodes, states))
    for i in range(nodes):
        parent = tree.parent[i]
        if parent < 0:
            above[:, i] = root
            continue
        siblings = heard[:, parent] - said[:, i]
        rest = above[:, parent] * emissions[:, parent] * np.exp(siblings - siblings.max(axis=1, keepdims=True))
        came = np.einsum("la,lab->lb", rest, moves[branch[i]])
        above[:, i] = came / np.maximum(came.sum(axis=1, keepdims=True), 1e-300)
    return above


def impute_phylogeny(cells: DataFrame, tree: Tree, q: np.ndarray, rates: dict[int, float] | None = None, haploid: bool = False) -> DataFrame:
    """Missing calls from the posterior at their tip: the likeliest of 0, 1 and 2.

    The root follows the stationary law; a rate matrix is repaired first and scaled to
    a mean rate of 1 under it. Branches are 1e-10 long at least.
    ``cells``: ``sample_name``, ``locus_id``, ``g``, ``ref``, ``alt`` (one base each). Samples
    that are no tips keep their missing calls. Loci are independent: blocks of
    LOCUS_BLOCK, or fewer for large trees, go to one task call, with the tree and the matrix in the closure.
    """
    ship_package(cells.sparkSession)
    tips = {tree.name[i]: i for i in tree.leaves}
    base = {b: i for i, b in enumerate("ACGT")}
    rates = rates or {}
    lengths, branch = np.unique(np.maximum(np.array(tree.length, float), 1e-10), return_inverse=True)
    state = np.array([[STATE[min(a, b), max(a, b)] for b in range(4)] for a in range(4)])
    block = max(1, min(LOCUS_BLOCK, LOCUS_NODES // len(tree.parent)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        proper = repair_rates(q)
        frame = frame.reset_index(drop=True)
        loci, at = np.unique(frame["locus_id"], return_inverse=True)
        node = frame["sample_name"].map(tips)
        ref, alt = frame["ref"].map(base).astype(np.int64).to_numpy(), frame["alt"].map(base).astype(np.int64).to_numpy()
        states = np.stack([ref, ref, alt] if haploid else [state[ref, ref], state[ref, alt], state[alt, alt]], axis=1)
        emissions = np.ones((len(loci), len(tree.parent), 4 if haploid else 10))
        g, known = frame["g"], node.notna().to_numpy()
        place = node.fillna(-1).to_numpy().astype(np.int64)
        rows = np.nonzero(g.notna().to_numpy() & known)[0]
        rows = rows[~pd.Series(at[rows] * len(tree.parent) + place[rows]).duplicated(keep="last").to_numpy()]
        emissions[at[rows], place[rows]] = 0.0
        emissions[at[rows], place[rows], states[rows, g.to_numpy()[rows].astype(np.int64)]] = 1.0
        speeds, speed = np.unique([rates.get(int(x), 1.0) for x in loci], return_inverse=True)
        tables = transitions(proper, np.multiply.outer(lengths, speeds).reshape(-1), haploid)
        moves = tables.reshape(len(lengths), len(speeds), *tables.shape[1:])[:, speed]
        post = posteriors(tree, emissions, moves, root_law(proper, haploid), branch)
        asked = np.nonzero(g.isna().to_numpy() & known)[0]
        chance = np.take_along_axis(post[at[asked], place[asked]], states[asked], axis=1)
        if haploid:
            chance[:, 1] = 0.0
        filled = g.astype("Int32")
        filled.iloc[asked] = chance.argmax(axis=1)
        return frame[["sample_name", "locus_id"]].assign(imputed=filled)

    blocks = cells.select("sample_name", "locus_id", "g", "ref", "alt", F.floor(F.col("locus_id") / F.lit(float(block))).alias("b"))
    return blocks.groupBy("b").applyInPandas(lambda frame: run(frame), "sample_name string, locus_id long, imputed int")


def take_clades(sizes: np.ndarray, share: int) -> np.ndarray:
    """Places of the clades that are taken in turn until ``share`` is met; what would overshoot by half of it is passed over, unless it is the first. Linear."""
    got, taken = 0, []
    for i, size in enumerate(sizes.tolist()):
        if got >= share:
            break
        if not got or got + size <= share * 1.5:
            taken.append(i)
            got += size
    return np.array(taken, np.int64)


def mask_clades(spark: SparkSession, cells: DataFrame, tree: Tree, prop: float, *, weighted: bool = False, seed: int = 0) -> DataFrame:
    """``simulated`` for observed calls of whole clades, drawn for each locus; branch lengths weigh the draw if ``weighted``.

    Every locus orders all clades (nodes but the root) by exponential draws, -ln(u) over
    the branch's weight, and takes them in that order until its even share of the target
    is met; a clade that would overshoot by half of it is passed over, unless it is the
    first. What the draws go beyond the target is released by hash order, so the share
    is exact to the cell. No shared names fail. The tree is what a tree file holds and
    is broadcast; loci and cells stay in Spark.
    """
    ship_package(spark)
    order, ends = tree.intervals()
    tips = spark.createDataFrame([(place, tree.name[i]) for place, i in enumerate(order)], "place int, sample_name string")
    eligible = cells.where("g IS NOT NULL").join(F.broadcast(tips.select("sample_name")), "sample_name", "left_semi")
    found = eligible.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("locus_id").alias("loci")).collect()[0]
    if not found["n"]:
        raise ValueError("tree and samples share no names")
    target = round(prop * found["n"])
    share = -(-target // found["loci"])
    weights = {i: tree.length[i] if weighted and np.isfinite(tree.length[i]) and tree.length[i] > 0 else float(not weighted) for i, up in enumerate(tree.parent) if up >= 0}
    if not any(weights.values()):
        weights = dict.fromkeys(weights, 1.0)
    clades = spark.createDataFrame([(i, float(w), ends[i][1] - ends[i][0] + 1) for i, w in weights.items() if w > 0], "node int, w double, size long")
    u = (F.pmod(F.xxhash64("locus_id", "node", F.lit(seed)), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53))
    # A row for each locus and clade: the tree is small, and loci are dealt over tasks.
    drawn = eligible.select("locus_id").distinct().join(F.broadcast(clades)).withColumn("turn", -F.log(u) / F.col("w"))

    def taken_in_turn(table: pa.Table) -> pa.Table:
        turn, node, size = (table[c].to_numpy() for c in ("turn", "node", "size"))
        order = np.lexsort((size, node, turn))
        at = order[take_clades(size[order], share)]
        return pa.table([table["locus_id"].take(pa.array(at)), pa.array(node[at], pa.int32())], names=["locus_id", "node"])

    taken = drawn.groupBy("locus_id").applyInArrow(lambda t: taken_in_turn(t), "locus_id long, node int")
    # A clade is an interval of tips: only those of clades that were taken are spelled out.
    spans = spark.createDataFrame([(i, *ends[i]) for i in weights], "node int, first int, last int")
    spelled = taken.join(F.broadcast(spans), "node").select("locus_id", F.explode(F.sequence("first", "last")).alias("place")).distinct()
    chosen = spelled.join(F.broadcast(tips), "place").select("locus_id", "sample_name").withColumn("drawn", F.lit(True))
    marked = cells.join(chosen, ["locus_id", "sample_name"], "left").withColumn("simulated", F.coalesce("drawn", F.lit(False)) & F.col("g").isNotNull()).select(*cells.columns, "simulated")
    excess = marked.agg(F.count_if("simulated")).collect()[0][0] - target
    if excess <= 0:
        return marked
    # Only drawn calls are ranked; the others stay as they are.
    drawn_calls = marked.where("simulated").withColumn("freed", F.pmod(F.xxhash64("locus_id", "sample_name", F.lit(seed)), F.lit(1 << 53)).cast("double"))
    released = running_total(drawn_calls, "freed", F.lit(1), "place", ["locus_id", "sample_name"]).withColumn("simulated", F.col("place") > excess)
    return released.select(*cells.columns, "simulated").unionByName(marked.where("NOT simulated"))
