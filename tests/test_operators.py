"""Hand-computed cases and invariants of the operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from genoframe.operators import compare, encode, evaluate, impute, learned, mask, phylo, popgen, trees
from genoframe.operators.clusters import dbscan, knee, silhouette
from genoframe.sources.tree import Tree, parse_newick, tree_nodes, tree_tips

CELLS = "sample_id long, locus_id long, pop_id int, g int"


@pytest.fixture(scope="module")
def tiny(spark):
    """Four samples, six loci: all missing, monomorphic, a tie, one het, one call, ordinary."""
    columns = [[None] * 4, [0, 0, 0, 0], [0, 2, 2, 0], [0, 1, 0, None], [None, None, 1, None], [0, 1, 2, 1]]
    return spark.createDataFrame([(s, j, s % 2, c[s]) for j, c in enumerate(columns) for s in range(4)], CELLS)


def by_locus(df):
    return {r["locus_id"]: r for r in df.collect()}


def test_modes_and_fallback(tiny):
    modes = {k: r["mode"] for k, r in by_locus(impute.locus_mode(tiny)).items()}
    assert modes == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    filled = impute.fill_population_mode(tiny, impute.population_mode(tiny), impute.locus_mode(tiny)).collect()
    assert all(r["imputed"] is not None for r in filled)
    assert all(r["imputed"] == r["g"] for r in filled if r["g"] is not None)
    assert {(r["sample_id"], r["imputed"]) for r in filled if r["locus_id"] == 4} == {(0, 1), (1, 1), (2, 1), (3, 1)}


def test_statistics_edges(tiny):
    s = by_locus(popgen.locus_statistics(popgen.genotype_counts(tiny)))
    assert s[0]["sample_size"] == 0 and s[0]["missingness"] == 1.0 and s[0]["maf"] is None and s[0]["hd"] is None and s[0]["theta_watt"] == 0.0
    assert s[1]["seg_sites"] == 0 and s[1]["maf"] == 0.0 and s[1]["tajima_d"] is None and s[1]["f_inbreeding"] is None
    assert s[3]["singletons"] == 1 and s[3]["hetz_positions"] == 1
    assert s[4]["sample_size"] == 1 and s[4]["theta_watt"] == 1.0 and s[4]["tajima_d"] is None and s[4]["he"] == 1.0
    assert s[5]["he"] == pytest.approx(0.5 * 8 / 7, abs=1e-9) and s[5]["hap"] == 3
    a1 = sum(1 / i for i in range(1, 8))
    e1 = (9 / 21 - 1 / a1) / a1
    assert s[5]["tajima_d"] == pytest.approx((4 / 7 - 1 / a1) / e1**0.5, abs=1e-8)


def test_zns_equals_numpy(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, (12, 7))
    g[:, 2] = 1
    cells = spark.createDataFrame([(int(s), int(j), 0, int(g[s, j])) for s in range(12) for j in range(7)], CELLS)
    r = np.corrcoef(np.delete(g, 2, axis=1).T)
    want = (r[np.triu_indices(6, 1)] ** 2).mean()
    for block in (2, 50):
        got = popgen.kelly_zns(cells, block=block).collect()[0]
        assert got["pairs"] == 15 and got["zns"] == pytest.approx(want, abs=1e-7)
    assert popgen.kelly_zns(cells, max_loci=3).collect()[0]["zns"] is None


def test_guard_and_disjoint_masks(tiny):
    masked = mask.guard(mask.mask_random(tiny, 1.1, F.lit(0.5))).collect()
    kept = {r["locus_id"] for r in masked if r["g"] is not None and not r["simulated"]}
    assert kept == {1, 2, 3, 4, 5}
    assert not [r for r in masked if r["g"] is None and r["simulated"]]
    with pytest.raises(Exception, match="overlap"):
        mask.mask_summary(tiny.withColumn("simulated", F.lit(True))).collect()


def test_exact_mask_counts(tiny):
    u = mask.draw(1, "sample_id", "locus_id")
    assert mask.mask_exact(tiny, 5, u).where("simulated").count() == 5
    assert mask.mask_inverse_genotype(tiny, 0.5, u).where("simulated").count() == 8


def test_split_explicit_and_three(spark):
    samples = spark.range(20).withColumnRenamed("id", "sample_id")
    with pytest.raises(IndexError):
        mask.split_explicit(samples, [99])
    parts = {r["part"]: r["count"] for r in mask.split_three(samples, 0.4, mask.sample_draw(1)).groupBy("part").count().collect()}
    assert parts == {"train": 12, "test": 4, "val": 4}
    with pytest.raises(ValueError):
        mask.split_three(samples.limit(3), 0.4, mask.sample_draw(1))


def test_decode_rules(spark):
    loci = spark.createDataFrame([(0, "A", "C"), (1, "R", "T"), (2, "A", "C,G"), (3, None, "G"), (4, "A", None), (5, None, None), (6, "A", "A"), (7, "N", "N")], "locus_id long, ref string, alt string")
    counts = spark.createDataFrame([(1, "G", 5), (1, "A", 2), (1, "T", 3), (2, "A", 4), (2, "G", 3), (2, "C", 1), (3, "G", 4), (3, "T", 1), (4, "A", 2), (4, "C", 2), (4, "T", 2), (7, "C", 3), (7, "A", 3)], "locus_id long, base string, n long")
    got = {r["locus_id"]: (r["ref"], r["alt"]) for r in encode.repair_alleles(loci, counts).collect()}
    assert got[0] == ("A", "C") and got[1] == ("G", "T") and got[2] == ("A", "G")
    assert got[3][1] == "G" and got[4] == ("A", "C") and got[5] == ("N", "N") and got[7] == ("A", "C")
    calls = spark.range(4).select(encode.decode_012(F.when(F.col("id") < 3, F.col("id")).cast("int"), F.lit("A"), F.lit("G")).alias("c")).collect()
    assert [r["c"] for r in calls] == ["A", "R", "G", "N"]


def test_scores_by_hand(spark):
    pairs = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (1, 1)], "y_true int, y_pred int")
    matrix = evaluate.confusion(pairs, (0, 1, 2))
    report = {r["label"]: r for r in evaluate.class_report(matrix).collect()}
    assert report["accuracy"]["f1"] == 0.75 and report["2"]["precision"] == 0.0 and report["1"]["f1"] == pytest.approx(0.8)
    assert {r["label"]: r["jaccard"] for r in evaluate.jaccard(matrix).collect()}["1"] == pytest.approx(2 / 3, abs=1e-9)
    ties = spark.createDataFrame([("a", True, 0.5), ("a", False, 0.5), ("a", True, 0.9), ("b", False, 0.1)], "cls string, positive boolean, score double")
    assert {r["cls"]: r["auc"] for r in evaluate.roc_auc(ties).collect()} == {"a": 0.75}
    assert {r["cls"]: r["ap"] for r in evaluate.average_precision(ties).collect()}["a"] == pytest.approx(0.5 + 0.5 * 2 / 3, abs=1e-9)


def test_bh_and_zero_spread(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "metric string, p double")
    got = {r["metric"]: r["p_bh"] for r in compare.adjust_bh(tests).collect()}
    assert got == {"a": pytest.approx(0.03), "b": pytest.approx(0.04), "c": pytest.approx(0.04), "d": None}
    flat = spark.createDataFrame([("x", "m", 1.0), ("y", "m", 1.0)], "dataset string, metric string, value double")
    assert compare.outliers(flat).count() == 0 and {r["z"] for r in compare.heatmap_z(flat).collect()} == {0.0}


TREE = "((a:0.1,b:0.1):0.2,(c:0.1,'d d':0.3):0.2);"


def test_tree(spark):
    tree = parse_newick(TREE)
    assert [tree.name[i] for i in tree.leaves] == ["a", "b", "c", "d d"]
    tips = tree_tips(tree_nodes(spark, tree)).groupBy("node_id").count().collect()
    assert sorted(r["count"] for r in tips) == [1, 1, 1, 1, 2, 2, 4]
    with pytest.raises(ValueError):
        parse_newick("((a,b);")


SKEWED = np.array([[-1.0, 0.5, 0.3, 0.2], [0.1, -0.6, 0.3, 0.2], [0.4, 0.4, -1.0, 0.2], [0.02, 0.02, 0.02, -0.06]])


def test_rates_are_repaired_and_scaled():
    q = phylo.repair_rates(SKEWED)
    law = phylo.stationary(q)
    assert law @ q == pytest.approx(np.zeros(4), abs=1e-12) and law.sum() == pytest.approx(1) and law[3] > 0.4
    assert -(law @ np.diag(q)) == pytest.approx(1.0) and q.sum(axis=1) == pytest.approx(np.zeros(4), abs=1e-12)
    stuck = phylo.repair_rates(np.array([[0, -3.0, np.nan, 1], [0, 0, 0, 0], [1, 1, 0, 1], [1, 1, 1, 0]]))
    assert (stuck - np.diag(np.diag(stuck)) >= 0).all() and stuck[1, 0] == pytest.approx(stuck[1, 2]) and stuck[1, 0] > 0


def test_transitions_are_exponentials():
    q, t = phylo.repair_rates(SKEWED), 0.7
    series, term = np.eye(4), np.eye(4)
    for k in range(1, 60):
        term = term @ q * t / k
        series = series + term
    assert phylo.transitions(q, np.array([t]), True)[0] == pytest.approx(series)
    ten = phylo.transitions(q, np.array([0.0, t]))
    assert ten[0] == pytest.approx(np.eye(10)) and ten.sum(axis=2) == pytest.approx(np.ones((2, 10)))
    assert ten[1][1, 0] == pytest.approx(series[0, 0] * series[1, 0])  # AC to AA
    assert ten[1][0, 1] == pytest.approx(2 * series[0, 0] * series[0, 1])  # AA to AC
    assert phylo.root_law(q) @ ten[1] == pytest.approx(phylo.root_law(q))


@pytest.mark.parametrize("haploid", [True, False])
def test_pruning_equals_enumeration(haploid):
    """Posteriors of a tip equal a sum over all states of the inner nodes, from the stationary law, for a skewed rate matrix."""
    tree = parse_newick("((a:0.3,b:0.2,d:0.6):0.1,c:0.4);")
    q, n = phylo.repair_rates(SKEWED), 4 if haploid else 10
    p = lambda t: phylo.transitions(q, np.array([t]), haploid)[0]
    e = np.ones((1, len(tree.parent), n))
    at = {name: i for i, name in enumerate(tree.name) if name}
    e[0, at["b"]], e[0, at["c"]], e[0, at["d"]] = np.eye(n)[1], np.eye(n)[2], np.eye(n)[1]
    moves = np.stack([p(max(t, 1e-10)) for t in tree.length])[:, None]
    got = phylo.posteriors(tree, e, moves, phylo.root_law(q, haploid))[0, at["a"]]
    want = np.zeros(n)
    for r in range(n):
        for i in range(n):
            for a in range(n):
                want[a] += phylo.root_law(q, haploid)[r] * p(0.4)[r, 2] * p(0.1)[r, i] * p(0.3)[i, a] * p(0.2)[i, 1] * p(0.6)[i, 1]
    assert got == pytest.approx(want / want.sum())


def test_many_children_do_not_underflow():
    n = 3000
    tree = parse_newick("(" + ",".join(f"t{i}:0.1" for i in range(n)) + ");")
    e = np.ones((1, n + 1, 4))
    e[0, 1 : n // 2] = np.eye(4)[1]
    q = phylo.repair_rates(SKEWED)
    moves = np.stack([phylo.transitions(q, np.array([max(t, 1e-10)]), True)[0] for t in tree.length])[:, None]
    assert phylo.posteriors(tree, e, moves, phylo.root_law(q, True))[0, n].argmax() == 1


def test_phylogeny_fills_from_sister(spark):
    tree = parse_newick(TREE)
    cells = spark.createDataFrame([("a", 0, None, "A", "G"), ("b", 0, 2, "A", "G"), ("c", 0, 0, "A", "G"), ("d d", 0, 0, "A", "G"), ("zz", 0, None, "A", "G")], "sample_name string, locus_id long, g int, ref string, alt string")
    got = {r["sample_name"]: r["imputed"] for r in phylo.impute_phylogeny(cells, tree, np.ones((4, 4))).collect()}
    assert got == {"a": 2, "b": 2, "c": 0, "d d": 0, "zz": None}


def test_clade_mask_hits_target(spark):
    tree = parse_newick(TREE)
    cells = spark.createDataFrame([(n, j, 0) for n in ("a", "b", "c", "d d") for j in range(10)], "sample_name string, locus_id long, g int")
    for weighted in (False, True):
        masked = phylo.mask_clades(spark, cells, tree, 0.25, weighted=weighted, seed=3)
        assert 5 <= masked.where("simulated").count() <= 10 and masked.count() == 40 and masked.columns == [*cells.columns, "simulated"]
    lone = parse_newick("((a:0,b:0):0,(c:0,'d d':5.0):0);")
    only = phylo.mask_clades(spark, cells, lone, 0.25, weighted=True, seed=3).where("simulated").select("sample_name").distinct().collect()
    assert [r[0] for r in only] == ["d d"]  # the one branch with a length
    with pytest.raises(ValueError):
        phylo.mask_clades(spark, cells.withColumn("sample_name", F.lit("q")), tree, 0.25)


def linked_cells(spark, samples=60, loci=8):
    """Loci that repeat one hidden factor, so that neighbours tell a missing call."""
    rng = np.random.default_rng(0)
    hidden = rng.integers(0, 3, samples)
    truth = np.stack([hidden if j < 6 else 2 - hidden for j in range(loci)], axis=1)
    g = truth.astype(object)
    for s, j in zip(rng.integers(0, samples, 40), rng.integers(0, loci, 40), strict=True):
        g[s, j] = None
    return truth, spark.createDataFrame([(s, j, 0, None if g[s, j] is None else int(g[s, j])) for s in range(samples) for j in range(loci)], CELLS)


@pytest.mark.parametrize("name", ["factors", "forest", "boosting", "autoencoder", "vae", "nlpca", "ubp"])
def test_learned_imputers(spark, name):
    truth, cells = linked_cells(spark)
    if name == "factors":
        filled = learned.fill_factors(cells)
    elif name in ("forest", "boosting"):
        filled = learned.fill_chained(cells, plan=trees.Plan(name, trees=25, depth=4, leaf=3.0), neighbours=3, rounds=1)
    else:
        filled = learned.fill_neural(cells, learned.NeuralConfig(name, epochs=120, patience=200))
    rows = filled.collect()
    assert len(rows) == truth.size and all(r["imputed"] is not None for r in rows)
    assert all(r["imputed"] == r["g"] for r in rows if r["g"] is not None)
    missing = [r for r in rows if r["g"] is None]
    right = np.mean([r["imputed"] == truth[r["sample_id"], r["locus_id"]] for r in missing])
    assert right > (0.9 if name in ("forest", "boosting") else 0.55)


def test_focal_gradient():
    rng = np.random.default_rng(1)
    logits, target, w = rng.normal(size=(4, 5, 3)), rng.integers(-1, 3, (4, 5)), np.array([1.0, 2.0, 0.5])
    for gamma in (0.0, 1.0, 2.0):
        _, grad = learned.focal_loss(logits, target, w, gamma)
        for at in ((0, 0, 1), (3, 4, 2), (2, 1, 0)):
            step = np.zeros_like(logits)
            step[at] = 1e-5
            slope = (learned.focal_loss(logits + step, target, w, gamma)[0] - learned.focal_loss(logits - step, target, w, gamma)[0]) / 2e-5
            assert grad[at] == pytest.approx(slope, abs=1e-6)
    assert learned.focal_loss(logits, np.full((4, 5), -1), w, 1.0)[0] == 0.0
    assert learned.kl_to_unit(np.zeros((3, 2)), np.zeros((3, 2))) == 0.0


def test_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2)), [[50, 50]]])
    labels = dbscan(x, 1.0, 3)
    assert sorted(np.unique(labels, return_counts=True)[1]) == [1, 20, 20] and silhouette(x, labels) > 0.9
    assert knee(np.array([0.0, 0.1, 0.2, 5.0])) == 0.2


def test_large_hypergeometric_special_functions():
    from genoframe.functions.special import f_survival, incomplete_beta

    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert f_survival(4.0, 1, 1e9) == pytest.approx(0.0455, abs=1e-4)


def test_pair_sums_equal_plain_sums(spark):
    """Tiles of any size: loci and samples that lie in different tiles, samples without a row, ids with gaps."""
    rng = np.random.default_rng(4)
    rows = [(int(s) * 3 - 20, int(locus) * 5 - 7, float(x)) for s in range(30) for locus, x in enumerate(rng.integers(0, 3, 14)) if rng.random() < 0.6]
    cells = spark.createDataFrame(rows, "sample_id long, locus_id long, x double")
    want = {}
    for s, l1, x in rows:
        for t, l2, y in rows:
            if s == t and l1 < l2:
                n, total = want.get((l1, l2), (0, 0.0))
                want[l1, l2] = (n + 1, total + x * y)
    for loci, samples in ((64, 4096), (4, 5), (7, 1)):
        got = {(r["l1"], r["l2"]): (r["n"], r["s"]) for r in popgen.pair_sums(cells, "x", loci=loci, samples=samples).collect()}
        assert len(got) == 14 * 13 // 2 and {k: v for k, v in got.items() if v[0]} == want
    assert popgen.pair_sums(cells.where("false"), "x").count() == 0


def test_macro_area_has_two_contracts(spark):
    scores = spark.createDataFrame([("a", True, 0.9), ("a", False, 0.1), ("b", False, 0.2), ("b", False, 0.3)], "cls string, positive boolean, score double")
    assert evaluate.macro_roc_auc(scores, single_class="drop").collect()[0]["auc"] == 1.0
    with pytest.raises(Exception, match="without positive"):
        evaluate.macro_roc_auc(scores).collect()
    given = [([0.6, 0.3, 0.1], 0), ([0.1, 0.4, 0.5], 1), ([0.0, 1.0, 0.0], 2)]
    rows = [(str(c), y == c, p[c]) for p, y in given for c in range(3)]
    assert evaluate.macro_roc_auc(spark.createDataFrame(rows, "cls string, positive boolean, score double")).collect()[0]["auc"] == pytest.approx(0.5)


def test_many_clades_are_taken_in_linear_time():
    """As the fold over an array says; 400,000 clades of one tip each, half of them taken."""
    def fold(sizes, share):
        got, taken = 0, []
        for i, n in enumerate(sizes):
            if got < share and (got == 0 or got + n <= share * 1.5):
                got, taken = got + n, [*taken, i]
        return taken

    rng = np.random.default_rng(5)
    for share in (0, 1, 7, 60):
        sizes = rng.integers(1, 12, 40)
        assert phylo.take_clades(sizes, share).tolist() == fold(sizes.tolist(), share)
    assert len(phylo.take_clades(np.ones(400_000, np.int64), 200_000)) == 200_000


def test_a_large_tree_keeps_tasks_small(spark, monkeypatch):
    """Equal branches share a matrix, and blocks of loci shrink as the tree grows: a call held a matrix for each node and locus."""
    seen = []
    whole = phylo.posteriors
    monkeypatch.setattr(phylo, "posteriors", lambda tree, emissions, moves, *more: seen.append((emissions.size, moves.size)) or whole(tree, emissions, moves, *more))
    tree = Tree((-1, *[0] * 3000), ("", *[f"s{i}" for i in range(3000)]), (0.0, *[0.1] * 3000))
    frame = pd.DataFrame({"sample_name": ["s1", "s2", "s3"], "locus_id": [1, 1, 1], "g": [0.0, None, 2.0], "ref": "A", "alt": "C"})
    cells = spark.createDataFrame([("s1", 1, 0, "A", "C")], "sample_name string, locus_id long, g int, ref string, alt string")
    monkeypatch.setattr(type(cells), "groupBy", lambda self, *_: type("G", (), {"applyInPandas": staticmethod(lambda run, _: run(frame))})())
    filled = phylo.impute_phylogeny(cells, tree, np.ones((4, 4)))
    assert filled["imputed"].tolist()[::2] == [0, 2] and filled["imputed"][1] in (0, 1, 2)
    assert seen and all(m <= 2 * 64 * 100 for _, m in seen)
