"""Imputers as objects: parameters, fit and transform, reports."""

import numpy as np
import pytest

from genoframe import imputers
from genoframe.plans import catalog
from genoframe.sources.tree import parse_newick


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in range(40):
        factor = int(rng.integers(0, 3))
        for locus in range(6):
            g = None if rng.random() < 0.15 else factor if locus % 2 else 2 - factor
            rows.append((s, f"s{s}", locus, s % 2, g, "A", "G"))
    return spark.createDataFrame(rows, "sample_id long, sample_name string, locus_id long, pop_id int, g int, ref string, alt string").cache()


@pytest.mark.parametrize("name", ["RefAllele", "MostFrequent", "AlleleFreq", "MatrixFactorization", "RandomForest", "GradientBoosting", "Autoencoder", "NLPCA"])
def test_every_missing_call_is_filled(cells, name):
    imputer = imputers.make(name, preset="fast")
    rows = imputer.fit_transform(cells).select("sample_id", "locus_id", "g", "imputed").collect()
    assert len(rows) == 240 and all(r["imputed"] in (0, 1, 2) and (r["g"] is None or r["imputed"] == r["g"]) for r in rows)


@pytest.mark.parametrize("by_populations", [False, True])
def test_decoded_calls_hold_no_missing_ones(cells, by_populations):
    imputer = imputers.make("ImputeMostFrequent", preset="fast", by_populations=by_populations).fit(cells)
    codes = {r["imputed"] for r in imputer.transform(decode=True).collect()}
    assert codes <= set("ACGTRYSWKM")
    assert imputer.transform(cells.where("sample_id < 3")).count() == 18


def test_report_of_a_linked_matrix_beats_modes(cells):
    accuracy = {}
    for name in ("MostFrequent", "RandomForest"):
        rows = imputers.make(name, preset="fast").report(cells, prop=0.3, test_size=0.5).collect()
        accuracy[name] = [r for r in rows if r["label"] == "accuracy"][0]
    assert accuracy["RandomForest"]["f1"] > accuracy["MostFrequent"]["f1"]


def test_parameters(tmp_path):
    forest = imputers.make("RandomForest")
    assert {"neighbours": 10, "rounds": 10, "trees": 300, "seed": 0}.items() <= forest.get_params().items() and forest.set_params(rounds=3).get_params()["rounds"] == 3
    (tmp_path / "c.yaml").write_text("preset: fast\nneighbours: '7'\n")
    given = imputers.make("RandomForest", document=str(tmp_path / "c.yaml"), seed=5).get_params()
    assert {"neighbours": 7, "rounds": 1, "trees": 30, "seed": 5}.items() <= given.items()
    assert imputers.make("GradientBoosting", learning_rate=0.3, depth=2).plan().rate == 0.3
    with pytest.raises(KeyError):
        imputers.make("RandomForest", nothing=1)
    with pytest.raises(KeyError):
        imputers.make("RandomForest", preset="hasty")
    with pytest.raises(KeyError):
        imputers.make("Nothing")
    with pytest.raises(RuntimeError):
        imputers.make("RefAllele").transform()


def test_run_order():
    assert imputers.run_order(["RefAllele", "ImputeVAE"]) == ("VAE", "RefAllele") and len(imputers.run_order()) == 6
    with pytest.raises(ValueError):
        imputers.run_order(["Nothing"])


def test_a_new_model_is_a_subclass(cells):
    @imputers.register("Always")
    class Always(imputers.RefAllele):
        def fill(self, cells):
            return cells.withColumn("imputed", imputers.F.coalesce("g", imputers.F.lit(2)))

    assert imputers.make("Always").fit_transform(cells).where("g IS NULL AND imputed != 2").count() == 0
    tree = parse_newick("(" + ",".join(f"s{i}:0.1" for i in range(40)) + ");")
    filled = imputers.make("Phylo", tree=tree, q=np.ones((4, 4))).fit_transform(cells)
    assert filled.count() == 240 and filled.where("imputed IS NULL OR imputed != coalesce(g, imputed)").count() == 0


def test_the_boosting_query_has_the_references_rounds(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(imputers.learned, "fill_chained", lambda cells, **options: asked.update(options) or cells.withColumn("imputed", imputers.F.lit(0)))
    catalog.QUERIES["i08_impute_boosting"](spark, "/root/testdata/sf0.001")
    assert asked["rounds"] == 10 and asked["plan"].trees == 100 and asked["neighbours"] == 10
