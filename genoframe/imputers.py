"""Imputers as objects: parameters with presets, ``fit`` on cells, ``transform`` of cells, a report on hidden calls.

Every imputer takes cells (``sample_id``, ``locus_id``, ``pop_id``, ``g``; ``ref`` and ``alt`` where calls
are to be decoded) and adds ``imputed``; observed calls stay. A new model is a subclass
with a parameter class, ``learn`` and ``fill``; ``register`` makes it known by name.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any, ClassVar

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.config import effective_parameters
from genoframe.operators import evaluate, impute, learned, mask, phylo, trees
from genoframe.operators.encode import decode_012
from genoframe.session import cut
from genoframe.sources.tree import Tree

#: Every imputer class by its name, and by the name with "Impute" before it.
IMPUTERS: dict[str, type[Imputer]] = {}
# The order in which models run, whatever order they are asked for in.
RUN_ORDER = ("UBP", "NLPCA", "VAE", "Autoencoder", "MostFrequent", "RefAllele")


def register(name: str) -> Callable[[type[Imputer]], type[Imputer]]:
    def known(kind: type[Imputer]) -> type[Imputer]:
        kind.name = name
        IMPUTERS[name] = IMPUTERS[f"Impute{name}"] = kind
        return kind

    return known


def make(name: str, **options: Any) -> Imputer:
    """An imputer by name; unknown names raise KeyError."""
    return IMPUTERS[name](**options)


def run_order(names: Iterable[str] = ()) -> tuple[str, ...]:
    """The asked models in the order in which they run, all of them for none; unknown ones raise ValueError."""
    asked = {n.removeprefix("Impute") for n in names}
    if unknown := asked - set(RUN_ORDER):
        raise ValueError(f"no such models: {sorted(unknown)}")
    return tuple(n for n in RUN_ORDER if n in asked or not asked)


class Imputer:
    """The contract of all imputers."""

    name: ClassVar[str] = ""
    Parameters: ClassVar[type]
    presets: ClassVar[Mapping[str, Mapping[str, Any]]] = {"fast": {}, "balanced": {}, "thorough": {}}

    def __init__(self, parameters: Any = None, *, preset: str | None = None, document: Mapping[str, Any] | str | None = None, **overrides: Any):
        """Defaults < preset < document (a mapping, JSON or the path of a YAML or JSON file) < overrides; or ready parameters."""
        base = parameters if parameters is not None else self.Parameters()
        self.parameters = effective_parameters(base, self.presets, preset, document, overrides)
        self.fitted = False

    def get_params(self) -> dict[str, Any]:
        """The parameter set."""
        return dataclasses.asdict(self.parameters)

    def set_params(self, **changes: Any) -> Imputer:
        self.parameters = effective_parameters(self.parameters, {}, None, None, changes)
        return self

    def learn(self, cells: DataFrame) -> None:
        """What is taken from the cells fitted on; nothing for models that fit and fill at once."""

    def fill(self, cells: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit(self, cells: DataFrame) -> Imputer:
        self.learn(cells)
        self._cells, self.fitted = cells, True
        return self

    def transform(self, cells: DataFrame | None = None, *, decode: bool = False) -> DataFrame:
        """The cells (those fitted on, if none are given) with ``imputed``; ``decode`` makes it an IUPAC code, by ``ref`` and ``alt``."""
        if not self.fitted:
            raise RuntimeError(f"{self.name} is not fitted")
        filled = self.fill(self._cells if cells is None else cells)
        return filled.withColumn("imputed", decode_012(F.col("imputed"), F.col("ref"), F.col("alt"))) if decode else filled

    def fit_transform(self, cells: DataFrame, *, decode: bool = False) -> DataFrame:
        return self.fit(cells).transform(decode=decode)

    def report(self, cells: DataFrame, *, prop: float = 0.2, test_size: float = 0.2, seed: int = 0) -> DataFrame:
        """The class report of calls of test samples that are hidden, filled by a copy fitted on the other samples."""
        samples = mask.split_rows(cells.select("sample_id").distinct(), test_size, mask.draw(seed, "sample_id"))
        split = mask.evaluation_cells(mask.mask_random(cells.join(samples, "sample_id"), prop, mask.draw(seed + 1, "sample_id", "locus_id")))
        split = cut(split)
        other = type(self)(self.parameters).fit(split.where("NOT is_test").drop("is_test", "simulated", "evaluated"))
        hidden = split.withColumn("__true", F.col("g")).withColumn("g", F.when(~F.col("evaluated"), F.col("g")))
        filled = other.transform(hidden).withColumn("g", F.col("__true"))
        pairs = impute.predictions(filled)
        return evaluate.class_report(evaluate.confusion(pairs, [0, 1, 2]))


@dataclass(frozen=True)
class RefAlleleParameters:
    pass


@register("RefAllele")
class RefAllele(Imputer):
    """I01."""

    Parameters = RefAlleleParameters

    def fill(self, cells: DataFrame) -> DataFrame:
        return impute.fill_reference(cells)


@dataclass(frozen=True)
class MostFrequentParameters:
    by_populations: bool = False
    default: int = 0


@register("MostFrequent")
class MostFrequent(Imputer):
    """I02, I03."""

    Parameters = MostFrequentParameters

    def learn(self, cells: DataFrame) -> None:
        self.modes = cut(impute.locus_mode(cells, self.parameters.default))
        self.own = cut(impute.population_mode(cells)) if self.parameters.by_populations else None

    def fill(self, cells: DataFrame) -> DataFrame:
        if self.own is None:
            return impute.fill_mode(cells, self.modes, self.parameters.default)
        return impute.fill_population_mode(cells, self.own, self.modes, self.parameters.default)


@dataclass(frozen=True)
class AlleleFreqParameters:
    by_populations: bool = False
    default: int = 0
    seed: int = 0


@register("AlleleFreq")
class AlleleFreq(Imputer):
    """I04."""

    Parameters = AlleleFreqParameters

    def learn(self, cells: DataFrame) -> None:
        self.states = cut(impute.distribution(cells, self.parameters.by_populations))

    def fill(self, cells: DataFrame) -> DataFrame:
        return impute.fill_frequency(cells, self.states, mask.draw(self.parameters.seed, "sample_id", "locus_id"), self.parameters.default)


@dataclass(frozen=True)
class FactorParameters:
    rank: int = 2
    reg: float = 0.02
    iterations: int = 10
    seed: int = 1


@register("MatrixFactorization")
class MatrixFactorization(Imputer):
    """I05."""

    Parameters = FactorParameters
    presets: ClassVar = {"fast": {"iterations": 5}, "balanced": {}, "thorough": {"rank": 4, "iterations": 30}}

    def fill(self, cells: DataFrame) -> DataFrame:
        return learned.fill_factors(cells, **self.get_params())


@dataclass(frozen=True)
class PhyloParameters:
    haploid: bool = False


@register("Phylo")
class Phylo(Imputer):
    """Needs a tree and a rate matrix; site rates are 1 where not given."""

    Parameters = PhyloParameters

    def __init__(self, *args: Any, tree: Tree, q: np.ndarray, rates: dict[int, float] | None = None, **options: Any):
        super().__init__(*args, **options)
        self.tree, self.q, self.rates = tree, q, rates

    def fill(self, cells: DataFrame) -> DataFrame:
        guessed = phylo.impute_phylogeny(cells, self.tree, self.q, self.rates, self.parameters.haploid)
        return cells.join(guessed, ["sample_name", "locus_id"], "left")


@dataclass(frozen=True)
class ForestParameters:
    neighbours: int = 10
    rounds: int = 10
    trees: int = 300
    depth: int = 8
    #: Features that a node may ask; 0: the root of their number.
    features: int = 0
    leaf: float = 1.0
    bootstrap: bool = True
    seed: int = 0


@register("RandomForest")
class RandomForest(Imputer):
    """I07."""

    Parameters = ForestParameters
    presets: ClassVar = {"fast": {"rounds": 1, "neighbours": 5, "trees": 30}, "balanced": {}, "thorough": {"neighbours": 20, "trees": 500}}

    def plan(self) -> trees.Plan:
        p = self.parameters
        return trees.Plan("forest", p.trees, p.depth, p.features or None, p.leaf, bootstrap=p.bootstrap, seed=p.seed)

    def fill(self, cells: DataFrame) -> DataFrame:
        return learned.fill_chained(cells, plan=self.plan(), neighbours=self.parameters.neighbours, rounds=self.parameters.rounds)


@dataclass(frozen=True)
class BoostingParameters:
    neighbours: int = 10
    rounds: int = 10
    #: Boosting rounds; each has a tree for each class.
    trees: int = 100
    depth: int = 5
    learning_rate: float = 0.1
    leaf: float = 20.0
    l2: float = 0.0
    seed: int = 0


@register("GradientBoosting")
class GradientBoosting(RandomForest):
    """I08."""

    Parameters = BoostingParameters
    presets: ClassVar = {"fast": {"rounds": 1, "neighbours": 5, "trees": 20, "depth": 3}, "balanced": {}, "thorough": {"neighbours": 20, "trees": 300}}

    def plan(self) -> trees.Plan:
        p = self.parameters
        return trees.Plan("boosting", p.trees, p.depth, None, p.leaf, p.learning_rate, p.l2, seed=p.seed)


class Neural(Imputer):
    """``kind`` is the subclass's."""

    Parameters = learned.NeuralConfig
    presets: ClassVar = {"fast": {"epochs": 20}, "balanced": {}, "thorough": {"epochs": 2000, "patience": 100}}

    def fill(self, cells: DataFrame) -> DataFrame:
        return learned.fill_neural(cells, dataclasses.replace(self.parameters, kind=self.name.lower()))


for _name in ("Autoencoder", "VAE", "NLPCA", "UBP"):
    register(_name)(type(_name, (Neural,), {"__doc__": f"The {_name} model."}))
