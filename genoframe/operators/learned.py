"""Iterative imputers: factorisation, chained trees, and small neural models in NumPy."""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.operators import trees
from genoframe.operators.components import exact_components, principal_components
from genoframe.operators.impute import fill_mode, locus_mode
from genoframe.operators.popgen import correlations, nearest_loci
from genoframe.session import cut, drop_cut, ship_package


def fill_factors(cells: DataFrame, *, rank: int = 2, reg: float = 0.02, iterations: int = 10, seed: int = 1) -> DataFrame:
    """Matrix factorisation by alternating least squares on codes + 1; a missing call takes the observed code of its locus nearest to the estimate.

    Cells whose sample or locus has no call take the locus's mode. The reference
    descends by gradient; the objective is of the same family, the numbers differ.
    """
    seen = cells.where("g IS NOT NULL").select(F.col("sample_id").cast("int").alias("sample_id"), F.col("locus_id").cast("int").alias("locus_id"), (F.col("g") + 1).cast("float").alias("rating"))
    model = ALS(rank=rank, regParam=reg, maxIter=iterations, userCol="sample_id", itemCol="locus_id", ratingCol="rating", coldStartStrategy="nan", seed=seed).fit(seen)
    missing = cells.where("g IS NULL").select(F.col("sample_id").cast("int").alias("sample_id"), F.col("locus_id").cast("int").alias("locus_id"))
    guess = model.transform(missing).select(F.col("sample_id").cast("long").alias("sample_id"), F.col("locus_id").cast("long").alias("locus_id"), F.nanvl(F.col("prediction").cast("double"), F.lit(None).cast("double")).alias("estimate"))
    codes = cells.where("g IS NOT NULL").groupBy("locus_id").agg(F.sort_array(F.collect_set("g")).alias("codes"))
    snapped = guess.join(codes, "locus_id", "left").withColumn("near", F.array_sort(F.transform("codes", lambda c: F.struct(F.abs(c + 1 - F.col("estimate")).alias("d"), c.alias("c")))))
    near = snapped.select("sample_id", "locus_id", F.when(F.col("estimate").isNotNull(), F.try_element_at("near", F.lit(1))["c"]).alias("snap"))
    joined = fill_mode(cells, locus_mode(cells)).withColumnRenamed("imputed", "by_mode").join(near, ["sample_id", "locus_id"], "left")
    return joined.withColumn("imputed", F.coalesce("g", "snap", "by_mode")).drop("snap", "by_mode")


# --- trees -------------------------------------------------------------------------


def fill_chained(cells: DataFrame, *, plan: trees.Plan | None = None, neighbours: int = 10, rounds: int = 10, train: str | None = None) -> DataFrame:
    """Each locus is predicted from its most correlated loci, over rounds, starting from modes.

    All loci of a round are fitted at once from the round before (Jacobi order), by
    ``trees``: 300 trees and 10 rounds by default. Neighbours are found once, from the
    calls. ``train`` names a boolean column of the rows to fit on. Observed calls stay.
    A locus of one class, or of fewer than five calls, keeps its mode.

    A sample is one row of a byte a locus, so a round goes over calls as arrays; what is
    exchanged are counts of patterns, and the missing calls with their patterns. A round
    that changes no call would be repeated by the next ones, so it is the last.
    """
    plan = plan or trees.Plan()
    if neighbours > trees.MOST_NEIGHBOURS:
        raise ValueError(f"at most {trees.MOST_NEIGHBOURS} neighbours")
    ship_package(cells.sparkSession)
    named = cut(cells.where("sample_id IS NOT NULL AND locus_id IS NOT NULL"))
    modes = locus_mode(named).orderBy("locus_id").toArrow()
    loci, mode = modes["locus_id"].to_numpy().astype(np.int64), modes["mode"].to_numpy().astype(np.int8)
    found = nearest_loci(correlations(named), neighbours).toArrow()
    # By locus and rank the place of the neighbour among loci; where there is none, a last place that never has a call.
    near = np.full((len(loci), neighbours), len(loci))
    near[np.searchsorted(loci, found["locus_id"].to_numpy()), found["rank"].to_numpy() - 1] = np.searchsorted(loci, found["neighbour"].to_numpy())
    shared = cells.sparkSession.sparkContext.broadcast((loci, mode, near))
    fit_on = F.col(train) if train else F.lit(True)
    code = F.when(F.col("g").isNull(), MISSING).when(fit_on, F.col("g")).otherwise(F.col("g") + UNFIT).cast("byte")
    lists = named.groupBy("sample_id").agg(F.collect_list(F.struct("locus_id", code.alias("g"))).alias("l"))
    now = cut(lists.mapInArrow(lambda batches: _started(batches, shared.value), _STATE))
    for _ in range(rounds):
        patterns = now.mapInArrow(lambda batches: _patterns(batches, shared.value, False), "locus_id long, code long, y int")
        counts = cut(patterns.groupBy("locus_id", "code", "y").agg(F.count(F.lit(1)).alias("n")))
        guesses = trees.predict(counts, plan, neighbours)
        asked = now.mapInArrow(lambda batches: _patterns(batches, shared.value, True), "sample_id long, locus_id long, code long")
        told = asked.join(guesses, ["locus_id", "code"]).groupBy("sample_id").agg(F.collect_list(F.struct("locus_id", F.col("imputed").cast("byte").alias("g"))).alias("l"))
        before, now = now, cut(now.drop("changed").join(told, "sample_id", "left").mapInArrow(lambda batches: _updated(batches, shared.value), _STATE))
        drop_cut(before)
        drop_cut(counts)
        if not now.agg(F.sum("changed")).collect()[0][0]:
            break
    guessed = now.mapInArrow(lambda batches: _guesses(batches, shared.value), "sample_id long, locus_id long, guess int")
    return named.join(guessed, ["sample_id", "locus_id"], "left").withColumn("imputed", F.coalesce("g", "guess")).drop("guess")


#: Bytes of a chained sample's calls: no cell, a missing call, and what is added to a call that is not fitted on.
ABSENT, MISSING, UNFIT = -1, 127, 64
_STATE = "sample_id long, calls binary, now binary, changed int"
#: Samples x loci whose patterns are worked out at once.
CHAINED_CELLS = 1 << 18


def _state(samples: pa.Array, calls: np.ndarray, now: np.ndarray, changed: np.ndarray) -> pa.RecordBatch:
    lines = [pa.array([line.tobytes() for line in part], pa.binary()) for part in (calls, now)]
    return pa.RecordBatch.from_arrays([samples, *lines, pa.array(changed.astype(np.int32))], names=["sample_id", "calls", "now", "changed"])


def _opened(batch: pa.RecordBatch, loci: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Samples of a batch some at a time, with their calls and what they are taken for by now."""
    step = max(1, CHAINED_CELLS // max(1, loci))
    for at in range(0, len(batch), step):
        part = batch.slice(at, step)
        yield part.column(0), *(np.frombuffer(b"".join(part.column(i).to_pylist()), np.int8).reshape(len(part), loci) for i in (1, 2))


def _started(batches: Iterator[pa.RecordBatch], shared: tuple) -> Iterator[pa.RecordBatch]:
    loci, mode, _ = shared
    for batch in batches:
        calls = dense_calls(batch.column(1), loci, ABSENT)[0]
        yield _state(batch.column(0), calls, np.where(calls == MISSING, mode, np.where(calls >= UNFIT, calls - UNFIT, calls)).astype(np.int8), np.zeros(len(calls)))


def _patterns(batches: Iterator[pa.RecordBatch], shared: tuple, missing: bool) -> Iterator[pa.RecordBatch]:
    """Patterns of neighbours of the calls that are asked or fitted on, or of missing ones with their samples; calls without neighbours have none."""
    loci, _, near = shared
    for batch in batches:
        for samples, calls, now in _opened(batch, len(loci)):
            wide = np.concatenate([now, np.full((len(now), 1), ABSENT, np.int8)], axis=1)
            code, any_near = np.zeros(now.shape, np.int64), np.zeros(now.shape, bool)
            for i in range(near.shape[1]):
                value = wide[:, near[:, i]]
                any_near |= value != ABSENT
                code += np.maximum(value, 0) * np.int64(trees.CODES**i)
            taken = any_near & ((calls == MISSING) if missing else (calls != ABSENT) & ((calls < UNFIT) | (calls == MISSING)))
            row, at = np.nonzero(taken)
            if missing:
                yield pa.RecordBatch.from_arrays([samples.take(pa.array(row)), pa.array(loci[at]), pa.array(code[taken])], names=["sample_id", "locus_id", "code"])
            else:
                y = calls[taken]
                yield pa.RecordBatch.from_arrays([pa.array(loci[at]), pa.array(code[taken]), pa.array(y.astype(np.int32), mask=y == MISSING)], names=["locus_id", "code", "y"])


def _updated(batches: Iterator[pa.RecordBatch], shared: tuple) -> Iterator[pa.RecordBatch]:
    loci = shared[0]
    for batch in batches:
        at = 0
        for samples, calls, now in _opened(batch, len(loci)):
            new = dense_calls(batch.column(3).slice(at, len(samples)), loci, ABSENT)[0]
            new = np.where(new == ABSENT, now, new)
            at += len(samples)
            yield _state(samples, calls, new, (new != now).sum(axis=1))


def _guesses(batches: Iterator[pa.RecordBatch], shared: tuple) -> Iterator[pa.RecordBatch]:
    loci = shared[0]
    for batch in batches:
        for samples, calls, now in _opened(batch, len(loci)):
            row, at = np.nonzero(calls == MISSING)
            yield pa.RecordBatch.from_arrays([samples.take(pa.array(row)), pa.array(loci[at]), pa.array(now[row, at].astype(np.int32))], names=["sample_id", "locus_id", "guess"])


# --- neural models -----------------------------------------------------------------


def layer_sizes(n: int, loci: int, latent: int, layers: int, alpha: float = 1.0) -> list[int]:
    """Hidden sizes: a base of alpha sqrt(n) sqrt(ln(1 + loci)), no wider than the input (three indicators a locus), multiples of 8, falling to above the latent size."""
    base = min(int(np.ceil(alpha * np.sqrt(n) * np.sqrt(np.log1p(loci)))), 3 * loci)
    sizes, floor = [], max(8, latent)
    for k in range(layers):
        size = max(floor + 8 * (layers - 1 - k), int(round(base * (1 - k / max(1, layers)) / 8)) * 8)
        sizes.append(min(size, sizes[-1] - 8) if sizes and size >= sizes[-1] else size)
    return [max(8, s) for s in sizes]


def focal_loss(logits: np.ndarray, target: np.ndarray, weights: np.ndarray, gamma: float) -> tuple[float, np.ndarray]:
    """Focal cross entropy and its gradient; targets below 0 take no part; 0 if there are none. Shapes (..., 3) and (...)."""
    z = logits - logits.max(axis=-1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=-1, keepdims=True)
    valid = target >= 0
    n = max(1, int(valid.sum()))
    t = np.where(valid, target, 0)
    hot = np.eye(3, dtype=p.dtype)[t]
    pt = np.clip((p * hot).sum(axis=-1), 1e-9, 1.0)
    w = (weights[t] * valid).astype(p.dtype)
    loss = -(w * (1 - pt) ** gamma * np.log(pt)).sum() / n
    slope = w * (gamma * (1 - pt) ** max(gamma - 1, 0) * np.log(pt) * (gamma > 0) - (1 - pt) ** gamma / pt)
    return float(loss), (slope * pt)[..., None] * (hot - p) / n


def kl_to_unit(mean: np.ndarray, log_var: np.ndarray) -> float:
    """Mean over rows of the divergence of a diagonal Gaussian to the unit one."""
    return float(-0.5 * (1 + log_var - mean**2 - np.exp(log_var)).sum(axis=1).mean())


def anneal(epoch: int, warm: int, ramp: int, final: float) -> float:
    """0 while warm, a linear ramp, then ``final``."""
    return 0.0 if epoch < warm else final * min(1.0, (epoch - warm + 1) / max(1, ramp))


@dataclass
class Adam:
    rate: float = 3e-3
    decay: float = 1e-4
    state: dict = field(default_factory=dict)
    step: int = 0

    def apply(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m *= 0.9
        m += 0.1 * grad
        v *= 0.999
        v += 0.001 * (grad * grad)
        root = np.sqrt(v / (1 - 0.999**self.step))
        root += 1e-8
        value *= 1 - self.rate * self.decay
        value -= m * (self.rate / (1 - 0.9**self.step)) / root


#: Numbers of the models.
REAL = np.float32


class Layers:
    """Dense layers with tanh between them; the last is linear."""

    def __init__(self, sizes: list[int], rng: np.random.Generator):
        self.w = [rng.normal(0, np.sqrt(1.0 / a), (a, b)).astype(REAL) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b, REAL) for b in sizes[1:]]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = out[-1] @ w + b
            out.append(np.tanh(z) if i < len(self.w) - 1 else z)
        return out

    def backward(self, out: list[np.ndarray], grad: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        grads = []
        for i in range(len(self.w) - 1, -1, -1):
            if i < len(self.w) - 1:
                grad = grad * (1 - out[i + 1] ** 2)
            grads.append((out[i].T @ grad, grad.sum(axis=0)))
            grad = grad @ self.w[i].T
        return grads[::-1], grad


#: Samples that go through a decoder at once.
BLOCK = 1024
#: Samples of a block at most, and their calls; a lane of a training holds one block at a time.
BLOCK_SAMPLES, BLOCK_CALLS = 4096, 1 << 22
#: Lanes of a training at most; a fixed number, so that a fit does not depend on the cluster.
LANES = 24
#: Loci whose components come from their inner products.
EXACT_LOCI = 2048
#: Numbers of a model that lanes add up together.
CHUNK = 1 << 16


@dataclass(frozen=True)
class NeuralConfig:
    """What the four models share. ``kind``: autoencoder, vae, nlpca or ubp."""

    kind: str = "autoencoder"
    latent: int = 4
    hidden: int = 1
    epochs: int = 60
    batch: int = 64
    gamma: float = 1.0
    beta: float = 0.05
    l1: float = 1e-5
    patience: int = 12
    seed: int = 0
    projection: int = 40


@dataclass
class Neural:
    """A fitted model: encoder (none for decoder-only kinds), decoder, and the latent start."""

    config: NeuralConfig
    encoder: Layers | None
    decoder: Layers
    history: list[float]

    def logits(self, g: np.ndarray) -> np.ndarray:
        """Logits of every call from a block of samples (-1 missing)."""
        if self.encoder is not None:
            code = self.encoder.forward(one_hot(g))[-1][:, : self.config.latent]
        else:
            code = np.zeros((len(g), self.config.latent), REAL)
            adam = Adam(rate=0.05, decay=0.0)
            for _ in range(self.config.projection):  # weights stay; each sample's place is refined on its own
                out = self.decoder.forward(code)
                _, grad = focal_loss(out[-1].reshape(*g.shape, 3) , g, np.ones(3), self.config.gamma)
                adam.step += 1
                adam.apply("code", code, self.decoder.backward(out, grad.reshape(len(g), -1) * len(g))[1])
        return np.clip(self.decoder.forward(code)[-1].reshape(*g.shape, 3), -30, 30)


def one_hot(g: np.ndarray) -> np.ndarray:
    """Calls as three indicators each, all 0 for missing."""
    return (g[..., None] == np.arange(3)).astype(REAL).reshape(len(g), -1)


class Training:
    """A model while it is fitted: layers, the optimiser's state and the best epoch so far. Calls come block by block, with their targets and places."""

    def __init__(self, config: NeuralConfig, n: int, loci: int, counts: np.ndarray):
        """``n`` samples are fitted on, whose calls are ``counts`` of the three classes."""
        rng = np.random.default_rng(config.seed)
        self.config, self.n, self.loci = config, n, loci
        hidden = layer_sizes(n, loci, config.latent, config.hidden)
        self.vae, self.own = config.kind == "vae", config.kind in ("nlpca", "ubp")
        self.encoder = None if self.own else Layers([loci * 3, *hidden, config.latent * (2 if self.vae else 1)], rng)
        self.decoder = Layers([config.latent, *hidden[::-1], loci * 3], rng)
        self.weights = np.where(counts > 0, counts.sum() / (3 * np.maximum(counts, 1)), 0.0) ** 0.5
        self.weights /= max(self.weights.mean(), 1e-9)
        self.adam, self.history, self.best, self.stale, self.kept = Adam(), [], np.inf, 0, None

    def frozen(self, epoch: int) -> bool:
        """Whether places stay: the first half of a ubp."""
        return self.config.kind == "ubp" and epoch < self.config.epochs // 2

    def epoch(self, epoch: int, g: np.ndarray, target: np.ndarray, places: np.ndarray | None, rng: np.random.Generator) -> float:
        """Go once over a block (-1 missing); targets and places are changed where they lie. Returns the losses' sum over samples."""
        config, encoder, decoder, adam, n = self.config, self.encoder, self.decoder, self.adam, len(g)
        frozen = self.frozen(epoch)
        beta = anneal(epoch, 5, 20, config.beta)
        if config.kind == "nlpca" and epoch > 1 and epoch % 10 == 1:  # missing targets take the model's own predictions
            for at in range(0, n, BLOCK):
                guess = decoder.forward(places[at : at + BLOCK])[-1].reshape(-1, self.loci, 3).argmax(axis=-1)
                target[at : at + BLOCK] = np.where(g[at : at + BLOCK] >= 0, g[at : at + BLOCK], guess)
        total = 0.0
        for rows in np.array_split(rng.permutation(n), max(1, -(-n // config.batch))):
            adam.step += 1
            if encoder is not None:
                hide = rng.random((len(rows), self.loci)) < 0.1  # some calls are withheld from the input
                enc = encoder.forward(one_hot(np.where(hide, -1, g[rows])))
                mean = enc[-1][:, : config.latent]
                log_var = np.clip(enc[-1][:, config.latent :], -8, 8) if self.vae else None
                noise = rng.normal(size=mean.shape).astype(REAL) if self.vae else 0.0
                code = mean + noise * np.exp(0.5 * log_var) if self.vae else mean
            else:
                code = places[rows]
            dec = decoder.forward(code)
            loss, grad = focal_loss(dec[-1].reshape(len(rows), self.loci, 3), target[rows], self.weights, config.gamma)
            grads, back = decoder.backward(dec, grad.reshape(len(rows), -1))
            for i, (gw, gb) in enumerate(grads):
                l1 = 0.0 if config.kind == "ubp" and not frozen else config.l1
                adam.apply(f"dw{i}", decoder.w[i], gw + l1 * np.sign(decoder.w[i]))
                adam.apply(f"db{i}", decoder.b[i], gb)
            if encoder is not None:
                top = back
                if self.vae:
                    loss += beta * kl_to_unit(mean, log_var)
                    top = np.concatenate([back + beta * mean / len(rows), back * noise * 0.5 * np.exp(0.5 * log_var) + beta * 0.5 * (np.exp(log_var) - 1) / len(rows)], axis=1)
                for i, (gw, gb) in enumerate(encoder.backward(enc, top)[0]):
                    adam.apply(f"ew{i}", encoder.w[i], gw)
                    adam.apply(f"eb{i}", encoder.b[i], gb)
            elif not frozen:
                places[rows] = places[rows] - 0.5 * back * len(rows)
            total += loss * len(rows)
        return total

    def judge(self, epoch: int, loss: float) -> bool:
        """Keep the weights if the epoch is the best; whether to stop."""
        self.history.append(loss)
        if np.isfinite(loss) and loss < self.best - 1e-4:
            self.best, self.stale = loss, 0
            self.kept = [[a.copy() for a in part] for layers in (self.decoder, self.encoder) if layers for part in (layers.w, layers.b)]
            return False
        self.stale += 1
        return self.stale >= self.config.patience and not self.frozen(epoch)

    def model(self) -> Neural:
        if self.kept:
            self.decoder.w, self.decoder.b = self.kept[:2]
            if self.encoder:
                self.encoder.w, self.encoder.b = self.kept[2:]
        return Neural(self.config, self.encoder, self.decoder, self.history)

    def _arrays(self) -> list[np.ndarray]:
        """Weights, and the optimiser's two means of each, always in one order."""
        out = []
        for letter, layers in (("d", self.decoder), ("e", self.encoder)):
            for kind in ("w", "b") if layers else ():
                for i, value in enumerate(getattr(layers, kind)):
                    out += [value, *self.adam.state.setdefault(f"{letter}{kind}{i}", (np.zeros_like(value), np.zeros_like(value)))]
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([a.reshape(-1) for a in self._arrays()])

    def take(self, flat: np.ndarray) -> None:
        """The inverse of ``flat``."""
        at = 0
        for a in self._arrays():
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size


def fit_neural(g: np.ndarray, config: NeuralConfig) -> Neural:
    """Fit on samples x loci of calls (-1 missing) with early stopping on the training loss's best epoch."""
    training = Training(config, *g.shape, np.array([(g == k).sum() for k in range(3)], float))
    rng = np.random.default_rng([config.seed, 1])
    target, places = g.copy(), None
    if training.own:  # V05: places start from principal components of mean-filled calls
        filled = np.where(g >= 0, g.astype(float), np.nan)
        filled = np.nan_to_num(filled - np.nanmean(np.where(np.isnan(filled).all(axis=0), 0.0, filled), axis=0))
        u, s, _ = np.linalg.svd(filled, full_matrices=False)
        places = np.zeros((len(g), config.latent), REAL)
        k = min(config.latent, u.shape[1])
        places[:, :k] = u[:, :k] * s[:k] / max(1e-9, s[:k].max())
    for epoch in range(config.epochs):
        if training.judge(epoch, training.epoch(epoch, g, target, places, rng) / len(g)):
            break
    return training.model()


def dense_calls(lists: pa.ListArray, loci: np.ndarray, empty: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples x loci of calls (``empty``: missing) from each sample's list of ``locus_id`` and ``g``, and the row and column of every entry."""
    entries = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    at = np.searchsorted(loci, entries.field("locus_id").to_numpy())
    g = np.full((len(lists), len(loci)), empty, np.int8)
    g[row, at] = entries.field("g").to_numpy()
    return g, row, at


_CALLS = "place long, sample_id long, calls binary"
_BLOCK = "lane int, block int, calls binary, target binary, places binary"
_TRAINED = f"{_BLOCK}, chunk int, n long, loss double, numbers binary"


def _calls(table: pa.Table, loci: int) -> tuple[np.ndarray, np.ndarray]:
    """Calls of samples x loci by hash and id, and that order."""
    order = np.lexsort((table["sample_id"].to_numpy(), table["place"].to_numpy()))
    calls = table["calls"].combine_chunks().to_pylist()
    return np.frombuffer(b"".join(calls[i] for i in order), np.int8).reshape(len(calls), loci), order


def fit_samples(cells: DataFrame, rows: DataFrame, loci: np.ndarray, config: NeuralConfig) -> Neural:
    """Fit on all samples, each a row (``sample_id``, ``l``: a list of calls).

    Samples are dealt over blocks by a hash. One block is fitted by one task. Blocks of more are dealt
    over lanes: in an epoch each lane goes over its blocks, one at a time, from common weights; then
    weights and the optimiser's means are averaged, by samples, for the next epoch. What comes to the
    driver is one model an epoch.
    """
    spark, place = cells.sparkSession, F.xxhash64("sample_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = dense_calls(batch.column(2), loci)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([line.tobytes() for line in g], pa.binary())], names=["place", "sample_id", "calls"])

    packed = cut(rows.select(place.alias("place"), "sample_id", "l").mapInArrow(pack, _CALLS))
    n, size = packed.count(), max(config.batch, min(BLOCK_SAMPLES, BLOCK_CALLS // len(loci)))
    blocks = -(-n // size)
    if blocks == 1:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = fit_neural(_calls(pa.Table.from_batches(batches), len(loci))[0], config)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

        model = pickle.loads(packed.repartition(1).mapInArrow(whole, "model binary").collect()[0][0])
        drop_cut(packed)
        return model
    lanes = min(LANES, blocks)
    counted = {r["g"]: r["count"] for r in cells.where("g IS NOT NULL").groupBy("g").count().collect()}
    training = Training(config, n, len(loci), np.array([counted.get(k, 0) for k in range(3)], float))
    source = packed.withColumn("start", F.lit(None).cast("array<double>"))
    if training.own:
        # Places start from principal components of mean-filled calls.
        found = exact_components(cells, config.latent) if len(loci) <= EXACT_LOCI else principal_components(cells, config.latent)
        most = float(found.singular.max(initial=1e-9))
        source = packed.join(found.places.select("sample_id", F.transform("places", lambda p: p / F.lit(most)).alias("start")), "sample_id", "left").select("place", "sample_id", "calls", "start")

    def block(table: pa.Table) -> pa.Table:
        g, order = _calls(table, len(loci))
        start = table["start"].combine_chunks().to_pylist()
        places = np.zeros((len(g), config.latent), REAL)
        for row, at in enumerate(order):
            places[row, : len(start[at] or ())] = start[at] or ()
        number = table["block"][0].as_py()
        return pa.table([pa.array([number % lanes], pa.int32()), pa.array([number], pa.int32()), *(pa.array([d], pa.binary()) for d in (g.tobytes(), g.tobytes() if training.own else None, places.tobytes() if training.own else None))], names=["lane", "block", "calls", "target", "places"])

    state = cut(source.withColumn("block", F.pmod("place", F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(lambda t: block(t), _BLOCK))
    drop_cut(packed)
    for epoch in range(config.epochs):
        shared = spark.sparkContext.broadcast(training)
        trained = state.repartitionById(lanes, "lane").sortWithinPartitions("lane", "block").mapInArrow(lambda batches, shared=shared, epoch=epoch: _lane(batches, shared.value, epoch), _TRAINED)
        if training.own:
            before, trained = state, cut(trained)
            state = trained.where("chunk IS NULL").select("lane", "block", "calls", "target", "places")
            state._cut_path = trained._cut_path
            drop_cut(before)
        parts = sorted(trained.where("chunk IS NOT NULL").select("chunk", "n", "loss", "numbers").groupBy("chunk").applyInArrow(lambda t: _averaged(t), "chunk int, loss double, numbers binary").collect())
        training.take(np.concatenate([np.frombuffer(r["numbers"], REAL) for r in parts]))
        training.adam.step += -(-n // (lanes * config.batch))
        shared.destroy()
        if training.judge(epoch, parts[0]["loss"] / n):
            break
    drop_cut(state)
    return training.model()


def _lane(batches: Iterator[pa.RecordBatch], start: Training, epoch: int) -> Iterator[pa.RecordBatch]:
    """An epoch of one lane: its blocks as they are then, and its weights in chunks."""
    names = [f.split()[0] for f in _TRAINED.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.binary()], strict=True)))
    training, n, loss = copy.deepcopy(start), 0, 0.0
    for batch in batches:
        for row in batch.to_pylist():
            g = np.frombuffer(row["calls"], np.int8).reshape(-1, training.loci)
            target = np.frombuffer(row["target"], np.int8).reshape(g.shape).copy() if training.own else g
            places = np.frombuffer(row["places"], REAL).reshape(len(g), -1).copy() if training.own else None
            loss += training.epoch(epoch, g, target, places, np.random.default_rng([training.config.seed, epoch, row["block"]]))
            n += len(g)
            if training.own:
                yield pa.RecordBatch.from_pylist([row | {"target": target.tobytes(), "places": places.tobytes()}], schema=schema)
    if n:
        flat = training.flat()
        for chunk, at in enumerate(range(0, len(flat), CHUNK)):
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "n": n, "loss": loss, "numbers": flat[at : at + CHUNK].tobytes()}], schema=schema)


def _averaged(table: pa.Table) -> pa.Table:
    """The mean of a chunk over lanes by samples, and the sum of losses."""
    # In a fixed order, as sums of floats depend on it.
    lanes = sorted(zip(table["n"].to_pylist(), table["loss"].to_pylist(), table["numbers"].to_pylist(), strict=True))
    total = sum(n * np.frombuffer(numbers, REAL).astype(float) for n, _, numbers in lanes)
    mean = (total / sum(n for n, _, _ in lanes)).astype(REAL)
    return pa.table([table["chunk"][:1], pa.array([sum(loss for _, loss, _ in lanes)]), pa.array([mean.tobytes()], pa.binary())], names=["chunk", "loss", "numbers"])


def fill_neural(cells: DataFrame, config: NeuralConfig) -> DataFrame:
    """Missing calls from a small neural model; observed calls stay.

    The model is fitted on all samples (``fit_samples``). Prediction covers all samples too: each is one row
    of calls, and blocks of rows go through the model in parallel.
    """
    ship_package(cells.sparkSession)
    # Written once, as the loci, the fit and the result read it.
    named = cut(cells.where("sample_id IS NOT NULL AND locus_id IS NOT NULL"))
    loci = named.select("locus_id").distinct().orderBy("locus_id").toArrow()["locus_id"].to_numpy().astype(np.int64)
    if not len(loci):
        return named.withColumn("imputed", F.col("g"))
    # Written once: the fit and the prediction both read it.
    rows = cut(named.groupBy("sample_id").agg(F.collect_list(F.struct("locus_id", F.coalesce("g", F.lit(-1)).cast("byte").alias("g"))).alias("l")))
    model = fit_samples(named, rows, loci, config)
    shared = cells.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, row, at = dense_calls(batch.column(1), loci)
            guess = shared.value.logits(g).argmax(axis=-1)
            # A guess for each missing call; of repeated ones one.
            row, at = np.divmod(np.unique((row * len(loci) + at)[g[row, at] < 0]), max(1, len(loci)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(loci[at]), pa.array(guess[row, at].astype(np.int32))], names=["sample_id", "locus_id", "guess"])

    guessed = rows.mapInArrow(run, "sample_id long, locus_id long, guess int")
    return named.join(guessed, ["sample_id", "locus_id"], "left").withColumn("imputed", F.coalesce("g", "guess")).drop("guess")
