"""Forests and boosted trees for all loci at once, grown level by level from counts that Spark merges.

A call is predicted from its neighbours' codes, so what a learner can know of a locus is
how often each pattern of codes goes with each class. Spark counts that: patterns are
base-3 numbers, summed up in the JVM. Patterns of a locus are dealt over tiles. At each
level a tile adds up, for every tree and open node, the classes (or the gradients) by
code of each feature that the node may ask; the sums of a locus's tiles are merged, the
best cut of each node is taken, and the tiles go down one level. So no task holds all
samples of a locus, and whatever the number of samples, a locus of k neighbours has at
most 3^k patterns. Where each locus fits one tile there is nothing to merge, and all
levels are done in one call; the trees are the same.

A bootstrap of rows is a Poisson weight of each row, so a pattern of n rows weighs a
Poisson draw of mean n, from a hash of seed, locus, tree, pattern and class.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.session import cut, drop_cut, ship_package

#: Codes of a call, which are also the classes.
CODES = 3
#: Rows (pattern, class) in a tile: all that ten neighbours can have, so that a locus of theirs is done in one call at any number of samples.
TILE_PATTERNS = CODES * CODES**10
#: Numbers (tree x pattern x feature) that are looked at together.
CELLS = 1 << 20
#: Numbers (tree x pattern) that are walked together where a locus is whole, so that they stay in a processor's cache.
WALKED = 1 << 16
#: Bytes of the table of joint codes of every set of asked features, and joint codes of a set.
JOINT_BYTES, JOINT_CELLS = 1 << 24, CODES**4
#: Features whose joint codes boosting counts together.
GROUP = 5
#: Tasks that loci are dealt over at most, one for each where there are fewer.
MOST_PARTS = 1024
#: Neighbours whose pattern fits 64 bits.
MOST_NEIGHBOURS = 39


@dataclass(frozen=True)
class Votes:
    """What a forest's trees add up: each row's class, and its weight in every tree (tree or 1, row)."""

    y: np.ndarray
    weight: np.ndarray


@dataclass(frozen=True)
class Plan:
    """``forest``: ``trees`` bagged trees; ``boosting``: ``trees`` rounds of a tree for each class, at a learning rate."""

    kind: str = "forest"
    trees: int = 300
    depth: int = 8
    #: Features that a node may ask; None: the root of their number for forests, all for boosting.
    features: int | None = None
    #: Least weight of a leaf.
    leaf: float = 1.0
    rate: float = 0.1
    l2: float = 0.0
    #: Trees see a bootstrap of the rows.
    bootstrap: bool = True
    seed: int = 0

    def __post_init__(self):
        if self.kind not in ("forest", "boosting") or self.trees < 1 or self.depth < 1 or self.leaf <= 0:
            raise ValueError(f"no such trees: {self}")

    def asked(self, k: int) -> int:
        if self.features is not None:
            return max(1, min(k, self.features))
        return max(1, int(np.sqrt(k))) if self.kind == "forest" else k

    @property
    def stages(self) -> int:
        """Ensembles grown one after another."""
        return 1 if self.kind == "forest" else self.trees

    @property
    def width(self) -> int:
        """Trees of a stage."""
        return self.trees if self.kind == "forest" else CODES


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(*parts: int) -> np.uint64:
    return np.uint64(zlib.crc32(repr(parts).encode()) * 0x9E3779B97F4A7C15 % 2**64)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Of each number one in (0, 1)."""
    return ((_mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def poisson_drawer(mean: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """From keys (..., row) a Poisson draw of each row's mean; of means over 64 a rounded normal one. Few means are distinct, as they are counts."""
    small = np.nonzero(mean <= 64)[0]
    large = np.nonzero(mean > 64)[0]
    distinct, which = np.unique(mean[small], return_inverse=True)
    # How likely at most k are drawn, and the least k that a draw of each 256th can be.
    chance = np.exp(-distinct)
    totals, chances = [chance], chance
    for k in range(1, 200):
        chances = chances * distinct / k
        totals.append(totals[-1] + chances)
        if (chances < 1e-18).all() and k > 64:
            break
    cumulative = np.stack(totals, axis=1) if len(distinct) else np.zeros((0, 1))
    least = np.array([np.searchsorted(row, np.arange(256) / 256) for row in cumulative], np.int64).reshape(-1)
    wide, first = cumulative.shape[1], cumulative.reshape(-1)

    def draw(key: np.ndarray) -> np.ndarray:
        out = np.zeros(key.shape)
        if len(small):
            u = _uniform(key if not len(large) else key[..., small])
            rows = np.broadcast_to(which, u.shape)
            found = least[rows * 256 + (u * 256).astype(np.int64)]
            found = np.minimum(found, wide - 1)
            over = np.nonzero((u > first[rows * wide + found]).reshape(-1))[0]
            flat, own, at = found.reshape(-1), u.reshape(-1), rows.reshape(-1)
            while len(over):
                flat[over] += 1
                over = over[flat[over] < wide - 1]
                over = over[own[over] > first[at[over] * wide + flat[over]]]
            out[..., small] = flat.reshape(u.shape)
        if len(large):
            high = key[..., large]
            normal = np.sqrt(-2 * np.log(_uniform(high))) * np.cos(2 * np.pi * _uniform(high + np.uint64(1)))
            out[..., large] = np.maximum(0, np.rint(mean[large] + np.sqrt(mean[large]) * normal))
        return out

    return draw


def poisson(mean: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A Poisson draw for each mean, by its key."""
    return poisson_drawer(mean)(key)


def features_of(codes: np.ndarray, k: int) -> np.ndarray:
    """The codes (0 to 2) of each pattern's neighbours, by rank."""
    powers = np.array([CODES**i for i in range(k)], np.int64)
    return (codes[:, None] // powers[None, :] % CODES).astype(np.uint8)


class Stage:
    """Trees of one stage of a locus while they grow: asked features of every node, cuts so far, values in the end."""

    def __init__(self, plan: Plan, locus: int, number: int, k: int):
        self.plan, self.k, self.m = plan, k, plan.asked(k)
        nodes = (1 << plan.depth) - 1
        key = _key(plan.seed, locus, number)
        draws = _mix(np.arange(plan.width * nodes * k, dtype=np.uint64) + key).reshape(plan.width, nodes, k)
        #: Features that each node may ask.
        self.offered = np.argsort(draws, axis=2, kind="stable")[:, :, : self.m] if self.m < k else np.broadcast_to(np.arange(k), (plan.width, nodes, k))
        self.feature = np.full((plan.width, nodes), -1, np.int16)
        #: A row goes low if its code is at most this.
        self.cut = np.zeros((plan.width, nodes), np.uint8)
        self.value = np.zeros((plan.width, 1 << plan.depth, CODES))
        #: Where rows have come to, by their array and slice of trees: levels above are final, so a walk goes on from there.
        self.walked: dict[tuple[int, int], tuple[int, np.ndarray]] = {}

    def places(self, x: np.ndarray, trees: slice, level: int) -> np.ndarray:
        """The node (from 0, of its level) that each row has come to, for each tree."""
        begun, node = self.walked.get((id(x), trees.start), (0, None))
        if node is None or begun > level:
            begun, node = 0, np.zeros((trees.stop - trees.start, len(x)), np.int64)
        rows, ts = np.arange(len(x))[None, :], np.arange(trees.start, trees.stop)[:, None]
        for d in range(begun, level):
            # What a node asks is looked up by its number among the slice's; a node without a cut sends all low.
            asks, nodes = self.feature[trees, (1 << d) - 1 : (2 << d) - 1], (ts - trees.start << d) + node
            steps = np.where(asks >= 0, self.cut[trees, (1 << d) - 1 : (2 << d) - 1], CODES).astype(np.uint8).reshape(-1)
            node = node * 2 + (x.reshape(-1)[rows * self.k + np.maximum(asks, 0).reshape(-1)[nodes]] > steps[nodes])
        self.walked[id(x), trees.start] = (level, node)
        return node

    def slices(self, n: int) -> Iterator[slice]:
        step = max(1, CELLS // max(1, n * self.m))
        for at in range(0, self.plan.width, step):
            yield slice(at, min(at + step, self.plan.width))

    def open_nodes(self, level: int, trees: slice = slice(None)) -> tuple[np.ndarray, int]:
        """(tree, node) of a level to a number, -1 for nodes under no cut; and how many are open. All tiles of a locus agree on it."""
        if not level:
            width = len(self.feature[trees])
            return np.arange(width)[:, None], width
        parents = self.feature[trees, (1 << level - 1) - 1 : (1 << level) - 1] >= 0
        both = np.repeat(parents, 2, axis=1)
        return np.where(both, np.cumsum(both).reshape(both.shape) - 1, -1), int(both.sum())

    def vote_sums(self, x: np.ndarray, votes: Votes, level: int) -> np.ndarray:
        """``sums`` of a forest: a row has one class, so it is counted once and not for each class."""
        number, size = self.open_nodes(level)
        out = np.zeros((size, self.m, CODES, CODES))
        first = (1 << level) - 1
        place = np.arange(self.m) * CODES * CODES
        for trees in self.slices(len(x)) if size else ():
            node = self.places(x, trees, level)
            own = votes.weight[trees] if len(votes.weight) > 1 else np.broadcast_to(votes.weight, node.shape)
            numbers = number[trees]
            opened = numbers[numbers >= 0]
            if not len(opened):
                continue
            low, high = int(opened.min()), int(opened.max()) + 1
            numbered = numbers.reshape(-1)[(np.arange(len(node)) << level)[:, None] + node] if level else np.broadcast_to(numbers, node.shape)
            t, r = np.nonzero((numbered >= 0) & (own != 0))
            offered = self.offered[trees, first : first + (1 << level)].reshape(-1, self.m)[(t << level) + node[t, r]]
            flat = (numbered[t, r] - low) * (self.m * CODES * CODES) + votes.y[r]
            flat = flat[:, None] + place + x.reshape(-1)[(r * self.k)[:, None] + offered].astype(np.int64) * CODES
            found = np.bincount(flat.reshape(-1), np.repeat(own[t, r], self.m), (high - low) * self.m * CODES * CODES)
            out[low:high] += found.reshape(high - low, self.m, CODES, CODES)
        return out

    def sums(self, x: np.ndarray, channels: np.ndarray | Votes, level: int) -> np.ndarray:
        """(open node, asked feature, code, channel): what a tile adds to the choice of cuts. ``channels`` are (tree or 1, row, channel)."""
        if isinstance(channels, Votes):
            return self.vote_sums(x, channels, level)
        number, size = self.open_nodes(level)
        out = np.zeros((size * self.m * CODES, CODES))
        if not size:
            return out.reshape(0, self.m, CODES, CODES)
        first = (1 << level) - 1
        for trees in self.slices(len(x)):
            node = self.places(x, trees, level)
            tree = np.arange(trees.start, trees.stop)[:, None]
            own = channels[trees] if len(channels) > 1 else np.broadcast_to(channels, (trees.stop - trees.start, *channels.shape[1:]))
            # Rows of closed nodes, and those that weigh nothing, take no further part.
            t, r = np.nonzero((number[tree, node] >= 0) & (own != 0).any(axis=2))
            at = node[t, r]
            offered = self.offered[t + trees.start, at + first]
            flat = ((number[t + trees.start, at][:, None] * self.m + np.arange(self.m)) * CODES + x[r[:, None], offered]).reshape(-1)
            weights = own[t, r]
            for c in range(CODES):
                out[:, c] += np.bincount(flat, np.repeat(weights[:, c], self.m), len(out))
        return out.reshape(size, self.m, CODES, CODES)

    def split(self, sums: np.ndarray, level: int, trees: slice = slice(None)) -> None:
        """The best cut of each open node of a level; none where nothing is gained or a leaf would be too light."""
        number, size = self.open_nodes(level, trees)
        if not size:
            return
        low = np.cumsum(sums, axis=2)[:, :, :-1]
        whole = sums.sum(axis=2, keepdims=True)
        high = whole - low
        gain = self._score(low) + self._score(high) - self._score(whole)
        fits = (self._weight(low) >= self.plan.leaf) & (self._weight(high) >= self.plan.leaf)
        gain = np.where(fits, gain, -np.inf).reshape(size, -1)
        # The first of those that are best but for the rounding of sums, which depends on their order.
        top = gain.max(axis=1, keepdims=True)
        best = (gain >= top - 1e-9 * (1 + np.abs(np.maximum(top, 0)))).argmax(axis=1)
        worth = gain[np.arange(size), best] > 1e-9
        tree, node = np.nonzero(number >= 0)
        tree, at = tree + (trees.start or 0), node + (1 << level) - 1
        self.feature[tree, at] = np.where(worth, self.offered[tree, at, best // (CODES - 1)], -1)
        self.cut[tree, at] = best % (CODES - 1)

    def _weight(self, s: np.ndarray) -> np.ndarray:
        return s.sum(axis=-1) if self.plan.kind == "forest" else s[..., 2]

    def _score(self, s: np.ndarray) -> np.ndarray:
        if self.plan.kind == "forest":  # squares over the weight: the lower the mean Gini impurity, the higher
            return (s * s).sum(axis=-1) / np.maximum(s.sum(axis=-1), 1e-12)
        return s[..., 0] ** 2 / np.maximum(s[..., 1] + self.plan.l2, 1e-12)

    def leaf_sums(self, x: np.ndarray, channels: np.ndarray | Votes) -> np.ndarray:
        """(tree, leaf, channel) of a tile."""
        leaves, out = 1 << self.plan.depth, []
        for trees in self.slices(len(x)):
            t = trees.stop - trees.start
            flat = (np.arange(t)[:, None] * leaves + self.places(x, trees, self.plan.depth)).reshape(-1)
            if isinstance(channels, Votes):
                own = channels.weight[trees] if len(channels.weight) > 1 else np.broadcast_to(channels.weight, (t, len(x)))
                out.append(np.bincount(flat * CODES + np.tile(channels.y, t), own.reshape(-1), t * leaves * CODES).reshape(t, leaves, CODES))
                continue
            own = channels[trees] if len(channels) > 1 else np.broadcast_to(channels, (t, *channels.shape[1:]))
            out.append(np.stack([np.bincount(flat, own[:, :, c].reshape(-1), t * leaves) for c in range(CODES)], axis=1).reshape(t, leaves, CODES))
        return np.concatenate(out)

    def settle(self, sums: np.ndarray) -> None:
        """Leaves' values: class shares, or steps down the gradient."""
        if self.plan.kind == "forest":
            self.value = sums / np.maximum(sums.sum(axis=2, keepdims=True), 1e-12)
        else:
            self.value = np.zeros_like(sums)
            self.value[:, :, 0] = self.plan.rate * sums[:, :, 0] / np.maximum(sums[:, :, 1] + self.plan.l2, 1e-12)

    def said(self, x: np.ndarray) -> np.ndarray:
        """(row, class): mean shares of a forest, or what a boosting round adds to the scores."""
        out = np.zeros((len(x), CODES))
        for trees in self.slices(len(x)):
            leaf = self.places(x, trees, self.plan.depth)
            value = self.value[np.arange(trees.start, trees.stop)[:, None], leaf]
            if self.plan.kind == "forest":
                out += value.sum(axis=0) / self.plan.trees
            else:
                out[:, trees] += value[:, :, 0].T
        return out

    def dump(self) -> bytes:
        return self.feature.tobytes() + self.cut.tobytes() + self.value.astype(np.float64).tobytes()

    def load(self, data: bytes) -> Stage:
        n = self.feature.size
        self.feature = np.frombuffer(data, np.int16, n).reshape(self.feature.shape).copy()
        self.cut = np.frombuffer(data, np.uint8, n, 2 * n).reshape(self.cut.shape).copy()
        self.value = np.frombuffer(data, np.float64, -1, 3 * n).reshape(self.value.shape).copy()
        return self


def channels_of(plan: Plan, locus: int, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, scores: np.ndarray) -> np.ndarray | Votes:
    """What a stage's trees add up of each row: votes of a forest; (class, row, (gradient, curvature, weight)) of a boosting round."""
    if plan.kind == "boosting":
        # Weights of each row's class, or of every class of a pattern.
        votes = np.eye(CODES)[y] * weight[:, None] if weight.ndim == 1 else weight
        weight = votes.sum(axis=1)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        parts = votes - p * weight[:, None], p * (1 - p) * weight[:, None], np.broadcast_to(weight[:, None], p.shape)
        return np.stack([c.T for c in parts], axis=2)
    if not plan.bootstrap:
        return Votes(y, weight[None])
    rows, draw = _row_keys(plan, locus, codes, y), poisson_drawer(weight)
    # Tree by tree, as small whole numbers.
    drawn = np.empty((plan.trees, len(rows)), np.float32 if weight.sum() < 1 << 22 else np.float64)
    for t, step in enumerate(_steps(plan.trees)):
        drawn[t] = draw(_mix(rows + step))
    return Votes(y, drawn)


def _row_keys(plan: Plan, locus: int, codes: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _mix(codes.astype(np.uint64) * np.uint64(CODES) + y.astype(np.uint64) + _key(plan.seed, locus, -1))


def _steps(trees: int) -> np.ndarray:
    """What is added to a row's key for each tree."""
    return np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def prior(counts: np.ndarray) -> np.ndarray:
    """Scores that boosting starts from: logarithms of class shares."""
    return np.log(np.maximum(counts / max(counts.sum(), 1.0), 1e-6))


def fit_predict(plan: Plan, locus: int, k: int, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Class scores of the ``asked`` patterns from rows (pattern, class, weight) that are all of a locus."""
    m = plan.asked(k)
    if plan.kind == "boosting":
        return _boosted(plan, locus, k, codes, y, weight, asked)
    if CODES**m <= JOINT_CELLS and math.comb(k, m) * (len(codes) + len(asked)) <= JOINT_BYTES:
        return _bagged(plan, locus, k, codes, y, weight, asked)
    x, new = features_of(codes, k), features_of(asked, k)
    stage = Stage(plan, locus, 0, k)
    channels = channels_of(plan, locus, codes, y, weight, np.zeros((len(x), CODES)))
    for level in range(plan.depth):
        stage.split(stage.sums(x, channels, level), level)
        if level + 1 == plan.depth or not stage.open_nodes(level + 1)[1]:
            break
    stage.settle(stage.leaf_sums(x, channels))
    return stage.said(new)


def _digits(m: int) -> np.ndarray:
    """(feature, joint code): the code of each of m features."""
    return np.arange(CODES**m) // CODES ** np.arange(m)[:, None] % CODES


def _packed(votes: np.ndarray, size: int) -> tuple[list[np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """Whole weights (class, tree x row) as few numbers whose sums are exact, each of the bits that a tree's sum can need; and how sums (..., number) become classes."""
    most = votes.sum(axis=0).reshape(-1, size).sum(axis=1).max(initial=0)
    bits = max(1, int(most).bit_length())
    if 3 * bits <= 52:
        low, high = 2.0**bits, 4.0**bits

        def three(sums: np.ndarray) -> np.ndarray:
            top = np.floor(sums / high)
            rest = sums - top * high
            middle = np.floor(rest / low)
            return np.concatenate([rest - middle * low, middle, top], axis=-1)

        return [votes[0] + votes[1] * low + votes[2] * high], three
    return list(votes), lambda sums: sums


def _bagged(plan: Plan, locus: int, k: int, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """A forest whose patterns are all here: the same trees as by ``sums``, some trees at a time.

    What a node asks of a pattern is one joint code of its features, looked up by the set of
    them; classes are counted by node and joint code, and the same number finds the next node.
    """
    stage = Stage(plan, locus, 0, k)
    every = np.unique(np.concatenate([codes, asked]))
    at, told, size = np.searchsorted(every, codes), np.searchsorted(every, asked), len(every)
    m, x = stage.m, features_of(every, k).T
    sets = np.array(list(itertools.combinations(range(k), m))).reshape(-1, m)
    joint = np.stack([sum(x[f] * np.uint8(CODES**j) for j, f in enumerate(s)) for s in sets]).reshape(-1)
    number_of = np.zeros((k,) * m, np.int64)
    number_of[tuple(sets.T)] = np.arange(len(sets))
    ordered = np.sort(stage.offered, axis=2)
    begins = number_of[tuple(np.moveaxis(ordered, 2, 0))] * size
    # Where an asked feature stands among the sorted ones of its node.
    stands = (stage.offered[..., None] == ordered[:, :, None, :]).argmax(axis=3)
    cells, digits = CODES**m, _digits(m)
    by_code = (digits[:, None, :] == np.arange(CODES)[:, None]).reshape(m * CODES, cells).astype(float)
    out = np.zeros((len(asked), CODES))
    keys, draw = (_row_keys(plan, locus, codes, y), poisson_drawer(weight)) if plan.bootstrap else (None, None)
    steps = _steps(plan.trees)
    step = max(1, WALKED // max(1, size))
    for begin in range(0, plan.trees, step):
        trees = slice(begin, min(begin + step, plan.trees))
        t = trees.stop - trees.start
        votes = np.zeros((CODES, t, size))
        votes[y, :, at] = (draw(_mix(keys + steps[trees][:, None])) if plan.bootstrap else np.broadcast_to(weight, (t, len(weight)))).T
        votes = votes.reshape(CODES, -1)
        packed, apart = _packed(votes, size)
        # Places of all trees of a level are numbered one after another.
        place, pattern = np.repeat(np.arange(t), size), np.tile(np.arange(size), t)
        depth = 0
        for level in range(plan.depth):
            number, opened = stage.open_nodes(level, trees)
            if not opened:
                break
            nodes, here = t << level, slice((1 << level) - 1, (2 << level) - 1)
            cell = place * cells + joint[begins[trees, here].reshape(-1)[place] + pattern]
            table = apart(np.stack([np.bincount(cell, v, nodes * cells) for v in packed], axis=1).reshape(nodes, cells, -1)[(number >= 0).reshape(-1)])
            asks = stands[trees, here][number >= 0]
            sums = np.matmul(by_code, table).reshape(opened, m, CODES, CODES)
            stage.split(np.take_along_axis(sums, asks[:, :, None, None], axis=1), level, trees)
            feature, cut_at = stage.feature[trees, here].reshape(-1), stage.cut[trees, here].reshape(-1)
            position = (ordered[trees, here].reshape(-1, m) == feature[:, None]).argmax(axis=1)
            high = (digits[position] > cut_at[:, None]) & (feature >= 0)[:, None]
            place = place * 2 + high.reshape(-1)[cell]
            depth = level + 1
        place = place << plan.depth - depth
        leaves = t << plan.depth
        sums = np.stack([np.bincount(place, v, leaves) for v in votes], axis=1)
        value = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)
        out += value[place.reshape(t, size)[:, told]].sum(axis=0) / plan.trees
    return out


def _boosted(plan: Plan, locus: int, k: int, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Boosting of a locus whose patterns are all here: the same trees as by ``sums``.

    Sums are taken by node and the joint code of some features together, and by single
    features from those. Asked patterns go along with no weight.
    """
    every, at = np.unique(np.concatenate([codes, asked]), return_inverse=True)
    told, size = at[len(codes) :], len(every)
    votes = np.bincount(at[: len(codes)] * CODES + y, weight, size * CODES).reshape(-1, CODES)
    x = np.ascontiguousarray(features_of(every, k).T)
    # Trees of the classes are grown together; places of all are numbered one after another.
    flat, pattern = x.reshape(-1), np.tile(np.arange(size), CODES)
    groups = []
    for first in range(0, k, GROUP):
        wide = min(GROUP, k - first)
        by_code = (_digits(wide)[:, None, :] == np.arange(CODES)[:, None]).reshape(wide * CODES, CODES**wide).astype(float)
        groups.append((CODES**wide, np.tile(sum(x[first + j] * np.int64(CODES**j) for j in range(wide)), CODES), by_code.T))
    scores = np.tile(prior(votes.sum(axis=0)), (size, 1))
    for number in range(plan.stages):
        stage = Stage(plan, locus, number, k)
        channels = np.moveaxis(channels_of(plan, locus, every, y, votes, scores), 2, 0).reshape(CODES, -1)
        place, depth = np.repeat(np.arange(CODES), size), 0
        for level in range(plan.depth):
            numbers, opened = stage.open_nodes(level)
            if not opened:
                break
            nodes, here, some = CODES << level, slice((1 << level) - 1, (2 << level) - 1), numbers >= 0
            parts = []
            for cells, joint, by_code in groups:
                cell = place * cells + joint
                table = np.stack([np.bincount(cell, v, nodes * cells).reshape(nodes, cells)[some.reshape(-1)] for v in channels])
                parts.append((table @ by_code).reshape(CODES, opened, -1, CODES))
            sums = np.moveaxis(np.concatenate(parts, axis=2), 0, 3)
            stage.split(np.take_along_axis(sums, stage.offered[:, here][some][:, :, None, None], axis=1), level)
            feature = stage.feature[:, here].reshape(-1)
            limit = np.where(feature >= 0, stage.cut[:, here].reshape(-1), CODES).astype(np.uint8)
            place = place * 2 + (flat[(np.maximum(feature, 0).astype(np.int64) * size)[place] + pattern] > limit[place])
            depth = level + 1
        place = place << plan.depth - depth
        gradient, curvature = (np.bincount(place, v, CODES << plan.depth) for v in channels[:2])
        scores += (plan.rate * gradient / np.maximum(curvature + plan.l2, 1e-12))[place].reshape(CODES, size).T
    return scores[told]


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return table[name].to_numpy().astype(kind)


def predict(counts: DataFrame, plan: Plan, k: int, *, tile_patterns: int = TILE_PATTERNS, least_known: int = 5) -> DataFrame:
    """``locus_id``, ``code``, ``imputed``: the likeliest class of every pattern that is asked, from ``locus_id``, ``code``, ``y`` (null: asked), ``n``.

    Patterns are base-3 numbers of k codes. A locus of fewer than ``least_known`` rows of
    a class, or of one class, has no rows. Ties go to the lower class.
    """
    ship_package(counts.sparkSession)
    if k > MOST_NEIGHBOURS:
        raise ValueError(f"at most {MOST_NEIGHBOURS} neighbours")
    known = counts.where("y IS NOT NULL").groupBy("locus_id").agg(F.sum("n").alias("rows"), F.count_distinct("y").alias("classes"), F.count(F.lit(1)).alias("patterns"))
    able = cut(known.where((F.col("rows") >= least_known) & (F.col("classes") > 1)))
    most, loci = able.agg(F.coalesce(F.max("patterns"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    rows = counts.join(able.select("locus_id"), "locus_id", "left_semi")
    if most <= tile_patterns:
        # Little data, much work: dealt by a number of its own, so that Spark does not join the parts.
        dealt = rows.repartition(max(2 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(loci, MOST_PARTS)), "locus_id")
        return dealt.groupBy("locus_id").applyInArrow(lambda t: _whole(plan, k, t), "locus_id long, code long, imputed int")
    return _by_levels(rows, plan, k, -(-most // tile_patterns))


def _parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes, n = _column(table, "code", np.int64), _column(table, "n", np.float64)
    y = table["y"].fill_null(-1).to_numpy().astype(np.int64)
    # In a fixed order, as sums of floats depend on it.
    order = np.lexsort((y, codes))
    codes, n, y = codes[order], n[order], y[order]
    fit = y >= 0
    return codes[fit], y[fit], n[fit], np.unique(codes[~fit])


def _answer(locus: int, asked: np.ndarray, scores: np.ndarray) -> pa.Table:
    return pa.table([pa.array(np.full(len(asked), locus)), pa.array(asked), pa.array(np.round(scores, 9).argmax(axis=1).astype(np.int32))], names=["locus_id", "code", "imputed"])


def _whole(plan: Plan, k: int, table: pa.Table) -> pa.Table:
    locus = table["locus_id"][0].as_py()
    codes, y, n, asked = _parts(table)
    return _answer(locus, asked, fit_predict(plan, locus, k, codes, y, n, asked) if len(asked) else np.zeros((0, CODES)))


_TILE = "locus_id long, part int, codes binary, y binary, n binary, scores binary"


def _merged(partial: DataFrame) -> DataFrame:
    """Sums of arrays by locus: first inside a task, then between tasks, each time one array at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for locus, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, np.float64)
                if locus != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()], pa.binary())], names=["locus_id", "sums"])
                    now, total = locus, own.copy()
                else:
                    total += own
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()], pa.binary())], names=["locus_id", "sums"])

    schema = "locus_id long, sums binary"
    return partial.sortWithinPartitions("locus_id").mapInArrow(add, schema).repartition("locus_id").sortWithinPartitions("locus_id").mapInArrow(add, schema)


def _by_levels(rows: DataFrame, plan: Plan, k: int, parts: int) -> DataFrame:
    """The same with a locus's patterns in several tiles: a job for each level."""
    part = F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int")

    def pack(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["y"].fill_null(-1).to_numpy(), table["code"].to_numpy()))
        data = [_column(table, "code", np.int64)[order], table["y"].fill_null(-1).to_numpy().astype(np.int64)[order], _column(table, "n", np.float64)[order]]
        scores = np.zeros((len(order), CODES))
        return pa.table([table["locus_id"][:1], table["part"][:1], *(pa.array([d.tobytes()], pa.binary()) for d in (*data, scores))], names=["locus_id", "part", "codes", "y", "n", "scores"])

    tiles = cut(rows.withColumn("part", part).groupBy("locus_id", "part").applyInArrow(lambda t: pack(t), _TILE))

    def opened(row: dict) -> tuple[np.ndarray, ...]:
        codes, y, n = np.frombuffer(row["codes"], np.int64), np.frombuffer(row["y"], np.int64), np.frombuffer(row["n"])
        return codes, y, n, np.frombuffer(row["scores"]).reshape(len(codes), CODES)

    def each(function, schema: str, source: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield function(row)

        return source.mapInArrow(run, schema)

    partial = lambda locus, sums: pa.RecordBatch.from_arrays([pa.array([locus]), pa.array([np.ascontiguousarray(sums).tobytes()], pa.binary())], names=["locus_id", "sums"])
    model_schema = "locus_id long, model binary"

    def start(row: dict) -> pa.RecordBatch:
        _, y, n, _ = opened(row)
        return partial(row["locus_id"], np.bincount(y[y >= 0], n[y >= 0], CODES))

    def with_prior(row: dict) -> pa.RecordBatch:
        codes, _, _, _ = opened(row)
        scores = np.tile(prior(np.frombuffer(row["sums"])), (len(codes), 1)) if plan.kind == "boosting" else np.zeros((len(codes), CODES))
        return pa.RecordBatch.from_pylist([{c: row[c] for c in ("locus_id", "part", "codes", "y", "n")} | {"scores": scores.tobytes()}], schema=pa.schema([("locus_id", pa.int64()), ("part", pa.int32()), *((c, pa.binary()) for c in ("codes", "y", "n", "scores"))]))

    tiles = cut(each(with_prior, _TILE, tiles.join(_merged(each(start, "locus_id long, sums binary", tiles)), "locus_id")))
    for number in range(plan.stages):
        models = tiles.select("locus_id").distinct().withColumn("model", F.lit(None).cast("binary"))
        for level in range(plan.depth + 1):

            def gather(row: dict, number: int = number, level: int = level) -> pa.RecordBatch:
                codes, y, n, scores = opened(row)
                fit = y >= 0
                stage = Stage(plan, row["locus_id"], number, k)
                if row["model"]:
                    stage.load(row["model"])
                x = features_of(codes[fit], k)
                channels = channels_of(plan, row["locus_id"], codes[fit], y[fit], n[fit], scores[fit])
                return partial(row["locus_id"], stage.sums(x, channels, level) if level < plan.depth else stage.leaf_sums(x, channels))

            def grown(row: dict, number: int = number, level: int = level) -> pa.RecordBatch:
                stage = Stage(plan, row["locus_id"], number, k)
                if row["model"]:
                    stage.load(row["model"])
                sums = np.frombuffer(row["sums"])
                if level < plan.depth:
                    stage.split(sums.reshape(-1, stage.m, CODES, CODES), level)
                else:
                    stage.settle(sums.reshape(plan.width, 1 << plan.depth, CODES))
                return pa.RecordBatch.from_arrays([pa.array([row["locus_id"]]), pa.array([stage.dump()], pa.binary())], names=["locus_id", "model"])

            sums = _merged(each(gather, "locus_id long, sums binary", tiles.join(models, "locus_id")))
            before, models = models, cut(each(grown, model_schema, models.join(sums, "locus_id")))
            drop_cut(before)

        def scored(row: dict, number: int = number) -> pa.RecordBatch:
            codes, _, _, scores = opened(row)
            more = Stage(plan, row["locus_id"], number, k).load(row["model"]).said(features_of(codes, k))
            return pa.RecordBatch.from_pylist([{c: row[c] for c in ("locus_id", "part", "codes", "y", "n")} | {"scores": (scores + more).tobytes()}], schema=pa.schema([("locus_id", pa.int64()), ("part", pa.int32()), *((c, pa.binary()) for c in ("codes", "y", "n", "scores"))]))

        before, tiles = tiles, cut(each(scored, _TILE, tiles.join(models, "locus_id")))
        drop_cut(before)

    def told(row: dict) -> pa.RecordBatch:
        codes, y, _, scores = opened(row)
        asked = np.nonzero(y < 0)[0]
        return _answer(row["locus_id"], codes[asked], scores[asked]).combine_chunks().to_batches(max_chunksize=None)[0] if len(asked) else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int32())], names=["locus_id", "code", "imputed"])

    return each(told, "locus_id long, code long, imputed int", tiles)
