"""Population inference: principal components, density clusters, nearest neighbours.

The functions of arrays are the plain forms, of a few points; ``infer_populations`` does the same on tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.operators import neighbours
from genoframe.operators.components import exact_components, principal_components
from genoframe.operators.impute import fill_mode, locus_mode
from genoframe.operators.relate import running_total
from genoframe.session import cut, drop_cut

#: The grid of the density clusters: neighbours that make a core (itself counted), and radii for each.
LEAST, RADII = range(2, 9), 12
#: Up to so many loci the components come from all directions, so they are exact.
EXACT_LOCI = 256
#: Settings whose clusters are looked for at first; twice as many each time after.
AT_ONCE = 24
#: A radius that is never reached.
NEVER = float("inf")


def dbscan(points: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Labels from 0 by density reach, -1 for noise."""
    near = (np.linalg.norm(points[:, None] - points[None], axis=2) <= eps)
    core = near.sum(axis=1) >= least
    labels, now = np.full(len(points), -1), 0
    for i in range(len(points)):
        if core[i] and labels[i] < 0:
            stack = [i]
            labels[i] = now
            while stack:
                for j in np.nonzero(near[stack.pop()] & (labels < 0))[0]:
                    labels[j] = now
                    if core[j]:
                        stack.append(j)
            now += 1
    return labels


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette of clustered points; 0 for fewer than two clusters."""
    kept = labels >= 0
    points, labels = points[kept], labels[kept]
    names = np.unique(labels)
    if len(names) < 2:
        return 0.0
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    scores = []
    for i in range(len(points)):
        same = (labels == labels[i]).sum()
        a = d[i, labels == labels[i]].sum() / max(1, same - 1)
        b = min(d[i, labels == k].mean() for k in names if k != labels[i])
        scores.append((b - a) / max(a, b, 1e-12) if same > 1 else 0.0)
    return float(np.mean(scores))


def neighbour_distances(points: np.ndarray, k: int) -> np.ndarray:
    """Sorted distances of each point to its k-th neighbour."""
    d = np.sort(np.linalg.norm(points[:, None] - points[None], axis=2), axis=1)
    return np.sort(d[:, min(k, len(points) - 1)])


def knee(sorted_distances: np.ndarray) -> float:
    """The distance where the scaled curve lies farthest from its diagonal."""
    span = np.ptp(sorted_distances)
    y = (sorted_distances - sorted_distances[0]) / (span if span > 0 else 1.0)
    return float(sorted_distances[np.argmax(np.linspace(0, 1, len(y)) - y)])


@dataclass
class _Setting:
    """One place of the grid; ``clusters`` is an upper bound until ``exact``, and ``same`` an earlier setting of the same clusters."""

    least: int
    eps: float
    cores: int
    noise: float
    full: int
    clusters: int
    exact: bool = False
    links: DataFrame | None = None
    roots: DataFrame | None = None
    same: int | None = None

    @property
    def base(self) -> float:
        """The score without the silhouette, which adds or takes half a point at most, and nothing below two clusters."""
        return self.clusters - 1.5 * self.noise

    @property
    def play(self) -> float:
        return 0.5 if self.clusters > 1 else 0.0


def stars(edges: DataFrame) -> DataFrame:
    """``s``, ``node``, ``root``: every node of a setting's edges ``s``, ``u``, ``v`` and the least node it reaches, itself left out (alternating large and small stars).

    Rounds grow with the logarithm of the longest path; minima are aggregated before they are exchanged.
    """
    turned = F.col("v").alias("u"), F.col("u").alias("v")
    now, state = cut(edges.select("s", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()), None
    while True:
        both = now.unionByName(now.select("s", *turned))
        least = both.groupBy("s", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, ["s", "u"]).where("v > u").select("s", F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("s", "u").agg(F.min("v").alias("m"))
        small = large.join(least, ["s", "u"]).select("s", F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        before, now = now, cut(small.select("s", "e.u", F.col("e.m").alias("v")).where("u != v").distinct())
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("s", "u", "v").cast("decimal(20,0)"))).collect()[0]
        drop_cut(before)
        if after == state or not after[0]:
            return now.select("s", F.col("u").alias("node"), F.col("v").alias("root"))
        state = after


def _sample_points(cells: DataFrame, components: int) -> DataFrame:
    """``id``, ``v``: samples with modes filled at their components, each of deviation 1."""
    cells = cut(cells.select("sample_id", "locus_id", "g"))
    filled = cut(fill_mode(cells, locus_mode(cells)).select("sample_id", "locus_id", F.col("imputed").alias("g")))
    drop_cut(cells)
    if filled.select("locus_id").distinct().count() <= EXACT_LOCI:
        found = exact_components(filled, components)
    else:
        found = principal_components(filled, components, rounds=12)
    rows = found.places.count()
    # Loci are centred, so a component's deviation is its singular value over the root of the rows.
    scaled = F.array(*[F.col("places")[i] / F.lit(max(float(s) / rows**0.5, 1e-12)) for i, s in enumerate(found.singular)]) if len(found.singular) else F.array(F.lit(0.0))
    return cut(found.places.select(F.col("sample_id").cast("long").alias("id"), scaled.alias("v"), F.lit(0).cast("long").alias("label")))


def _radii(lists: DataFrame, rows: int) -> dict[int, list[float]]:
    """For each number of neighbours the radii from half the knee of its sorted distances to the largest.

    The knee is the distance where the scaled curve lies farthest below its diagonal; the last of equal distances, at its first place, is it.
    """
    far = F.transform(F.array(*[F.lit(k) for k in LEAST]), lambda k: F.struct(k.alias("least"), F.coalesce(F.try_element_at("d", k), F.try_element_at("d", F.lit(-1)), F.lit(0.0)).alias("d")))
    counts = cut(lists.select(F.inline(far)).groupBy("least", "d").agg(F.count(F.lit(1)).alias("n")))
    span = counts.groupBy("least").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    upto = running_total(counts, "least", F.col("n"), "upto", ["d"]).join(F.broadcast(span), "least")
    place = (F.col("upto") - (F.col("least") - LEAST[0]) * rows - 1) / F.lit(max(rows - 1, 1))
    width = F.col("high") - F.col("low")
    height = (F.col("d") - F.col("low")) / F.when(width > 0, width).otherwise(1.0)
    found = upto.groupBy("least").agg(F.max_by("d", F.struct(F.round(place - height, 12), -F.col("upto"))).alias("knee"), F.any_value("high").alias("high")).collect()
    return {r["least"]: [float(e) for e in np.geomspace(max(r["knee"] * 0.5, 1e-6), max(r["high"], 1e-5), RADII)] for r in found}


def _core(d: Column, least: int) -> Column:
    """The radius from which a point with these neighbours' distances is a core."""
    return F.coalesce(F.try_element_at(d, F.lit(least - 1)), F.lit(NEVER))


class _Grid:
    """Density clusters of points for each setting of the grid, from the eight nearest of each point.

    A point that is no core has all its near points among its nearest ones, so noise is
    known from the lists. So are the links of cores, but for those between two points
    whose lists end within the radius ("full"): these are looked for over tiles.
    Linking only lowers the number of clusters, so settings are taken by their upper
    bounds until no other can reach the best one.
    """

    def __init__(self, points: DataFrame):
        self.points = points
        near = cut(neighbours.nearest(points, LEAST[-1]))
        # Points alone in the table have no neighbours, and are in no list.
        self.lists = cut(points.select("id").join(near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "distance", "neighbour"))).alias("l")), "id", "left").select("id", F.coalesce(F.transform("l", lambda t: t["distance"]), F.array().cast("array<double>")).alias("d")))
        self.rows = self.lists.count()
        theirs = self.lists.select(F.col("id").alias("neighbour"), F.col("d").alias("e"))
        self.pairs = cut(near.join(theirs, "neighbour").join(self.lists, "id").select("id", "neighbour", "distance", "d", "e"))
        self.at_once = AT_ONCE
        self.settings = self._bounds(_radii(self.lists, self.rows))

    def _bounds(self, radii: dict[int, list[float]]) -> list[_Setting]:
        """Cores, noise and a bound of clusters (cores that no core of a lower number is linked to) of all settings, counted by levels: the first radius that holds."""
        counted: dict[int, list[tuple]] = {}
        for least in LEAST:
            reach = F.greatest("distance", _core(F.col("e"), least))
            both = F.greatest(reach, _core(F.col("d"), least))
            lower = self.pairs.select(F.greatest("id", "neighbour").alias("id"), both.alias("low"), F.lit(NEVER).alias("border"))
            sides = lower.unionByName(self.pairs.select("id", F.lit(NEVER).alias("low"), reach.alias("border")))
            best = sides.groupBy("id").agg(F.min("low").alias("low"), F.min("border").alias("border"))
            level = lambda x: F.size(F.filter(F.array(*map(F.lit, radii[least])), lambda r: r < x)).alias  # noqa: B023, E731
            core, end = _core(F.col("d"), least), F.coalesce(F.try_element_at("d", F.lit(LEAST[-1])), F.lit(NEVER))
            marks = self.lists.join(best, "id", "left").select(level(core)("core"), level(F.least(core, F.coalesce("border", F.lit(NEVER))))("held"), level(F.coalesce("low", F.lit(NEVER)))("low"), level(F.greatest(core, end))("full"))
            counted[least] = marks.groupBy("core", "held", "low", "full").agg(F.count(F.lit(1)).alias("n")).withColumn("least", F.lit(least))
        frame = None
        for part in counted.values():
            frame = part if frame is None else frame.unionByName(part)
        rows = frame.collect()
        out = []
        for least in LEAST:
            mine = [r for r in rows if r["least"] == least]
            for j, eps in enumerate(radii[least]):
                upto = lambda c: sum(r["n"] for r in mine if r[c] <= j)  # noqa: B023, E731
                out.append(_Setting(least, eps, upto("core"), 1 - upto("held") / self.rows, upto("full"), upto("core") - upto("low"), not upto("core")))
        return out

    def _linked(self, chosen: list[int]) -> None:
        """Clusters of settings by the links in the lists."""
        tests = [(self.settings[i].least, self.settings[i].eps, i) for i in chosen]
        within = F.array(*[F.when(F.greatest("distance", _core(F.col("d"), least), _core(F.col("e"), least)) <= eps, F.lit(i)) for least, eps, i in tests])
        roots = stars(self.pairs.select(F.explode(F.array_compact(within)).alias("s"), F.col("id").alias("u"), F.col("neighbour").alias("v")))
        apart = {r["s"]: r["n"] for r in roots.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
        for i in chosen:
            s = self.settings[i]
            s.links = roots.where(F.col("s") == i)
            s.clusters = s.cores - apart.get(i, 0)
            if s.full < 2 or s.clusters < 2:
                s.exact, s.roots = True, s.links

    def _named(self, s: _Setting, roots: DataFrame) -> DataFrame:
        """``id``, ``root``, ``d`` of the setting's cores."""
        cores = self.lists.where(_core(F.col("d"), s.least) <= s.eps)
        return cores.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "d")

    def _settle(self, i: int) -> None:
        """The links of full lists: cores of different clusters within the radius."""
        s, eps = self.settings[i], self.settings[i].eps
        full = self._named(s, s.links).where(F.try_element_at("d", F.lit(LEAST[-1])) <= eps).select("id", F.col("root").alias("label"))

        def met(_, labels, __, c_labels, squares) -> pa.RecordBatch:
            near = (np.sqrt(np.round(squares, neighbours.DIGITS)) <= eps) & (labels[:, None] > c_labels[None, :])
            at, to = np.nonzero(near)
            found = np.unique(np.stack([labels[at], c_labels[to]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["u", "v"])

        points = self.points.select("id", "v").join(full, "id")
        joined = stars(neighbours._meet(points, met, "u long, v long", neighbours.BLOCK_ROWS).select(F.lit(i).alias("s"), "u", "v"))
        s.clusters -= joined.count()
        over = joined.select(F.col("node").alias("root"), F.col("root").alias("over"))
        ends = self._named(s, s.links).join(over, "root", "left").select("id", F.coalesce("over", "root").alias("root"))
        s.roots = cut(ends.where("id != root").select(F.col("id").alias("node"), "root"))
        s.exact = True

    def _spread(self) -> None:
        """Where all points are cores, links only grow with the radius: between two radii of as many clusters the clusters are the same, and beyond a radius there are no more."""
        whole = sorted((s.eps, i) for i, s in enumerate(self.settings) if s.cores == self.rows)
        known = [(e, i) for e, i in whole if self.settings[i].exact]
        for (low, first), (high, last) in zip(known, known[1:], strict=False):
            a, b = self.settings[first], self.settings[last]
            if a.clusters == b.clusters:
                b.same = first if b.same is None else b.same
                for e, i in whole:
                    if low <= e <= high and not self.settings[i].exact:
                        t = self.settings[i]
                        t.clusters, t.exact, t.same = a.clusters, True, first
        for eps, i in known:
            for e, j in whole:
                if e >= eps and not self.settings[j].exact:
                    self.settings[j].clusters = min(self.settings[j].clusters, self.settings[i].clusters)

    def _first(self, i: int) -> int:
        while self.settings[i].same is not None:
            i = self.settings[i].same
        return i

    def best(self) -> _Setting:
        """The setting of the highest score; of equal ones the first."""
        while True:
            known = [s.base - s.play for s in self.settings if s.exact]
            floor = max(known, default=-NEVER)
            open_ = [i for i, s in enumerate(self.settings) if not s.exact and s.base + s.play >= floor]
            if not open_:
                break
            self._next(open_)
            self._spread()
        left = {}
        for i, s in enumerate(self.settings):
            if s.exact and s.base + s.play >= floor:
                left.setdefault(self._first(i), []).append(i)
        if len(left) == 1:
            return self.settings[next(iter(left))]
        scored = [(round(self.settings[i].base + 0.5 * self._silhouette(self.settings[i]), 9), -min(own), i) for i, own in left.items()]
        return self.settings[max(scored)[2]]

    def _next(self, open_: list[int]) -> None:
        """One step for the setting of the highest bound; among settings where all points are cores, the narrowest radius first, then by halves."""
        order = sorted(open_, key=lambda i: (-self.settings[i].base, i))
        top = sorted((i for i in order if self.settings[i].base == self.settings[order[0]].base and self.settings[i].cores == self.rows), key=lambda i: (self.settings[i].eps, i))
        if top:
            known = any(s.exact and s.cores == self.rows and s.clusters == self.settings[top[0]].clusters for s in self.settings)
            first = top[len(top) // 2] if known else top[0]
            order = [first, *[i for i in order if i not in top]]
        unlinked = [i for i in order if self.settings[i].links is None]
        if self.settings[order[0]].links is None:
            self._linked(unlinked[: self.at_once])
            self.at_once *= 2
        else:
            self._settle(order[0])

    def labelled(self, s: _Setting) -> DataFrame:
        """``id``, ``label``: the least core of the cluster; points that are no cores have the lowest one of the cores near them, else null."""
        if not s.cores:
            return self.lists.select("id", F.lit(None).cast("long").alias("label"))
        cores = cut(self._named(s, s.roots).select("id", "root"))
        reached = self.pairs.where((_core(F.col("d"), s.least) > s.eps) & (F.col("distance") <= s.eps) & (_core(F.col("e"), s.least) <= s.eps))
        borders = reached.join(cores.select(F.col("id").alias("neighbour"), "root"), "neighbour").groupBy("id").agg(F.min("root").alias("border"))
        return self.lists.select("id").join(cores, "id", "left").join(borders, "id", "left").select("id", F.coalesce("root", "border").alias("label"))

    def _silhouette(self, s: _Setting) -> float:
        if s.clusters < 2:
            return 0.0
        placed = self.points.select("id", "v").join(self.labelled(s).where("label IS NOT NULL"), "id")
        return neighbours.silhouettes(placed).agg(F.avg("silhouette")).collect()[0][0] or 0.0


def infer_populations(cells: DataFrame, *, components: int = 10) -> DataFrame:
    """``sample_id``, ``cluster`` (-1 noise): modes filled, components of samples x loci, DBSCAN over a grid scored by clusters, noise and silhouette.

    The clusters, 0 and on by their least core, and the setting are those of all pairs, but
    pairs meet in tiles, and only settings that can still be the best are worked out.
    Components are exact up to EXACT_LOCI loci.
    """
    points = _sample_points(cells, components)
    if points.isEmpty():
        return points.select(F.col("id").alias("sample_id"), F.lit(-1).alias("cluster"))
    grid = _Grid(points)
    labels = cut(grid.labelled(grid.best()))
    names = running_total(labels.where("label IS NOT NULL").select("label").distinct(), "label", F.lit(1), "place").select("label", (F.col("place") - 1).cast("int").alias("place"))
    return labels.join(names, "label", "left").select(F.col("id").alias("sample_id"), F.coalesce("place", F.lit(-1)).alias("cluster"))
