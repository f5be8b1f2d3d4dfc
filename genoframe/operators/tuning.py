"""Hyper-parameter search over tables of trials: a tree-structured Parzen sampler, successive halving, Pareto fronts.

A trial is a row ``study``, ``trial_id``, ``value`` (null while it has none) and a column
for each parameter; many studies are one table, and nothing looks beyond a study. The
sampler models each parameter by two mixtures, of a study's best trials and of the
rest, draws candidates from the first and keeps the one of the highest ratio. What it
needs of the rest are sums over all trials less those over the best ones, of which
there are GOOD_MOST at most, so the trials are aggregated where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoframe.session import cut, ship_package

#: Best trials of a study: this share of the complete ones, so many at most.
GOOD_SHARE, GOOD_MOST = 0.1, 25
#: Candidates drawn for one parameter of one proposal.
CANDIDATES = 24
#: Complete trials below which a study draws from the whole space.
STARTUP = 10
#: A logistic law of scale 1 has this inverse of its deviation.
LOGISTIC = 0.5513288954217921
#: Keys (study and parameter) whose candidates are broadcast at most. Beyond, trials come to the studies, and candidates stay where their study is.
BROADCAST_KEYS = 10_000
PRIME = 1_000_003


@dataclass(frozen=True)
class Real:
    """A number from ``low`` to ``high``, searched on a logarithmic scale with ``log``, rounded with ``whole``."""

    name: str
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def place(self) -> Column:
        """The column's values on a scale from 0 to 1; null outside."""
        v = F.col(self.name).cast("double")
        scaled = (F.ln(v) - F.ln(F.lit(self.low))) / (F.ln(F.lit(self.high)) - F.ln(F.lit(self.low))) if self.log else (v - F.lit(self.low)) / F.lit(self.high - self.low)
        return F.when(v.between(self.low, self.high), scaled)

    def number(self, x: Column) -> Column:
        at = F.exp(F.ln(F.lit(self.low)) + x * (F.ln(F.lit(self.high)) - F.ln(F.lit(self.low)))) if self.log else F.lit(self.low) + x * F.lit(self.high - self.low)
        return F.rint(at) if self.whole else at

    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class Choice:
    """One of the options, as strings."""

    name: str
    options: tuple[str, ...]

    def place(self) -> Column:
        """The option's number; null for what is no option."""
        at = F.array_position(F.array(*map(F.lit, self.options)), F.col(self.name).cast("string"))
        return F.when(at > 0, (at - 1).cast("double"))


Space = Sequence[Real | Choice]


def hash_draw(seed: int) -> Callable[[int, Column, Column], Column]:
    """Draws in [0, 1) for each of a candidate's needs, from a hash of its study, parameter, proposal and number."""
    return lambda need, proposal, candidate: F.pmod(F.xxhash64("study", "parameter", proposal, candidate, F.lit(seed), F.lit(need)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def residue_draw(seed: int) -> Callable[[int, Column, Column], Column]:
    """The same by plain arithmetic that SQL engines agree on; studies are numbers."""
    mixed = lambda proposal, candidate: F.col("study") * 7919 + F.col("at") * 15485863 + proposal * 104729 + candidate * 1299709
    return lambda need, proposal, candidate: ((mixed(proposal, candidate) + F.lit(seed * 611953 + need * 32452843)) % PRIME).cast("double") / F.lit(float(PRIME))


def _logistic(u: Column) -> Column:
    return 1 / (1 + F.exp(-u))


def _kernel(x: Column, centre: Column, scale: Column) -> Column:
    """A logistic density around ``centre``, cut to [0, 1]."""
    f = _logistic((x - centre) / scale)
    return f * (1 - f) / scale / (_logistic((1 - centre) / scale) - _logistic(-centre / scale))


def _scale(n: Column, total: Column, squares: Column) -> Column:
    """Width of the kernels of n trials: their deviation shrunk by the fifth root of n, not under a 1 / min(100, n + 2) part of the range."""
    count = F.greatest(n, F.lit(1)).cast("double")
    spread = F.sqrt(F.greatest(squares / count - (total / count) * (total / count), F.lit(0.0)))
    return F.lit(LOGISTIC) * F.greatest(spread * F.pow(count, F.lit(-0.2)), 1 / F.least(F.lit(100.0), count + 2))


def _complete() -> Column:
    """A trial that says something: its value is there and no NaN."""
    return F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))


def best_trials(trials: DataFrame, share: float = GOOD_SHARE, most: int = GOOD_MOST, startup: int = STARTUP) -> DataFrame:
    """The trials of the highest values of each study, ties by trial: the given share of the complete ones, rounded up, ``most`` at most; none in a study of fewer than ``startup``."""
    done = trials.where(_complete())
    counts = done.groupBy("study").agg(F.count(F.lit(1)).alias("done"))
    order = Window.partitionBy("study").orderBy(F.desc("value"), "trial_id")
    # Spark keeps ``most`` rows of a study in each task before it exchanges them.
    first = done.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return first.join(counts, "study").where((F.col("done") >= startup) & (F.col("place") <= F.ceil(F.col("done") * F.lit(share))))


def propose(trials: DataFrame, space: Space, count: int = 1, *, draw: Callable[[int, Column, Column], Column] | None = None, share: float = GOOD_SHARE, startup: int = STARTUP, candidates: int = CANDIDATES) -> DataFrame:
    """The next ``count`` trials of each study: ``study``, ``proposal``, ``parameter``, ``number`` (null for choices), ``option``, ``gain`` (log ratio of the densities).

    Higher values are better. Every study of the table gets proposals, by chance while
    it has fewer than ``startup`` complete trials (null and NaN values are not). A
    value outside its parameter's range is left out of that parameter's mixtures.
    """
    draw = draw or hash_draw(0)
    places = [p.place() for p in space]
    wide_places = lambda df, *also: df.select("study", *also, *[x.alias(f"x{i}") for i, x in enumerate(places)])
    known = [F.when(_complete(), x) for x in places]
    totals = trials.groupBy("study").agg(*[f.alias(f"{c}{i}") for i, x in enumerate(known) for c, f in (("n", F.count(x)), ("s", F.coalesce(F.sum(x), F.lit(0.0))), ("q", F.coalesce(F.sum(x * x), F.lit(0.0))))])
    totals = cut(totals)
    few = totals.count() * len(space) <= BROADCAST_KEYS
    if not few:  # little is exchanged for much work: a number that is asked for is not coalesced
        totals = totals.repartition(int(trials.sparkSession.conf.get("spark.sql.shuffle.partitions")), "study")
    firsts = wide_places(best_trials(trials, share, GOOD_MOST, startup), "place").groupBy("study").agg(F.sort_array(F.collect_list(F.struct("place", *[f"x{i}" for i in range(len(space))]))).alias("best"))
    # A study's parameters, each with its counts, sums and best places.
    own = lambda i: F.filter(F.transform(F.coalesce("best", F.array()), lambda t: t[f"x{i}"]), lambda x: x.isNotNull())
    parameters = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(p.name).alias("parameter"), F.lit(len(p.options)).alias("options"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q"), own(i).alias("good")) for i, p in enumerate(space)])
    keys = totals.join(firsts, "study", "left").select("study", F.inline(parameters))
    added = lambda f: F.aggregate("good", F.lit(0.0), lambda a, x: a + f(x))
    k = F.size("good")
    keys = keys.withColumn("k", k).withColumn("gs", added(lambda x: x)).withColumn("gq", added(lambda x: x * x))
    keys = keys.withColumn("w", _scale(F.col("k"), F.col("gs"), F.col("gq"))).withColumn("v", _scale(F.col("n") - F.col("k"), F.col("s") - F.col("gs"), F.col("q") - F.col("gq")))
    real = F.col("options") == 0
    number_of = lambda c: (F.floor(c / candidates).cast("int"), c % candidates)
    # One of the best trials, or one of the prior's: the whole range, or each option once.
    picks = F.transform(F.sequence(F.lit(0), F.lit(count * candidates - 1)), lambda c: F.floor(draw(0, *number_of(c)) * (F.col("k") + F.greatest(F.col("options"), F.lit(1)))).cast("int"))

    def place_of(pick: Column, c: Column) -> Column:
        centre = F.try_element_at("good", pick + 1)
        low, high = _logistic(-centre / F.col("w")), _logistic((1 - centre) / F.col("w"))
        at = low + draw(1, *number_of(c)) * (high - low)
        inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), centre + F.col("w") * F.ln(at / (1 - at))))
        return F.when(real, F.when(pick < F.col("k"), inside).otherwise(draw(1, *number_of(c)))).otherwise(F.when(pick < F.col("k"), centre).otherwise((pick - F.col("k")).cast("double")))

    near = lambda x, other: F.when(real, _kernel(x, other, F.col("v"))).otherwise((x == other).cast("double"))

    def of_best(x: Column) -> Column:
        of_good = added(lambda g: near(x, g))
        return F.struct(x.alias("x"), of_good.alias("of_good"), F.when(real, added(lambda g: _kernel(x, g, F.col("w")))).otherwise(of_good).alias("like"))

    asked = keys.withColumn("picks", picks).withColumn("asked", F.transform("picks", place_of)).withColumn("asked", F.transform("asked", of_best)).select("study", "at", "options", "n", "k", "v", "asked")
    # Sums over all trials. A row of a trial meets all of its study's candidates where they lie.
    seen = wide_places(trials.where(_complete()))
    other = F.array(*[f"x{i}" for i in range(len(space))])[F.col("at")].alias("other")
    each = ["study", "at", "options", "n", "k", "v"]
    if few:
        asked = cut(asked)
        met = seen.join(F.broadcast(asked), "study").select(*each, other, "asked").where("other IS NOT NULL")
        met = met.unionByName(asked.select(*each, F.lit(None).cast("double").alias("other"), "asked"))
    else:
        met = asked.join(seen, "study", "left").select(*each, other, "asked")
    met = met.select(*each, "other", F.posexplode("asked").alias("c", "a")).select(*each, "other", "c", "a.*")
    # Numbers only are carried, so groups are hashed and exploded rows are not sorted.
    carried = ["options", "n", "k", "x", "of_good", "like"]
    scored = met.groupBy("study", "at", "c").agg(F.coalesce(F.sum(near(F.col("x"), F.col("other"))), F.lit(0.0)).alias("all"), *[F.first(c).alias(c) for c in carried])
    rest = F.greatest(F.col("all") - F.col("of_good"), F.lit(0.0))
    prior = F.greatest(F.col("options"), F.lit(1))
    ratio = F.ln((1 + F.col("like")) / (F.col("k") + prior)) - F.ln((1 + rest) / (F.col("n") - F.col("k") + prior))
    gain = F.round(F.when(F.col("k") > 0, ratio).otherwise(0.0), 6)
    proposal, candidate = number_of(F.col("c"))
    order = F.round(gain * 1e6).cast("long") * candidates - candidate
    best = scored.select("study", proposal.alias("proposal"), "at", "x", gain.alias("gain"), order.alias("order")).groupBy("study", "proposal", "at").agg(F.max("gain").alias("gain"), F.max_by("x", "order").alias("x"))
    best = best.withColumn("parameter", F.array(*[F.lit(p.name) for p in space])[F.col("at")])
    number = option = F.lit(None)
    for i, p in enumerate(space):
        mine = F.col("at") == i
        if isinstance(p, Choice):
            option = F.when(mine, F.element_at(F.array(*map(F.lit, p.options)), F.col("x").cast("int") + 1)).otherwise(option)
        else:
            number = F.when(mine, p.number(F.col("x"))).otherwise(number)
    return best.select("study", "proposal", "parameter", number.cast("double").alias("number"), option.cast("string").alias("option"), "gain")


def _budgets(brackets: int, eta: int) -> list[int]:
    """Trials of each bracket out of a round: the harder a bracket halves, the more start in it."""
    return [math.ceil(brackets * eta ** (brackets - 1 - b) / (brackets - b)) for b in range(brackets)]


def rungs(least: int, most: int, eta: int) -> list[int]:
    """The steps at which trials are compared."""
    if least < 1 or most < least or eta < 2:
        raise ValueError("a search needs 1 <= least <= most and eta >= 2")
    out = [least]
    while out[-1] * eta <= most:
        out.append(out[-1] * eta)
    return out


def hyperband(reports: DataFrame, *, least: int, most: int, eta: int = 3, patience: int = 0) -> DataFrame:
    """Where each trial is stopped: ``study``, ``trial_id``, ``bracket``, ``rungs`` (compared at), ``last_step`` (of those), ``stopped``, from ``study``, ``trial_id``, ``step``, ``value``.

    Bracket b compares at ``least`` times eta to the power b, b + 1 and on. At a rung the
    trials of a study and bracket that came so far and reported up to that step are
    ranked by their last value there, ties by trial; a part of 1 / eta goes on, one at
    least. With ``patience``, one that rose within so many steps before the rung goes on
    too. A trial that reported less than a rung asks ended by itself. Null and NaN
    values are the lowest. Trials are dealt to brackets by their number.
    """
    steps = rungs(least, most, eta)
    budgets = _budgets(len(steps), eta)
    at = F.pmod(F.col("trial_id"), F.lit(sum(budgets)))
    bracket = sum(((at >= sum(budgets[: b + 1])).cast("int") for b in range(len(budgets) - 1)), F.lit(0))
    value = F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    said = reports.withColumn("v", value)
    upto = [F.struct(F.max_by(F.when(F.col("step") <= s, F.col("v")), F.when(F.col("step") <= s, F.col("step"))).alias("v"), F.max_by(F.when(F.col("step") <= s, F.col("step")), F.when(F.col("step") <= s, F.struct("v", (-F.col("step")).alias("first")))).alias("rose")) for s in steps]
    state = said.groupBy("study", "trial_id").agg(F.max("step").alias("reached"), *[u.alias(f"r{i}") for i, u in enumerate(upto)]).withColumn("bracket", bracket).withColumn("alive", F.lit(True)).withColumn("rungs", F.lit(0)).withColumn("last_step", F.lit(None).cast("int")).withColumn("stopped", F.lit(False))
    # Every rung's window has the same partitioning: one exchange for all of them.
    for i, s in enumerate(steps):
        here = F.col("alive") & (F.lit(i) >= F.col("bracket")) & (F.col("reached") >= s)
        ended = F.col("alive") & (F.col("reached") < s)
        group = Window.partitionBy("study", "bracket", "here")
        place = F.row_number().over(group.orderBy(F.desc(f"r{i}.v"), "trial_id"))
        goes = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(group) / eta))
        state = state.withColumn("here", here).withColumn("goes", place <= goes)
        if patience:
            state = state.withColumn("goes", F.col("goes") | (F.lit(s) - F.col(f"r{i}.rose") < patience))
        out = F.col("here") & ~F.col("goes") & F.lit(i < len(steps) - 1)
        state = state.withColumn("rungs", F.col("rungs") + F.col("here").cast("int")).withColumn("last_step", F.when(F.col("here"), F.lit(s)).otherwise(F.col("last_step")))
        state = state.withColumn("stopped", F.col("stopped") | out).withColumn("alive", F.col("alive") & ~out & ~ended)
    return state.select("study", "trial_id", F.col("bracket").cast("int").alias("bracket"), "rungs", "last_step", "stopped")


def pareto_front(trials: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """The trials that no other trial of their study beats: as good in every objective, higher being better, and better in one.

    Equal trials are all on the front; a null or NaN in an objective keeps a trial off it.
    First, a few strong trials of each study drop what they beat; two objectives then
    take one running maximum over distinct points, more of them an anti-join.
    """
    values = [F.col(o).cast("double") for o in objectives]
    sound = trials
    for v in values:
        sound = sound.where(v.isNotNull() & ~F.isnan(v))
    points = sound.select("study", *[v.alias(f"o{i}") for i, v in enumerate(values)]).groupBy("study", *[f"o{i}" for i in range(len(values))]).agg(F.count(F.lit(1)).alias("n"))
    names = [f"o{i}" for i in range(len(values))]
    point = F.struct(*names)
    # On the front for sure: the best by the sum, and by each objective, then by the others.
    strong = points.groupBy("study").agg(F.array(F.max_by(point, F.struct(sum((F.col(n) for n in names), F.lit(0.0)), point)), *[F.max_by(point, F.struct(n, *[m for m in names if m != n])) for n in names]).alias("strong"))
    beats = lambda s: _all([s[n] >= F.col(n) for n in names]) & _any([s[n] > F.col(n) for n in names])
    left = points.join(strong, "study").where(~F.exists("strong", beats)).drop("strong")
    if len(names) == 2:
        falling = Window.partitionBy("study").orderBy(F.desc("o0"), F.desc("o1")).rowsBetween(Window.unboundedPreceding, -1)
        front = left.withColumn("above", F.max("o1").over(falling)).where("above IS NULL OR o1 > above").select("study", *names)
    elif len(names) == 1:
        front = left.select("study", *names)
    else:
        other = left.select(F.col("study").alias("s"), *[F.col(n).alias(f"x_{n}") for n in names])
        worse = (F.col("study") == F.col("s")) & _all([F.col(f"x_{n}") >= F.col(n) for n in names]) & _any([F.col(f"x_{n}") > F.col(n) for n in names])
        front = left.join(other, worse, "left_anti").select("study", *names)
    keyed = sound.select(F.struct(*sound.columns).alias("trial"), F.col("study").alias("__s"), *[v.alias(f"__{i}") for i, v in enumerate(values)])
    front = front.select(F.col("study").alias("__s"), *[F.col(n).alias(f"__{i}") for i, n in enumerate(names)])
    return keyed.join(front, ["__s", *[f"__{i}" for i in range(len(names))]], "left_semi").select("trial.*")


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def wide(proposals: DataFrame, space: Space) -> DataFrame:
    """``study``, ``proposal`` and a column for each parameter."""
    of = lambda p: F.max(F.when(F.col("parameter") == p.name, F.col("option" if isinstance(p, Choice) else "number")))
    return proposals.groupBy("study", "proposal").agg(*[of(p).cast("long" if isinstance(p, Real) and p.whole else "string" if isinstance(p, Choice) else "double").alias(p.name) for p in space])


def _schema(space: Space) -> str:
    return ", ".join(f"`{p.name}` {'string' if isinstance(p, Choice) else 'long' if p.whole else 'double'}" for p in space)


def run_as_rows(proposals: DataFrame, space: Space, objective: Callable[[dict[str, Any]], float]) -> DataFrame:
    """``value`` and ``state`` of every proposed trial (``study``, ``trial_id`` and the parameters), each a row in a partition of its own; a failed one says why."""
    ship_package(proposals.sparkSession)
    names = [p.name for p in space]

    def run(frames):
        for frame in frames:
            values, states = [], []
            for row in frame.to_dict("records"):
                try:
                    value, state = float(objective({n: row[n] for n in names})), "COMPLETE"
                except Exception as error:  # noqa: BLE001  a trial may fail in any way; the study goes on
                    value, state = None, f"FAIL: {error}"
                values.append(value)
                states.append(state)
            yield frame.assign(value=values, state=states)[["study", "trial_id", *names, "value", "state"]]

    rows = proposals.select("study", "trial_id", *names)
    return rows.repartition(max(rows.count(), 1), "study", "trial_id").mapInPandas(run, f"study long, trial_id long, {_schema(space)}, value double, state string")


def run_as_jobs(proposals: DataFrame, space: Space, objective: Callable[[dict[str, Any]], float], jobs: int = 4) -> DataFrame:
    """The same for objectives that run Spark jobs of their own: ``jobs`` of them at a time. A round's proposals are a short list, and come to the driver."""
    names = [p.name for p in space]

    def one(row) -> tuple:
        params = {n: row[n] for n in names}
        try:
            return (row["study"], row["trial_id"], *params.values(), float(objective(params)), "COMPLETE")
        except Exception as error:  # noqa: BLE001
            return (row["study"], row["trial_id"], *params.values(), None, f"FAIL: {error}")

    with ThreadPoolExecutor(jobs) as pool:
        done = list(pool.map(one, proposals.select("study", "trial_id", *names).collect()))
    return proposals.sparkSession.createDataFrame(done, f"study long, trial_id long, {_schema(space)}, value double, state string")


def optimise(spark: SparkSession, objective: Callable[[dict[str, Any]], float], space: Space, *, rounds: int = 10, per_round: int = 8, seed: int = 0, run: Callable[..., DataFrame] = run_as_rows, history: DataFrame | None = None, patience: int | None = None) -> DataFrame:
    """The table of all trials of one study, after ``rounds`` rounds of ``per_round`` trials that run side by side; each round is proposed from all before it.

    ``history`` (of an earlier call) is continued. With ``patience`` the search ends when
    so many rounds brought no new best. Trials are written each round, so a lost
    executor repeats its own only.
    """
    empty = spark.createDataFrame([], f"study long, trial_id long, {_schema(space)}, value double, state string")
    trials = history if history is not None else empty
    best, stale = None, 0
    for _ in range(rounds):
        at = trials.agg(F.coalesce(F.max("trial_id"), F.lit(-1))).collect()[0][0] + 1
        known = trials if at else spark.createDataFrame([(0, -1)], "study long, trial_id long").join(empty.drop("study", "trial_id"), F.lit(False), "left")
        asked = wide(propose(known, space, per_round, draw=hash_draw(seed + at)), space).withColumn("trial_id", (F.col("proposal") + F.lit(at)).cast("long"))
        trials = cut(trials.unionByName(run(cut(asked), space, objective)))
        top = trials.agg(F.max("value")).collect()[0][0]
        best, stale = (top, 0) if top is not None and (best is None or top > best) else (best, stale + 1)
        if patience is not None and stale >= patience:
            break
    return trials


def best_parameters(trials: DataFrame, space: Space) -> Mapping[str, Any]:
    """The parameters of the best complete trial; a search without one raises."""
    found = trials.where(_complete()).orderBy(F.desc("value"), "trial_id").limit(1).collect()
    if not found:
        raise RuntimeError("no trial was completed")
    return {p.name: found[0][p.name] for p in space}
