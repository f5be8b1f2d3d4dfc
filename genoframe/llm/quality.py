"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, of order five: one model for each language that has
enough trusted text, and one of all trusted text. Characters below U+0800 stand for
themselves, the others for one of 2048 classes, so a five-gram and its order are one
64-bit key, and shorter grams and contexts are parts of it. Five-grams are counted
over all trusted documents, lower orders count continuations, and counts meet their
contexts' totals and the lower orders' probabilities in shuffled joins, sharded by
language and gram. The table grows with the text: a row for each gram of any order,
with its log-probability and, where it is a context, what it leaves to lower orders.

Workers hold the most frequent rows, HOT of them over all languages together, and a
Bloom filter of all. A gram that is in neither is unseen, and its place backs off. A
place that needs a row which only the filter knows is looked up in the sharded table,
once for all documents, and joined back to each document's counts. While all rows of
a language fit, nothing has to be looked up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.llm.resemblance import digest
from genoframe.session import cut, kept, scratch, ship_package, tidy

ORDER = 5
#: Rows of the model that every worker holds, of 16 bytes each.
HOT = 1 << 21
#: Trusted characters that a language needs for a model of its own; others are scored by the model of all text.
MIN_CHARACTERS = 20_000
ALL = "*"
#: Characters that are told apart, of so many bits each, and from where on they share classes.
BITS, OWN = 12, 0x800
ALPHABET = 1 << BITS
#: Nats that a character costs at most.
MOST = 20.0
#: Bits of the Bloom filter for each row, and its most 64-bit words: beyond them it says "maybe" more often, and more is looked up.
FILTER_BITS, FILTER_WORDS = 10, 1 << 22
#: Characters of average text that each document's mean is smoothed with: short texts say little.
PRIOR = 20
#: Nats a character above its language's mean from which a document is also tried with the model of all text: its language may be named wrongly.
SUSPECT = 0.1
#: Most trusted ids, and most rejected texts, that are broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
#: One trusted document of so many is held out from training, for thresholds.
HELD_OUT = 5
#: Nats that bounds are widened by where one held-out document gave them; falls with the root of their number.
FEW = 0.5
#: Bins of a nat in the histograms that quantiles are read from.
BINS = 2000
#: Characters scored at once, and distinct five-grams that a counting task holds before it sends them.
SLICE, HELD_GRAMS = 1 << 17, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: What is no key.
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


def symbols(text: str) -> np.ndarray:
    """What a text's characters count as, after ORDER - 1 line breaks that stand for its beginning."""
    p = np.frombuffer(("\n" * (ORDER - 1) + text).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(p < OWN, p, OWN + p % OWN).astype(np.uint64)


def gram_codes(s: np.ndarray) -> np.ndarray:
    """The five-gram that ends at each character: BITS for each symbol, the last one lowest."""
    n = len(s) - (ORDER - 1)
    code = np.zeros(n, np.uint64)
    for i in range(ORDER):
        code = code << np.uint64(BITS) | s[i : i + n]
    return code


def gram_key(code: np.ndarray, k: int) -> np.ndarray:
    """The key of the last ``k`` symbols; 0 for none."""
    return (code & np.uint64((1 << BITS * k) - 1)) | np.uint64(k << BITS * ORDER)


def context_key(code: np.ndarray, k: int) -> np.ndarray:
    """The key of the context of the last ``k`` symbols: those but the last one."""
    return gram_key(code >> np.uint64(BITS), k - 1)


def _mixed(keys: np.ndarray) -> np.ndarray:
    h = keys * _MIX
    h ^= h >> np.uint64(32)
    return h * _MIX


def blocks(texts: Iterable[tuple[int, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Five-grams of texts, SLICE characters or a little more at once: codes, and the number that each one's text came with."""
    held: list[str] = []
    places: list[int] = []
    size, before = 0, "\n" * (ORDER - 1)

    def coded() -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in held])
        # What a piece begins with is context, also for the codes that would reach into the piece before.
        begins = np.cumsum(lengths) - lengths
        own = np.ones(int(lengths.sum()), bool)
        for i in range(ORDER - 1):
            own[begins + i] = False
        codes = gram_codes(symbols("".join(held)))[own]
        out = codes, np.repeat(np.array(places), lengths - (ORDER - 1))
        held.clear()
        places.clear()
        return out

    for place, text in texts:
        for at in range(0, len(text), SLICE):
            held.append(before + text[:SLICE] if not at else text[at - ORDER + 1 : at + SLICE])
            places.append(place)
            size += len(held[-1])
            if size >= SLICE:
                yield coded()
                size = 0
    if held:
        yield coded()


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts one, two and more, from the numbers of entries with counts 1 to 4."""
    n1, n2, n3, n4 = (max(float(x), 0.5) for x in n)
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.05, 0.1, 0.15], [0.95, 1.9, 2.85])


def count_grams(texts: DataFrame) -> DataFrame:
    """``lang``, ``code`` of each five-gram and ``n`` over whole texts (columns ``lang``, ``text``). A task sums before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}

        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)  # exact below 2^53

        def sent(lang: str | None) -> pa.RecordBatch:
            codes, n = summed(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lang in dict.fromkeys(langs):
                for codes, _ in blocks((i, texts[i].as_py() or "") for i, x in enumerate(langs) if x == lang):
                    held.setdefault(lang, []).append(np.unique(codes, return_counts=True))
                if sum(len(c) for c, _ in held.get(lang, ())) > HELD_GRAMS:
                    held[lang] = [summed(held[lang])]
                    if len(held[lang][0][0]) > HELD_GRAMS // 2:
                        yield sent(lang)
            while len(held) > 6:
                yield sent(next(iter(held)))
        for lang in list(held):
            yield sent(lang)

    return texts.select("lang", "text").mapInArrow(tidy(run), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _key(code: Column, k: int) -> Column:
    return code.bitwiseAND(F.lit((1 << BITS * k) - 1)).bitwiseOR(F.lit(k << BITS * ORDER)) if k else F.lit(0).cast("long")


def _context(code: Column, k: int) -> Column:
    return _key(F.shiftright(code, BITS), k - 1)


class Held:
    """The rows of one language that a worker holds: an open hash table of keys. And the filter of all rows, where there are others."""

    def __init__(self, keys: np.ndarray, log_p: np.ndarray, log_left: np.ndarray, filter_words: np.ndarray | None):
        bits = max(4, int(1.5 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.words = np.full(1 << bits, NOTHING), filter_words
        self.log_p, self.log_left = np.full(1 << bits, np.nan, np.float32), np.zeros(1 << bits, np.float32)
        todo, slot = np.arange(len(keys)), (_mixed(keys) >> self.shift).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == NOTHING
            at, first = np.unique(slot[free], return_index=True)
            won = todo[free][first]
            self.keys[at], self.log_p[at], self.log_left[at] = keys[won], log_p[won], log_left[won]
            stay = self.keys[slot] != keys[todo]
            todo, slot = todo[stay], (slot[stay] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it isn't held."""
        slot = (_mixed(keys) >> self.shift).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, slot, -1)
        todo = np.nonzero((there != keys) & (there != NOTHING))[0]
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (there != NOTHING)]
        return out

    def elsewhere(self, keys: np.ndarray) -> np.ndarray:
        """Whether the sharded table may have what isn't held."""
        if self.words is None:
            return np.zeros(len(keys), bool)
        at, bits = filter_place(keys, len(self.words))
        return self.words[at] & bits == bits

    def log_probabilities(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each place, and which places have to be looked up in the sharded table (0 there)."""
        out = np.zeros(len(codes), np.float64)
        cold = np.zeros(len(codes), bool)
        todo = np.arange(len(codes))
        for k in range(ORDER, 0, -1):
            keys = gram_key(codes[todo], k)
            slot = self.find(keys)
            out[todo] += np.where(slot >= 0, np.nan_to_num(self.log_p[slot]), 0.0)
            # A row that is a context only has no probability of its own.
            missed = (slot < 0) | np.isnan(self.log_p[slot])
            unknown = slot < 0
            unknown[unknown] = self.elsewhere(keys[unknown])
            cold[todo[unknown]] = True
            todo = todo[missed & ~unknown]
            contexts = context_key(codes[todo], k)
            left = self.find(contexts)
            out[todo] += np.where(left >= 0, self.log_left[left], 0.0)
            unknown = left < 0
            unknown[unknown] = self.elsewhere(contexts[unknown])
            cold[todo[unknown]] = True
            todo = todo[~unknown]
        out[todo] -= np.log(ALPHABET)
        out[cold] = 0.0
        return out, cold


def filter_place(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter that a key belongs to, and its four bits there."""
    h = _mixed(keys ^ np.uint64(0xA0761D6478BD642F))
    bits = np.zeros(len(h), np.uint64)
    for i in range(4):
        bits |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
    return (h >> np.uint64(24)).astype(np.int64) % words, bits


def build_filter(rows: DataFrame, words: int) -> np.ndarray:
    """The Bloom filter of ``key``: tasks fill words, equal words are or-ed in Spark, and at most ``words`` come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bits = filter_place(batch.column(0).to_numpy().view(np.uint64), words)
            order = np.argsort(at, kind="stable")
            at, first = np.unique(at[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bitwise_or.reduceat(bits[order], first).view(np.int64) if len(at) else np.zeros(0, np.int64))], names=["at", "bits"])

    table = rows.select("key").mapInArrow(tidy(run), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


@dataclass
class Model:
    hot: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]  # language: keys, log_p, log_left, the filter if these are not all
    means: dict[str, float]  # nats a character of the text trained on
    rows: DataFrame  # lang, key, log_p (null: a context only), log_left (0: no context)


def train(texts: DataFrame) -> Model:
    """Fit on ``lang``, ``text`` of all trusted documents.

    To the driver come a row of discounts for each language and order, a row of
    totals for each language, a histogram of counts, and the HOT rows.
    """
    spark = texts.sparkSession
    own = cut(count_grams(texts))
    known = [r["lang"] for r in own.groupBy("lang").agg(F.sum("n").alias("n")).where((F.col("n") >= MIN_CHARACTERS) & F.col("lang").isNotNull() & (F.col("lang") != ALL)).collect()]
    pooled = own.groupBy("code").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "code", "n")
    level = own.where(F.col("lang").isin(known)).select("lang", "code", "n").unionByName(pooled) if known else pooled
    levels = None
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # continuations: how many longer grams end in this one
            level = level.groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        said = level.select("lang", F.lit(k).alias("k"), _key(F.col("code"), k).alias("key"), _context(F.col("code"), k).alias("context"), _key(F.col("code"), k - 1).alias("lower"), "n")
        levels = said if levels is None else levels.unionByName(said)
    levels = cut(levels)
    few = levels.groupBy("lang", "k").agg(*[F.count_if(F.col("n") == j).alias(f"n{j}") for j in (1, 2, 3, 4)]).collect()
    d = spark.createDataFrame([(r["lang"], r["k"], *map(float, _discounts(np.array([r["n1"], r["n2"], r["n3"], r["n4"]])))) for r in few] or [("", 0, 0.0, 0.0, 0.0)], "lang string, k int, d1 double, d2 double, d3 double")
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    counted = levels.join(F.broadcast(d), ["lang", "k"]).withColumn("taken", taken)  # five rows a language
    contexts = counted.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("taken").alias("left"))
    shares = cut(counted.join(contexts, ["lang", "context"]).select("lang", "k", "key", "lower", "n", ((F.col("n") - F.col("taken")) / F.col("total")).alias("own"), (F.col("left") / F.col("total")).alias("left")))
    p = shares.where("k = 1").select("lang", "k", "key", "n", (F.col("own") + F.col("left") / ALPHABET).alias("p"))
    every = p
    for k in range(2, ORDER + 1):
        below = p.select("lang", F.col("key").alias("lower"), F.col("p").alias("below"))
        p = shares.where(F.col("k") == k).join(below, ["lang", "lower"]).select("lang", "k", "key", "n", (F.col("own") + F.col("left") * F.col("below")).alias("p"))
        every = every.unionByName(p)
    grams = every.select("lang", "key", "n", "k", F.log("p").alias("log_p"), F.lit(None).cast("double").alias("log_left"))
    lefts = contexts.select("lang", F.col("context").alias("key"), F.col("total").alias("n"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("log_p"), F.log(F.col("left") / F.col("total")).alias("log_left"))
    rows = grams.unionByName(lefts).groupBy("lang", "key").agg(F.max("n").alias("n"), F.max("k").alias("k"), F.max("log_p").alias("log_p"), F.coalesce(F.max("log_left"), F.lit(0.0)).alias("log_left"))
    rows = cut(rows)
    # The most frequent rows, by a histogram of their counts in eighths of a doubling.
    bin_of = F.floor(F.log2(F.col("n").cast("double")) * 8)
    sizes = sorted(((r["b"], r["rows"]) for r in rows.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    total, least = 0, None
    for b, n in sizes:
        if total + n > HOT:
            break
        total, least = total + n, b
    held = rows.where(bin_of >= least) if least is not None else rows.where("false")
    # Words of the filters are shared out evenly, so that all of them together are bounded.
    per = {r["lang"]: r["rows"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()}
    table = held.select("lang", "key", F.col("log_p").cast("float").alias("log_p"), F.col("log_left").cast("float").alias("log_left")).toArrow()
    langs = table.column("lang").combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    hot = {}
    for lang, n in per.items():
        code = langs.dictionary.index(lang).as_py()
        at = np.nonzero(langs.indices.to_numpy(zero_copy_only=False) == code)[0] if code >= 0 else np.zeros(0, np.int64)
        keys, log_p, log_left = (table.column(c).to_numpy()[at] for c in ("key", "log_p", "log_left"))
        words = None
        if len(at) < n:
            words = build_filter(rows.where(F.col("lang") == lang), max(1, min(FILTER_WORDS // max(1, len(per)), n * FILTER_BITS // 64)))
        hot[lang] = (keys.view(np.uint64), log_p, log_left, words)
    means = {r["lang"]: r["m"] for r in rows.where(F.col("k") == ORDER).groupBy("lang").agg((-F.sum(F.col("n") * F.col("log_p")) / F.sum("n")).alias("m")).collect()}
    return Model(hot, means, rows.select("lang", "key", "log_p", "log_left"))


def score(documents: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", lang: str = "lang", both: str = "false") -> DataFrame:
    """For each row, and each model that it is scored by: ``row`` (its place), key, ``h1``, ``h2``, ``lang``, ``model``, ``second``, ``n_chars_scored``, ``suspect``, ``nats`` (mean, smoothed) and ``perplexity``.

    A row is scored by its language's model, by that of all text where there is none.
    A text that its language's model finds unlikely (``suspect``: by SUSPECT nats a
    character) is scored by the model of all text too (``second``): named languages can
    be wrong. So is every row for which the SQL condition ``both`` holds, and what may
    be suspect before it is looked up. Null and empty texts have no characters and a null perplexity.
    """
    spark = documents.sparkSession
    ship_package(spark)
    kind = documents.schema[key].dataType.simpleString()
    shared = spark.sparkContext.broadcast((model.hot, model.means))
    identity = uuid.uuid4().hex
    names = ["row", key, "h1", "h2", "lang", "model", "second", "n_chars_scored", "log_sum", "codes", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, means = shared.value
        owner = ("quality", identity)
        row = TaskContext.get().partitionId() << 40

        def said(name: str, bodies: list[tuple[int, str]]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
            """For each text the sum of log-probabilities, and the five-grams that have to be looked up, with their counts."""
            table = kept(owner, name, lambda: Held(*hot[name]))
            totals, found = dict.fromkeys((i for i, _ in bodies), 0.0), {}
            for codes, places in blocks(bodies):
                log_p, cold = table.log_probabilities(codes)
                starts = np.concatenate([[0], np.nonzero(np.diff(places))[0] + 1])
                for i, total in zip(places[starts].tolist(), np.add.reduceat(log_p, starts).tolist(), strict=True):
                    totals[i] += total
                if cold.any():
                    asked, of = codes[cold], places[cold]
                    ends = np.concatenate([np.nonzero(np.diff(of))[0] + 1, [len(of)]])
                    for start, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
                        found.setdefault(int(of[start]), []).append(asked[start:end])
            return {i: (t, *(np.unique(np.concatenate(found[i]), return_counts=True) if i in found else (none, none))) for i, t in totals.items()}

        none = np.zeros(0, np.uint64)
        for batch in batches:
            keys, first, second, langs, texts, twice = batch.columns
            bodies = [t.as_py() or "" for t in texts]
            owners = [own if own in hot else ALL for own in langs.to_pylist()]
            by_model: dict[str, list[tuple[int, str]]] = {}
            for i, (name, body) in enumerate(zip(owners, bodies, strict=True)):
                if body and name in hot:
                    by_model.setdefault(name, []).append((i, body))
            results = {i: r for name, texts_of in by_model.items() for i, r in said(name, texts_of).items()}
            again = twice.to_pylist()
            # What has to be looked up may be as unlikely as can be: such a text is scored twice, and judged by its exact sum.
            may = lambda i, total, counts: -total + MOST * int(counts.sum()) > (means[owners[i]] + SUSPECT) * len(bodies[i])
            seconds = said(ALL, [(i, bodies[i]) for i, (total, _, counts) in results.items() if owners[i] != ALL and (again[i] or may(i, total, counts))]) if ALL in hot else {}
            out: list[tuple] = []
            for i, own in enumerate(langs.to_pylist()):
                total, codes, counts = results.get(i, (0.0, none, none))
                out.append((row, i, own, owners[i], False, len(bodies[i]), total, codes.view(np.int64), counts.view(np.int64)))
                if i in seconds:
                    total, codes, counts = seconds[i]
                    out.append((row, i, own, ALL, True, len(bodies[i]), total, codes.view(np.int64), counts.view(np.int64)))
                row += 1
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            at = pa.array(columns[1], pa.int64())
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *c]))) for c in columns[7:]]
            scalars = (pa.array(c, t) for c, t in zip(columns[2:7], (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.float64()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), keys.take(at), first.take(at), second.take(at), *scalars, *lists], names=names)

    asked = documents.select(key, *digest(text), F.col(lang).alias("lang"), text, F.coalesce(F.expr(both), F.lit(False)).alias("both"))
    parts = cut(asked.mapInArrow(tidy(run), f"row long, {key} {kind}, h1 long, h2 long, lang string, model string, second boolean, n_chars_scored long, log_sum double, codes array<long>, counts array<long>"))
    whole = parts.drop("codes", "counts").withColumn("gained", F.lit(0.0))
    if any(words is not None for *_, words in model.hot.values()):
        cold = parts.where(F.size("codes") > 0).select("row", F.col("model").alias("lang"), "second", F.explode(F.arrays_zip("codes", "counts")).alias("e"))
        cold = cold.select("row", "lang", "second", F.col("e.codes").alias("code"), F.col("e.counts").alias("n"))
        gained = cold.join(look_up(cold, model.rows), ["lang", "code"]).groupBy("row", "second").agg(F.sum(F.col("n") * F.col("log_p")).alias("gained"))
        whole = parts.drop("codes", "counts").join(gained, ["row", "second"], "left")
    means = spark.createDataFrame([(k, float(m)) for k, m in model.means.items()] or [("", 0.0)], "model string, mean double")
    whole = whole.join(F.broadcast(means), "model", "left")  # a row for each language
    nats = -(F.col("log_sum") + F.coalesce(F.col("gained"), F.lit(0.0)))
    smoothed = F.when(F.col("n_chars_scored") > 0, (nats + PRIOR * F.coalesce(F.col("mean"), F.lit(0.0))) / (F.col("n_chars_scored") + PRIOR))
    suspect = nats > (F.col("mean") + SUSPECT) * F.col("n_chars_scored")
    return whole.select(*names[:-3], F.coalesce(suspect, F.lit(False)).alias("suspect"), smoothed.alias("nats")).withColumn("perplexity", F.exp("nats"))


def look_up(cold: DataFrame, rows: DataFrame) -> DataFrame:
    """``lang``, ``code``, ``log_p`` of each distinct five-gram of ``cold``, from the sharded rows of all orders."""
    slots = [(f"k{k}", _key(F.col("code"), k)) for k in range(1, ORDER + 1)] + [(f"c{k}", _context(F.col("code"), k)) for k in range(1, ORDER + 1)]
    asked = cold.select("lang", "code").distinct().select("lang", "code", F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), key.alias("key")) for s, key in slots])).alias("e")).select("lang", "code", "e.*")
    met = asked.join(rows, ["lang", "key"], "left").groupBy("lang", "code").agg(*[F.max(F.when(F.col("slot") == s, F.col("log_p" if s[0] == "k" else "log_left"))).alias(s) for s, _ in slots])
    log_p = F.lit(-float(np.log(ALPHABET)))
    for k in range(1, ORDER + 1):
        log_p = F.coalesce(F.col(f"k{k}"), F.coalesce(F.col(f"c{k}"), F.lit(0.0)) + log_p)
    return met.select("lang", "code", log_p.alias("log_p"))


def quantiles(scored: DataFrame, low: float, high: float) -> DataFrame:
    """For each ``bounds`` ``nats_low``, ``nats_high`` and ``rows``: quantiles of its scored rows.

    They come from histograms of BINS bins a nat, which add up over any number of tasks
    and cover every row.
    """
    bins = scored.where(F.col("nats").isNotNull()).groupBy("bounds", F.floor(F.col("nats") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("bounds").orderBy("bin")
    placed = bins.withColumn("upto", F.sum("n").over(running)).withColumn("all", F.sum("n").over(Window.partitionBy("bounds")))
    found = placed.groupBy("bounds").agg(F.min(F.when(F.col("upto") >= F.col("all") * low, F.col("bin"))).alias("l"), F.min(F.when(F.col("upto") >= F.col("all") * high, F.col("bin") + 1)).alias("h"), F.max("all").alias("rows"))
    return found.select("bounds", (F.col("l") / BINS).alias("nats_low"), (F.col("h") / BINS).alias("nats_high"), "rows")


def thresholds(trusted: DataFrame, low: float, high: float, margin: float) -> DataFrame:
    """For each ``bounds`` the bounds of ``nats`` for trusted rows (``nats``, ``held``: not trained on).

    The upper bound is a quantile of held-out rows, since a model is surprised less by what it
    was trained on; the lower one of all. Both are widened by ``margin`` times their
    distance, and by what a quantile of few rows is uncertain by.
    """
    every = quantiles(trusted, low, high).select("bounds", "nats_low", F.col("nats_high").alias("any_high"), "rows")
    held = quantiles(trusted.where("held"), low, high).select("bounds", "nats_high", F.col("rows").alias("held_rows"))
    both = every.join(held, "bounds", "left").withColumn("nats_high", F.greatest(F.coalesce("nats_high", "any_high"), F.col("any_high")))
    wide = (F.col("nats_high") - F.col("nats_low")) * margin + F.lit(FEW) / F.sqrt(F.coalesce(F.col("held_rows"), F.lit(1)))
    return both.select("bounds", (F.col("nats_low") - wide).alias("nats_low"), (F.col("nats_high") + wide).alias("nats_high"))


def classify(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", low: float = 0.001, high: float = 0.995, margin: float = 0.25) -> DataFrame:
    """Every row's ``row``, key, ``h1``, ``h2`` (digest of its text), ``lang``, ``perplexity``, ``threshold_low``, ``threshold_high`` and ``keep``.

    Trusted text is every document that a label calls of quality 1. The model is
    trained on all of it but one document of HELD_OUT, by the key's hash. A document is
    kept if its perplexity lies between its language's bounds: quantiles ``low`` and
    ``high`` of that language's trusted documents, widened as ``thresholds`` says. Too
    low is as suspect as too high: text that repeats itself is too easy. A language
    without trusted documents, and a null one, goes by the bounds of all text, those of
    held-out documents of every language under the model of all text. A document above
    its language's bounds, and suspect, is kept if it lies between the bounds of all text under that
    model; what is reported then is that perplexity and those bounds.

    Null and empty texts have a null perplexity and are not kept. With no trusted text
    at all, nothing can be judged and every row with text is kept. Repeated rows are
    judged each; rows of equal text and language are judged alike. Repeated or
    contradictory labels: any label of quality 1 makes a document trusted. A null key
    has no label. Empty tables give no rows. Only the named columns are read.
    """
    spark = documents.sparkSession
    ship_package(spark)
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(HELD_OUT)) == 0
    good = cut(labels.where("quality = 1").select(F.col("doc_id").alias(key), held.alias("held")).distinct())
    small = good.count() <= BROADCAST_IDS
    trusted_ids = F.broadcast(good) if small else good
    slim = documents.select(key, F.col(lang).alias("lang"), F.col(text).alias("text"))
    model = train(slim.join(trusted_ids, key).where("NOT held").select("lang", "text"))
    scored = cut(score(slim.join(trusted_ids, key, "left"), model, key=key, text="text", lang="lang", both="held"))
    group = F.when(F.col("second"), F.lit(ALL)).otherwise(F.coalesce("lang", F.lit(ALL)))
    # Rows of languages without a model are under the model of all text anyhow: held-out ones count for its bounds too.
    trusted = scored.join(trusted_ids, key).withColumn("bounds", F.explode(F.array_distinct(F.when((F.col("model") == ALL) & F.col("held"), F.array(group, F.lit(ALL))).otherwise(F.array(group)))))
    trusted = trusted.where("NOT second OR held")
    bounds = F.broadcast(cut(thresholds(trusted, low, high, margin)))  # a row for each language
    plain = bounds.select(F.col("bounds").alias("own"), F.col("nats_low").alias("own_low"), F.col("nats_high").alias("own_high"))
    last = bounds.where(F.col("bounds") == ALL).select(F.col("nats_low").alias("all_low"), F.col("nats_high").alias("all_high"))
    firsts = scored.where("NOT second").withColumn("own", group)
    seconds = scored.where("second").select("row", F.col("nats").alias("all_nats"))
    judged = firsts.join(plain, "own", "left").join(last, F.lit(True), "left").join(seconds, "row", "left")
    judged = judged.withColumn("low", F.coalesce("own_low", "all_low")).withColumn("high", F.coalesce("own_high", "all_high"))
    saved = F.coalesce(F.col("suspect") & (F.col("nats") > F.col("high")) & F.col("all_nats").between(F.col("all_low"), F.col("all_high")), F.lit(False))
    pick = lambda a, b: F.exp(F.when(saved, F.col(a)).otherwise(F.col(b)))
    keep = F.col("nats").isNotNull() & (saved | F.coalesce(F.col("nats").between(F.col("low"), F.col("high")), F.lit(True)))
    return judged.select("row", key, "h1", "h2", "lang", pick("all_nats", "nats").alias("perplexity"), pick("all_low", "low").alias("threshold_low"), pick("all_high", "high").alias("threshold_high"), keep.alias("keep"))


def accepted(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that ``classify`` keeps, all their columns.

    Decisions depend on text and language only and are joined by them, so rows of a
    repeated or null key are judged each by its own text. What goes is broadcast if it
    is little (BROADCAST_IDS), else joined by a shuffle; texts are not judged twice.
    """
    text, lang = options.get("text", "text"), options.get("lang", "lang")
    with scratch() as made:
        gone = cut(classify(documents, labels, **options).where("NOT keep").select("h1", "h2", F.col("lang").alias("__lang")).distinct())
        made.pop()
    small = gone.count() <= BROADCAST_IDS
    gone = gone.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "__lang")
    h1, h2 = digest(text)
    same = (h1 == F.col("__h1")) & (h2 == F.col("__h2")) & F.col(lang).eqNullSafe(F.col("__lang"))
    return documents.join(F.broadcast(gone) if small else gone, same, "left_anti")
