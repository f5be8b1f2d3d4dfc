"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Fingerprints that differ in three bits at most differ
in three bytes at most, so they share at least five positional bytes. Postings of one
positional byte would hold a 256th of all fingerprints, so the index is kept on sets
of four positions: the fourteen blocks of the Steiner system S(3,4,8), of which every
five positions contain exactly one. A pair that shares five positional bytes or more
therefore meets in at least one of fourteen postings with 32-bit keys. The tally of
shared positional bytes is taken for each pair that meets; pairs under five are
dropped, and the rest are verified by counting differing bits.

Equal fingerprints are one entry of the index. A posting that is still long (many
near copies of one text) is not expanded into pairs: two fingerprints at distance
three at most have a midpoint within one bit of the first and two bits of the second,
so members are joined to one hub for each midpoint. That is linear in the posting and
loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.session import cut, drop_cut, ship_package, tidy

SEED = 42
MAX_BITS = 3
POSITIONS = 8
MIN_SHARED = POSITIONS - MAX_BITS
#: Longest posting that is expanded into pairs; longer ones go by midpoints.
LONG_POSTING = 512
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def _blocks() -> list[tuple[int, ...]]:
    """Positions of the weight-4 words of the extended Hamming code of length 8."""
    generators = (0b11110000, 0b11001100, 0b10101010, 0b11111111)
    words = set()
    for chosen in product((0, 1), repeat=4):
        word = 0
        for take, g in zip(chosen, generators, strict=True):
            word ^= g * take
        words.add(word)
    return sorted(tuple(i for i in range(8) if w >> i & 1) for w in words if w.bit_count() == 4)


BLOCKS = _blocks()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


BLOCK_MASKS = [_signed(sum(0xFF << 8 * p for p in block)) for block in BLOCKS]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 for no words.

    Words are runs of anything but space and U+0009 to U+000D, after A-Z are
    lower-cased (bytes.lower and bytes.split do just that). Fewer words than a shingle
    make one shingle of them all.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    if len(words) < shingle:
        groups = iter([words])
    else:
        groups = zip(*(words[i:] for i in range(shingle)), strict=False)
    counts, n = np.zeros(64, np.int64), 0
    while hashes := b"".join([digest(join(g), SEED) for g in islice(groups, CHUNK)]):
        rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
        n += len(rows)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(documents: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """The key and ``fp`` (long, the fingerprint's bits) of every row; a null text counts as empty."""
    ship_package(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=[key, "fp"])

    return documents.select(key, text).mapInArrow(tidy(run), f"{key} {kind}, fp long")


def shared_bytes(x: Column) -> Column:
    """How many of the eight bytes of an exclusive or are zero: the tally of shared positional bytes."""
    total = F.lit(0)
    for p in range(POSITIONS):
        total = total + F.when(F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0)
    return total


def _midpoints(spark: SparkSession) -> DataFrame:
    """For each block the changes of up to two bits outside it: ``block``, ``change``, ``near`` (one bit at most). 14 x 529 rows."""
    rows = []
    for b, block in enumerate(BLOCKS):
        free = [8 * p + i for p in range(POSITIONS) if p not in block for i in range(8)]
        for size in (0, 1, 2):
            rows += [(b, _signed(sum(1 << i for i in bits)), size <= 1) for bits in combinations(free, size)]
    return spark.createDataFrame(rows, "block int, change long, near boolean")


def links(fps: DataFrame) -> DataFrame:
    """``u``, ``v``: links that connect all distinct ``fp`` at distance three or less, each link such a pair.

    For postings that are not long these are all pairs at that distance; for long ones
    a spanning part of them (through hubs), which connects the same fingerprints.
    """
    spark = fps.sparkSession
    entries = F.array(*[F.struct(F.lit(b).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for b, m in enumerate(BLOCK_MASKS)])
    postings = fps.select("fp").distinct().select("fp", F.explode(entries).alias("e")).select("e.block", "e.key", "fp")
    lengths = postings.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(postings.join(lengths, ["block", "key"]))
    short = met.where(F.col("n") <= LONG_POSTING)
    x = F.col("u").bitwiseXOR(F.col("v"))
    # A pair that shares more than five bytes meets in several postings; the first of them reports it.
    first = F.lit(True)
    for b, m in enumerate(BLOCK_MASKS):
        first = first & ~((F.col("block") > b) & (x.bitwiseAND(F.lit(m)) == 0))
    pairs = short.select("block", "key", F.col("fp").alias("u")).join(short.select("block", "key", F.col("fp").alias("v")), ["block", "key"]).where(F.col("u") < F.col("v"))
    pairs = pairs.where((shared_bytes(x) >= MIN_SHARED) & first).where(F.bit_count(x) <= MAX_BITS).select("u", "v")
    long = met.where(F.col("n") > LONG_POSTING)
    if long.isEmpty():
        return pairs
    # 529 changes are a fixed list of 120 kB for all blocks.
    changed = long.join(F.broadcast(_midpoints(spark)), "block").select("block", F.col("fp").bitwiseXOR(F.col("change")).alias("mid"), "fp", "near")
    hubs = changed.where("near").groupBy("block", "mid").agg(F.min("fp").alias("u"))
    spokes = changed.join(hubs, ["block", "mid"]).where(F.col("u") != F.col("fp"))
    spokes = spokes.select(F.least("u", "fp").alias("u"), F.greatest("u", "fp").alias("v")).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS).distinct()
    return pairs.unionByName(spokes)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: every node of the links and the least node it reaches (alternating large and small stars).

    Each round is written to the shared folder; rounds grow with the logarithm of the
    longest path. Minima are aggregated before the exchange, so a node with very many
    links sends one row from each task.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        before, now = now, cut(small.select("e.u", F.col("e.m").alias("v")).where("u != v").distinct())
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).collect()[0]
        drop_cut(before)
        if after == state or not after[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = after


def near_duplicates(documents: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Every row's key, ``fingerprint`` (16 hex digits) and ``component_id`` (the least key it reaches, its own included).

    Fingerprints at three differing bits or fewer are linked, and links add up. Null
    and empty texts have fingerprint zero and are linked like any other. Repeated rows
    and ties share a fingerprint. A null key has its group's least key, null if the
    group has no other. Empty tables give no rows. Only the two columns are read.
    """
    fps = cut(fingerprints(documents, key=key, text=text, shingle=shingle))
    first = cut(fps.groupBy("fp").agg(F.min(key).alias("first")))
    roots = components(links(first))
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
