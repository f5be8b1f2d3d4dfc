"""Exact dedup against a minimal perfect hash of historical distinct digests.

Texts are equal when their normalised forms are, so SHA-256 digests of those stand for
them. The distinct digests of the history are dealt over shards by hash; every shard
is one row: a minimal perfect hash (levels of bits, a digest's slot is the rank of its
bit) and, in slot order, the full digests, the locators of the rows that stay and how
many rows had the text. Arrivals are reduced to distinct digests before any exchange
and meet the shard that alone can hold them. The hash names one slot for any digest,
member or not, so all 32 bytes are compared there: equal ones are repeats of history,
the rest are new and form groups of their own.

A shard holds SHARD_ROWS digests on average, whatever the corpus, and an arrival costs
one slot; no text is moved for it. Rows learn their group's fate by a join in which
no digest has more than a HOT_SHARE-th of all rows: the more frequent ones, of which
there can be HOT_SHARE at most, are broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.session import cut, drop_cut, ship_package

#: Digests in a shard, on average.
SHARD_ROWS = 65_536
#: Shards for each shuffle partition at least, so that partitions are even.
SHARDS_EACH = 4
#: A digest of more than one of so many rows is broadcast.
HOT_SHARE = 1024
#: Bits of a level for each digest that is left.
ROOM = 1.5
DIGEST_BYTES = 32
#: White space that is one space in the normalised text.
BLANKS = r"[\x20\x09-\x0D]+"
INDEX_SCHEMA = "shard int, n long, sizes array<long>, bits binary, digests binary, winners array<long>, rows array<long>, counts array<long>"
_GOLDEN, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class PerfectHash:
    """Slots 0 to n-1 for n distinct digests, one each."""

    def __init__(self, levels: list[np.ndarray]):
        #: Bits of each level, as booleans.
        self.levels = levels
        self.ranks = []
        before = 0
        for bits in levels:
            ranks = np.cumsum(bits, dtype=np.int64) - 1 + before
            before += int(bits.sum())
            self.ranks.append(ranks)
        self.n = before

    @staticmethod
    def places(words: np.ndarray, level: int, size: int) -> np.ndarray:
        """Where digests (rows of four 64-bit words) fall in a level. Levels go round the words, so distinct digests part sometime."""
        x = words[:, level % 4] + np.uint64((level + 1) * int(_GOLDEN) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * _MIX_A
        x = (x ^ (x >> np.uint64(27))) * _MIX_B
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        """From distinct digests: those alone in their place take it, the others go on to the next level."""
        levels: list[np.ndarray] = []
        left = words
        while len(left):
            size = max(2, int(ROOM * len(left)))
            at = cls.places(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where no level has a bit for it. What was not built in may get any slot."""
        out = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self.places(words[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[list[int], bytes]:
        return [len(b) for b in self.levels], np.packbits(np.concatenate(self.levels) if self.levels else np.zeros(0, bool)).tobytes()

    @classmethod
    def load(cls, sizes: list[int], data: bytes) -> PerfectHash:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=sum(sizes)).astype(bool)
        return cls(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [])


def _bytes(column: pa.ChunkedArray) -> bytes:
    """All digests of a column of binaries of one length, one after another."""
    return b"".join(column.to_pylist())


def _words(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8").reshape(-1, DIGEST_BYTES // 8)


def _build(table: pa.Table) -> pa.Table:
    """One shard of the index from the distinct digests that fall in it."""
    data = _bytes(table["digest"])
    words = _words(data)
    hashed = PerfectHash.build(words)
    # order[slot] is the digest that has the slot.
    order = np.empty(len(words), np.int64)
    order[hashed.slots(words)] = np.arange(len(words))
    sizes, bits = hashed.dump()
    held = np.frombuffer(data, np.uint8).reshape(-1, DIGEST_BYTES)[order].tobytes()
    place = pa.array(order)
    columns = [pa.array([x.take(place).combine_chunks().to_pylist()], pa.list_(pa.int64())) for x in (table["winner"], table["row"], table["n"])]
    return pa.Table.from_arrays([pa.array([table["shard"][0].as_py()], pa.int32()), pa.array([len(words)], pa.int64()), pa.array([sizes], pa.list_(pa.int64())), pa.array([bits], pa.binary()), pa.array([held], pa.binary()), *columns], names=["shard", "n", "sizes", "bits", "digests", "winners", "rows", "counts"])


def _settle(index: pa.Table, asked: pa.Table) -> pa.Table:
    """All digests of a shard with the row that stays: the slots, counted up by the repeats that arrived, and the arrivals that no slot holds."""
    data = _bytes(asked["digest"])
    first, row, count = (asked[c].combine_chunks() if isinstance(asked[c], pa.ChunkedArray) else asked[c] for c in ("winner", "row", "n"))
    n = count.to_numpy(zero_copy_only=False).astype(np.int64)
    asked_digests = np.frombuffer(data, np.uint8).reshape(-1, DIGEST_BYTES)
    member = np.zeros(len(n), bool)
    parts = []
    for shard in index.to_pylist():
        held = np.frombuffer(shard["digests"], np.uint8).reshape(-1, DIGEST_BYTES)
        slots = PerfectHash.load(shard["sizes"], shard["bits"]).slots(_words(data))
        found = np.nonzero(slots >= 0)[0]
        # Byte check: the slot is right only if it holds this very digest.
        found = found[(held[slots[found]] == asked_digests[found]).all(axis=1)]
        member[found] = True
        counts = np.array(shard["counts"], np.int64)
        counts[slots[found]] += n[found]  # asked digests are distinct, so slots are
        parts.append((held, pa.array(shard["winners"], pa.int64()), pa.array(shard["rows"], pa.int64()), counts, True))
    fresh = np.nonzero(~member)[0]
    parts.append((asked_digests[fresh], first.take(pa.array(fresh)).cast(pa.int64()), row.take(pa.array(fresh)).cast(pa.int64()), n[fresh], False))
    return pa.concat_tables([pa.Table.from_arrays([pa.array([d.tobytes() for d in held], pa.binary()), winners, rows, pa.array(counts), pa.array(np.full(len(counts), old))], names=["digest", "keep", "keep_row", "group_size", "historical"]) for held, winners, rows, counts, old in parts])


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the text with each run of white space as one space; a null text counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ").cast("binary"), 256))


def _distinct(rows: DataFrame) -> DataFrame:
    """``digest``, ``winner`` and ``row`` (of the least key, nulls last), ``n``: one row for each distinct digest; summed up before the exchange."""
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("least")
    return rows.groupBy("digest").agg(least, F.count(F.lit(1)).alias("n")).select("digest", F.col("least.key").alias("winner"), F.col("least.row").alias("row"), "n")


def _shards(distinct: DataFrame, shards: int) -> DataFrame:
    return distinct.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def shard_count(rows: DataFrame) -> int:
    """Shards for a table of so many rows: SHARD_ROWS digests each on average if none repeats, and several for each shuffle partition."""
    return max(SHARDS_EACH * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_ROWS))


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """The index of a history of ``key`` long, ``row`` long, ``digest`` binary: one row for each shard that has digests (INDEX_SCHEMA).

    It can be written as Parquet and read again; whoever looks up must deal by the same
    number of shards. An empty history gives no rows.
    """
    ship_package(rows.sparkSession)
    return _shards(_distinct(rows), shards).groupBy("shard").applyInArrow(_build, INDEX_SCHEMA)


def settle(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """Every distinct digest of history and arrivals: ``digest``, ``keep`` and ``keep_row`` (locator of the row that stays), ``group_size``, ``historical``.

    A digest that history has keeps history's row. ``rows`` are the arrivals, as for
    ``build_index``.
    """
    ship_package(rows.sparkSession)
    asked = _shards(_distinct(rows), shards)
    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_settle, "digest binary, keep long, keep_row long, group_size long, historical boolean")


def _told(rows: DataFrame, settled: DataFrame, total: int) -> DataFrame:
    """``rows`` with what was settled for their digests."""
    # Digests of more than a HOT_SHARE-th of all rows are HOT_SHARE at most, so they can be broadcast; no other one makes a partition uneven.
    bound = max(total // HOT_SHARE, 1)
    hot = settled.where(F.col("group_size") > bound)
    by_broadcast = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(settled.where(F.col("group_size") <= bound), "digest")
    return by_broadcast.unionByName(rest)


def _staged(documents: DataFrame, key: str, text: str, whole: bool) -> DataFrame:
    """Keys and digests, written once: ``row`` numbers must not change when a task is repeated."""
    columns = [F.col(key).cast("long").alias("key"), digest(F.col(text)).alias("digest")]
    if whole:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole"))
    return cut(documents.select(*columns).withColumn("row", F.monotonically_increasing_id()))


def duplicates(documents: DataFrame, *, key: str = "doc_id", text: str = "text", history_share: float = 0.5, whole: bool = False) -> DataFrame:
    """Groups of equal texts in one table; the rows of the lower keys are the history that the others are looked up in.

    Returns for every row ``key``, ``keep_id`` (key of the row that stays, the least of
    the group), ``group_size`` long, ``kept``, ``text_sha256`` (lower-case hex of the
    normalised text); ``whole`` adds the row as a struct of that name. History ends at
    the ``history_share`` quantile of the keys, as Spark estimates it; no result depends
    on where that is. Null and empty texts are equal to each other. A null key comes
    after all others: its row stays only if no row of the group has a key. Exactly one
    row of a group stays, also where a row is repeated. Keys are cast to long. Empty
    tables give no rows. Other columns are read only for ``whole``.
    """
    rows = _staged(documents, key, text, whole)
    total = rows.count()
    edge = rows.agg(F.percentile_approx("key", history_share, 10_000)).collect()[0][0]
    old = F.coalesce(F.col("key") <= F.lit(edge), F.lit(False)) if edge is not None else F.lit(False)
    slim = rows.select("key", "row", "digest")
    shards = shard_count(rows)
    index = cut(build_index(slim.where(old), shards))
    settled = cut(settle(index, slim.where(~old), shards))
    drop_cut(index)
    told = _told(rows, settled, total)
    extra = ["whole"] if whole else []
    return told.select(F.col("key").alias(key), F.col("keep").alias("keep_id"), "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *extra)


def unique(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; edge cases as in ``duplicates``."""
    return duplicates(documents, key=key, text=text, whole=True).where("kept").select("whole.*")


def arrivals(documents: DataFrame, index: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of new documents whose text neither an index of earlier ones nor a lower key among them has; all their columns.

    ``shards`` is what the index was built with. Null keys, null texts and repeats as in
    ``duplicates``.
    """
    rows = _staged(documents, key, text, True)
    settled = cut(settle(index, rows.select("key", "row", "digest"), shards)).where("NOT historical")
    return _told(rows, settled, rows.count()).where(F.col("row") == F.col("keep_row")).select("whole.*")
