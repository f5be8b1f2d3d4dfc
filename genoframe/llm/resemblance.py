"""Near-duplicate texts by shingles of five words: postings of sampled positional bytes, a tally, and the exact similarity.

At a Jaccard similarity of 0.8 two 64-bit majority fingerprints differ in about ten
bits, and no set of bytes that they surely share is left to index. So here each byte
of the fingerprint is a SimHash of one sampled shingle: the low byte of the hash that
is least in that position's own order. Two texts share a byte with the probability of
their similarity at least. The index, its blocks of four positions and the count
filter are those of ``simhash``, over two fingerprints of eight bytes: at a similarity
of 0.8 a pair meets in one of the 28 postings and shares MIN_SHARED bytes with a
probability of 0.996, and more above. What meets is verified by the Jaccard similarity
of the whole shingle sets.

Groups of copies stay linear. Equal texts are one entry. Every text is first verified
against the leader that most of its postings name (the least hash in each), which
links nearly all of a group. Afterwards texts of one posting that are not connected
yet are compared, all of them: by a join in a posting of PART members at most, and as
tiles of a longer one, where a task counts shared bytes and shingles of two tiles as
arrays and gives the links that connect their groups. Tiles of one and the same group
do not meet, so copies that a leader joined cost their members and not their pairs;
texts of a posting that stay unlike are compared in pairs, two tiles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.llm.simhash import BLOCK_MASKS, components, shared_bytes
from genoframe.session import cut, kept, scratch, ship_package, tidy

SHINGLE = 5
SIMILARITY = 0.8
POSITIONS = 16
#: Shared bytes of 16 that a pair needs to be verified.
MIN_SHARED = 8
#: Longest posting whose unconnected members meet in a join; those of longer ones meet in tiles.
PART = 32
#: Shingles of a tile, and how many a text counts for at least: 512 texts of a tile at most, or one long text.
TILE, LEAST = 1 << 17, 1 << 8
#: Shingles that two tiles have in common which are counted at once.
COMMON = 2048
#: Shingles whose samples are drawn at once.
CHUNK = 1 << 16
#: Most ids and decisions that are broadcast, of some 100 bytes each; beyond it the join is shuffled.
BROADCAST_IDS = 500_000
_RNG = np.random.default_rng(17)
ORDERS = _RNG.integers(0, 1 << 63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of a whole text's shingles, sorted. Words are those of ``simhash.fingerprint``; fewer words than a shingle make one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):  # a polynomial of the words' hashes, mixed at the end
        out = out * _STEP + h[i : i + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29)))


def sampled_bytes(hashes: np.ndarray) -> tuple[int, int]:
    """The sixteen positional bytes as two signed 64-bit numbers; zeros for no shingles."""
    if not len(hashes):
        return 0, 0
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[at : at + CHUNK, None] * ORDERS[None, :]).min(axis=0))
    a, b = np.frombuffer(least.astype(np.uint8).tobytes(), "<i8").tolist()
    return a, b


def prints(documents: DataFrame, *, key: str, text: str) -> DataFrame:
    """Each row's ``h1``, ``h2`` (a 128-bit digest of the text), ``key``, ``p1``, ``p2`` (positional bytes), ``n`` and ``s`` (shingle hashes)."""
    ship_package(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("resemblance", "", dict)  # what the worker has of other stages goes first
        for batch in batches:
            sets = [shingle_hashes(t.as_py()) for t in batch.column(3)]
            both = [sampled_bytes(s) for s in sets]
            sizes = np.array([len(s) for s in sets], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([p[0] for p in both], pa.int64()), pa.array([p[1] for p in both], pa.int64()), pa.array(sizes), lists], names=["h1", "h2", "key", "p1", "p2", "n", "s"])

    return documents.select(*digest(text), F.col(key).alias("key"), text).mapInArrow(tidy(run), f"h1 long, h2 long, key {kind}, p1 long, p2 long, n long, s array<long>")


def digest(text: str) -> tuple[Column, Column]:
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2")


def _alike(a: str, b: str) -> Column:
    """Whether sizes allow the similarity, and enough bytes are shared."""
    size = F.least(f"{a}.n", f"{b}.n") >= F.greatest(f"{a}.n", f"{b}.n") * F.lit(SIMILARITY) - F.lit(1e-9)
    return size & (_shared(a, b) >= MIN_SHARED)


def _shared(a: str, b: str) -> Column:
    """The tally: how many of the sixteen positional bytes are the same."""
    return sum((shared_bytes(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in ("p1", "p2")), F.lit(0))


#: The positions of each of the 28 blocks.
PLACES = [base + np.nonzero(np.array(m).astype("<i8").reshape(1).view(np.uint8))[0] for base in (0, 8) for m in BLOCK_MASKS]


def _entries(classes: DataFrame) -> DataFrame:
    """``posting``, ``block`` and the class, for each of the 28 blocks."""
    keys = [F.struct(F.xxhash64(F.lit(b), F.col(p).bitwiseAND(F.lit(m))).alias("posting"), F.lit(b).alias("block")) for p, base in (("p1", 0), ("p2", 14)) for b, m in enumerate(BLOCK_MASKS, base)]
    return classes.select(F.inline(F.array(*keys)), F.struct("id", "h1", "p1", "p2", "n").alias("c"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u``, ``v`` whose shingle sets (``id``, ``s``) have the similarity."""
    # Sets are larger than texts: only those of the pairs are moved, as long as their ids are few.
    asked = cut(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    found = cut(sets.join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, "id", "left_semi").groupBy("id").agg(F.first("s").alias("s")))
    met = pairs.join(found.select(F.col("id").alias("v"), F.col("s").alias("t")), "v").join(found.select(F.col("id").alias("u"), "s"), "u")
    shared = F.size(F.array_intersect("s", "t"))
    return met.where(shared >= F.lit(SIMILARITY) * (F.size("s") + F.size("t") - shared) - F.lit(1e-9)).select("u", "v")


def links(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """``u``, ``v``: verified links of similarity SIMILARITY or more between the classes (``id``, ``h1``, ``p1``, ``p2``, ``n``)."""
    leaders = cut(_entries(classes.select("id", "h1", "p1", "p2", "n")).groupBy("posting").agg(F.count(F.lit(1)).alias("size"), F.min("c.h1").alias("leader")).where("size > 1"))
    met = _entries(classes).join(F.broadcast(leaders) if leaders.count() <= 2 * BROADCAST_IDS else leaders, "posting")
    # First: each class and the least leader that is like it.
    named = met.where("c.h1 != leader").select("c", "leader").distinct()
    led = named.join(classes.select(F.col("h1").alias("leader"), F.struct("id", "p1", "p2", "n").alias("l")), "leader").where(_alike("c", "l"))
    first = cut(led.groupBy("c.id").agg(F.min("l.id").alias("v")).select(F.col("id").alias("u"), "v").where("u != v"))
    one = cut(verified(first, sets))
    # Then what meets and is not connected yet.
    roots = components(one)
    grouped = cut(met.select("posting", "block", "size", "c").join(roots.select(F.col("node"), "root"), F.col("c.id") == F.col("node"), "left").select("posting", "block", "size", "c", F.coalesce("root", "c.id").alias("root")))
    mixed = grouped.groupBy("posting").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("posting")
    apart = cut(grouped.join(mixed, "posting"))
    short = apart.where(F.col("size") <= PART)
    other = short.select("posting", F.col("c").alias("d"), F.col("root").alias("other"))
    pairs = short.join(other, "posting").where((F.col("root") < F.col("other")) & _alike("c", "d")).select(F.least("c.id", "d.id").alias("u"), F.greatest("c.id", "d.id").alias("v"))
    two = verified(cut(pairs.distinct()), sets)
    long = cut(apart.where(F.col("size") > PART).select("posting", "block", "root", "c.id", "c.p1", "c.p2", "c.n"))
    return one.unionByName(two) if long.isEmpty() else one.unionByName(two).unionByName(tile_links(long, sets))


def tile_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``u``, ``v``: verified links between texts of one posting and other ``root``; of several to the same effect in two tiles, one.

    A pair that meets in several postings is compared in that of its first block.
    """
    asked = cut(members.select("id").distinct())
    found = sets.join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, "id", "left_semi").groupBy("id").agg(F.first("s").alias("s"))
    upto = F.sum(F.greatest("n", F.lit(LEAST))).over(Window.partitionBy("posting").orderBy("root", "id").rowsBetween(Window.unboundedPreceding, -1))
    placed = members.withColumn("tile", F.floor(F.coalesce(upto, F.lit(0)) / F.lit(float(TILE)))).join(found, "id")
    kinds = "posting long, tile long, block int, low string, high string, ids binary, roots binary, prints binary, sizes binary, s binary"

    def pack(table: pa.Table) -> pa.Table:
        roots, ids = (np.array(table[c].to_pylist(), "S32") for c in ("root", "id"))
        prints = np.stack([table[p].to_numpy().astype("<i8") for p in ("p1", "p2")], axis=1)
        sizes, flat = table["n"].to_numpy().astype(np.int64), table["s"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        said = [pa.array([x.tobytes()], pa.binary()) for x in (ids, roots, prints, sizes, flat)]
        return pa.table([*(table[c][:1] for c in ("posting", "tile", "block")), pa.array([min(roots).decode()]), pa.array([max(roots).decode()]), *said], names=[x.split()[0] for x in kinds.split(", ")])

    tiles = cut(placed.groupBy("posting", "tile").applyInArrow(lambda t: pack(t), kinds))
    left, right = (tiles.select("posting", *[F.col(c).alias(side + c) for c in tiles.columns if c != "posting"]) for side in "ab")
    apart = (F.col("atile") <= F.col("btile")) & ~((F.col("alow") == F.col("bhigh")) & (F.col("ahigh") == F.col("blow")) & (F.col("alow") == F.col("ahigh")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                u, v = meet_tiles(*(_opened(row, side) for side in "ab"), row["ablock"], row["atile"] == row["btile"])
                yield pa.RecordBatch.from_arrays([pa.array(u.astype(str), pa.string()), pa.array(v.astype(str), pa.string())], names=["u", "v"])

    return cut(left.join(right, "posting").where(apart).mapInArrow(tidy(run), "u string, v string").distinct())


def _opened(row: dict, side: str) -> tuple[np.ndarray, ...]:
    ids, roots = (np.frombuffer(row[side + c], "S32") for c in ("ids", "roots"))
    return ids, roots, np.frombuffer(row[side + "prints"], np.uint8).reshape(-1, POSITIONS), np.frombuffer(row[side + "sizes"], np.int64), np.frombuffer(row[side + "s"], np.int64)


def meet_tiles(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], block: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The links between two tiles (ids, roots, positional bytes, numbers of shingles, shingles) of a block's posting, as many as connect what they connect."""
    a_ids, a_roots, a_prints, a_sizes, _ = a
    b_ids, b_roots, b_prints, b_sizes, _ = b
    shared = np.zeros((len(a_ids), len(b_ids)), np.uint8)
    for p in range(POSITIONS):
        shared += a_prints[:, p, None] == b_prints[None, :, p]
    near = (shared >= MIN_SHARED) & (a_roots[:, None] != b_roots[None, :])
    near &= np.minimum(a_sizes[:, None], b_sizes[None, :]) >= SIMILARITY * np.maximum(a_sizes[:, None], b_sizes[None, :]) - 1e-9
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    first = np.ones(len(i), bool)
    for places in PLACES[:block]:
        first &= (a_prints[i[:, None], places] != b_prints[j[:, None], places]).any(axis=1)
    i, j = i[first], j[first]
    if not len(i):
        return a_ids[:0], b_ids[:0]
    both = common_shingles(a[3:], b[3:], i, j)
    sound = both >= SIMILARITY * (a_sizes[i] + b_sizes[j] - both) - 1e-9
    i, j = i[sound], j[sound]
    # Of links between the same two roots, and of those that close a circle, one is enough.
    _, code = np.unique(np.concatenate([a_roots[i], b_roots[j]]), return_inverse=True)
    ends = np.stack([code[: len(i)], code[len(i) :]], axis=1)
    _, once = np.unique(np.sort(ends, axis=1), axis=0, return_index=True)
    above, chosen = list(range(len(code))), []

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for at in once.tolist():
        x, y = top(int(ends[at, 0])), top(int(ends[at, 1]))
        if x != y:
            above[x] = y
            chosen.append(at)
    return a_ids[i[chosen]], b_ids[j[chosen]]


def common_shingles(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles text i of one tile and text j of another have in common, for each pair: a product of incidence matrices, COMMON shingles at a time."""
    sides = []
    for (sizes, flat), asked in ((a, i), (b, j)):
        rows = np.unique(asked)
        text = np.repeat(np.arange(len(sizes)), sizes)
        used = np.isin(text, rows)
        sides.append((rows, np.searchsorted(rows, text[used]), flat[used]))
    names = np.intersect1d(sides[0][2], sides[1][2])
    counts = np.zeros((len(sides[0][0]), len(sides[1][0])), np.float32)
    coded = []
    for _, text, flat in sides:
        at = np.searchsorted(names, flat)
        known = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == flat) if len(names) else np.zeros(len(flat), bool)
        order = np.argsort(at[known], kind="stable")
        coded.append((text[known][order], at[known][order]))
    for first in range(0, len(names), COMMON):
        parts = []
        for (rows, _, _), (text, at) in zip(sides, coded, strict=True):
            low, high = np.searchsorted(at, [first, first + COMMON])
            part = np.zeros((len(rows), min(COMMON, len(names) - first)), np.float32)
            part[text[low:high], at[low:high] - first] = 1
            parts.append(part)
        counts += parts[0] @ parts[1].T
    return counts[np.searchsorted(sides[0][0], i), np.searchsorted(sides[1][0], j)].astype(np.float64)


def _named(df: DataFrame) -> DataFrame:
    """``id``: the digest as one string."""
    return df.withColumn("id", F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")))


def groups(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each distinct text ``h1``, ``h2``, its least ``key``, how many ``rows`` have both, whether there are ``others``, and ``keep``: whether it is its group's."""
    staged = cut(prints(documents, key=key, text=text))
    rows = staged.groupBy("h1", "h2", "key").agg(F.count(F.lit(1)).alias("rows"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("n").alias("n"))
    place = F.struct(F.col("key").isNull().alias("none"), "key")
    least = rows.groupBy("h1", "h2").agg(F.min(F.struct(place.alias("place"), "rows")).alias("m"), F.sum("rows").alias("all"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("n").alias("n"))
    classes = cut(_named(least.select("h1", "h2", F.col("m.place").alias("place"), F.col("m.rows").alias("rows"), "all", "p1", "p2", "n")))
    roots = components(links(classes, _named(staged.select("h1", "h2", "s")).select("id", "s")))
    rooted = classes.join(roots, classes["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
    chosen = rooted.groupBy("root").agg(F.min(F.struct("place", "id")).alias("best"))
    return rooted.join(chosen, "root").select("h1", "h2", F.col("place.key").alias("key"), "rows", (F.col("all") > F.col("rows")).alias("others"), (F.col("best.id") == F.col("id")).alias("keep"))


def keep_first(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of each group of near-duplicates: the one of the least key (null last).

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles
    is 0.8 or more, and links add up. Rows are told apart by key and text, so a
    repeated key with another text is a document of its own, and rows of a null key
    are judged by their texts. Of rows that share key and text one stays, that of the
    least hash of its plain columns. Null and empty texts, and texts without words,
    are one group; a text of fewer than five words is like those of the same words
    only. Empty tables give no rows. No column is added, so none can clash.

    Texts are not shuffled for this as long as few of them go (BROADCAST_IDS); beyond
    that the decisions are joined by a shuffle.
    """
    with scratch() as made:
        told = cut(groups(documents, key=key, text=text).where("NOT keep OR others OR rows > 1"))
        made.pop()
    small = told.count() <= BROADCAST_IDS
    names = documents.columns
    h1, h2 = digest(text)
    marked = documents.select(F.struct(*names).alias("row"), h1, h2)
    met = marked.join(F.broadcast(told) if small else told, ["h1", "h2"], "left").where(F.col("keep").isNull() | (F.col("keep") & F.col("row")[key].eqNullSafe(F.col("key"))))
    single = met.where("rows IS NULL OR rows = 1").select("row.*")
    if told.where("keep AND rows > 1").isEmpty():
        return single
    plain = [F.col("row")[f.name] for f in documents.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    one = met.where("rows > 1").groupBy("h1", "h2").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return single.unionByName(one.select("row.*"))
