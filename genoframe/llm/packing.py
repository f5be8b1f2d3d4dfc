"""Retrieval packing: windows of fixed length, filled with lexical neighbours found by BM25.

A document is its token ids and an end id. Its whole windows stand alone; what is left
(its tail, shorter than a window) is packed. Tails are sharded by likeness: clusters of
their terms, fitted on a bounded sample, then a min-hash inside a cluster. A shard
holds SHARD_ROWS tails on average and twice as many at most, and has a BM25 inverted
index of all of them, with document frequencies of the whole corpus. Tails are taken
in turn as seeds: the index scores every unused tail of the shard by all terms of the
seed, and the best ones fill the seed's window greedily; the one that does not fit is
cut, and its rest stays unused. When no tail of a positive score is left the next
unused tail of the shard is taken. So every window is full but the last of a shard.

A seed sees its own shard only: what it costs does not grow with the corpus, and the
share of the corpus's best neighbours that it can see falls with the number of shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm import bpe
from genoframe.session import cut, kept, ship_package, tidy

WINDOW = 1024
#: Tails in a shard: what one task indexes. Time is in proportion to it.
SHARD_ROWS = 4096
K1, B = 1.2, 0.75
#: A term in more than one of so many tails of a shard has its weights in a dense row.
DENSE = 16
#: Clusters of tails, the documents of the sample that they are fitted on (those of the lowest hashes), and dimensions of the projection that they live in.
CLUSTERS, SAMPLE_ROWS, DIMENSIONS = 16, 2048, 32
#: Terms are hashed into so many by their low bits, for projection and min-hash.
TERMS = 1 << 17
#: Tails whose terms are counted at once.
COUNTED = 256
#: Bytes of text whose stretches a worker looks up at once, and whose ids it holds at once.
LOOKED_UP_BYTES, ENCODED_BYTES = 1 << 20, 1 << 19
#: The same where workers have little memory, and the stretches they then remember: some 155 MB of a process for 240, for two thirds more time.
LEAN_BYTES, LEAN_STRETCHES = 1 << 18, 50_000
#: Sequence numbers: the shard, then this many bits inside it.
SEQUENCE_BITS = 32


def counted(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, id, count) of every distinct id of each tail, by place, then id; ``flat`` holds the tails one after another."""
    terms = np.nonzero(np.bincount(flat))[0]
    place_of = np.zeros(int(terms[-1]) + 1 if len(terms) else 0, np.int64)
    place_of[terms] = np.arange(len(terms))
    code = place_of[flat]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    places, ids, counts = [], [], []
    for first in range(0, len(lengths), COUNTED):
        last = min(first + COUNTED, len(lengths))
        part = code[ends[first] : ends[last]] + np.repeat(np.arange(last - first) * len(terms), lengths[first:last])
        tally = np.bincount(part)
        used = np.nonzero(tally)[0]
        place, at = np.divmod(used, max(1, len(terms)))
        places.append(place + first)
        ids.append(terms[at])
        counts.append(tally[used])
    if not places:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(places), np.concatenate(ids), np.concatenate(counts)


@dataclass(frozen=True)
class Clusters:
    """Centres of tails' projected terms, neighbours in order, and the weight of each term in the projection."""

    centres: np.ndarray
    weights: np.ndarray

    @staticmethod
    def projection() -> np.ndarray:
        return np.random.default_rng(13).standard_normal((TERMS, DIMENSIONS), np.float32)

    @staticmethod
    def project(projection: np.ndarray, weights: np.ndarray, place: np.ndarray, ids: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """A unit vector for each of n tails, of its terms' counts; zeros for none."""
        out = np.zeros((n, DIMENSIONS), np.float32)
        terms = ids % TERMS
        weight = (np.log1p(counts) * weights[terms]).astype(np.float32)
        for first in range(0, n, COUNTED):
            a, b = np.searchsorted(place, [first, first + COUNTED])
            if a < b:
                starts = np.concatenate([[0], np.nonzero(np.diff(place[a:b]))[0] + 1])
                out[place[a:b][starts]] = np.add.reduceat(weight[a:b, None] * projection[terms[a:b]], starts, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    @classmethod
    def fit(cls, tails: list[np.ndarray], clusters: int = CLUSTERS, rounds: int = 20) -> Clusters:
        """k-means of the sample, begun at its first tails; deterministic."""
        lengths = np.array([len(t) for t in tails], np.int64)
        place, ids, counts = counted(np.concatenate([*tails, np.zeros(0, "<u4")]), lengths)
        df = np.bincount(ids % TERMS, minlength=TERMS)
        weights = np.log1p((len(tails) + 1) / (df + 0.5)).astype(np.float32)
        points = cls.project(cls.projection(), weights, place, ids, counts, len(tails))[lengths > 0]
        if not len(points):
            return cls(np.zeros((1, DIMENSIONS), np.float32), weights)
        centres = points[:clusters]
        for _ in range(rounds):
            at = cls(centres, weights).nearest(points)
            centres = np.stack([points[at == k].mean(axis=0) if (at == k).any() else c for k, c in enumerate(centres)])
        # Neighbouring clusters get neighbouring numbers: along the direction in which centres differ most.
        _, _, axes = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)
        return cls(centres[np.argsort(centres @ axes[0], kind="stable")], weights)

    def nearest(self, points: np.ndarray) -> np.ndarray:
        return (points @ self.centres.T - (self.centres**2).sum(axis=1) / 2).argmax(axis=1)


def pack_tails(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Tails as binary: a word that says how wide ids are (0: two bytes, 1: four), then the ids."""
    narrow = not flat.size or int(flat.max()) < 1 << 16
    per = 1 if narrow else 2
    words = np.ascontiguousarray(flat, "<u2" if narrow else "<u4").view("<u2")
    stops = np.cumsum(lengths * per + 1)
    out = np.empty(int(stops[-1]) if len(stops) else 0, "<u2")
    mark = np.zeros(len(out), bool)
    mark[np.concatenate([[0], stops[:-1]]) if len(stops) else []] = True
    out[mark], out[~mark] = 0 if narrow else 1, words
    offsets = np.concatenate([[0], 2 * stops]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpack_tail(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"\x00" else "<u4", offset=2).astype("<u4")


def part_starts(texts: pa.Array, size: int) -> list[int]:
    """Where parts of so many bytes of text each, or one text more, begin, and the end: ids and their places take some thirty times that."""
    passed = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // size
    return np.concatenate([[0], np.nonzero(np.diff(passed))[0] + 1, [len(passed)]]).tolist()


def parts_of(batch: pa.RecordBatch, text: int = 1, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in those parts, of ENCODED_BYTES by default."""
    starts = part_starts(batch.column(text), size or ENCODED_BYTES)
    return (batch.slice(first, last - first) for first, last in zip(starts, starts[1:]) if last > first)


def _encoded(own: bpe.Codec, batches: Iterator[pa.RecordBatch], text: int, lean: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """All batches in parts of ENCODED_BYTES, with their ids and where each text's end; stretches are looked up for LOOKED_UP_BYTES at once."""
    looked_up, held = (LEAN_BYTES, LEAN_BYTES) if lean else (LOOKED_UP_BYTES, ENCODED_BYTES)
    own.remembered.bound = LEAN_STRETCHES if lean else bpe.REMEMBERED
    for batch in (part for whole in batches for part in parts_of(whole, text, looked_up)):
        for first, last, ids, ends in own.encode_parts(batch.column(text), part_starts(batch.column(text), held)):
            yield batch.slice(first, last - first), ids, ends


def _with_ends(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' ids, each followed by the end id, and the documents' lengths with it."""
    lengths = np.diff(np.concatenate([[0], ends])) + 1
    out = np.empty(len(ids) + len(lengths), "<u4")
    last = np.zeros(len(out), bool)
    last[np.cumsum(lengths) - 1] = True
    out[last], out[~last] = end_id, ids
    return out, lengths


def sample_tails(documents: DataFrame, *, key: str, text: str, vocabulary: str, window: int, end_id: int, rows: int, lean: bool = False) -> list[np.ndarray]:
    """Tails of a bounded sample of documents: those of the lowest hashes of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("packing", "", dict)
        own = bpe.codec("json", bpe.vocabulary(vocabulary))
        for _, ids, ends in _encoded(own, batches, 0, lean):
            ids, lengths = _with_ends(ids, ends, end_id)
            ends = np.cumsum(lengths)
            tails = [ids[e - n % window : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pack_tails(np.concatenate([*tails, np.zeros(0, "<u4")]), lengths % window)], names=["tail"])

    # The bound of the hashes first: texts are not sorted, and only those below it are moved.
    place = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    bound = documents.select(place.alias("place")).orderBy("place").limit(rows).agg(F.max("place")).collect()[0][0]
    chosen = documents.where(place <= bound).select(text).limit(rows) if bound is not None else documents.select(text).limit(0)
    return [unpack_tail(r["tail"]) for r in chosen.mapInArrow(tidy(run), "tail binary").collect()]


def stage_tokens(documents: DataFrame, clusters: Clusters, *, key: str, text: str, vocabulary: str, window: int, end_id: int, keep_ids: bool, lean: bool = False) -> DataFrame:
    """Each row's key, ``tokens``, ``whole_crcs``, ``tail`` (packed ids), ``whole`` (ids of whole windows if kept), ``cluster`` and ``signature``.

    Each task adds one row of statistics, with ``tokens`` -1: the tails' lengths in ``whole_crcs`` (their
    number and sum), the ids that occur in ``tail``, and in how many tails each does in ``whole``.
    """
    kind = documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(clusters)
    names = [key, "tokens", "whole_crcs", "tail", "whole", "cluster", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("packing", "", dict)  # what the worker has of other stages goes first
        own, model = bpe.codec("json", bpe.vocabulary(vocabulary)), shared.value
        order = np.random.default_rng(11).permutation(TERMS).astype(np.int64)
        projection = model.projection()
        seen = np.zeros(1 << 16, np.int64)
        rows = total = 0
        last = None
        for batch, ids, ends in _encoded(own, batches, 1, lean):
            ids, lengths = _with_ends(ids, ends, end_id)
            ends, tail_lengths = np.cumsum(lengths), lengths % window
            data = memoryview(ids).cast("B")
            crcs, wholes = [], []
            for end, n, rest in zip(ends.tolist(), lengths.tolist(), tail_lengths.tolist(), strict=True):
                start, split = end - n, end - rest
                crcs.append([zlib.crc32(data[4 * i : 4 * (i + window)]) for i in range(start, split, window)])
                wholes.append(data[4 * start : 4 * split].tobytes() if keep_ids else None)
            in_tail = np.arange(len(ids)) >= np.repeat(ends - tail_lengths, lengths)
            flat = ids[in_tail]
            place, terms, counts = counted(flat, tail_lengths)
            cluster = model.nearest(model.project(projection, model.weights, place, terms, counts, len(lengths)))
            signature = np.full(len(lengths), -1, np.int64)
            if len(place):
                starts = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
                signature[place[starts]] = np.minimum.reduceat(order[terms % TERMS], starts)
                tally = np.bincount(terms)
                if len(tally) > len(seen):
                    seen = np.concatenate([seen, np.zeros(len(tally) - len(seen), np.int64)])
                seen[: len(tally)] += tally
            rows += int((tail_lengths > 0).sum())
            total += len(flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pack_tails(flat, tail_lengths), pa.array(wholes, pa.binary()), pa.array(cluster, pa.int64()), pa.array(signature)], names=names)
            last = batch.column(0)[:1]
        if rows:
            used = np.nonzero(seen)[0]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, last.type), pa.array([-1], pa.int64()), pa.array([[rows, total]], pa.list_(pa.int64())), pa.array([used.astype("<i8").tobytes()], pa.binary()), pa.array([seen[used].astype("<i8").tobytes()], pa.binary()), pa.array([-1], pa.int64()), pa.array([-1], pa.int64())], names=names)

    return documents.select(key, text).mapInArrow(tidy(run), f"{key} {kind}, tokens long, whole_crcs array<long>, tail binary, whole binary, cluster long, signature long")


def term_statistics(staged: DataFrame) -> tuple[np.ndarray, int, float]:
    """In how many tails each id occurs, the number of tails, and their mean length: the tasks' statistics added up, ids by partial sums in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sums, terms, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms, counts = np.frombuffer(terms, "<i8"), np.frombuffer(counts, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([terms, [-1, -2]])), pa.array(np.concatenate([counts, sums]))], names=["term", "n"])

    rows = staged.where("tokens = -1").select("whole_crcs", "tail", "whole").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = rows.toPandas()  # a row for each id of the vocabulary at most
    counts = dict(zip(found["term"].tolist(), found["n"].tolist(), strict=True))
    tails, total = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(max(counts, default=0) + 1)
    for term, n in counts.items():
        df[term] = n
    return df, tails, total / tails if tails else 0.0


class Index:
    """BM25 inverted index of one shard's tails. Terms in many tails have a dense row of weights, the others postings."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.n = n = len(tails)
        length = np.array([len(t) for t in tails], np.int64)
        place, term, count = counted(np.concatenate([*tails, np.zeros(0, "<u4")]), length)
        weight = (idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[place] / max(mean_length, 1.0)))).astype(np.float32)
        code, sizes = term, np.bincount(term)
        # What each tail asks for: its terms, by place.
        self.asks, self.ask_ends = code.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(place, minlength=n))])
        often = sizes > max(1, n // DENSE)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), n), np.float32)
        dense = often[code]
        self.dense[self.row[code[dense]], place[dense]] = weight[dense]
        order = np.argsort(code[~dense], kind="stable")
        self.place, self.weight = place[~dense][order], weight[~dense][order].astype(np.float64)
        self.stops = np.cumsum(np.where(often, 0, sizes))
        self.starts = self.stops - np.where(often, 0, sizes)

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every tail for all terms of the seed."""
        asked = self.asks[self.ask_ends[seed] : self.ask_ends[seed + 1]]
        rows = self.row[asked]
        rare = asked[rows < 0]
        out = np.zeros(self.n, np.float32)
        for r in rows[rows >= 0].tolist():
            out += self.dense[r]
        spans = [slice(a, b) for a, b in zip(self.starts[rare].tolist(), self.stops[rare].tolist(), strict=True) if b - a > 1]  # its own alone is no neighbour
        if spans:
            out += np.bincount(np.concatenate([self.place[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        return out


def fill_windows(tails: list[np.ndarray], window: int, scores: Callable[[int], np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Windows of (tail, first id, ids) pieces; every window is full but the last. Of equal scores the first tail goes first."""
    left = np.array([len(t) for t in tails], np.int64)
    unused = (left > 0).astype(np.float32)
    next_at, windows = 0, []

    def take(j: int, room: int) -> tuple[int, int, int]:
        n = min(room, int(left[j]))
        piece = (j, len(tails[j]) - int(left[j]), n)
        left[j] -= n
        if not left[j]:
            unused[j] = 0
        return piece

    while True:
        while next_at < len(tails) and not left[next_at]:
            next_at += 1
        if next_at == len(tails):
            return windows
        pieces = [take(next_at, window)]
        room = window - pieces[0][2]
        if room:
            found = scores(next_at) * unused
            while room:
                best = int(found.argmax())
                if not found[best] > 0:
                    break
                found[best] = 0
                pieces.append(take(best, room))
                room -= pieces[-1][2]
        at = next_at
        while room:
            while at < len(tails) and not left[at]:
                at += 1
            if at == len(tails):
                break
            pieces.append(take(at, room))
            room -= pieces[-1][2]
        windows.append(pieces)


def pack(documents: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", window: int = WINDOW, end_id: int = 0, keep_ids: bool = False, shard_rows: int = SHARD_ROWS, lean: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens.

    One row for each piece: the key, ``start`` and ``length`` in the document's ids,
    ``ids_crc32`` (of its ids as unsigned little-endian 32-bit numbers), ``doc_tokens``,
    ``sequence_id`` and ``offset`` in the sequence; ``keep_ids`` adds them as ``ids``
    (binary, the same encoding). Every id of every document is in one piece. Null and
    empty texts are the end id alone. Repeated rows are packed each, under the same
    key. Ranges of equal clusters and signatures are cut by the keys' hashes, so a
    group of copies of any size is dealt over as many shards as it fills. Empty tables
    give no rows. Only the two columns are read. ``lean`` encodes in less memory and
    more time, with the same rows.
    """
    spark = documents.sparkSession
    ship_package(spark)
    kind = documents.schema[key].dataType.simpleString()
    options = {"key": key, "text": text, "vocabulary": vocabulary, "window": window, "end_id": end_id, "lean": lean}
    clusters = Clusters.fit(sample_tails(documents, rows=SAMPLE_ROWS, **options))
    staged = cut(stage_tokens(documents, clusters, keep_ids=keep_ids, **options))
    df, rows, mean_length = term_statistics(staged)
    # As long as the vocabulary, whatever the corpus.
    idf = spark.sparkContext.broadcast(np.log1p((rows - df + 0.5) / (df + 0.5)))
    staged = staged.where("tokens >= 0")
    shards = max(1, -(-staged.count() // shard_rows))
    tie = F.xxhash64(F.col(key).cast("string"), F.lit("tail"))
    dealt = staged.withColumn("tie", tie).repartitionByRange(shards, "cluster", "signature", "tie").sortWithinPartitions("cluster", "signature", "tie", key)

    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    schema = f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    kinds = [pa.int64()] * 6 + [pa.binary()] * keep_ids

    def packed(held: list[pa.RecordBatch], sequence: int) -> Iterator[tuple[pa.RecordBatch, int]]:
        """The pieces of one shard, and the next free sequence number."""
        keys = pa.concat_arrays([b.column(0) for b in held])
        column = lambda name: [x for b in held for x in b.column(b.schema.get_field_index(name)).to_pylist()]
        tokens, crcs, wholes, tails = column("tokens"), column("whole_crcs"), column("whole") if keep_ids else [], [unpack_tail(x) for x in column("tail")]
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names=names)
            rows.clear()
            return out

        for i, own in enumerate(crcs):
            for w, crc in enumerate(own):
                more = (wholes[i][4 * window * w : 4 * window * (w + 1)],) if keep_ids else ()
                rows.append((i, w * window, window, crc, tokens[i], sequence, 0, *more))
                sequence += 1
            if len(rows) >= 10_000:
                yield flush(), sequence
        index = Index(tails, idf.value, mean_length)
        for pieces in fill_windows(tails, window, index.scores):
            offset = 0
            for i, first, n in pieces:
                data = tails[i][first : first + n].tobytes()
                rows.append((i, tokens[i] - len(tails[i]) + first, n, zlib.crc32(data), tokens[i], sequence, offset, *((data,) if keep_ids else ())))
                offset += n
            sequence += 1
            if len(rows) >= 10_000:
                yield flush(), sequence
        if rows:
            yield flush(), sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()  # the worker may be one that encoded
        sequence = TaskContext.get().partitionId() << SEQUENCE_BITS
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # Ranges are sampled, so a partition can be longer than a shard: what a task holds is bounded here.
            if held and sum(b.num_rows for b in held) + batch.num_rows > 2 * shard_rows:
                for out, sequence in packed(held, sequence):
                    yield out
                held = []
            held.append(batch)
        if held:
            for out, _ in packed(held, sequence):
                yield out

    return dealt.mapInArrow(tidy(run), schema)
