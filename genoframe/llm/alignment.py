"""Alignment of two tokenizers' tokens over the bytes of the same text.

Both tokenizations of a text spell the same bytes, so a token is a byte range and its
end tells where it is. The union of both end arrays cuts the bytes into elementary
intervals, and a binary search finds the two tokens that own each interval: an
interval is one overlap of a pair. Where both owners end, a group closes. Texts of a
batch that both sides spell alike are laid one after another, so a batch is one such
computation. Links are pairs that end together (``ends``), all overlaps
(``overlaps``), or all pairs inside a group, expanded as products (``groups``).

How often an id pair is linked is counted over the whole corpus. Tokens are made once:
each text's distinct pairs are written beside its row. Pairs that are frequent in the
corpus, FREQUENT at most by their share of all links, go to the workers as a sorted
array; a text's other pairs meet their counts in a join, in which no pair has more
rows than that share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm import bpe
from genoframe.session import cut, kept, ship_package, tidy

#: Pairs that workers hold at most.
FREQUENT = 1 << 19
#: Bits of an id in a pair's code.
ID_BITS = 24
#: Row numbers: the partition, then this many bits inside it.
ROW_BITS = 40
SPACE = "▁"
#: Texts whose spaces are not single and between words go to the library whole.
ODD = r"^ |  | $"
REMEMBERED = 200_000
KINDS = ("ends", "overlaps", "groups")


class Pieces:
    """A sentencepiece vocabulary: ids of texts, bytes of ids. No piece goes on after a space into the next word, so words are encoded once each."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        #: Whether a text may be cut before its spaces.
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.id_bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.id_bytes], np.int64)
        self.buffer, self.ends = np.frombuffer(b"".join(self.id_bytes), np.uint8), np.cumsum(self.lengths)
        self.remembered = bpe.Stretches(self._encode, REMEMBERED)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode(texts, num_threads=1) if texts else []
        sizes = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter((i for f in found for i in f), np.uint32, int(sizes.sum()))
        return flat, sizes

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, one after another, and where each text's ids end."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) | (not self.by_words)
        parts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        per_text = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(parts).dictionary_encode()
        flat, ends, sizes = self.remembered.find(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[codes]
        ids = bpe.gather(flat, ends[codes], lengths)
        text_ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(per_text)]
        if not odd.any():
            return ids, text_ends
        whole, whole_sizes = self._encode(texts.filter(pa.array(odd)).to_pylist())
        whole_parts = iter(np.split(whole, np.cumsum(whole_sizes)[:-1]))
        starts = np.concatenate([[0], text_ends[:-1]])
        pieces = [next(whole_parts) if o else ids[a:b] for o, a, b in zip(odd, starts, text_ends, strict=True)]
        return np.concatenate(pieces), np.cumsum([len(p) for p in pieces])

    def decode_array(self, ids: np.ndarray) -> bytes:
        return bpe.gather(self.buffer, self.ends[ids], self.lengths[ids]).tobytes()


@dataclass
class Aligned:
    """Tokens of a run of texts in order, the group of each, and the links as places of tokens."""

    group_a: np.ndarray
    group_b: np.ndarray
    groups: int
    link_a: np.ndarray
    link_b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray, links: str = "ends") -> Aligned:
    """Groups and links of two tokenizations of the same bytes, given where tokens end."""
    ends = np.union1d(ends_a, ends_b)
    # The owner of an interval is the first token that does not end before the interval does.
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    shared = (ends_a[own_a] == ends) & (ends_b[own_b] == ends)
    closing = ends[shared]
    group_a, group_b = np.searchsorted(closing, ends_a), np.searchsorted(closing, ends_b)
    if links == "ends":
        link_a, link_b = own_a[shared], own_b[shared]
    elif links == "overlaps":
        link_a, link_b = own_a, own_b
    elif links == "groups":
        n_a, n_b = np.bincount(group_a, minlength=len(closing)), np.bincount(group_b, minlength=len(closing))
        # Every A token of a group meets as many B tokens as the group has, from the group's first on.
        times = n_b[group_a]
        link_a = np.repeat(np.arange(len(ends_a)), times)
        first = (np.cumsum(n_b) - n_b)[group_a]
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    else:
        raise ValueError(f"links must be one of {KINDS}")
    return Aligned(group_a, group_b, len(closing), link_a, link_b)


def _spelled(n: int) -> dict[str, np.ndarray]:
    """Decimal ids followed by each of the separators."""
    return {s: np.array([f"{i}{s}" for i in range(n)], object) for s in ",|;"}


def _written(ids_a: np.ndarray, ids_b: np.ndarray, found: Aligned, said_a: dict[str, np.ndarray], said_b: dict[str, np.ndarray]) -> np.ndarray:
    """Both sides' ids as words of `a1,a2|b1;a3|b2,b3`, in the order in which they are written; every group ends with its own ``;``."""
    out = np.empty(len(ids_a) + len(ids_b), object)
    for ids, own, other, side, said, end in ((ids_a, found.group_a, found.group_b, "left", said_a, "|"), (ids_b, found.group_b, found.group_a, "right", said_b, ";")):
        last = np.append(own[1:] != own[:-1], True) if len(own) else np.zeros(0, bool)
        # A group's A tokens stand after the B tokens of the groups before it, its B tokens after its own A tokens.
        out[np.arange(len(ids)) + np.searchsorted(other, own, side=side)] = np.where(last, said[end][ids], said[","][ids])
    return out


def tokenized(documents: DataFrame, *, key: str = "doc_id", text: str = "text", first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", links: str = "ends") -> DataFrame:
    """Each row's alignment: the key, ``row`` (its own number), ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, and its distinct linked id pairs as arrays ``a``, ``b``, ``n``.

    ``first`` encodes a space and the text, ``second`` the text, to which it adds the
    space. A text that is null, empty, or not spelled alike by both has no tokens.
    """
    ship_package(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def spell(a: bpe.Codec, b: Pieces) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        return _spelled(len(a.lengths)), _spelled(len(b.id_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_a = bpe.codec("json", bpe.vocabulary(first))
        own_b = kept("alignment", second, lambda: Pieces(bpe.vocabulary(second)))
        said_a, said_b = kept("alignment", (first, second), lambda: spell(own_a, own_b))
        row = TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
            ids_a, stop_a = own_a.encode_batch(spaced)
            ids_b, stop_b = own_b.encode_batch(texts)
            count_a, count_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
            sound = count_a > 0
            data_a, data_b = own_a.decode_array(ids_a), own_b.decode_array(ids_b)
            truth = "".join(spaced.to_pylist()).encode()
            if data_a != truth or data_b != truth:
                bytes_a, bytes_b = own_a.lengths[ids_a].cumsum(), own_b.lengths[ids_b].cumsum()
                at_a = at_b = 0
                for i, said in enumerate(spaced.to_pylist()):
                    to_a, to_b = (int(x[s - 1]) if s else 0 for x, s in ((bytes_a, stop_a[i]), (bytes_b, stop_b[i])))
                    sound[i] &= data_a[at_a:to_a] == data_b[at_b:to_b] == said.encode()
                    at_a, at_b = to_a, to_b
                ids_a, ids_b = ids_a[np.repeat(sound, count_a)], ids_b[np.repeat(sound, count_b)]
            count_a, count_b = np.where(sound, count_a, 0), np.where(sound, count_b, 0)
            stop_a, stop_b = np.cumsum(count_a), np.cumsum(count_b)
            found = align(own_a.lengths[ids_a].cumsum(), own_b.lengths[ids_b].cumsum(), links)
            words = _written(ids_a, ids_b, found, said_a, said_b)
            # A text's last A token closes its last group.
            closed = np.concatenate([[0], found.group_a + 1])[stop_a] if len(stop_a) else stop_a
            owner = np.searchsorted(stop_a, found.link_a, side="right")
            code = ids_a[found.link_a].astype(np.int64) << ID_BITS | ids_b[found.link_b].astype(np.int64)
            order = np.lexsort((code, owner))
            owner, code = owner[order], code[order]
            new = np.append(True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
            at = np.nonzero(new)[0]
            offsets = pa.array(np.searchsorted(owner[at], np.arange(len(texts) + 1)).astype(np.int32))
            pairs = [code[at] >> ID_BITS, code[at] & (1 << ID_BITS) - 1, np.diff(np.append(at, len(code)))]
            stop = stop_a + stop_b
            digests = [hashlib.sha256("".join(words[a:b].tolist())[:-1].encode()).hexdigest() if b > a else "" for a, b in zip(np.append(0, stop[:-1]).tolist(), stop.tolist(), strict=True)]
            numbers = [row + np.arange(len(texts)), count_a, count_b, np.diff(closed, prepend=0), np.bincount(owner, minlength=len(texts))]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(digests, pa.string()), *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in pairs)],
                names=[key, "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n"],
            )

    return documents.select(key, text).mapInArrow(tidy(run), f"{key} {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a``, ``b``, ``count`` (links of the corpus that hold the pair) and ``best`` (no pair of this ``b`` has more), from what ``tokenized`` returned."""
    counts = aligned.select(F.inline(F.arrays_zip("a", "b", "n"))).groupBy("a", "b").agg(F.sum("n").alias("count"))
    # Partial maxima of each b come before the exchange; the counts are joined to them, at most a vocabulary's rows for one b.
    counts = cut(counts)
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def _split(texts: DataFrame, shared, rare: bool) -> DataFrame:
    """Sums over the pairs of each row that workers know, or, with ``rare``, the pairs that they do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = shared.value
        for batch in batches:
            # A batch's list columns may be slices: their own offsets say where values are.
            offsets = batch.column(1).offsets.to_numpy(zero_copy_only=False)
            a, b, n = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            code = a << ID_BITS | b
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            if rare:
                left = ~known
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[left])), *(pa.array(x[left]) for x in (a, b, n))], names=["row", "a", "b", "n"])
                continue
            total = np.zeros(batch.num_rows, np.int64)
            most = np.zeros(batch.num_rows, np.int64)
            if len(codes):
                np.add.at(total, owner, np.where(known, n * counts[at], 0))
                np.add.at(most, owner, np.where(known & best[at], n, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(most), pa.array(total)], names=["row", "n_best", "count_sum"])

    return texts.select("row", "a", "b", "n").mapInArrow(tidy(run), "row long, a long, b long, n long" if rare else "row long, n_best long, count_sum long")


def correspondences(documents: DataFrame, *, key: str = "doc_id", text: str = "text", first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", links: str = "ends", frequent: int = FREQUENT) -> DataFrame:
    """For each row how its two tokenizations align, and how usual its links are in the whole table.

    Returns the key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose
    count is the highest of their second id, ties included), ``count_sum`` (of the
    counts over links) and ``groups_sha256`` (of `a1,a2|b1;a3|b2,b3`). Texts that are
    null, empty or not spelled alike by both have zeros and an empty string. Repeated
    rows count each and are returned each, null keys too. Empty tables give no rows.
    Only the two columns are read. ``frequent`` bounds what workers hold and changes no
    result.
    """
    spark = documents.sparkSession
    aligned = cut(tokenized(documents, key=key, text=text, first=first, second=second, links=links))
    counts = cut(pair_counts(aligned))
    pairs, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).collect()[0]
    # At most ``frequent`` pairs have that share of all links or more.
    bound = 1 if pairs <= frequent else -(-total // frequent)
    table = counts.where(F.col("count") >= bound).select(F.shiftleft(F.col("a").cast("long"), ID_BITS).bitwiseOR(F.col("b").cast("long")).alias("code"), "count", "best").toArrow()
    code, count, best = (table[c].to_numpy() for c in ("code", "count", "best"))
    order = np.argsort(code)
    shared = spark.sparkContext.broadcast((code[order].astype(np.int64), count[order].astype(np.int64), best[order].astype(bool)))
    known = _split(aligned, shared, rare=False)
    columns = [key, "n_a", "n_b", "n_groups", "n_links"]
    if bound > 1:
        rest = _split(aligned, shared, rare=True).join(counts.where(F.col("count") < bound), ["a", "b"])
        rest = rest.select("row", F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum"))
        known = known.unionByName(rest)
    sums = known.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(sums, "row").select(*columns, "n_best", "count_sum", "groups_sha256")
