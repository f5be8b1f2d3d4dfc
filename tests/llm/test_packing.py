import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from genoframe.llm import packing, queries

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, window=1024):
    """Every id in exactly one piece, sequences gapless and within the window; returns padded and all tokens."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        ids, at = ids_of(texts[key]), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part)) and r["length"] > 0
            if "ids" in r.asDict():
                assert bytes(r["ids"]) == part
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, total


def test_query_over_the_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    padding, total = check(queries.op6_packing(spark, sf).collect(), texts)
    assert padding < 1024 and total > 100_000


def test_edge_cases(spark, odd_documents, no_documents, odd_texts):
    table = odd_documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {i: t for i, t in enumerate(odd_texts) if i != 7}
    check(packing.pack(table, keep_ids=True).collect(), texts)
    check(packing.pack(table, window=64, shard_rows=4).collect(), texts, 64)
    assert packing.pack(no_documents).count() == 0
    twice = packing.pack(odd_documents).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in twice}[5] == 2 * len(ids_of("a b")) and {r[0]: r[1] for r in twice}[None] == len(ids_of(odd_texts[7]))


def plain_scores(tails, idf, mean):
    """BM25 of every tail for all terms of every other, term by term."""
    counts = [dict(zip(*(x.tolist() for x in np.unique(t, return_counts=True)), strict=True)) for t in tails]
    out = np.zeros((len(tails), len(tails)))
    for j, (tail, tf) in enumerate(zip(tails, counts, strict=True)):
        for term, n in tf.items():
            weight = idf[term] * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(tail) / mean))
            for i, other in enumerate(counts):
                if term in other and i != j:
                    out[i, j] += weight
    return out


def bm25(tails):
    df = np.bincount(np.concatenate([np.unique(t) for t in tails]).astype(np.int64))
    return np.log1p((len(tails) - df + 0.5) / (df + 0.5)), float(np.mean([len(t) for t in tails]))


@pytest.mark.parametrize("dense", [1, 16, 10_000])
def test_index_scores_are_bm25(monkeypatch, dense):
    monkeypatch.setattr(packing, "DENSE", dense)
    monkeypatch.setattr(packing, "COUNTED", 7)
    rng = np.random.default_rng(5)
    tails = [np.array(t, np.uint32) for t in ([1, 2, 3, 9], [1, 2, 3, 4], [1, 5, 5, 5], [7, 8], [1, 2, 6, 6], [])]
    tails += [rng.zipf(1.4, n).clip(0, 60).astype(np.uint32) for n in rng.integers(0, 80, 40)]
    idf, mean = bm25(tails)
    index, want = packing.Index(tails, idf, mean), plain_scores(tails, idf, mean)
    for i in range(len(tails)):
        got = index.scores(i)
        got[i] = 0
        assert np.allclose(got, want[i], rtol=1e-4, atol=1e-4)


def test_counted_is_every_tails_counts():
    rng = np.random.default_rng(6)
    tails = [rng.integers(0, 50_000, n).astype("<u4") % 300 for n in rng.integers(0, 40, 700)]
    place, ids, counts = packing.counted(np.concatenate(tails), np.array([len(t) for t in tails]))
    want = [(i, int(t), int(n)) for i, tail in enumerate(tails) for t, n in zip(*np.unique(tail, return_counts=True), strict=True)]
    assert list(zip(place.tolist(), ids.tolist(), counts.tolist(), strict=True)) == want


def test_tails_are_packed_reversibly():
    for top in (60_000, 70_000):
        tails = [np.array(t, "<u4") for t in ([], [1], [top, 2, 3], [])]
        packed = packing.pack_tails(np.concatenate(tails), np.array([len(t) for t in tails]))
        assert [packing.unpack_tail(x).tolist() for x in packed.to_pylist()] == [t.tolist() for t in tails]


def test_recall_of_neighbours(spark, sf):
    """The share of a tail's five best neighbours, by brute force over all tails, that are in its shard, where it sees them all."""
    documents = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    tails = {k: np.array(ids_of(t)[len(ids_of(t)) // 1024 * 1024 :], np.uint32) for k, t in texts.items()}
    keys = [k for k in sorted(tails) if len(tails[k])]
    index = packing.Index([tails[k] for k in keys], *bm25([tails[k] for k in keys]))
    place = {k: i for i, k in enumerate(keys)}

    def recall(shard_rows):
        rows = packing.pack(documents, shard_rows=shard_rows).where("start + length = doc_tokens AND length < 1024").collect()
        shard = np.array([-1] * len(keys))
        for r in rows:
            shard[place[r["doc_id"]]] = r["sequence_id"] >> packing.SEQUENCE_BITS
        found = []
        for i in range(0, len(keys), 5):
            scores = index.scores(i)
            scores[i] = -1
            best = np.argsort(-scores, kind="stable")[:5]
            found.append((shard[best] == shard[i]).mean())
        return float(np.mean(found)), len(set(shard.tolist()))

    assert recall(packing.SHARD_ROWS) == (1.0, 1)
    four, shards = recall(250)
    assert shards == 4 and four > 0.6


def test_a_partition_longer_than_two_shards_is_cut(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumn("text", F.lit("one text of all rows"))
    rows = packing.pack(documents, shard_rows=4).collect()
    check(rows, {r["doc_id"]: "one text of all rows" for r in documents.select("doc_id").collect()})


def test_windows_are_full_but_the_last():
    rng = np.random.default_rng(1)
    tails = [np.arange(n, dtype=np.uint32) for n in rng.integers(0, 100, 200)]
    windows = packing.fill_windows(tails, 100, lambda i: np.arange(200, dtype=np.float32) % 7)
    sizes = [sum(p[2] for p in w) for w in windows]
    assert all(s == 100 for s in sizes[:-1]) and sum(sizes) == sum(map(len, tails))
    assert packing.fill_windows([], 100, None) == []


def test_the_best_unused_neighbour_is_next():
    tails = [np.zeros(n, np.uint32) for n in (4, 3, 5, 6)]
    scores = {0: [9, 1, 0, 2], 1: [0, 9, 0, 0], 2: [0, 0, 9, 0], 3: [0, 0, 0, 9]}
    windows = packing.fill_windows(tails, 8, lambda i: np.array(scores[i], np.float32))
    assert windows == [[(0, 0, 4), (3, 0, 4)], [(1, 0, 3), (2, 0, 5)], [(3, 4, 2)]]


def test_batches_are_encoded_in_parts():
    """A batch is cut by its texts' bytes, in order, with no text lost; a long text is a part of its own."""
    texts = [None, "", "a" * 700_000, "b", None, *["c d" * 50_000] * 9, "é" * 300_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(packing.parts_of(batch.slice(1)))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(1, len(texts)))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts[1:] and len(parts) > 3
    assert all(sum(len((t or "").encode()) for t in p.column(1).to_pylist()) < 2 * packing.ENCODED_BYTES for p in parts)
    assert not list(packing.parts_of(batch.slice(0, 0)))
    own = packing.bpe.codec("json", packing.bpe.vocabulary("byte_bpe_50k.json"))
    assert [i for p in parts for i in own.encode_batch(p.column(1))[0].tolist()] == own.encode_batch(batch.column(1))[0].tolist()


def test_parts_of_a_batch_are_looked_up_once(monkeypatch):
    """A look-up reads all that a worker remembers, so it is made for a batch and not for each part; ids are those of the whole."""
    texts = pa.array([None, "", "a b  c\todd" * 9_000, "b", *["c d, e\nf" * 20_000] * 9, "\u00e9" * 300_000])
    own = packing.bpe.codec("json", packing.bpe.vocabulary("byte_bpe_50k.json"))
    want, ends = own.encode_batch(texts)
    asked = []
    find = own.remembered.find
    monkeypatch.setattr(own.remembered, "find", lambda x: asked.append(len(x)) or find(x))
    parts = list(own.encode_parts(texts, packing.part_starts(texts, packing.ENCODED_BYTES)))
    assert len(parts) > 2 and len(asked) == 1
    assert [p[0] for p in parts[1:]] == [p[1] for p in parts[:-1]] and parts[-1][1] == len(texts)
    assert np.array_equal(np.concatenate([p[2] for p in parts]), want)
    assert np.array_equal(np.concatenate([np.diff(p[3], prepend=0) for p in parts]), np.diff(ends, prepend=0))


def test_a_look_up_costs_what_is_asked():
    """Ten lists are met by one that remembers 300,000 stretches: no step goes over all that is remembered."""
    own = packing.bpe.Stretches(lambda said: (np.arange(len(said), dtype=np.uint32), np.ones(len(said), np.int64)), 400_000)
    own.find(pa.array([f"w{i}" for i in range(300_000)]))
    flat, ends, sizes = own.find(pa.array(["w7", "new", "w299999"]))
    assert flat[ends - 1].tolist() == [7, 0, 299_999] and sizes.tolist() == [1, 1, 1]
    held = own.flat
    for i in range(10):
        own.find(pa.array([f"w{i}"]))
    assert own.flat is held


def test_lean_packing_gives_the_same_rows(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [sorted(map(tuple, packing.pack(documents, lean=lean).collect())) for lean in (False, True)]
    assert rows[0] == rows[1]


def test_lean_encoding_remembers_less():
    own = packing.bpe.Codec.from_json(packing.bpe.vocabulary("byte_bpe_50k.json"))
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i * 40_000 + j}" for j in range(40_000)) for i in range(4)])], names=["text"])
    parts = {lean: [ids.tolist() for _, ids, _ in packing._encoded(own, [batch], 0, lean)] for lean in (False, True)}
    assert sum(parts[False], []) == sum(parts[True], [])
    assert own.remembered.known <= packing.LEAN_STRETCHES
