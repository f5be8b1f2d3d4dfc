import hashlib
import io
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoframe.llm import media, queries, sharding, topk

# --- sharding -----------------------------------------------------------------------


def slots(rows, shards):
    by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(shards)}
    assert all(by[s] == list(range(len(by[s]))) for s in by)
    sizes = [len(by[s]) for s in by]
    assert max(sizes) - min(sizes) <= 1
    return by


def test_matrix_sums():
    rows, sizes = [5, 0, 17, 3, 100], [40, 40, 45]
    dense = sharding.communication_matrix(rows, sizes, 3)
    assert dense.sum(axis=1).tolist() == rows and dense.sum(axis=0).tolist() == sizes
    huge = sharding.communication_matrix([25_000] * 3 + [8 * 10**9], [2 * 10**9, 6 * 10**9 + 75_000], 5)
    assert huge.sum(axis=1).tolist() == [25_000] * 3 + [8 * 10**9] and huge.sum(axis=0).tolist() == [2 * 10**9, 6 * 10**9 + 75_000]


def test_draws_are_exact_beyond_numpys_bound(monkeypatch):
    """Chi-square of the rejection draws against the law itself, small enough to write down, and against its moments where it is not."""
    monkeypatch.setattr(sharding, "POPULATION", 0)
    rng = np.random.default_rng(4)
    for good, bad, n in ((7, 12, 6), (7, 12, 15), (30, 4, 20)):
        law = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
        drawn = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(4000))
        assert set(drawn) <= set(law)
        likely = [k for k in law if law[k] > 0.002]
        assert sum((drawn[k] - 4000 * law[k]) ** 2 / (4000 * law[k]) for k in likely) < 40
    good, bad, n = 3 * 10**10, 7 * 10**10, 25_000
    drawn = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(2000)])
    assert abs(drawn.mean() - 7500) < 8 and abs(drawn.var() / (n * 0.3 * 0.7) - 1) < 0.15


def test_shuffle_is_uniform(spark):
    """Over many seeds, every row is as often in every shard and slot."""
    table = spark.range(6, numPartitions=3)
    seen = Counter()
    n = 60
    for seed in range(n):
        for r in sharding.shuffle_into_shards(table, 2, seed=seed, rows_per_bin=2, stable_input=True).collect():
            seen[r["id"], r["shard"], r["slot"]] += 1
    counts = np.array([seen[i, s, k] for i in range(6) for s in range(2) for k in range(3)])
    assert ((counts - n / 6) ** 2 / (n / 6)).sum() < 75  # 25 degrees of freedom: chance below 1e-6


def test_shards_edge_cases(spark, odd_documents, no_documents):
    for stable in (False, True):
        rows = sharding.shuffle_into_shards(odd_documents.select("doc_id", "text", "shard", "host") if not stable else spark.range(1000, numPartitions=7), 8, rows_per_bin=50, stable_input=stable).collect()
        slots(rows, 8)
    assert sharding.shuffle_into_shards(no_documents, 8).count() == 0
    one = [sharding.shuffle_into_shards(spark.range(100, numPartitions=4), 3, seed=9, stable_input=True).orderBy("id").collect() for _ in range(2)]
    assert one[0] == one[1]


def test_sharding_query(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_sharding(spark, sf).collect()
    slots(rows, 8)
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {k: (len(t) + 1, zlib.crc32(t), "rows", None) for k, t in texts.items()}


def test_sharding_query_deals_whole_documents(spark, sf, monkeypatch):
    """Every column reaches the operator, and sizes and digests are of the rows it returns."""
    deal, given = sharding.shuffle_into_shards, []

    def marked(df, shards, **options):
        given.append(df)
        return deal(df, shards, **options).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("!")))

    monkeypatch.setattr(sharding, "shuffle_into_shards", marked)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: ((r["text"] or "") + "!").encode() for r in documents.collect()}
    rows = queries.op5_sharding(spark, sf).collect()
    assert given[0].columns == documents.columns
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in texts.items()}


# --- media --------------------------------------------------------------------------


def plain_resize(grey, height, width):
    """Means over exact areas, pixel by pixel."""
    rows, cols = grey.shape
    out = np.zeros((height, width))
    for y in range(height):
        for x in range(width):
            total = 0.0
            for r in range(rows):
                dy = max(0, min((y + 1) * rows, (r + 1) * height) - max(y * rows, r * height))
                for c in range(cols):
                    dx = max(0, min((x + 1) * cols, (c + 1) * width) - max(x * cols, c * width))
                    total += dy * dx * int(grey[r, c])
            out[y, x] = np.floor(total / (rows * cols) + 0.5)
    return out.astype(np.uint8)


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (17, 4), (8, 9), (30, 31)])
def test_resize_equals_plain_means(shape, monkeypatch):
    grey = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    for strip in (4096, 5):
        monkeypatch.setattr(media, "STRIP_ROWS", strip)
        for target in ((8, 9), (2, 3), (40, 12)):
            assert np.array_equal(media.resize_area(grey, *target), plain_resize(grey, *target))


def test_formats_round_trip():
    rng = np.random.default_rng(2)
    grey, colour = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert np.array_equal(media.decode(media.encode_pgm(grey)), grey)
    assert np.array_equal(media.decode(media.encode_bmp(grey)), grey) and np.array_equal(media.decode(media.encode_bmp(colour)), colour)
    assert np.array_equal(media.decode(b"P6\n# c\n7 5\n255\n" + colour.tobytes()), colour)
    assert media.decode(b"P2 2 1 15 0 15").tolist() == [[0, 255]] and media.decode(b"P1\n3 1\n1 0 1").tolist() == [[0, 255, 0]] and media.decode(b"P4\n9 1\n\x80\x80").tolist() == [[0, *[255] * 7, 0]]
    for wrong in (b"", b"P5\n4 4\n255\nxx", b"P5\n4", b"BM", b"GIF89a", b"P5\n1 1\n70000\nx"):
        with pytest.raises(media.MediaError):
            media.decode(wrong)


def test_media_operator(spark):
    grey = np.arange(40 * 50, dtype=np.uint32).reshape(40, 50).astype(np.uint8)
    table = spark.createDataFrame([(1, media.encode_pgm(grey), "x"), (2, None, "y"), (3, b"junk", "z"), (1, media.encode_pgm(grey), "x")], "id int, media binary, media_hash string")
    rows = media.process_media(table, height=32, width=32, tile=16).collect()
    assert len(rows) == 4
    good = next(r for r in rows if r["id"] == 1)
    parts = [np.load(io.BytesIO(bytes(t))) for t in good["media_tiles"]]
    assert np.array_equal(np.block([[parts[0], parts[1]], [parts[2], parts[3]]]), media.resize_area(grey, 32, 32)) and (good["media_height"], good["media_width"]) == (40, 50)
    assert {r["id"]: r["media_error"] is None for r in rows} == {1: True, 2: False, 3: False}
    assert media.process_media(table.where("false")).count() == 0


def test_media_query(spark, sf, odd_documents, odd_texts, no_documents):
    def want(text):
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        return len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_media_columns(spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows} == {k: want(t) for k, t in texts.items()}
    odd = media.text_media(odd_documents).collect()
    assert len(odd) == len(odd_texts) + 1 and {r["doc_id"]: r["payload_bytes"] for r in odd}[0] == 64
    assert media.text_media(no_documents).count() == 0


def test_media_query_makes_tiles_and_hashes(spark, sf):
    """The feature is of NPY tiles that were made, read back and put together again, and of the stored image's hash."""
    rows = {r["doc_id"]: r for r in queries.op9_media_columns(spark, sf).collect()}
    for r in media.process_media(media.payload_images(spark.read.parquet(f"{sf}/documents.parquet"))).collect():
        grey = media.decode(bytes(r["media"]))
        parts = [np.load(io.BytesIO(bytes(t))) for t in r["media_tiles"]]
        small = np.block([parts[:2], parts[2:]])
        assert np.array_equal(small, media.resize_area(grey, 32, 32)) and r["media_error"] is None
        assert rows[r["doc_id"]]["feature"] == f"{media.difference_hash(grey)}:{zlib.crc32(b''.join(map(bytes, r['media_tiles']))):08x}"
        assert (rows[r["doc_id"]]["media_bytes"], rows[r["doc_id"]]["media_sha256"]) == (len(r["media"]), hashlib.sha256(bytes(r["media"])).hexdigest())


# --- top k --------------------------------------------------------------------------


def found(df):
    return sorted(map(tuple, df.collect()))


def test_topk_query_and_tiles(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = topk.brute_force(table.toPandas(), 5)
    assert found(queries.op10_exact_top_k(spark, sf)) == want
    slim = table.select("vec_id", "embedding")
    for tile_rows, query_rows, groups in ((7, 2, 3), (1, 1, 1), (100, 100, 40)):
        assert found(topk.exact_top_k(slim.where("vec_id % 50 = 0"), slim, 5, tile_rows=tile_rows, query_rows=query_rows, groups=groups)) == want


def test_topk_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-1.0, -1.0]), (50, [0.001, -0.001]), (8, [1.0]), (None, [1.0, 1.0]), (100, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = found(topk.exact_top_k(table.where("vec_id % 50 = 0"), table, 3))
    assert [r for r in got if r[0] == 0] == [(0, 1, 1, 327680), (0, 2, 2, 327680), (0, 3, 50, -512)]
    assert [r[2] for r in got if r[0] == 50] == [7, 0, 1] and not [r for r in got if r[0] == 100]
    empty = table.where("false")
    assert topk.exact_top_k(empty, table, 3).count() == 0 and topk.exact_top_k(table, empty, 3).count() == 0


def test_topk_beyond_floats(spark):
    big = float(2**40)
    table = spark.createDataFrame([(0, [big, 1.0]), (1, [1.0, 3.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = found(topk.exact_top_k(table.where("vec_id = 0"), table, 2, scale=1024.0))
    assert got == [(0, 1, 1, 2**60 + 3 * 2**20), (0, 2, 2, 2**60 + 2 * 2**20)]
