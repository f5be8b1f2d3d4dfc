import random

import numpy as np
import pytest

from genoframe.llm import resemblance


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_groups(rows):
    """Rows (key, text) to the set of rows that stay: connected components over all pairs, the least key (null last) of each."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, text_order(r[1])))
    sets = [shingles(t) for _, t in order]
    root = list(range(len(order)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(order)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {order[i] for i in range(len(order)) if find(i) == i}


def text_order(text):
    return text or ""


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, id string, posting int").repartition(3)


def kept(spark, rows, **options):
    out = resemblance.keep_first(frame(spark, rows), **options)
    assert out.columns == ["doc_id", "text", "id", "posting"]
    return sorted((r["doc_id"], r["text"]) for r in out.collect())


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.getrandbits(30)}"
    return " ".join(words)


def copies(seed=3, sizes=(60, 120, 400)):
    """Texts and copies with more and more words exchanged, so that similarities run from 1 down to about 0.5."""
    rng = random.Random(seed)
    rows, key = [], 0
    for size in sizes:
        for _ in range(6):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            rows.append((key, " ".join(words)))
            key += 1
            for _ in range(8):
                rows.append((key, edited(rng, words, rng.randint(0, size // 15))))
                key += 1
    return rows


def test_hashes_are_of_shingles():
    text = "one two three four five six seven one two three four five"
    assert len(resemblance.shingle_hashes(text)) == len(shingles(text)) == 7
    a, b = (set(resemblance.shingle_hashes(t).tolist()) for t in ("A b c d e f", "x A b c d e f"))
    assert a < b and len(b - a) == 1
    assert len(resemblance.shingle_hashes("a b")) == 1 and not len(resemblance.shingle_hashes(" \t")) and not len(resemblance.shingle_hashes(None))


def test_groups_equal_all_pairs(spark):
    """Postings of PART members at most lose no link that the index meets."""
    rows = copies()
    assert kept(spark, rows) == sorted(plain_groups(rows))


def test_long_postings_go_by_leaders(spark, monkeypatch):
    """Where all postings count as long, no unlike text goes, and few copies stay that all pairs would drop."""
    monkeypatch.setattr(resemblance, "PART", 1)
    rows = copies()
    got, want = set(kept(spark, rows)), plain_groups(rows)
    assert want <= got and len(got - want) <= 0.1 * (len(rows) - len(want))


def test_recall_of_planted_copies(spark):
    """Pairs of a similarity of 0.8 to 0.95: no more than one in fifty keeps both."""
    rng, rows, pairs = random.Random(9), [], 0
    while pairs < 150:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(80, 300))]
        a, b = " ".join(words), edited(rng, words, rng.randint(1, max(1, len(words) // 45)))
        if 0.8 <= similarity(shingles(a), shingles(b)) <= 0.95:
            rows += [(2 * pairs, a), (2 * pairs + 1, b)]
            pairs += 1
    assert 150 <= len(kept(spark, rows)) <= 153


def test_rows_are_told_apart_by_key_and_text(spark):
    texts = {x: " ".join(f"{x}{i}" for i in range(40)) for x in "abcd"}
    rows = [(1, texts["a"]), (5, texts["a"]), (5, texts["b"]), (7, texts["c"]), (7, texts["d"]), (7, texts["d"]), (None, texts["d"]), (None, "only a null key"), (None, "only a null key")]
    assert sorted(((k is None, k or 0), t) for k, t in _unsorted(spark, rows)) == sorted([((False, 1), texts["a"]), ((False, 5), texts["b"]), ((False, 7), texts["c"]), ((False, 7), texts["d"]), ((True, 0), "only a null key")])


def _unsorted(spark, rows):
    return [(r["doc_id"], r["text"]) for r in resemblance.keep_first(frame(spark, rows)).collect()]


def test_shuffled_decisions_are_the_same(spark, monkeypatch):
    rows = copies(4, (60,))
    want = kept(spark, rows)
    monkeypatch.setattr(resemblance, "BROADCAST_IDS", 0)
    assert kept(spark, rows) == want


def test_edge_cases(spark, odd_documents, no_documents, odd_texts):
    out = resemblance.keep_first(odd_documents)
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == odd_documents.columns and set(odd_documents.schema.fields) == set(out.schema.fields)
    # Null, empty and blank texts are one group; "A B C", "a\tb\x0bc" and the null-keyed row are like "a b c".
    assert not {1, 2, 3, 8, 16, None} & set(rows) and {0, 4, 5, 6, 15, 17} <= set(rows) and rows[17] == odd_texts[17]
    assert resemblance.keep_first(no_documents).count() == 0


def test_chunks_do_not_change_samples(monkeypatch):
    hashes = resemblance.shingle_hashes(" ".join(f"w{i}" for i in range(300)))
    want = resemblance.sampled_bytes(hashes)
    monkeypatch.setattr(resemblance, "CHUNK", 7)
    assert resemblance.sampled_bytes(hashes) == want


def template(n=150, size=120, edits=12, seed=5):
    """Variants of a template, and edits of each: all share postings, few are copies."""
    rng, rows = random.Random(seed), []
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    for _ in range(n):
        variant = edited(rng, base, edits).split()
        rows += [(len(rows), " ".join(variant)), (len(rows) + 1, edited(rng, variant, 2))]
    return rows


def test_long_postings_lose_no_link(spark, monkeypatch):
    """Members of long postings are all compared: what stays is what stays where every posting is short, and what all pairs leave."""
    rows = copies()
    monkeypatch.setattr(resemblance, "PART", 1)
    assert kept(spark, rows) == sorted(plain_groups(rows))
    monkeypatch.setattr(resemblance, "TILE", 1 << 10)
    rows = template()
    by_tiles = kept(spark, rows)
    monkeypatch.setattr(resemblance, "PART", 10**9)
    assert by_tiles == kept(spark, rows)
    want = plain_groups(rows)
    assert want <= set(by_tiles) and len(set(by_tiles) - want) <= 3


def test_common_shingles_are_those_of_the_sets(monkeypatch):
    monkeypatch.setattr(resemblance, "COMMON", 7)
    rng = np.random.default_rng(4)
    tiles = [[np.unique(rng.integers(0, 60, rng.integers(0, 50))) for _ in range(n)] for n in (9, 13)]
    i, j = (x.reshape(-1) for x in np.meshgrid(range(1, 9), range(0, 13, 2), indexing="ij"))
    sides = [(np.array([len(s) for s in t]), np.concatenate(t)) for t in tiles]
    assert resemblance.common_shingles(*sides, i, j).tolist() == [len(np.intersect1d(tiles[0][x], tiles[1][y])) for x, y in zip(i, j, strict=True)]
