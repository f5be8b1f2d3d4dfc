import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from genoframe.llm import queries, simhash


def plain_fingerprint(text, k=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least key of each connected component, by comparing all fingerprints."""
    root = {f: f for f in set(prints.values())}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    array = np.array(distinct, np.uint64)
    for i, f in enumerate(distinct):
        near = np.bitwise_count(array[i + 1 :] ^ np.uint64(f)) <= 3
        for j in np.nonzero(near)[0]:
            a, b = find(f), find(distinct[i + 1 + j])
            root[max(a, b)] = min(a, b)
    least = {}
    for key, f in prints.items():
        least[find(f)] = min(least.get(find(f), key), key)
    return {key: least[find(f)] for key, f in prints.items()}


def test_blocks_are_a_steiner_system():
    from itertools import combinations

    assert len(simhash.BLOCKS) == 14
    for five in combinations(range(8), 5):
        assert sum(set(b) <= set(five) for b in simhash.BLOCKS) == 1


def test_fingerprints(odd_texts, monkeypatch):
    for t in odd_texts[:-1]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint("one two three four five " * 9) == plain_fingerprint("one two three four five " * 9)


def test_chunk_borders_lose_no_shingle(monkeypatch):
    """Words that never repeat, so that many bits are decided by a margin of one, at lengths around multiples of the chunk."""
    monkeypatch.setattr(simhash, "CHUNK", 4)
    rng = random.Random(11)
    words = [f"w{rng.getrandbits(40):x}" for _ in range(40)]
    for n in range(1, 41):
        assert simhash.fingerprint(" ".join(words[:n])) == plain_fingerprint(" ".join(words[:n]))


def test_query_equals_brute_force(spark, sf):
    rows = queries.op8_simhash(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    want = plain_components(prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{prints[k]:016x}", want[k]) for k in texts}


@pytest.mark.parametrize("long_posting", [512, 8, 1])
def test_links_lose_nothing(spark, monkeypatch, long_posting):
    """Clusters of fingerprints a few bits apart, with postings of any length expanded or joined to hubs."""
    monkeypatch.setattr(simhash, "LONG_POSTING", long_posting)
    rng = random.Random(5)
    prints = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                f ^= 1 << b
            prints.append(f)
    prints += [rng.getrandbits(64) for _ in range(200)] + [0, (1 << 64) - 1, 7, 1 << 63]
    keyed = dict(enumerate(prints))
    signed = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in keyed.items()], "doc_id long, fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(signed)).collect()}
    groups = {}
    for k, f in keyed.items():
        s = f - (1 << 64) if f >> 63 else f
        groups.setdefault(roots.get(s, s), []).append(k)
    assert {k: min(g) for g in groups.values() for k in g} == plain_components(keyed)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(500, 501), (501, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[100 + i] == 100 for i in range(1, 80)) and got[501] == 500
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edge_cases(spark, odd_documents, no_documents, odd_texts):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == len(odd_texts) + 1
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["component_id"] == by[1]["component_id"] == by[2]["component_id"] == 0 and by[0]["fingerprint"] == "0" * 16
    assert by[6]["fingerprint"] == by[None]["fingerprint"] == by[8]["fingerprint"] and by[None]["component_id"] == 6 and by[16]["component_id"] == 15
    assert simhash.near_duplicates(no_documents).count() == 0
