import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from genoframe.llm import alignment as A
from genoframe.llm import bpe, queries

FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokens(text):
    """(id, bytes) of both tokenizations, from the libraries themselves; none if they do not spell the text."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for t in text:
        one = a.encode(" " + t, add_special_tokens=False) if t else None
        left = [(i, bpe.as_bytes(s)) for i, s in zip(one.ids, one.tokens, strict=True)] if t else []
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(t))] if t else []
        spelled = [b"".join(x for _, x in side) for side in (left, right)]
        yield (left, right) if t and spelled == [(" " + t).encode()] * 2 else ([], [])


def expected(rows, links="ends"):
    """By definition: every pair of tokens of a text is looked at."""
    found, counts = [], Counter()
    for left, right in tokens([t or "" for _, t in rows]):
        ranges = []
        for side in (left, right):
            at, own = 0, []
            for i, data in side:
                own.append((i, at, at + len(data)))
                at += len(data)
            ranges.append(own)
        ends = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
        group = lambda e: bisect_left(ends, e)
        meets = {"ends": lambda x, y: x[2] == y[2], "overlaps": lambda x, y: max(x[1], y[1]) < min(x[2], y[2]), "groups": lambda x, y: group(x[2]) == group(y[2])}[links]
        linked = Counter((x[0], y[0]) for x in ranges[0] for y in ranges[1] if meets(x, y))
        told = [[[] for _ in ends] for _ in ranges]
        for own, side in zip(ranges, told, strict=True):
            for i, _, e in own:
                side[group(e)].append(str(i))
        said = ";".join("|".join(map(",".join, both)) for both in zip(*told, strict=True))
        found.append((len(left), len(right), len(ends), linked, hashlib.sha256(said.encode()).hexdigest() if left else ""))
        counts += linked
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return sorted(((k, *f[:3], sum(f[3].values()), sum(n for p, n in f[3].items() if counts[p] == top[p[1]]), sum(n * counts[p] for p, n in f[3].items()), f[4]) for (k, _), f in zip(rows, found, strict=True)), key=str)


def got(frame):
    return sorted(((r["doc_id"], *(r[f] for f in FIELDS)) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def small(odd_texts):
    texts = [t if t is None else t[:400] for t in odd_texts] + ["a ▁b", "spaces   in   runs ", "x▁y", "naïve", "é", "tail ", "3.14159e-10 == π ≈ 22/7", "\r\nwindows\r\n", "ﬁne Ⅷ ²"]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)]
    return [*rows, rows[9]]


@pytest.mark.parametrize("links", A.KINDS)
@pytest.mark.parametrize("frequent", [3, A.FREQUENT])
def test_odd_texts_by_definition(spark, small, links, frequent):
    documents = spark.createDataFrame([(*r, -1, "x") for r in small], "doc_id long, text string, row long, a string").repartition(3)
    assert got(A.correspondences(documents, links=links, frequent=frequent)) == expected(small, links)


def test_all_pairs_rare_or_frequent_give_the_same(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(A.correspondences(documents, frequent=50)) == got(A.correspondences(documents))


def test_empty_table_and_very_long_text(spark, no_documents, odd_documents):
    assert A.correspondences(no_documents).count() == 0
    rows = {r["doc_id"]: r for r in A.correspondences(odd_documents.where("length(text) > 100000")).collect()}
    assert all(r["n_a"] > 100_000 and r["n_links"] == r["n_groups"] for r in rows.values()) and rows


def test_align_of_arrays():
    ends_a, ends_b = np.array([2, 5, 6, 9]), np.array([1, 3, 6, 9])
    assert A.align(ends_a, ends_b).groups == 2
    assert list(zip(*[x.tolist() for x in (A.align(ends_a, ends_b).link_a, A.align(ends_a, ends_b).link_b)], strict=True)) == [(2, 2), (3, 3)]
    over = A.align(ends_a, ends_b, "overlaps")
    assert list(zip(over.link_a.tolist(), over.link_b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (3, 3)]
    assert len(A.align(ends_a, ends_b, "groups").link_a) == 10
    with pytest.raises(ValueError):
        A.align(ends_a, ends_b, "other")


def test_query_over_the_table(spark, sf):
    documents = pd.read_parquet(f"{sf}/documents.parquet")
    short = [(k, t) for k, t in zip(documents["doc_id"].tolist(), documents["text"].tolist(), strict=True) if len(t or "") < 1000]
    frame = spark.createDataFrame(short, "doc_id long, text string")
    assert got(A.correspondences(frame)) == expected(short)
    ours = {r["doc_id"]: r for r in queries.op12_token_alignment(spark, sf).collect()}
    assert len(ours) == len(documents)
    by_key = {e[0]: e for e in expected(short)}
    assert all((ours[k]["n_a"], ours[k]["n_b"], ours[k]["n_groups"], ours[k]["groups_sha256"]) == (e[1], e[2], e[3], e[7]) for k, e in by_key.items())
