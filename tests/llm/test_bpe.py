import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from genoframe.llm import bpe, queries
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.codec("ranks", PATH)


def test_byte_table_is_one_to_one():
    table = bpe.byte_table()
    assert len(set(table)) == 256 and all(len(c) == 1 and c.isprintable() for c in table)
    assert bpe.as_bytes(bpe.as_chars(bytes(range(256)))) == bytes(range(256))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab  \n\n\t'sévedtrlm1٣ 😀  ſ\x01\x1c.,!?漢\r\x85\u3000|Ç"), max_size=25), max_size=6))
def test_ids_equal_tiktoken(texts):
    own = bpe.codec("ranks", PATH)
    ids, ends = own.encode_batch(pa.array(texts, pa.string()))
    at = 0
    for text, end in zip(texts, ends, strict=True):
        part = ids[at:end]
        at = end
        assert part.tolist() == ENCODING.encode_ordinary(text)
        assert own.decode_array(part) == own.decode(part.tolist()) == text.encode()


def test_json_vocabulary_is_the_same(own, odd_texts):
    other = bpe.codec("json", public_tokenizers.path("byte_bpe_50k.json"))
    for text in odd_texts[:-1]:
        assert other.ids(text or "").tolist() == own.ids(text or "").tolist()


def test_memory_is_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    fresh = bpe.Codec(own.model, own.id_bytes)
    for k in range(4):
        texts = [f"word{k}{i} and more {i}." for i in range(20)]
        ids, ends = fresh.encode_batch(pa.array(texts))
        assert np.array_equal(ids, np.concatenate([ENCODING.encode_ordinary(t) for t in texts])) and len(ends) == 20


def test_offsets_cover_split_characters(own):
    text = "x 漢😀é"
    for token, start, end in own.offsets(text):
        assert own.id_bytes[token] in text[start:end].encode() and end > start


def test_operators(spark, odd_documents, odd_texts, no_documents):
    encoded = bpe.encode(odd_documents, offsets=True)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    assert rows[11]["ids"] == ENCODING.encode_ordinary(odd_texts[11]) and len(rows[11]["starts"]) == len(rows[11]["ids"]) and rows[0]["ids"] == []
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(bpe.encode(odd_documents)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(odd_texts) if i != 7)
    assert bpe.encode(no_documents).count() == 0 and bpe.round_trip(no_documents).count() == 0
    digests = {r["doc_id"]: r for r in bpe.round_trip(odd_documents).collect()}
    for i, t in enumerate(odd_texts):
        if i != 7:
            ids = ENCODING.encode_ordinary(t or "")
            assert digests[i]["n_tokens"] == len(ids) and digests[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert digests[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_query_over_the_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ENCODING.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
