import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    return SF


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empties, ties, repeats, odd white space, split characters, one very long text."""
    words = "the quick brown fox jumps over the lazy dog".split()
    return [None, "", " ", "\n", "a", "a b", "a b c", "A B C", "a\tb\x0bc", "  lead and  double ", "line\nbreak\n", "naïve café 漢字 😀 ß", "<|endoftext|> x</s>[INST]~0", "it's don't I'LL", "\x00\x01 \x1c y", "tie one two three", "tie one two three", " ".join(words * 20_000)]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_texts):
    rows = [(i if i != 7 else None, t, "en" if i % 3 else None, "src", None if t is None else len(t), "x", -1) for i, t in enumerate(odd_texts)]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, host string, shard int").repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
