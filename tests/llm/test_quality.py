import math

import numpy as np
import pytest

from genoframe.llm import quality, queries
from pyspark.sql import functions as F


def plain_probability(texts):
    """Interpolated modified Kneser-Ney of order five from dictionaries, as a function of (context of four, character)."""
    begun = ["".join(map(chr, quality.symbols(t).tolist())) for t in texts]
    grams = [t[i : i + 5] for t in begun for i in range(len(t) - 4)]
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1

    def continuation(longer):
        out = {}
        for g in longer:
            out[g[1:]] = out.get(g[1:], 0) + 1
        return out

    levels = [counts]
    for _ in range(4):
        levels.append(continuation(levels[-1]))

    def level(k, context, w):
        table = levels[k]
        d = quality._discounts(np.array([sum(c == n for c in table.values()) for n in (1, 2, 3, 4)]))
        lower = (lambda: level(k + 1, context[1:], w)) if k < 4 else (lambda: 1 / quality.ALPHABET)
        own = {g[-1]: c for g, c in table.items() if g[:-1] == context}
        if not own:
            return lower()
        total = sum(own.values())
        taken = sum(d[min(c, 3) - 1] for c in own.values())
        c = own.get(w, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total + taken / total * lower()

    return lambda context, w: level(0, context, w)


TRUSTED = ["the cat sat on the mat. ", "a dog sat on the log, and the cat ran.", "Then the dog\nran on 12 mats!", "sat cat mat"]


@pytest.mark.parametrize(("hot", "words"), [(0, 1 << 22), (60, 1 << 22), (60, 1), (10_000, 1)])
def test_scores_equal_plain_model(spark, monkeypatch, hot, words):
    """Whatever part of the model workers hold, and whatever part is joined from shards, the sums are the same; so they are in slices."""
    monkeypatch.setattr(quality, "HOT", hot)
    monkeypatch.setattr(quality, "FILTER_WORDS", words)
    monkeypatch.setattr(quality, "MIN_CHARACTERS", 10)
    monkeypatch.setattr(quality, "SLICE", 9)
    texts = spark.createDataFrame([("en", t) for t in TRUSTED] + [("xx", "few")], "lang string, text string")
    model = quality.train(texts)
    assert set(model.hot) == {"en", quality.ALL} and (model.hot["en"][3] is None) == (hot > 1000)
    p = {"en": plain_probability(TRUSTED), quality.ALL: plain_probability([*TRUSTED, "few"])}
    documents = [*TRUSTED, "the dog sat on zebras", "QQ##", "q", "щука щука 漢"]
    frame = spark.createDataFrame([(i, t, "en" if i != 2 else None) for i, t in enumerate(documents)], "doc_id long, text string, lang string")
    scored = quality.score(frame, model, both="doc_id = 3").collect()
    assert {(r["doc_id"], r["model"]) for r in scored} >= {(i, "en" if i != 2 else quality.ALL) for i in range(8)} | {(3, quality.ALL), (5, quality.ALL)}
    for r in scored:
        text = documents[r["doc_id"]]
        s = "".join(map(chr, quality.symbols(text).tolist()))
        want = -sum(math.log(p[r["model"]](s[i : i + 4], s[i + 4])) for i in range(len(text)))
        mean = model.means[r["model"]]
        assert r["n_chars_scored"] == len(text) and r["second"] == (r["model"] == quality.ALL and r["doc_id"] != 2)
        assert r["nats"] == pytest.approx((want + quality.PRIOR * mean) / (len(text) + quality.PRIOR), rel=1e-4)


def test_probabilities_sum_to_one():
    p = plain_probability(TRUSTED)
    letters = sorted(set("".join(TRUSTED)) | {"\n"})
    for context in ("\n\n\n\n", "sat ", "zzzz"):
        unseen = p(context, "\u0416") * (quality.ALPHABET - len(letters))
        assert sum(p(context, w) for w in letters) + unseen == pytest.approx(1.0)


def test_counts_grow_with_the_text(spark, monkeypatch):
    """Distinct grams are rows of their own: scripts, cases and digits are told apart, and small buffers change nothing."""
    rows = [("en", "Ab1 шщ"), ("en", "aB2 щш"), (None, "x")]
    want = quality.count_grams(spark.createDataFrame(rows, "lang string, text string"))
    assert want.where("lang = 'en'").count() == 12 and want.count() == 13
    monkeypatch.setattr(quality, "HELD_GRAMS", 3)
    small = quality.count_grams(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_held_out_accuracy(spark, sf):
    """Trained on labels of even ids, held to those of odd ids."""
    sf = sf.replace("sf0.001", "sf0.01")
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.classify(documents, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["keep"] for r in judged if r["quality"] == 1]
    poor = [r["keep"] for r in judged if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(poor) < 0.25


def test_quantiles(spark):
    rng = np.random.default_rng(0)
    nats = rng.normal(2, 0.2, 5000)
    scored = spark.createDataFrame([("m", float(x)) for x in nats] + [("m", None), ("n", 1.0)], "bounds string, nats double")
    got = {r["bounds"]: r for r in quality.quantiles(scored, 0.01, 0.99).collect()}
    assert got["m"]["nats_low"] == pytest.approx(np.quantile(nats, 0.01, method="inverted_cdf"), abs=2e-3) and got["m"]["nats_high"] == pytest.approx(np.quantile(nats, 0.99, method="inverted_cdf"), abs=2e-3)
    assert got["n"]["nats_low"] <= 1.0 <= got["n"]["nats_high"]


def test_bounds_widen_for_few_rows(spark):
    rows = [("m", 2.0, False)] * 50 + [("m", 2.2, True)] + [("n", 1.0, False)]
    got = {r["bounds"]: r for r in quality.thresholds(spark.createDataFrame(rows, "bounds string, nats double, held boolean"), 0.0, 1.0, 0.0).collect()}
    assert got["m"]["nats_low"] == pytest.approx(1.5, abs=2e-3) and got["m"]["nats_high"] == pytest.approx(2.7, abs=2e-3) and got["n"]["nats_high"] == pytest.approx(1.5, abs=2e-3)


def test_edge_cases(spark, odd_documents, no_documents, odd_texts):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (6, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd_documents, labels).collect()
    assert len(rows) == len(odd_texts) + 1
    assert all(r["perplexity"] is None and not r["keep"] for r in rows if r["doc_id"] in (0, 1))
    assert quality.classify(no_documents, labels).count() == 0
    unlabelled = quality.classify(odd_documents, labels.where("false")).collect()
    assert {r["keep"] for r in unlabelled if r["doc_id"] not in (0, 1)} == {True}
    kept = quality.accepted(odd_documents, labels)
    assert kept.columns == odd_documents.columns and kept.schema == odd_documents.schema


def test_every_row_is_judged_by_its_own_text(spark):
    """Rows of a repeated or null key stay or go each; equal texts of one language alike, whatever their keys."""
    clean = ["the cat sat on the mat and the dog sat on the log. " * k for k in range(3, 40)]
    rows = [(k, t, "en") for k, t in enumerate(clean)]
    labels = spark.createDataFrame([(k, 1, 0) for k, _, _ in rows], "doc_id long, quality int, toxic int")
    good, junk = clean[5] + clean[4], "#@!% 0x7f;; %%$$ QQZX " * 12
    more = [(900, good, "en"), (900, junk, "en"), (None, good, "en"), (None, junk, "en"), (901, junk, "xx"), (902, good, "xx"), (903, junk, None), (904, good, None)]
    documents = spark.createDataFrame(rows + more, "doc_id long, text string, lang string").withColumn("__lang_", F.lit(1)).withColumn("h1", F.lit("x"))
    kept = quality.accepted(documents, labels)
    got = [(r["doc_id"], r["text"], r["lang"]) for r in kept.collect() if r["doc_id"] is None or r["doc_id"] >= 900]
    assert kept.columns == documents.columns and sorted(map(str, got)) == sorted(map(str, [x for x in more if x[1] == good]))


def test_each_language_has_bounds_of_its_own(spark, sf):
    """A language of few trusted characters is scored by the model of all text, against bounds of its own documents."""
    documents = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.when(F.col("lang") != "en", F.col("lang")).otherwise(F.concat(F.lit("en"), F.col("doc_id") % 3)))
    judged = quality.classify(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    bounds = judged.where("threshold_low IS NOT NULL").groupBy("lang").agg(F.count_distinct("threshold_low").alias("n")).collect()
    assert len(bounds) == 6 and all(1 <= r["n"] <= 2 for r in bounds)


def test_query_over_the_whole_table(spark, sf):
    rows = queries.op1_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and sum(r["keep"] for r in rows) > 0.7 * len(rows)
