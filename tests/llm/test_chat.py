import hashlib
import time

from genoframe.llm import chat, queries
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, window int, n long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 5, 6) for r in rows], SCHEMA)


ROWS = [
    (1, 0, "system", "be [brief] </s>"), (1, 1, "user", "hi ~0 ~ <s>"), (1, 2, "assistant", "[INST] yes [/INST]"), (1, 3, "user", "x" * 900), (1, 4, "assistant", "y" * 5000), (1, 5, "assistant", "]"),
    (2, 1, None, None), (2, 0, "assistant", ""), (3, 0, "a]b[c<", "漢😀"), (None, None, "user", "lost"), (4, 0, "user", "t"), (4, 0, "user", "t"),
    *[(9, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 40)) for i in range(300)],
]


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss))
    return out


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_reads_back_for_any_budget(spark):
    table = conversations(spark, ROWS)
    for budget, history in ((1024, 256), (64, 16), (20, 0), (10**6, 10**5)):
        windows = chat.format_windows(table, budget=budget, history=history)
        assert got(chat.digests(chat.read_back(windows))) == want(ROWS)


def test_windows_keep_the_budget_and_their_order(spark):
    for r in chat.format_windows(conversations(spark, ROWS), budget=256, history=64).collect():
        assert r["tokens"] <= 256 or r["n_new"] == 1
        for s in r["loss_spans"]:
            assert 0 <= s["start"] <= s["end"] <= len(r["formatted"])
        if r["conv_id"] == 1 and r["window"] > 0:
            assert r["formatted"].startswith("<s>[INST:system]") and r["n_repeated"] >= 1
    many = [r for r in chat.format_windows(conversations(spark, ROWS), budget=256, history=64).collect() if r["conv_id"] == 9]
    assert len(many) > 10 and any(r["n_repeated"] for r in many) and sum(r["n_new"] for r in many) == 300


def test_empty_and_query(spark, sf):
    assert chat.digests(chat.read_back(chat.format_windows(conversations(spark, ROWS).where("false")))).count() == 0
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    control = "</s>[INST] ok [/INST]"
    assert got(queries.op2_chat_formatting(spark, sf)) == want([*rows, (-1, 0, "user", control), (-1, 1, "assistant", control)])


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op2_chat_formatting(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_windows_of_short_turns_are_nearly_full(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", "some words " * (i % 7)) for i in range(2000)]
    sizes = [r["tokens"] for r in chat.format_windows(conversations(spark, rows), budget=1024, history=0).orderBy("window").collect()]
    assert max(sizes) <= 1024 and sum(sizes[:-1]) / len(sizes[:-1]) > 0.9 * 1024


def greedy(sizes, system, budget, history):
    """First turns of windows that are filled one by one, by plain Python."""
    starts, left = [], -1
    for i, n in enumerate(sizes):
        if n > left:
            held, j = 0, i - 1
            while j >= (1 if system else 0) and held + sizes[j] <= history:
                held += sizes[j]
                j -= 1
            starts.append(i)
            left = budget - held - (sizes[0] if system and i else 0)
        left -= n
    return starts


def test_windows_are_filled_one_by_one(spark, sf):
    """Over the whole table and turns of all sizes: every window begins where plain filling begins one."""
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect() if r["conv_id"] is not None]
    rows += [(c, i, "system" if i == 0 and c % 2 else "user", "ab " * ((i * 37 + c) % (400 if c % 3 else 60))) for c in range(10**6, 10**6 + 12) for i in range(80)]
    table = conversations(spark, rows)
    sized = table.select("conv_id", "turn", "role", "text", chat.turn_tokens(chat.escape(F.coalesce("role", F.lit(""))), chat.escape(F.coalesce("text", F.lit("")))).alias("n")).collect()
    own = {}
    for r in sorted(sized, key=lambda r: (r["conv_id"], r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
        own.setdefault(r["conv_id"], []).append(r)
    for budget, history in ((1024, 256), (300, 100), (200, 0)):
        got = {}
        for r in chat.format_windows(table, budget=budget, history=history).orderBy("conv_id", "window").collect():
            assert r["tokens"] <= budget or r["n_new"] == 1
            got.setdefault(r["conv_id"], []).append(r["n_new"])
        for c, turns in own.items():
            starts = greedy([r["n"] for r in turns], turns[0]["role"] == "system", budget, history)
            # One block holds these conversations, so nothing is cut but by the budget.
            if sum(r["n"] for r in turns) <= chat.BLOCK * budget:
                assert [sum(got[c][:k]) for k in range(len(got[c]))] == starts


def test_blocks_cost_one_window_each(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", "some words " * (i % 7)) for i in range(12_000)]
    table = conversations(spark, rows)
    tokens = [r["n"] for r in table.select("turn", chat.turn_tokens(chat.escape(F.col("role")), chat.escape(F.col("text"))).alias("n")).orderBy("turn").collect()]
    sizes = [r["tokens"] for r in chat.format_windows(table, budget=128, history=0).collect()]
    blocks = sum(tokens) // (chat.BLOCK * 128) + 1
    assert blocks > 20 and max(sizes) <= 128 and sum(sizes) == sum(tokens)
    assert len(sizes) <= len(greedy(tokens, False, 128, 0)) + blocks


def test_a_long_conversation_takes_linear_time(spark):
    turns = spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "system").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id")).alias("text"))
    began = time.monotonic()
    read = chat.digests(chat.read_back(chat.format_windows(turns))).collect()
    assert read[0]["n_turns"] == 100_000 and time.monotonic() - began < 60
