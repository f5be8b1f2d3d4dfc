"""Chat formatting into budgeted windows, with DataFrame functions only.

Template, one block for each turn::

    <s>[INST:role]text[/INST]</s>

Roles and texts are escaped so that no control string can occur inside them: ``~``
becomes ``~0``, ``<`` becomes ``~1``, ``[`` becomes ``~2`` and ``]`` becomes ``~3``. All
control strings begin with ``<``, ``[`` or ``]``, so a block is unambiguous and reading it back gives the
same characters.

A conversation is cut into windows of at most ``budget`` tokens at turn borders, by
prefix sums of turn tokens. Every window begins with the system turn (the
conversation's first turn, if its role is ``system``) and repeats up to
``history`` tokens of the turns right before its first new turn. Repeated turns are
not trained on again: loss spans cover each assistant text once, in the window where
the turn is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "<s>[INST:", "]", "[/INST]</s>"
#: Escapes in the order of writing; reading goes the other way.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))
#: Characters that a block has besides role and text.
OVERHEAD = len(OPEN) + len(ROLE_END) + len(CLOSE)
#: Budgets of tokens in a block: what is filled by one fold, and as much as a task gathers besides one turn.
BLOCK = 64


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def turn_tokens(role: Column, text: Column) -> Column:
    """Tokens that a turn is counted as: one for each four bytes of its block, begun ones included."""
    return F.ceil((F.octet_length(role) + F.octet_length(text) + F.lit(OVERHEAD)) / F.lit(4.0)).cast("long")


def format_windows(turns: DataFrame, *, budget: int = 1024, history: int = 256, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row for each window: the conversation id, ``window`` (int from 0), ``n_repeated`` and ``n_new`` turns, ``formatted``, ``loss_spans``, ``tokens``.

    ``loss_spans`` are half-open ranges of characters (code points) of ``formatted``.
    A window takes new turns, beside the system turn and its history, until the next one
    does not fit. Blocks of BLOCK windows' tokens, by prefix sums, are filled apart, so a
    conversation of any length is filled side by side; only a block's last window may
    hold less than fits. A turn that has no room beside all its history stands with the
    part of it that fits. A window holds at most ``budget`` tokens unless its one new
    turn and the system turn are longer than that themselves; turns are never cut.

    Null texts and roles count as empty. Rows go by turn (null first); equal turns go
    by role, then text; repeated rows are turns of their own. Rows of a null
    conversation id form one conversation. Empty tables give no windows. Other columns
    are not read, so none can clash.

    Sums run over a conversation's turns in order and stream, in time proportional to
    them; only the turns of one block are gathered.
    """
    plain = turns.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    plain = plain.withColumn("er", escape(F.col("r"))).withColumn("ex", escape(F.col("x")))
    plain = plain.withColumn("n", turn_tokens(F.col("er"), F.col("ex")))
    order = Window.partitionBy("c").orderBy(F.asc_nulls_first("t"), "r", "x")
    placed = plain.withColumn("i", F.row_number().over(order)).withColumn("p", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    first = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("sys_n", F.first(F.when((F.col("i") == 1) & (F.col("r") == "system"), F.col("n")).otherwise(F.lit(0).cast("long"))).over(first))
    by_place = Window.partitionBy("c").orderBy("i")
    whole = Window.partitionBy("c")
    # What a window that begins here repeats, the system turn not counted.
    before = F.col("p") - F.greatest("sys_n", F.min("p").over(Window.partitionBy("c").orderBy("p").rangeBetween(-history, 0)))
    placed = placed.withColumn("room", F.lit(budget) - F.when(F.col("i") > 1, F.col("sys_n") + F.greatest(before, F.lit(0))).otherwise(F.lit(0)))
    # Windows are filled turn by turn inside a block, which is as long as BLOCK windows.
    blocks = placed.withColumn("block", F.expr(f"p div {BLOCK * budget}")).groupBy("c", "block").agg(F.array_sort(F.collect_list(F.struct("i", "p", "n", "room", "sys_n", "r", "er", "ex"))).alias("u"))
    filled = F.aggregate(
        "u",
        F.struct(F.lit(-1).cast("long").alias("left"), F.array().cast("array<int>").alias("starts")),
        lambda s, u: F.struct(
            F.when(u["n"] <= s["left"], s["left"] - u["n"]).otherwise(u["room"] - u["n"]).alias("left"),
            F.when(u["n"] <= s["left"], s["starts"]).otherwise(F.concat(s["starts"], F.array(u["i"]))).alias("starts"),
        ),
        lambda s: s["starts"],
    )
    placed = blocks.select("c", filled.alias("at"), "u").select("c", "at", F.explode("u").alias("u")).select("c", "u.*", F.array_contains("at", F.col("u.i")).alias("starts"))
    placed = placed.withColumn("w", F.sum(F.col("starts").cast("int")).over(by_place.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    # The last window that begins within reach of this turn repeats it, and so do those between.
    reach = Window.partitionBy("c").orderBy("p").rangeBetween(1, history)
    placed = placed.withColumn("last", F.coalesce(F.max(F.when(F.col("starts"), F.col("w"))).over(reach), F.col("w")))
    placed = placed.withColumn("last", F.when((F.col("i") == 1) & (F.col("r") == "system"), F.max("w").over(whole)).otherwise(F.greatest("last", "w")))
    copies = placed.select("c", "w", F.struct("i", "p", "n", "w", "r", "er", "ex").alias("u"), "sys_n", F.explode(F.sequence("w", F.col("last").cast("int"))).alias("window"))
    gathered = copies.groupBy("c", "window").agg(
        F.array_sort(F.collect_list("u")).alias("u"),
        F.max("sys_n").alias("sys_n"),
        F.min(F.when(F.col("w") == F.col("window"), F.col("u.p"))).alias("from"),
        F.sum(F.when(F.col("w") == F.col("window"), F.col("u.n"))).alias("new_n"),
    )
    # History that the budget has no room for goes; the system turn and the new turns stay.
    room = F.least(F.lit(history).cast("long"), F.lit(budget) - F.col("sys_n") - F.col("new_n"))
    fits = F.filter("u", lambda u: (u["w"] == F.col("window")) | ((u["i"] == 1) & (F.col("sys_n") > 0)) | (F.col("from") - u["p"] <= room))
    cut = gathered.withColumn("turns", fits).withColumn("n_new", F.size(F.filter("turns", lambda u: u["w"] == F.col("window")))).withColumn("n_repeated", F.size("turns") - F.col("n_new"))
    cut = cut.withColumn("blocks", F.transform("turns", lambda u: F.concat(F.lit(OPEN), u["er"], F.lit(ROLE_END), u["ex"], F.lit(CLOSE))))
    # Loss spans: block starts by a running sum of block lengths, then the text's place inside its block.
    spans = F.aggregate(
        F.sequence(F.lit(0), F.size("turns") - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, i: F.struct(
            (s["at"] + F.length(F.get("blocks", i))).alias("at"),
            F.when(
                (F.get("turns", i)["w"] == F.col("window")) & (F.get("turns", i)["r"] == target),
                F.concat(s["spans"], F.array(F.struct((s["at"] + len(OPEN) + len(ROLE_END) + F.length(F.get("turns", i)["er"])).alias("start"), (s["at"] + F.length(F.get("blocks", i)) - len(CLOSE)).alias("end")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda s, u: s + u["n"])
    return cut.select(F.col("c").alias(conv), F.col("window").cast("int").alias("window"), F.col("n_repeated").cast("int").alias("n_repeated"), F.col("n_new").cast("int").alias("n_new"), F.concat_ws("", "blocks").alias("formatted"), spans.alias("loss_spans"), tokens.alias("tokens"))


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted windows say: the id, ``n_turns``, ``turns`` (array of role and text, once each), ``loss_text``, ``formatted_chars``.

    Only ``formatted``, ``loss_spans`` and the count of repeated turns are read.
    """
    blocks = F.filter(F.split("formatted", "</s>"), lambda b: b != "")
    body = lambda b: F.substring(b, len(OPEN) + 1, F.length(b) - len(OPEN) - len(CLOSE) + len("</s>"))
    parsed = F.transform(blocks, lambda b: F.struct(unescape(F.substring_index(body(b), ROLE_END, 1)).alias("role"), unescape(F.substring(body(b), F.length(F.substring_index(body(b), ROLE_END, 1)) + 2, F.length(b))).alias("text")))
    new = F.slice(parsed, F.col("n_repeated") + 1, F.col("n_new"))
    lost = F.concat_ws("", F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    each = windows.select(F.col(conv).alias("c"), F.struct("window", new.alias("turns"), unescape(lost).alias("loss"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    whole = each.groupBy("c").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return whole.select(F.col("c").alias(conv), F.flatten("w.turns").alias("turns"), F.concat_ws("", "w.loss").alias("loss_text"), F.aggregate("w.chars", F.lit(0).cast("long"), lambda a, b: a + b).alias("formatted_chars")).withColumn("n_turns", F.size("turns").cast("long"))


def digests(read: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The contract's columns from what was read back."""
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(conv, "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
