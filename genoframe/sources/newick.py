"""Many Newick trees as one table of nodes, parsed in Spark.

A text becomes tokens with places. The running sum of brackets is the depth, brackets of
one depth open and close by turns, so the next bracket of a depth closes the one before
it; the last open bracket of the depth above is the parent. A node is an interval of
places, and of ranks of the tips between them: what is below a node is what lies in its
interval, and no walk of the tree and no join by level is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quoted names, brackets and commas, lengths with their colon, bare names.
TOKENS = r"'(?:[^']|'')*'|[(),;]|:\s*[^\s(),;:']+|[^\s(),;:']+"
COMMENTS = r"\[[^\]]*\]"


def tokens(trees: DataFrame, key: str = "tree_id", text: str = "newick") -> DataFrame:
    """``key``, ``at`` (from 0), ``token`` up to the first semicolon; comments in square brackets are left out."""
    said = F.regexp_extract_all(F.regexp_replace(F.col(text), COMMENTS, ""), F.lit(TOKENS), F.lit(0))
    end = F.array_position(said, ";")
    return trees.select(F.col(key).alias("tree_id"), F.posexplode(F.when(end > 0, F.slice(said, F.lit(1), end.cast("int") - 1)).otherwise(said)).alias("at", "token"))


def parse(trees: DataFrame, key: str = "tree_id", text: str = "newick") -> DataFrame:
    """The nodes of all trees: ``tree_id``, ``node_id``, ``parent_id`` (null for the root), ``name``, ``branch_len``, ``is_leaf``, ``depth``, and ``first``, ``last``: ranks from 0 of the tips below.

    Nodes are numbered in the order in which they begin, the root 0. Names are quoted or
    not, and empty where there are none; lengths are 0 where there are none. Tips need
    no name. A tree whose brackets do not match fails the query; a null or blank text
    has no nodes. A tree's tokens are one window; trees are dealt over tasks.
    """
    own = Window.partitionBy("tree_id").orderBy("at")
    read = tokens(trees, key, text).withColumn("before", F.lag("token").over(own))
    mark = F.col("token").isin("(", ")", ",") | F.col("token").startswith(":")
    opens, closes = (F.col("token") == "(").cast("int"), (F.col("token") == ")").cast("int")
    begins = F.col("before").isNull() | F.col("before").isin("(", ",")
    # A tip is a name where a node begins, or nothing there: then it has the place before.
    tip = begins & (F.col("token") != "(")
    unnamed = tip & mark
    deep = F.sum(opens - closes).over(own)
    read = read.withColumn("deep", deep)
    # Places are doubled, so that there is one before each token.
    event = F.struct(
        F.when(F.col("token") == "(", F.lit("open")).when(F.col("token") == ")", F.lit("close")).when(F.col("token").startswith(":"), F.lit("length")).when(F.col("token") == ",", F.lit("comma")).when(tip, F.lit("tip")).otherwise(F.lit("name")).alias("kind"),
        (F.col("at") * 2 + 1).alias("place"),
        F.col("token").alias("token"),
        # Of a bracket: the depth inside it; of others: where they are.
        F.when(F.col("token") == ")", F.col("deep") + 1).otherwise(F.col("deep")).alias("level"),
    )
    empty = F.struct(F.lit("tip").alias("kind"), (F.col("at") * 2).alias("place"), F.lit("''").alias("token"), F.when(F.col("token") == ")", F.col("deep") + 1).otherwise(F.col("deep")).alias("level"))
    events = read.select("tree_id", F.inline(F.when(unnamed, F.array(empty, event)).otherwise(F.array(event))))
    line = Window.partitionBy("tree_id").orderBy("place")
    ranked = events.withColumn("rank", F.sum((F.col("kind") == "tip").cast("int")).over(line))
    turn = ranked.withColumn("bracket", F.col("kind").isin("open", "close"))
    nested = Window.partitionBy("tree_id", "level", "bracket").orderBy("place")
    paired = turn.withColumn("next_kind", F.lead("kind").over(nested)).withColumn("end", F.lead("place").over(nested)).withColumn("end_rank", F.lead("rank").over(nested))
    wrong = (F.col("bracket") & (F.col("level") < 1)) | ((F.col("kind") == "open") & ~F.coalesce(F.col("next_kind") == "close", F.lit(False)))
    paired = paired.withColumn("kind", F.when(wrong, F.raise_error(F.lit("unbalanced Newick"))).otherwise(F.col("kind")))
    # The names and lengths that follow a tip or a closed bracket are its own.
    anchor = F.last(F.when(F.col("kind").isin("tip", "close"), F.col("place")), True).over(line)
    said = paired.withColumn("anchor", anchor)
    label = F.regexp_replace(F.regexp_replace(F.col("token"), "^'|'$", ""), "''", "'")
    unquoted = F.when(F.col("token").startswith("'"), label).otherwise(F.col("token"))
    length = F.expr("try_cast(trim(substring(token, 2)) AS double)")
    attributes = said.where(F.col("kind").isin("name", "length", "tip") & F.col("anchor").isNotNull()).groupBy("tree_id", "anchor").agg(F.min_by(F.when(F.col("kind") != "length", unquoted), F.when(F.col("kind") != "length", F.col("place"))).alias("name"), F.min_by(F.when(F.col("kind") == "length", length), F.when(F.col("kind") == "length", F.col("place"))).alias("branch_len"))
    inner = F.col("kind") == "open"
    # A parent opened the level around the node: both are events of that level.
    around = F.when(inner, F.col("level") - 1).otherwise(F.col("level"))
    nodes = said.where(F.col("kind").isin("open", "tip")).select("tree_id", "place", "kind", around.alias("around"), F.when(inner, F.col("end")).otherwise(F.col("place")).alias("anchor"), F.when(inner, F.col("rank")).otherwise(F.col("rank") - 1).cast("int").alias("first"), (F.when(inner, F.col("end_rank")).otherwise(F.col("rank")) - 1).cast("int").alias("last"))
    numbered = nodes.withColumn("node_id", (F.row_number().over(line) - 1).cast("int"))
    as_parent = numbered.where("kind = 'open'").select("tree_id", (F.col("around") + 1).alias("around"), "place", F.col("node_id").alias("up"), F.lit(None).cast("int").alias("node_id"))
    as_child = numbered.select("tree_id", "around", "place", F.lit(None).cast("int").alias("up"), "node_id")
    beside = Window.partitionBy("tree_id", "around").orderBy("place")
    found = as_parent.unionByName(as_child).withColumn("parent_id", F.last("up", True).over(beside)).where("node_id IS NOT NULL").select("tree_id", "node_id", "parent_id")
    whole = numbered.join(found, ["tree_id", "node_id"]).join(attributes, ["tree_id", "anchor"], "left")
    return whole.select("tree_id", "node_id", "parent_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("branch_len", F.lit(0.0)).alias("branch_len"), (F.col("kind") == "tip").alias("is_leaf"), F.col("around").cast("int").alias("depth"), "first", "last")


def tips_below(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``tree_id``, ``node_id``, ``tip``: the nodes ``of`` (``tree_id``, ``node_id``; all by default) with the names of the tips below them, a tip with itself.

    A node's interval of ranks is spelled out and met by rank, so what is joined is what
    comes out. For counts, ``last - first + 1`` says it without a join.
    """
    asked = nodes if of is None else nodes.join(of, ["tree_id", "node_id"], "left_semi")
    spelled = asked.select("tree_id", "node_id", F.explode(F.sequence("first", "last")).alias("rank"))
    tips = nodes.where("is_leaf").select("tree_id", F.col("first").alias("rank"), F.col("name").alias("tip"))
    return spelled.join(tips, ["tree_id", "rank"]).select("tree_id", "node_id", "tip")


def _label(name: Column) -> Column:
    """A name as Newick has it: quoted where a bare one would not be read back."""
    quoted = F.concat(F.lit("'"), F.regexp_replace(name, "'", "''"), F.lit("'"))
    return F.when(name.rlike(r"[\s(),;:'\[\]]") | (name == ""), quoted).otherwise(name)


def star_lines(tips: DataFrame, by: Sequence[str], name: str, length: str) -> DataFrame:
    """``by`` and ``newick`` of a star tree of each group's tips, in order of their names."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(length).alias("l"))))
    return tips.groupBy(*by).agg(listed.alias("t")).select(*by, F.concat(F.lit("("), F.array_join(F.transform("t", lambda t: F.concat(_label(t["n"]), F.lit(":"), t["l"].cast("string"))), ","), F.lit(");")).alias("newick"))
