"""Reply trees as conversations, with DataFrame joins and SQL functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm._store import materialize

OPEN, CLOSE = "<turn>", "</turn>\n"
ASSISTANT = "assistant"
#: A path of over 2**STEPS turns, or parents in a circle, raise.
STEPS = 40


def escape(text: Column) -> Column:
    """Reversible: backslashes are doubled and control strings broken by one, so neither mark occurs in a text."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), "<(?=/?turn)", r"<\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """The `top` best root-to-leaf paths of each tree: rows (tree, branch, depth, role, text), branch from 1, depth from 1.

    nodes: (tree, node, parent, score, role, text), node unique in its tree; a
    null or unknown parent makes a root, a null score is 0. A branch's score is
    the sum along its path; ties go to the longer path, then the smaller leaf.

    Self-joins double the distance that each node looks up at every step, so a
    path of n turns takes log2(n) of them; the same distances, walked down from
    the chosen leaves, list their paths. The joins' key is (tree, node), which
    no hot tree makes hot. Parents in a circle raise.
    """
    keys = ["tree", "node"]
    nodes = materialize(
        nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "role", "text"), "nodes"
    )
    known = nodes.select("tree", F.col("node").alias("parent"))
    links = nodes.select("tree", "node", "parent", "score").join(known.withColumn("known", F.lit(True)), ["tree", "parent"], "left")
    state = materialize(
        links.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("gain"), F.lit(1).cast("long").alias("depth")),
        "jump0",
    )
    jumps, done, active = [], [state.where("up is null")], state.where("up is not null")
    while active.limit(1).count():
        if len(jumps) == STEPS:
            raise ValueError("parents form a circle, or a path is too long")
        jumps.append(active.select("tree", "node", "up"))
        state = active.unionByName(reduce(DataFrame.unionByName, done))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("gain").alias("gain2"), F.col("depth").alias("depth2"))
        # Only nodes that haven't reached their root look further.
        further = active.join(above, ["tree", "up"]).select(
            *keys, F.col("up2").alias("up"), (F.col("gain") + F.col("gain2")).alias("gain"), (F.col("depth") + F.col("depth2")).alias("depth")
        )
        further = materialize(further, f"jump{len(jumps)}")
        done.append(further.where("up is null"))
        active = further.where("up is not null")
    state = reduce(DataFrame.unionByName, done)
    inner = nodes.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    best = Window.partitionBy("tree").orderBy(F.desc("gain"), F.desc("depth"), "node")
    chosen = (
        state.join(inner, keys, "left_anti").withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= top).select("tree", "branch", "node")
    )
    for jump in jumps:
        chosen = materialize(chosen, "paths")
        chosen = chosen.unionByName(chosen.join(jump, keys).select("tree", "branch", F.col("up").alias("node")))
    return chosen.join(state.select(*keys, "depth"), keys).join(nodes.select(*keys, "role", "text"), keys).select(
        "tree", "branch", "depth", "role", "text"
    )


def format_paths(paths: DataFrame) -> DataFrame:
    """One row for each (tree, branch): formatted, and loss_mask, the code-point spans of the assistant's texts in it.

    Null roles and texts are empty. A formatted conversation is one value, so
    it has to fit a task, as its path's turns do.
    """
    rows = paths.select(
        "tree",
        "branch",
        "depth",
        F.concat(F.lit(OPEN), _role(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
        F.coalesce(F.col("role") == ASSISTANT, F.lit(False)).alias("learn"),
    )
    # The places are running sums of lengths over rows, dealt as the grouping below needs them.
    size = F.length("head") + F.length("body") + len(CLOSE)
    before = F.sum(size).over(Window.partitionBy("tree", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + F.length("head")
    rows = rows.withColumns({"start": start, "end": start + F.length("body")})
    turns = rows.groupBy("tree", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "head", "body", "start", "end", "learn"))).alias("turns"))
    return turns.select(
        "tree",
        "branch",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array<struct<role, text>>) and loss_texts (array<string>), both parsed from formatted and loss_mask."""
    parts = F.split("formatted", "</turn>\n", -1)
    rows = formatted.withColumn("turns", F.slice(parts, F.lit(1), F.size(parts) - 1))

    def turn(part: Column) -> Column:
        role = F.regexp_extract(part, r"(?s)^<turn>((?:[^\\\n]++|\\.)*+)\n", 1)
        text = F.substring(part, F.length(role) + len(OPEN) + 2, F.length(part))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    cut = lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return rows.withColumns({"turns": F.transform("turns", turn), "loss_texts": F.transform("loss_mask", cut)})


def linear_trees(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees in which each turn replies to the one before.

    Rows are ordered by turn, then role and text, nulls first; rows with equal
    turns, and repeated rows, all stay, one after another. A row without conv_id
    belongs to no other: it is a conversation of its own, whose tree's name
    begins with "null:". Other columns are left out; an empty table gives none.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("null:"), F.monotonically_increasing_id())).alias("tree"), "turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )
