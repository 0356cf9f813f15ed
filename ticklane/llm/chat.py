"""Reply trees to conversations, with DataFrame operations only.

``reply_paths`` finds the paths from roots to leaves by iterative self-joins that double the distance each time (so a
thread of n messages takes about log2(n) joins), ranks each root's branches by score and keeps the best ones;
``format_paths`` writes each chosen path as one conversation in a marked template with a loss mask, and ``read_back``
takes it apart again.

Null texts and roles are empty; a message whose parent is not there, or is itself, is a root; messages in a cycle of
replies have no root and are in no path; equal scores go to the path with the lesser leaf id; equal ids are one message
(the first by role and text). One conversation is one string, so a path must fit a row, however long its texts. An empty
table gives no paths; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.llm.common import checkpointed

#: The template's marks, and the control strings of common chat templates that texts must not contain.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROL = r"([<\[])(=*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|eot_id\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"
STUFFED = r"([<\[])=(=*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|eot_id\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escaped(text: Column) -> Column:
    """Put one more = after the first character of each control string, so that none is left; ``unescaped`` undoes it."""
    return F.regexp_replace(text, CONTROL, "$1=$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, STUFFED, "$1$2$3")


def one_line(role: Column) -> Column:
    """A role without line breaks: ^ becomes ^0 and a line feed ^1."""
    return F.replace(F.replace(role, F.lit("^"), F.lit("^0")), F.lit("\n"), F.lit("^1"))


def many_lines(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("^1"), F.lit("\n")), F.lit("^0"), F.lit("^"))


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Chosen paths of messages (id, parent_id, score): rows (path_id, branch, id, depth); path_id is the leaf's id.

    A path's score is the sum of its messages' scores (null: 0); ``branches`` paths of each root are kept, best first.
    """
    nodes = messages.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct(F.col("parent_id").isNull(), "parent_id", "score")).alias("m"))
    nodes = nodes.select("id", F.when(F.col("m.parent_id") != F.col("id"), F.col("m.parent_id")).alias("parent_id"), F.coalesce("m.score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    # roots have no parent to look for, and all of them would meet in one task
    answers = nodes.where(F.col("parent_id").isNotNull()).join(known, "parent_id", "left").select("id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"), "score")
    nodes = checkpointed(answers.unionByName(nodes.where(F.col("parent_id").isNull())))
    # total: score of the nodes from here up to, not including, far; jumps[k]: far after 2 ** k steps
    state = nodes.select("id", F.col("parent_id").alias("far"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"), F.col("id").alias("top"))
    jumps = [state.select("id", "far")]
    # a path without a cycle is no longer than the number of nodes, and each round doubles what is passed
    for _ in range(nodes.count().bit_length() + 1):
        ahead = state.select(F.col("id").alias("far"), F.col("far").alias("next"), F.col("total").alias("t"), F.col("depth").alias("d"), F.col("top").alias("r"))
        moving = state.where(F.col("far").isNotNull()).join(ahead, "far")
        state = checkpointed(
            state.where(F.col("far").isNull()).unionByName(
                moving.select("id", F.col("next").alias("far"), (F.col("total") + F.col("t")).alias("total"), (F.col("depth") + F.col("d")).alias("depth"), F.col("r").alias("top"))
            )
        )
        if state.where(F.col("far").isNotNull()).isEmpty():
            break
        jumps.append(state.select("id", "far"))
    state = state.where(F.col("far").isNull())  # without cycles
    parents = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct()
    leaves = state.join(parents, "id", "left_anti")
    best = Window.partitionBy("top").orderBy(F.desc("total"), "id")
    chosen = checkpointed(leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches))
    # every chosen leaf walks up: after step k the path holds all nodes less than 2 ** (k + 1) above the leaf
    path = chosen.select(F.col("id").alias("path_id"), "branch", F.col("id").alias("id"), F.col("depth").alias("depth"))
    for k in range(len(jumps) - 1, -1, -1):
        up = jumps[k].where(F.col("far").isNotNull())
        # the union reads the path twice, so each step is cut off
        path = checkpointed(path.unionByName(path.join(up, "id").select("path_id", "branch", F.col("far").alias("id"), (F.col("depth") - F.lit(2**k)).alias("depth"))))
    return path


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One row for each path: path_id, branch, n_turns, formatted and loss_spans (start, length in code points of the
    assistant texts in formatted). messages: id, role, text."""
    turns = messages.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("role", "text")).alias("m"))
    turns = paths.join(turns, "id").select(
        "path_id", "branch", "depth",
        one_line(escaped(F.coalesce("m.role", F.lit("")))).alias("role"),
        (F.coalesce("m.role", F.lit("")) == "assistant").alias("learned"),
        escaped(F.coalesce("m.text", F.lit(""))).alias("body"),
    )
    turns = turns.withColumn("turn", F.concat(F.lit(OPEN), "role", F.lit("\n"), "body", F.lit(CLOSE)))
    upto = Window.partitionBy("path_id", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("upto", F.sum(F.length("turn").cast("long")).over(upto))
    start = F.col("upto") - F.length("body") - len(CLOSE)
    parts = turns.groupBy("path_id", "branch").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("depth", "turn"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("learned"), F.struct(start.alias("start"), F.length("body").cast("long").alias("length"))))).alias("loss_spans"),
    )
    return parts.select("path_id", "branch", "n_turns", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """Array of structs (role, text) from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(CLOSE))
        return F.struct(unescaped(many_lines(role)).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def under_mask(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(loss_spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def as_chain(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages: each row answers the one before it in its conversation (by turn, nulls
    first, then role and text). Null conv_ids are one conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order))
    return rows.select(
        F.struct("conv_id", "n").alias("id"), F.when(F.col("n") > 1, F.struct("conv_id", (F.col("n") - 1).alias("n"))).alias("parent_id"),
        F.lit(0.0).alias("score"), "role", "text",
    )
