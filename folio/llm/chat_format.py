"""Chat formatting: reply trees to one training conversation for each chosen branch.

Messages point to the message they answer. Self-joins by pointer doubling enumerate the root-to-leaf paths: after
k joins a message knows its 2^k-th ancestor and the score summed on the way, so a tree of depth d takes log2(d)
joins and each table keeps one row for each message, never a path. Leaves are branches; the branch with the
highest mean score wins (then the longest, then the smallest leaf). The chosen leaf's ancestors are marked by the
same tables, from jump 1 upward, and each path is then written as one conversation. Every tree goes this way, those of a
single branch too. The joins hold no text: texts are gathered once for each tree, and the marks, in the same order, pick.

A turn is ``<turn:ROLE>TEXT</turn>`` and a line feed. Inside texts a backslash is doubled, and ``<turn:`` and
``</turn>`` get a backslash after ``<``; so neither control string ever stands in a text, and two replacements
give the text back. In roles, ``%`` and ``>`` are written ``%25`` and ``%3E``. The loss mask is the list of
[start, end) code points of the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import cut

OPEN, CLOSE = "<turn:", "</turn>"


def escape(text: Column) -> Column:
    for old, new in (("\\", "\\\\"), (OPEN, "<\\turn:"), (CLOSE, "<\\/turn>")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescape(text: Column) -> Column:
    for new, old in ((CLOSE, "<\\/turn>"), (OPEN, "<\\turn:"), ("\\", "\\\\")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(">"), F.lit("%3E"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%3E"), F.lit(">")), F.lit("%25"), F.lit("%"))


def chosen_paths(messages: DataFrame) -> DataFrame:
    """The best root-to-leaf path of each tree: columns tree, msg of the messages on it.

    ``messages`` has tree, msg (unique in its tree), parent (null at a root) and score. A message whose parent is
    missing is a root. A tree with several roots counts as one tree. Messages that answer each other in a circle
    have no root; no path holds them.

    Jumps double until every message has met its root; messages that lead into a circle never do, and are the only ones
    still jumping once jumps are longer than the largest tree.
    """
    base = messages.select("tree", "msg", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = base.select(F.col("tree"), F.col("msg").alias("parent"), F.lit(True).alias("there"))
    jump = cut(base.join(known, ["tree", "parent"], "left").select("tree", "msg", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("size"), "score"))
    largest = base.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    # only messages that haven't reached their root jump on, so a few deep trees don't make the others join again
    ended, active = jump.where("up is null"), jump.where("up is not null")
    jumps = [active]
    while 2 ** (len(jumps) - 1) <= largest and active.limit(1).count():
        far = ended.unionByName(active).select("tree", F.col("msg").alias("up"), F.col("up").alias("far"), F.col("size").alias("more"), F.col("score").alias("add"))
        jump = cut(active.join(far, ["tree", "up"], "left").select("tree", "msg", F.col("far").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), (F.col("score") + F.coalesce("add", F.lit(0.0))).alias("score")))
        ended, active = ended.unionByName(jump.where("up is null")), jump.where("up is not null")
        jumps.append(active)
    parents = jumps[0].select("tree", F.col("up").alias("msg")).distinct()
    branches = ended.join(parents, ["tree", "msg"], "left_anti")
    rank = F.struct((F.col("score") / F.col("size")).alias("mean"), "size")
    best = branches.groupBy("tree").agg(F.max(rank).alias("top")).join(branches.withColumn("top", rank), ["tree", "top"])
    marked = cut(best.groupBy("tree").agg(F.min("msg").alias("msg")))
    for step in jumps:
        above = marked.join(step, ["tree", "msg"]).select("tree", F.col("up").alias("msg"))
        marked = cut(marked.union(above).distinct())
    return marked


def format_turns(turns: DataFrame, loss_role: str = "assistant", marks: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: tree, formatted, loss_mask (array of start, end in code points, from 0).

    ``turns`` has tree, place (the order), role and text; null roles and texts are empty. Equal places are ordered
    by role and text, so repeated rows give the same output in any order. ``marks`` (tree, place, chosen: one row for each
    turn) says which turns are formatted, all of them by default; a tree of which none is chosen has no row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    made = turns.select("tree", "place", F.concat(F.lit(OPEN), escape_role(role), F.lit(">")).alias("head"), escape(text).alias("body"), (role == loss_role).alias("loss"))
    gathered = made.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("place", "head", "body", "loss"))).alias("t"))
    if marks is not None:
        told = marks.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("place", "chosen"))).alias("marks"))
        gathered = gathered.join(told, "tree").select("tree", F.filter("t", lambda _, i: F.get("marks", i)["chosen"]).alias("t")).where(F.size("t") > 0)
    tail = F.lit(CLOSE + "\n")
    lengths = F.transform("t", lambda x: F.struct(F.length(x["head"]).alias("h"), F.length(x["body"]).alias("b"), x["loss"].alias("loss")))
    step = lambda a, x: F.struct((a["at"] + x["h"] + x["b"] + len(CLOSE) + 1).alias("at"), F.when(x["loss"], F.concat(a["mask"], F.array(F.struct((a["at"] + x["h"]).alias("start"), (a["at"] + x["h"] + x["b"]).alias("end"))))).otherwise(a["mask"]).alias("mask"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    return gathered.select("tree", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], tail)), "").alias("formatted"), F.aggregate(lengths, zero, step)["mask"].alias("loss_mask"))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), unescaped."""
    parts = F.split(formatted, CLOSE + "\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    end = lambda x: F.instr(x, ">")
    role = lambda x: unescape_role(F.substring(x, F.lit(len(OPEN) + 1), end(x) - len(OPEN) - 1))
    return F.transform(parts, lambda x: F.struct(role(x).alias("role"), unescape(F.substring(x, end(x) + 1, F.length(x))).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped span by span, with nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def format_conversations(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Reply trees to conversations: tree, formatted, loss_mask.

    ``messages`` has tree, msg, parent, score, role and text. ``msg`` orders a path's turns, so a message must be
    larger than its parent. Rows with a null tree or msg belong to no tree and are left out.
    """
    given = messages.where("tree is not null and msg is not null")
    narrow = cut(given.select("tree", "msg", "parent", "score"))
    best = chosen_paths(narrow).select("tree", "msg", F.lit(True).alias("on"))
    marks = narrow.select("tree", "msg").join(best, ["tree", "msg"], "left").select("tree", F.col("msg").alias("place"), F.coalesce("on", F.lit(False)).alias("chosen"))
    return format_turns(given.select("tree", F.col("msg").alias("place"), "role", "text"), loss_role, marks)


def linear_messages(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Conversations as trees of one branch: each row answers the one before it, by turn, then role and text.

    Rows with a null id are left out; a null turn comes first.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    given = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("tree"), "turn", "role", "text")
    return given.withColumn("msg", F.row_number().over(w).cast("long")).select("tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")
