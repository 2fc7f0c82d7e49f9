"""Chat formatting of reply trees, in DataFrame functions only.

A message names its parent. Paths are found by self-joins that double: every message holds the
ancestor 2^k steps up, the number of steps and the score gathered, so a chain of n messages takes
log2(n) rounds. Each tree keeps its ``keep`` leaves of best rank (path score, then length, then the
smaller leaf), and each kept leaf's path is listed by walking the held pointers of all powers of two.

Template: ``<s>``, then per turn an opening mark, the escaped text and a closing mark, then ``</s>``.
``&``, ``<``, ``[`` and ``]`` in a text become entities, so no text can hold a mark and unescaping is
exact. The loss mask is the list of code-point spans of the assistants' escaped texts.

Defined cases: a null text or role counts as empty; a message whose parent is missing is a root; a
null tree id is a tree of its own; repeated (tree, message) rows count once, the smallest by (role,
text); cycles have no root and are left out; an empty table gives an empty result; other columns are
not read. A tree's messages are spread over tasks by (tree, message), never by tree alone, until a
kept path is put together as the one row that it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.store import written

#: Marks of the known roles; others carry their name.
MARKS = {"system": "SYS", "user": "INST", "assistant": "OUT"}
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))


def escape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ENTITIES), c)


def _mark(role: Column) -> Column:
    known = F.lit(None).cast("string")
    for name, mark in MARKS.items():
        known = F.when(role == name, F.lit(mark)).otherwise(known)
    return F.coalesce(known, F.concat(F.lit("ROLE "), escape(role)))


def _role(mark: Column) -> Column:
    role = unescape(F.substring(mark, 6, 1 << 30))
    for name, m in MARKS.items():
        role = F.when(mark == m, F.lit(name)).otherwise(role)
    return role


def chain(turns: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as the messages of a one-branch tree: each replies to the one before it."""
    base = turns.select(
        turns[tree].alias("tree"), turns[order].alias("_o"), F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text")
    )
    w = Window.partitionBy("tree").orderBy("_o", "role", "text")
    n = F.row_number().over(w).cast("long")
    numbered = base.select("tree", n.alias("message"), "role", "text")
    return numbered.select(
        "tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )


def best_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """tree, rank, leaf, step (0 at the root), message of each tree's ``keep`` best root-to-leaf paths.

    ``messages``: tree, message, parent, score; (tree, message) unique.
    """
    ids = messages.select("tree", "message", "parent", F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"))
    there = ids.select(F.col("tree").alias("_t"), F.col("message").alias("parent"), F.lit(True).alias("_there"))
    ids = written(
        ids.join(there, ids.tree.eqNullSafe(there._t) & (ids.parent == there.parent), "left").select(
            "tree", "message", F.when(F.col("_there"), ids.parent).alias("up"), F.col("score").alias("sum"), F.when(F.col("_there"), F.lit(1)).otherwise(0).cast("long").alias("steps")
        ),
        "chat-ids",
    )
    parents = ids.where("up is not null").select(F.col("tree").alias("_t"), F.col("up").alias("_m")).distinct()
    # Round k: ``up`` is the ancestor 2^k steps above; ``sum`` is of all scores from the message up to, not
    # with, ``up``. A message whose next pointer would pass the root is done and isn't joined again.
    done, active, levels = [ids.where("up is null")], ids.where("up is not null"), []
    while not active.isEmpty() and len(levels) < 40:  # what is left after 2^40 steps is a cycle
        levels.append(active)
        above = reduce(DataFrame.unionByName, [*done, active]).select(F.col("tree").alias("_t"), F.col("message").alias("_m"), F.col("up").alias("_up"), F.col("sum").alias("_sum"), F.col("steps").alias("_steps"))
        moved = active.join(above, active.tree.eqNullSafe(above._t) & (active.up == above._m)).select(
            "tree", "message", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"), (F.col("steps") + F.col("_steps")).alias("steps")
        )
        moved = written(moved, "chat-up")
        done.append(moved.where("up is null"))
        active = moved.where("up is not null")
    ends = reduce(DataFrame.unionByName, done)
    leaves = ends.join(parents, ends.tree.eqNullSafe(parents._t) & (ends.message == parents._m), "left_anti")
    best = F.struct((-F.col("sum")).alias("s"), (-F.col("steps")).alias("n"), F.col("message").alias("leaf"))
    if keep == 1:
        leaves = leaves.groupBy("tree").agg(F.min(best).alias("b")).select("tree", F.lit(1).alias("rank"), F.col("b.leaf").alias("leaf"), (-F.col("b.n")).alias("depth"))
    else:
        w = Window.partitionBy("tree").orderBy(best)
        leaves = leaves.select("tree", F.row_number().over(w).alias("rank"), F.col("message").alias("leaf"), F.col("steps").alias("depth")).where(F.col("rank") <= keep)
    path = leaves.select("tree", "rank", "leaf", "depth", F.col("leaf").alias("message"), F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(levels))):
        up = levels[k].select(F.col("tree").alias("_t"), F.col("message").alias("_m"), "up")
        # Every message listed so far also lists the one 2^k above it: all distances, each once.
        higher = path.join(up, path.tree.eqNullSafe(up._t) & (path.message == up._m)).select("tree", "rank", "leaf", "depth", F.col("up").alias("message"), (F.col("back") + (1 << k)).alias("back"))
        path = written(path.unionByName(higher), "chat-path")
    return path.select("tree", "rank", "leaf", (F.col("depth") - F.col("back")).alias("step"), "message")


def format_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """One row per kept path: tree, rank, leaf, n_turns, formatted, loss_spans (array of start, length)."""
    unique = messages.groupBy("tree", "message").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("tree", "message", "m.*")
    unique = written(
        unique.select("tree", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent", "score"), "chat-messages"
    )
    path = best_paths(unique, keep)
    body = unique.select(F.col("tree").alias("_t"), F.col("message").alias("_m"), "role", "text")
    turns = path.join(body, path.tree.eqNullSafe(body._t) & (path.message == body._m))
    mark = _mark(F.col("role"))
    turns = turns.select(
        "tree", "rank", "leaf", F.struct(F.col("step"), (F.col("role") == "assistant").alias("learn"), F.concat(F.lit("["), mark, F.lit("]")).alias("open"), escape(F.col("text")).alias("body"), F.concat(F.lit("[/"), F.element_at(F.split(mark, " "), 1), F.lit("]")).alias("close")).alias("t")
    )
    paths = turns.groupBy("tree", "rank", "leaf").agg(F.array_sort(F.collect_list("t")).alias("t"))
    start = F.struct(F.lit(3).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    size = lambda x: F.length(x).cast("long")
    spans = F.aggregate(
        F.transform("t", lambda x: F.struct(x["learn"].alias("learn"), size(x["open"]).alias("a"), size(x["body"]).alias("b"), size(x["close"]).alias("c"))),
        start,
        lambda s, x: F.struct(
            (s["at"] + x["a"] + x["b"] + x["c"]).alias("at"),
            F.when(x["learn"], F.concat(s["spans"], F.array(F.struct((s["at"] + x["a"]).alias("start"), x["b"].alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    whole = F.concat(F.lit("<s>"), F.array_join(F.transform("t", lambda x: F.concat(x["open"], x["body"], x["close"])), ""), F.lit("</s>"))
    return paths.select("tree", "rank", "leaf", F.size("t").cast("long").alias("n_turns"), whole.alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation: array of (role, text), unescaped."""
    one = r"\[((?:SYS|INST|OUT|ROLE )[^\[\]]*)\]([^\[\]]*)\[/[A-Z]+\]"
    marks, texts = F.regexp_extract_all(formatted, F.lit(one), F.lit(1)), F.regexp_extract_all(formatted, F.lit(one), F.lit(2))
    return F.zip_with(marks, texts, lambda m, t: F.struct(_role(m).alias("role"), unescape(t).alias("text")))


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
