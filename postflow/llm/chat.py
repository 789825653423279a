"""Chat formatting of reply trees, with DataFrame functions only (operator 11).

Messages that reply to one another form trees.  Every path from a root to a leaf is a conversation; the paths
are enumerated by iterative self-joins: round k joins the table of 2**k-th ancestors with itself, and
the leaves then collect their ancestors from the longest jump to the shortest, so a path of n messages takes 2 log n
joins and a table of paths never holds more rows than the paths have messages.  The branches of a tree are
ranked by score, and each chosen path becomes one text with the ranges that a model is to learn from.
"""

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postflow.session import materialise


class Template(NamedTuple):
    """How turns are marked: ``begin``, then for each turn ``turn`` role ``text`` text ``end``.

    Roles and texts are escaped so that none of ``control`` occurs in them: a backslash is doubled, and one is put
    after the first character of a control string.  A control string starts with a character that it
    doesn't hold elsewhere and holds no backslash, so none can overlap another.
    """

    # The marks of public chat templates.
    begin: str = "<|begin_of_text|>"
    turn: str = "<|start_header_id|>"
    text: str = "<|end_header_id|>\n\n"
    end: str = "<|eot_id|>"
    control: tuple[str, ...] = (
        "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|end_of_text|>",
        "<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "<s>", "</s>",
    )


def escape(text: Column, template: Template = Template()) -> Column:
    """``text`` without control strings; ``unescape`` gives it back."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.control:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _replies(messages: DataFrame) -> DataFrame:
    """(row, up): each message with the one it replies to, null for a root."""
    heads = messages.filter("node is not null").groupBy(F.col("tree").alias("t"), F.col("node").alias("n")).agg(F.min("row").alias("up"))
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n"))
    return messages.join(heads, same, "left").select("row", "up")


def _ancestors(replies: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables k = 0, 1, .. of (row, up), ``up`` being the 2**k-th ancestor; and the rows that reach no root."""
    total = replies.count()
    steps = [materialise(replies.filter("up is not null"), "ancestors")]
    while True:
        near, far = steps[-1], steps[-1].select(F.col("row").alias("up"), F.col("up").alias("further"))
        found = materialise(near.join(far, "up").select("row", F.col("further").alias("up")), "ancestors")
        if found.isEmpty():
            return steps, None
        if 2 ** len(steps) >= total:  # more ancestors than messages
            return steps, found.select("row")
        steps.append(found)


def reply_paths(replies: DataFrame) -> DataFrame:
    """(leaf, row, back): every message of every path that ends in a message without a reply.

    ``replies`` holds (row, up); ``back`` counts from the leaf.  Messages that reply to each other in a circle have
    no root: neither they nor what hangs on them are in a path.
    """
    steps, endless = _ancestors(replies)
    leaves = replies.select("row").join(steps[0].select(F.col("up").alias("row")).distinct(), "row", "left_anti")
    if endless is not None:
        leaves = leaves.join(endless, "row", "left_anti")
    paths = leaves.select(F.col("row").alias("leaf"), "row", F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(steps))):
        more = paths.join(steps[k], "row").select("leaf", F.col("up").alias("row"), (F.col("back") + 2**k).alias("back"))
        paths = materialise(paths.unionByName(more), "paths")
    return paths


def _chosen(paths: DataFrame, messages: DataFrame, branches: int | None) -> DataFrame:
    """(leaf, tree, node, rank) of the chosen branches: those of the highest mean score, ties by the leaf's row."""
    scores = paths.join(messages.select("row", "score"), "row").groupBy("leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    ends = scores.join(messages.select(F.col("row").alias("leaf"), "tree", "node"), "leaf")
    best = Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")
    ranked = ends.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    return ranked.select("leaf", "tree", "node", F.col("rank").cast("long").alias("rank"))


def format_trees(
    messages: DataFrame, tree: str, node: str, parent: str, role: str = "role", text: str = "text",
    score: str | None = None, branches: int | None = None, template: Template = Template(), learned=("assistant",),
) -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, loss): one row for each chosen path of each tree.

    ``leaf`` is the node that ends the path and ``rank`` its place among the tree's branches by the mean
    ``score`` of their messages, a null score being 0; ``branches`` is the number of branches kept for a tree,
    all when None.  ``loss`` lists the (start, size) of every text by a role in ``learned``, in bytes of the
    UTF-8 text ``formatted``.  A null tree is a tree of its own; a null role or text is empty; a
    message without a node takes no replies; one whose parent is null or absent is a root; replies to a node
    that several rows repeat go to one of them.  One conversation has to fit into one row.
    """
    rows = messages.select(
        messages[tree].alias("tree"), messages[node].alias("node"), messages[parent].alias("parent"),
        F.coalesce(messages[role], F.lit("")).alias("role"), F.coalesce(messages[text], F.lit("")).alias("text"),
        (messages[score].cast("double") if score else F.lit(None).cast("double")).alias("score"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "messages")  # the numbers of rows must not change
    paths = reply_paths(materialise(_replies(rows), "replies"))
    chosen = _chosen(paths, rows, branches)
    turns = paths.join(chosen, "leaf").join(rows.select("row", "role", "text"), "row")
    head = F.concat(F.lit(template.turn), escape(F.col("role"), template), F.lit(template.text))
    turns = turns.select(
        "leaf", "tree", "node", "rank", "back", head.alias("head"), escape(F.col("text"), template).alias("body"),
        F.col("role").isin(*learned).alias("learn"),
    )
    size = F.octet_length("head") + F.octet_length("body") + len(template.end.encode())
    before = Window.partitionBy("leaf").orderBy(F.desc("back")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + len(template.begin.encode()) + F.octet_length("head")
    turns = turns.select(
        "leaf", "tree", "node", "rank",
        F.struct(
            (-F.col("back")).alias("place"), F.concat("head", "body", F.lit(template.end)).alias("turn"),
            start.cast("long").alias("start"), F.octet_length("body").cast("long").alias("size"), "learn",
        ).alias("part"),
    )
    grouped = turns.groupBy("leaf", "tree", "node", "rank").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return grouped.select(
        "tree", F.col("node").alias("leaf"), "rank", F.size("parts").cast("long").alias("n_turns"),
        F.concat(F.lit(template.begin), F.array_join("parts.turn", "")).alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["learn"]), lambda p: F.struct(p["start"].alias("start"), p["size"].alias("size"))).alias("loss"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The (role, text) of every turn of a formatted text, as they were before they were escaped."""
    pieces = F.split(formatted, re.escape(template.end))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # nothing follows the last mark

    def turn(piece):
        role = F.substring_index(F.substring_index(piece, template.text, 1), template.turn, -1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring_index(piece, template.text, -1)).alias("text"))

    return F.transform(pieces, turn)


def digest(formatted: DataFrame, tree: str = "conv_id", template: Template = Template()) -> DataFrame:
    """(tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, formatted_bytes), read from texts and ranges."""
    read = formatted.select(
        F.col("tree").alias(tree), read_turns(F.col("formatted"), template).alias("turns"),
        F.encode("formatted", "utf-8").alias("bytes"), "formatted", "loss",
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    cut = F.transform("loss", lambda s: F.decode(F.substr(F.col("bytes"), (s["start"] + 1).cast("int"), s["size"].cast("int")), "utf-8"))
    read = read.select(
        tree, F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        unescape(F.array_join(cut, "")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.octet_length("bytes").cast("long").alias("formatted_bytes"),
    )
    return read.select(
        tree, "n_turns", "turns_sha256", F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "formatted_bytes",
    )
