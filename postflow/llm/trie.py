"""The prefix trie of conversations, from sorted neighbours' common prefixes (operator 12).

A turn is a code of 20 bytes, a 128-bit digest and its number of characters, and a conversation is the
string of its turns' codes.  Equal conversations are counted together; the distinct ones are sorted by ranges.  In
blocks of sorted neighbours, two that follow each other are joined by an edge as deep as their common
prefix, and a union-find takes the edges in descending depth: a merge of two components makes the branching
node of that depth, or widens the one that is there.  Between a node and the one above lie the turns that
all its members share.

A node whose members reach over the end of a block is a prefix of the block's first or last conversation.
Of those a block tells only sums that add up over blocks: what is below a prefix that continues one of the block
before is counted there.  These spines are merged by one aggregation over (depth, prefix); all other nodes are
settled within their block, but for the name of a parent on a spine, which is joined to them.
"""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postflow.session import materialise

#: Bytes of a turn's code: a digest, and the number of characters of its text.
WIDTH = 20
#: Conversations of a block, and bytes of their codes; a longer conversation is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 20_000, 8 << 20

_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_code(role: Column, text: Column) -> Column:
    """The code of a turn as 40 hexadecimal digits; a null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.md5(whole.cast("binary")), F.lpad(F.hex(F.length(text)), 8, "0"))


class Forest(NamedTuple):
    """The nodes of a block; ``up`` is the node above a node, -1 for the last."""

    depth: np.ndarray
    low: np.ndarray
    high: np.ndarray
    up: np.ndarray
    own: np.ndarray  # the conversation that ends in the node, or -1


def merged(lengths: np.ndarray, common: np.ndarray) -> Forest:
    """Union-find over the edges (i, i + 1) of depth ``common[i]`` in descending depth."""
    n = len(lengths)
    depth, low, high, own = lengths.tolist(), list(range(n)), list(range(n)), list(range(n))
    up, root, top = [-1] * n, list(range(n)), list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.argsort(-common, kind="stable").tolist():
        left, right, level = find(i), find(i + 1), int(common[i])
        a, b = top[left], top[right]
        if depth[a] != level:  # a new branching node; else that of an earlier edge or a shorter conversation
            node = len(depth)
            depth.append(level)
            low.append(low[a])
            high.append(high[a])
            own.append(-1)
            up.append(-1)
            up[a] = node
            a = node
        # Of equal depth is only the left one: sorted strings come after their prefixes, and edges go from left to right.
        up[b] = a
        high[a] = high[b]
        if high[left] - low[left] < high[right] - low[right]:
            left, right = right, left
        root[right] = left
        top[left] = a
    return Forest(*[np.array(x, np.int64) for x in (depth, low, high, up, own)])


def _common(a: bytes, b: bytes) -> int:
    """Turns of the common prefix of two strings of codes."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(s, np.uint8, n).reshape(-1, WIDTH) for s in (a, b))
    differs = (x != y).any(axis=1)
    return int(differs.argmax()) if differs.any() else n // WIDTH


def _prefixes(code: bytes, most: int) -> list[bytes]:
    """A digest of each prefix of 0 to ``most`` turns."""
    out = [hashlib.md5(b"").digest()]
    for d in range(most):
        out.append(hashlib.md5(out[-1] + code[WIDTH * d : WIDTH * (d + 1)]).digest())
    return out


_NODES = (
    "open boolean, block long, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, weight long, once long, ends_sha256 string"
)


def _block(number: int, codes: list[bytes], copies, least, ends, before: bytes | None, after: bytes | None) -> pa.Table:
    """The nodes of a block of sorted distinct conversations between those ``before`` and ``after`` it."""
    n = len(codes)
    lengths = np.array([len(c) // WIDTH for c in codes], np.int64)
    common = np.array([_common(a, b) for a, b in zip(codes, codes[1:])], np.int64)
    left = _common(before, codes[0]) if before is not None else -1
    right = _common(codes[-1], after) if after is not None else -1
    forest = merged(lengths, common)
    m = len(forest.depth)
    # ends[k] - ends[j] is the number of characters of the turns j + 1 to k of a conversation.
    chars = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, WIDTH)[:, 16:].copy().view(">u4").ravel().astype(np.int64)
    base = np.concatenate([[0], np.cumsum(lengths + 1)])
    flat = np.zeros(base[-1], np.int64)
    flat[np.arange(len(chars)) + np.repeat(np.arange(1, n + 1), lengths)] = chars
    total = np.cumsum(flat)
    # A conversation is a leaf if the next one doesn't continue it.
    leaf = np.append(common, right) < lengths
    count = np.concatenate([np.asarray(copies, np.int64), np.zeros(m - n, np.int64)])
    leaves = np.concatenate([leaf.astype(np.int64), np.zeros(m - n, np.int64)])
    name = np.concatenate([np.asarray(least, np.int64), np.full(m - n, np.iinfo(np.int64).max)])
    weight, once, children = (np.zeros(m, np.int64) for _ in range(3))
    at, first = base[forest.low], forest.low == 0
    seen = np.where(first, np.minimum(max(left, 0), forest.depth), 0)  # turns that the block before counts
    top = np.where(forest.up >= 0, forest.depth[forest.up], -1)
    for v in np.lexsort((-forest.depth,)).tolist():  # children come before parents
        p = forest.up[v]
        if p < 0:
            continue
        e, l, b = forest.depth[v], top[v], at[v]
        count[p] += count[v]
        leaves[p] += leaves[v]
        name[p] = min(name[p], name[v])
        weight[p] += weight[v] + count[v] * (total[b + e] - total[b + l])
        once[p] += once[v] + total[b + e] - total[b + max(l, seen[v])]
        children[p] += not (first[v] and l + 1 <= left)
    # Every node stands for all depths from the one below its parent to its own.
    node = np.repeat(np.arange(m), forest.depth - top)
    d = np.arange(len(node)) - np.repeat(np.cumsum(forest.depth - top) - (forest.depth - top), forest.depth - top) + top[node] + 1
    e, b = forest.depth[node], at[node]
    above = np.maximum(d - 1, 0)
    last = d == e
    on_left, on_right = first[node] & (d <= left), (forest.high[node] == n - 1) & (d <= right)
    open_ = on_left | on_right
    parent = d - 1
    up = forest.up[node]
    inner = d > top[node] + 1  # the parent is the same node, a turn less deep
    parent_name = np.where(inner, name[node], name[np.maximum(up, 0)])
    parent_low, parent_high = np.where(inner, forest.low[node], forest.low[np.maximum(up, 0)]), np.where(inner, forest.high[node], forest.high[np.maximum(up, 0)])
    parent_left, parent_right = (parent_low == 0) & (parent <= left), (parent_high == n - 1) & (parent <= right)
    parent_open = (d > 0) & (parent_left | parent_right)
    front, back = _prefixes(codes[0], max(left, 0)), _prefixes(codes[-1], max(right, 0))

    def keys(which, depths, of_left):
        return [(front if l else back)[k] if w else None for w, k, l in zip(which.tolist(), depths.tolist(), of_left.tolist())]

    own = forest.own[node]
    ended = [ends[o] if k and o >= 0 else None for o, k in zip(own.tolist(), last.tolist())]
    known = (d > 0) & ~parent_open
    columns = {
        "open": pa.array(open_),
        "block": pa.array(np.full(len(node), number)),
        "key": pa.array(keys(open_, d, on_left), pa.binary()),
        "parent_key": pa.array(keys(parent_open, parent, parent_left), pa.binary()),
        "depth": pa.array(d),
        "conv_id": pa.array(name[node]),
        "parent_conv_id": pa.array(parent_name, mask=~known),
        "n_convs": pa.array(count[node]),
        "n_children": pa.array(np.where(last, children[node], ~(first[node] & (d + 1 <= left)))),
        "n_leaves": pa.array(leaves[node]),
        "weight": pa.array(weight[node] + count[node] * (total[b + e] - total[b + above])),
        "once": pa.array(once[node] + total[b + e] - total[b + np.maximum(above, seen[node])]),
        "ends_sha256": pa.array(ended, pa.string()),
    }
    return pa.table(columns)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sorted rows (part, kind, code, copies, least, ends) into blocks; kinds 0 and 2 stand in the parts beside."""
    rows = (row for batch in batches for row in zip(*[batch.column(k).to_pylist() for k in range(6)]))
    part, before, held, size, number = None, None, [], 0, 0

    def flush(after):
        block = part * (1 << 32) + number
        codes, copies, least, ends = (list(x) for x in zip(*held))
        return _block(block, codes, copies, least, ends, before, after).to_batches(max_chunksize=20_000)

    for own, kind, code, copies, least, ends in rows:
        if held and (own != part or kind == 2 or len(held) >= BLOCK_ROWS or size + len(code) > BLOCK_BYTES):
            yield from flush(code if own == part else None)
            before, held, size, number = held[-1][0], [], 0, number + 1
        if own != part:
            part, before, held, size, number = own, None, [], 0, 0
        if kind == 0:
            before = code
        elif kind == 1:
            held.append((code, copies, least, ends))
            size += len(code)
    if held:
        yield from flush(None)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code_id, ends): the digest of the ids of each conversation; rows come sorted by both."""
    now, digest, out = None, None, []

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])], ["code_id", "ends"])

    for part in batches:
        for code, member in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if code == now:
                digest.update(b",%d" % member)
                continue
            if now is not None:
                out.append((now, digest.hexdigest()))
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            now, digest = code, hashlib.sha256(b"%d" % member)
    if now is not None:
        out.append((now, digest.hexdigest()))
    if out:
        yield batch(out)


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the members' turns: (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256).

    ``turns`` holds (conv_id, place, code), the code as of ``turn_code``, and ``members`` the conv_id of every
    conversation, those without turns too.  A prefix is named by its smallest member and its depth, and its parent by
    the parent's smallest member; the empty prefix has depth 0 and no parent.  ``saved_tokens`` sums over the subtree the
    characters of a prefix's last text, times its members but one.  ``ends_sha256`` is a digest of the members
    that end there.  A null conv_id is no conversation; turns of equal place are ordered by code; without
    members the result is empty.  One conversation's codes, 20 bytes a turn, have to fit into one row.
    """
    placed = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("turns"))
    ids = members.filter("conv_id is not null").select("conv_id").distinct()
    whole = F.unhex(F.array_join(F.coalesce("turns.code", F.array().cast("array<string>")), ""))
    rows = ids.join(placed, "conv_id", "left").select("conv_id", whole.alias("code"))
    rows = materialise(rows.withColumn("code_id", F.unhex(F.md5("code"))), "conversations")
    distinct = rows.groupBy("code", "code_id").agg(F.count(F.lit(1)).alias("copies"), F.min("conv_id").alias("least"))
    ends = rows.select("code_id", "conv_id").repartition("code_id").sortWithinPartitions("code_id", "conv_id").mapInArrow(
        _ends, "code_id binary, ends string"
    )
    ordered = distinct.join(ends, "code_id").repartitionByRange("code")
    ordered = materialise(ordered.select(F.spark_partition_id().alias("part"), "code", "copies", "least", "ends"), "ranges")
    # Every part is told the conversations beside it; there are as many rows as parts.
    beside = Window.orderBy("part")
    around = ordered.groupBy("part").agg(F.min("code").alias("first"), F.max("code").alias("last")).select(
        "part", F.lag("last").over(beside).alias("before"), F.lead("first").over(beside).alias("after")
    )
    none = F.lit(None)
    other = around.select("part", F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("before").alias("code")), F.struct(F.lit(2).alias("kind"), F.col("after").alias("code")))))
    other = other.filter("code is not null").select(
        "part", "kind", "code", none.cast("long").alias("copies"), none.cast("long").alias("least"), none.cast("string").alias("ends")
    )
    known = ordered.select("part", F.lit(1).alias("kind"), "code", "copies", "least", "ends")
    nodes = (
        known.unionByName(other).repartition("part").sortWithinPartitions("part", "kind", "code").mapInArrow(_forests, _NODES)
    )
    nodes = materialise(nodes, "nodes")
    spines = nodes.filter("open").groupBy("depth", "key", "parent_key").agg(
        F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weight", "once")],
    )
    spines = materialise(spines, "spines")
    names = spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "weight", "once", "ends_sha256"]
    closed = nodes.filter("not open")
    settled = closed.filter("parent_key is null").select(*out)
    # Of a hot prefix every block names its own copy, so its children are joined block by block.
    local = nodes.filter("open").select("block", F.col("key").alias("parent_key")).join(names, "parent_key")
    hanging = closed.filter("parent_key is not null").drop("parent_conv_id").join(local, ["block", "parent_key"]).select(*out)
    merged_spines = spines.join(names, "parent_key", "left").select(*out)
    found = settled.unionByName(hanging).unionByName(merged_spines)
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("weight") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
