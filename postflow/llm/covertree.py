"""Embedding near-duplicates: all pairs of cosine 0.9 or more, by dual traversal of cover trees (operator 6).

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c).  The vectors are dealt to
cells, the leaves of a cover tree over a bounded sample; a cell's covering radius is taken over all its
members.  Two cells can hold a pair only if their centres are no further apart than both radii and that
distance, so the other pairs of cells are never made.  A cell with many members is dealt into blocks by a
hash, and each pair of blocks is one task's work: a cover tree is built over each, nested levels whose
radius halves, and both are walked together, pruning pairs of nodes by the same bound.  Where halving the radius
would take very many children, as among vectors that are all far from each other, a node stays undivided; two
undivided nodes are compared by a product of matrices.  Nothing is approximate: sample, cells, blocks and nodes
change the work, never the pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.llm.components import components, forest
from postflow.session import materialise

#: Vectors of the sample that cells are made from, cells at most, and members of a block.
SAMPLE = 8192
MOST_CELLS = 512
BLOCK = 8192
#: Nodes of so few points, and those that would have so many children, are not divided.
LEAF = 256
MOST_PARTS = 64
#: Rows of a product of matrices.
_ROWS = 1024
_SLACK = 1e-9


class Node:
    """Points ``rows`` within ``radius`` of the point ``center``; ``parts`` are its children, points if it is a leaf."""

    __slots__ = ("center", "centers", "parts", "radii", "radius", "rows")

    def __init__(self, center, radius, rows):
        self.center, self.radius, self.rows = center, radius, rows
        self.parts = self.centers = self.radii = None


def _distance(points, center):
    return np.sqrt(np.maximum(0, ((points - center) ** 2).sum(axis=1)))


def build(points: np.ndarray) -> Node:
    """The cover tree of the rows of ``points``.

    A node of radius r is covered by children of radius r / 2 at most; its own centre is the first child's.
    """
    rows = np.arange(len(points))
    root = Node(0, float(_distance(points, points[0]).max()), rows)
    open_ = [root]
    while open_:
        node = open_.pop()
        if len(node.rows) <= LEAF or node.radius <= _SLACK:
            continue
        left = node.rows
        center, parts = node.center, []
        while len(left) and len(parts) < MOST_PARTS:
            away = _distance(points[left], points[center])
            near = away <= node.radius / 2
            parts.append(Node(center, float(away[near].max(initial=0)), left[near]))
            left = left[~near]
            if len(left):
                center = int(left[0])
        if len(left):
            continue
        node.parts = parts
        node.centers = np.array([p.center for p in parts])
        node.radii = np.array([p.radius for p in parts])
        open_ += parts
    return root


def close_pairs(a: np.ndarray, b: np.ndarray, cosine: float):
    """Yields (i, j): rows of unit vectors ``a`` and ``b`` whose cosine is at least ``cosine``."""
    if not len(a) or not len(b):
        return
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    open_ = [(build(a), build(b))]
    while open_:
        x, y = open_.pop()
        if not x.parts and not y.parts:
            for at in range(0, len(x.rows), _ROWS):
                rows = x.rows[at : at + _ROWS]
                i, j = np.nonzero(a[rows] @ b[y.rows].T >= cosine)
                yield rows[i], y.rows[j]
            continue
        left, p, own = (x.parts, x.centers, x.radii) if x.parts else ([x], np.array([x.center]), np.array([x.radius]))
        right, q, other = (y.parts, y.centers, y.radii) if y.parts else ([y], np.array([y.center]), np.array([y.radius]))
        away = np.sqrt(np.maximum(0, 2 - 2 * (a[p] @ b[q].T)))
        near = away <= own[:, None] + other[None, :] + reach
        open_ += [(left[i], right[j]) for i, j in zip(*np.nonzero(near))]


def _cells(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Centres of about ``wanted`` cells: the nodes that come first when the largest are divided first."""
    if not len(sample):
        return sample
    found = [build(sample)]
    while len(found) < wanted:
        k = max(range(len(found)), key=lambda i: len(found[i].rows) if found[i].parts else 0)
        if not found[k].parts or len(found) + len(found[k].parts) > 4 * wanted:
            break
        found += found.pop(k).parts
    return sample[[n.center for n in found]]


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    points = flat.reshape(len(column), -1)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _links(cosine: float):
    """The links within a pair of blocks: per vector its number of linked vectors, and joining edges."""

    def pair(table):
        points = _unit(table.column("embedding").combine_chunks())
        ids = table.column("rep").to_numpy()
        copies = table.column("copies").to_numpy()
        side = table.column("side").to_numpy()
        same = (side == 2).all()
        a = np.flatnonzero(side != 1)
        b = a if same else np.flatnonzero(side == 1)
        links = np.zeros(len(ids), np.int64)
        label_left, label_right = [], []
        for i, j in close_pairs(points[a], points[b], cosine):
            i, j = a[i], b[j]
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label_left.append(i)
            label_right.append(j)
        if not label_left:
            label_left = label_right = [np.zeros(0, np.int64)]
        order = np.argsort(ids, kind="stable")  # roots are smallest ids
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        own, root = forest(place[np.concatenate(label_left)], place[np.concatenate(label_right)], len(ids))
        joined = np.full(len(ids), -1, np.int64)
        joined[order[own]] = order[root]
        kept = np.flatnonzero(links > 0)
        to = np.where(joined[kept] >= 0, ids[joined[kept]], ids[kept])
        return pa.table({"rep": pa.array(ids[kept]), "links": pa.array(links[kept]), "root": pa.array(to)})

    return pair


def near_vectors(vectors: DataFrame, vec_id="vec_id", embedding="embedding", cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    A vector that is null, empty, zero or holds a null or non-finite number links with nothing and is
    its own component; so does one whose size differs from the other's.  Equal vectors are compared once
    and count as linked with each other.  Rows that repeat an id are vectors of their own; a null id
    stays null, and its component is the smallest other id if there is one.
    """
    rows = vectors.select(
        vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast("array<double>").alias("embedding")
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("embedding", F.when(good, F.col("embedding")))
    reps = rows.filter("embedding is not null").groupBy("embedding").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    # Rows that repeat an id or have none may hold other vectors: the number of the vector, ``rep``, keeps them apart.
    reps = materialise(reps.withColumn("size", F.size("embedding")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    found = None
    for size in sorted(r["size"] for r in reps.select("size").distinct().collect()):
        part = _linked(reps.filter(F.col("size") == size), cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found, "links")
    joined = components(found.filter("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    joined = joined.withColumnRenamed("id", "rep")
    named = joined.join(reps.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("name"))
    joined = joined.join(named, "component").select("rep", "name")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        reps.select("embedding", "rep", "least", "copies")
        .join(counts, "rep", "left")
        .join(joined, "rep", "left")
        .select("embedding", F.coalesce("links", F.lit(0)).alias("links"), "copies", F.coalesce("name", "least").alias("component"))
    )
    out = rows.join(known, "embedding", "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        "vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _linked(reps: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, root) of the linked ones of distinct vectors of one size; several rows per vector."""
    spark = reps.sparkSession
    total = reps.count()
    share = min(1.0, SAMPLE / max(1, total))
    # The sample is bounded by its share of the rows, the cells by MOST_CELLS.
    sample = reps.filter(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding")
    sample = sample.orderBy("embedding").limit(2 * SAMPLE).toArrow().column("embedding").combine_chunks()
    points = _unit(sample) if len(sample) else np.zeros((0, 1))
    centers = _cells(points, min(MOST_CELLS, max(1, total // BLOCK + 1)))

    def deal(batches):
        for batch in batches:
            own = _unit(batch.column(0))
            if len(centers):
                dot = own @ centers.T
                cell = dot.argmax(axis=1)
                away = np.sqrt(np.maximum(0, ((own - centers[cell]) ** 2).sum(axis=1)))
            else:
                cell, away = np.zeros(len(own), np.int64), np.full(len(own), 2.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(away)], ["embedding", "rep", "copies", "cell", "away"])

    dealt = materialise(
        reps.select("embedding", "rep", "copies").mapInArrow(deal, "embedding array<double>, rep long, copies long, cell long, away double"),
        "cells",
    )
    stats = {r["cell"]: (r["radius"], r["n"]) for r in dealt.groupBy("cell").agg(F.max("away").alias("radius"), F.count("cell").alias("n")).collect()}
    cells = sorted(stats)
    blocks = {c: -(-stats[c][1] // BLOCK) for c in cells}
    near = [(x, y, blocks[x], blocks[y]) for x, y in _near_cells(centers, {c: stats[c][0] for c in cells}, cosine)]
    pairs = spark.createDataFrame(near, "x long, y long, x_blocks int, y_blocks int")
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1)))
    pairs = pairs.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("y_blocks") - 1)))
    pairs = pairs.filter("x != y or i <= j")

    def side(cell, block, number):
        return F.struct(F.col(cell).alias("cell"), F.col(block).cast("long").alias("block"), F.lit(number).alias("side"))

    alone = F.array(side("x", "i", 2))
    both = F.array(side("x", "i", 0), side("y", "j", 1))
    places = pairs.select(
        "x", "y", "i", "j", F.inline(F.when(F.expr("x = y and i = j"), alone).otherwise(both))
    )
    many = F.create_map(*[F.lit(v) for c in cells for v in (c, blocks[c])])
    blocked = dealt.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), many[F.col("cell")].cast("long")))
    return (
        blocked.join(places, ["cell", "block"]).select("x", "y", "i", "j", "embedding", "rep", "copies", "side")
        .groupBy("x", "y", "i", "j").applyInArrow(_links(cosine), "rep long, links long, root long")
    )


def _near_cells(centers: np.ndarray, radius: dict[int, float], cosine: float) -> list[tuple[int, int]]:
    """The pairs x <= y of cells that can hold a link, by their covering radii."""
    cells = np.array(sorted(radius))
    if not len(centers):
        return [(int(c), int(c)) for c in cells]
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    radii = np.array([radius[c] for c in cells.tolist()])
    out = []
    for k, c in enumerate(cells.tolist()):
        away = _distance(centers[cells[k:]], centers[c])
        out += [(c, int(d)) for d in cells[k:][away <= radii[k] + radii[k:] + reach]]
    return out
