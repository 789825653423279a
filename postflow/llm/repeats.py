"""Which windows of fixed length occur more than once: what both substring deduplicators share.

A text is a sequence of symbols (words or bytes) and a window is ``window`` of them.  No row per window
is ever made.  Every window has an anchor, the place of the least hash among its ``gram``-symbol pieces,
the leftmost if several; equal windows have their anchors at the same distance.  Neighbouring windows
that share an anchor form a run, whose whole content is hashed, and one row per run is shuffled by the
anchor's hash:

1. runs of equal content are equal as a whole; a task keeps one of each content and settles the
   others itself, so copies are pre-aggregated and a common run is one row per task and content;
2. a content that is alone with its anchor has no equal window anywhere and is dropped;
3. different contents around one anchor can share some of their windows.  Only these are fetched as
   text and compared exactly, by the method of the calling module.

Anchors with very many contents, such as a line that many documents share, are found in a sample of
documents beforehand and their windows become runs of their own, keyed by the whole window.  So they
are dealt over many tasks and meet only if they are equal.  The sample changes where rows go, never
the result.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postflow.llm import text as tx
from postflow.session import materialise

#: One document in so many is looked at for anchors with many contents.
SAMPLE = 64
#: Contents in the sample that make an anchor hot, and how many hot anchors are told to all tasks.
HOT_CONTENTS = 32
MOST_HOT = 100_000
#: Bytes of text whose runs a task settles together, and that are hashed at once.
SETTLE_BYTES = 24 << 20
#: Bytes of fetched text that are compared at once; a group of one anchor is never cut.
SOLVE_BYTES = 4 << 20


class Kind(NamedTuple):
    """What a symbol is and how texts are compared."""

    window: int
    gram: int  # a power of two
    slice_bytes: int
    #: texts -> (offsets, a 64-bit hash of each symbol)
    symbols: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    #: one text -> function of (start, end) in symbols that gives those symbols as bytes
    cutter: Callable[[str], Callable[[int, int], bytes]]
    #: True: a window counts if an equal one starts earlier; False: if an equal one starts elsewhere.
    earlier: bool
    #: (keys, chunks, leads, counts, again) -> for each chunk, which of its windows count
    solve: Callable


class Runs(NamedTuple):
    """Runs of windows: hash of anchor and of content, row of the text, first window, number, lead."""

    anchor: np.ndarray
    content: np.ndarray
    row: np.ndarray
    low: np.ndarray
    count: np.ndarray
    lead: np.ndarray


def runs(offsets: np.ndarray, symbols: np.ndarray, window: int, gram: int, hot: np.ndarray | None = None) -> Runs:
    """The runs of all windows that lie within one text; those of ``hot`` anchors are single windows."""
    n = len(symbols)
    starts = n - window + 1
    empty = np.zeros(0, np.int64)
    if starts <= 0:
        return Runs(empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty)
    grams, size = symbols, 1
    pieces = None
    while 2 * size <= window:
        if size == gram:
            pieces = grams
        grams = tx.paired(grams[:-size], grams[size:])
        size *= 2
    pieces = grams if pieces is None else pieces
    whole = grams[:starts] if size == window else tx.paired(grams[:starts], grams[window - size : window - size + starts])
    del grams
    bits = np.uint64(max(1, n.bit_length()))
    least = (pieces >> bits << bits) | np.arange(len(pieces), dtype=np.uint64)
    width, done = window - gram + 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    least = (least[:starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)  # windows that would run over the end of their text
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - window + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    at = np.flatnonzero(np.cumsum(edge[:starts]) == 0)
    if not len(at):
        return Runs(empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty)
    own = least[at]
    begin = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(at)) - 1
    if hot is not None and len(hot):
        place = np.searchsorted(hot, pieces[own[first]])
        is_hot = hot[np.minimum(place, len(hot) - 1)] == pieces[own[first]]
        if is_hot.any():
            single = np.repeat(is_hot, last - first + 1)
            first = np.flatnonzero(begin | single)
            last = np.append(first[1:], len(at)) - 1
            is_hot = single[first]
    else:
        is_hot = np.zeros(len(first), bool)
    low, high, anchor = at[first], at[last], own[first]
    key = pieces[anchor]
    shape = ((high - low) * 4096 + (anchor - low)).astype(np.uint64)
    content = tx.paired(tx.paired(whole[low], whole[high]), shape)
    key = np.where(is_hot, whole[low], key)
    row = np.searchsorted(offsets, low, side="right") - 1
    return Runs(key, content, row, low - offsets[row], high - low + 1, anchor - low)


def _packed(low, count, lead):
    return (low << 22) | (count << 11) | lead


def _unpacked(spot):
    return spot >> 22, (spot >> 11) & 2047, spot & 2047


def _joined(ids, low, count):
    """Windows [low, low + count) of each id as maximal ranges; ordered by id."""
    order = np.lexsort((low, ids))
    ids, low, high = ids[order], low[order], (low + count)[order]
    # The furthest end so far within an id: ends are made to grow from id to id.
    new_id = np.concatenate([[True], ids[1:] != ids[:-1]])
    base = np.cumsum(new_id) * (int(high.max()) + 1)
    furthest = np.maximum.accumulate(high + base) - base
    begin = np.flatnonzero(new_id | np.concatenate([[True], low[1:] > furthest[:-1]]))
    end = np.append(begin[1:], len(ids)) - 1
    return ids[begin], low[begin], furthest[end] - low[begin]


def _ranked(ids, marks):
    """(place, ids, marks): the distinct pairs in order, and for each given pair its place among them."""
    order = np.lexsort((marks, ids))
    ids, marks = ids[order], marks[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, ids[new], marks[new]


def _settled(ids, found: Runs, earlier: bool):
    """(rows to shuffle, ranges already known to count) of the runs of one task's texts."""
    order = np.lexsort((found.low, ids, found.content))
    content, ids, low = found.content[order], ids[order], found.low[order]
    anchor, count, lead = found.anchor[order], found.count[order], found.lead[order]
    new = np.concatenate([[True], content[1:] != content[:-1]])
    # Rows that repeat a document id repeat its places, which are one place each.
    place = new | np.concatenate([[True], (ids[1:] != ids[:-1]) | (low[1:] != low[:-1])])
    group = np.cumsum(new) - 1
    again = np.bincount(group[place]) > 1
    if earlier:
        counts = place & ~new
        head = new
        flag = np.zeros(int(new.sum()), bool)
    else:
        counts = place & again[group]
        head = new
        flag = again
    known = _joined(ids[counts], low[counts], count[counts]) if counts.any() else (ids[:0], low[:0], low[:0])
    return (anchor[head], content[head], ids[head], _packed(low[head], count[head], lead[head]), flag), known


def _spots(kind: Kind, hot: np.ndarray):
    """The rows of a task: (anchor, content, id, spot, state); state 2 is a known range, of ``content`` windows."""

    def emit(held):
        ids, marks = (np.concatenate([h[0][k] for h in held]) for k in range(2))
        found = Runs(*[np.concatenate([h[1][k] for h in held]) for k in range(6)])
        held.clear()
        if not len(ids):
            return
        place, ids, marks = _ranked(ids, marks)
        (anchor, content, own, spot, flag), (kid, klow, kcount) = _settled(place, found, kind.earlier)
        del place, found
        tx.give_back()
        anchor = np.concatenate([anchor.view(np.int64), tx.mixed(ids[kid].view(np.uint64)).view(np.int64)])
        content = np.concatenate([content.view(np.int64), kcount])
        own, spot = np.concatenate([own, kid]), np.concatenate([spot, _packed(klow, 0, 0)])
        state = np.concatenate([flag.astype(np.int8), np.full(len(kid), 2, np.int8)])
        for at in range(0, len(own), 50_000):
            cut = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[cut]), pa.array(content[cut]), pa.array(ids[own[cut]]), pa.array(marks[own[cut]]), pa.array(spot[cut]),
                 pa.array(state[cut])],
                ["anchor", "content", "id", "mark", "spot", "state"],
            )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in tx.slices(batches, "text", kind.slice_bytes):
            offsets, symbols = kind.symbols(tx.column(part, "text"))
            found = runs(offsets, symbols, kind.window, kind.gram, hot)
            held.append(([tx.column(part, c).to_numpy()[found.row] for c in ("id", "mark")], found))
            size += part.nbytes
            if size >= SETTLE_BYTES:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    return rows


_SPOTS = "anchor long, content long, id long, mark long, spot long, state byte"


def _hot_anchors(docs: DataFrame, kind: Kind) -> np.ndarray:
    sample = docs.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    found = (
        sample.mapInArrow(_spots(kind, np.zeros(0, np.uint64)), _SPOTS).filter("state < 2")
        .groupBy("anchor").agg(F.approx_count_distinct("content").alias("contents"))
        .filter(F.col("contents") >= HOT_CONTENTS).orderBy(F.desc("contents"), "anchor").limit(MOST_HOT)
    )
    return np.sort(np.array([r["anchor"] for r in found.select("anchor").collect()], np.int64).view(np.uint64))


def _fetch(kind: Kind):
    """Cuts the chunks of a document's runs out of its text."""

    def rows(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                out = []
                part = batch.slice(at, 500)
                for own, mark, text, wanted in zip(*(part.column(k).to_pylist() for k in range(4))):
                    cut = kind.cutter(text or "")
                    for w in wanted:
                        low, count, _ = _unpacked(w["spot"])
                        out.append((w["anchor"], own, mark, w["spot"], w["state"], cut(low, low + count + kind.window - 1)))
                if out:
                    names = ["anchor", "id", "mark", "spot", "state", "chunk"]
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows


def _compared(kind: Kind):
    """Compares the chunks of each anchor; rows come sorted by anchor, id, mark and spot."""

    def solved(table):
        low, count, lead = _unpacked(tx.column(table, "spot").to_numpy())
        counts = kind.solve(
            tx.column(table, "anchor").to_numpy(), tx.column(table, "chunk").to_pylist(), lead, count,
            tx.column(table, "state").to_numpy() > 0,
        )
        row, place = np.nonzero(counts)
        if len(row):
            own, ids, marks = _ranked(*(tx.column(table, c).to_numpy()[row] for c in ("id", "mark")))
            own, low, count = _joined(own, low[row] + place, np.ones(len(row), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[own], marks[own], low, count)], ["id", "mark", "low", "count"])

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            if held and size >= SOLVE_BYTES:
                last = held[-1].column(0)[len(held[-1]) - 1].as_py()
                end = int(np.searchsorted(keys != last, True)) if keys[0] == last else 0
                if end < len(batch):
                    if end:
                        held.append(batch.slice(0, end))
                    yield from solved(pa.Table.from_batches(held).combine_chunks())
                    held, size = [], 0
                    batch = batch.slice(end)
            if len(batch):
                held.append(batch)
                size += batch.nbytes
        if held:
            yield from solved(pa.Table.from_batches(held).combine_chunks())

    return rows


def repeated_windows(docs: DataFrame, kind: Kind) -> DataFrame:
    """(id, mark, low, count): ranges of windows that count, by their first symbol; ranges may overlap.

    ``docs`` has (id, mark, text) with a long id that is not null and a hash of the text.  Rows that repeat an id and a text
    count as one text; other texts of an id are texts of their own, in the order of their marks.
    """
    hot = _hot_anchors(docs, kind)
    spots = docs.mapInArrow(_spots(kind, hot), _SPOTS)
    equal = Window.partitionBy("anchor", "content")
    ordered = equal.orderBy("id", "mark", "spot")
    around = Window.partitionBy("anchor")
    run = F.col("state") < 2
    other = F.when(run, F.col("content"))
    marked = spots.repartition("anchor").select(
        "*",
        F.rank().over(ordered).alias("rank"),
        *([] if kind.earlier else [
            (F.max("state").over(equal).cast("int") == 1).alias("flagged"),
            (F.min(F.struct("id", "mark", "spot")).over(equal) != F.max(F.struct("id", "mark", "spot")).over(equal)).alias("apart"),
        ]),
    )
    if kind.earlier:
        counts, again = F.col("rank") > 1, F.lit(False)
    else:
        counts = again = F.col("flagged") | F.col("apart")
    marked = marked.select(
        "anchor", "id", "mark", "spot", "state",
        F.when(run, (F.col("spot").bitwiseAND(F.lit(2047 << 11))) / (1 << 11)).otherwise(F.col("content")).cast("long").alias("count"),
        (~run | counts).alias("counts"), (run & again).alias("again"),
        (run & (F.col("rank") == 1) & (F.min(other).over(around) != F.max(other).over(around))).alias("shared"),
    )
    # Few rows are left: those that count and those whose anchor has several contents.
    left = materialise(marked.filter("counts or shared"), "repeats")
    known = left.filter("counts").select("id", "mark", F.shiftright("spot", 22).alias("low"), "count")
    wanted = left.filter("shared").groupBy("id", "mark").agg(
        F.collect_set(F.struct("anchor", "spot", F.col("again").cast("byte").alias("state"))).alias("wanted")
    )
    chunks = docs.join(wanted, ["id", "mark"]).select("id", "mark", "text", "wanted").mapInArrow(
        _fetch(kind), "anchor long, id long, mark long, spot long, state byte, chunk binary"
    )
    shared = (
        chunks.repartition("anchor").sortWithinPartitions("anchor", "id", "mark", "spot")
        .mapInArrow(_compared(kind), "id long, mark long, low long, count long")
    )
    return known.unionByName(shared)


def covered(docs: DataFrame, kind: Kind, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, low, count, kept columns): every row with its ranges of windows, lists that may be null.

    A row without an id is neither searched nor cut.  The columns ``keep`` are put into one struct,
    ``rest``, so their names can't clash.
    """
    rest = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(keep)]) if keep else F.lit(None).cast("int")
    mark = F.xxhash64(docs[text]).alias("mark")
    rows = docs.select(docs[doc_id].cast("long").alias("id"), mark, docs[text].alias("text"))
    ranges = repeated_windows(rows.filter("id is not null"), kind).groupBy("id", "mark").agg(
        F.collect_list(F.struct("low", "count")).alias("ranges")
    )
    found = docs.select(docs[doc_id].cast("long").alias("id"), mark, docs[text].alias("text"), rest.alias("rest")) if keep else rows
    return found.join(ranges, ["id", "mark"], "left").select(
        F.col("id").alias("doc_id"), "text", F.col("ranges")["low"].alias("low"), F.col("ranges")["count"].alias("count"),
        *(["rest"] if keep else []),
    )


def inside(n: int, low, count, window: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a window of the ranges."""
    edge = np.zeros(n + 1, np.int32)
    if low:
        low = np.asarray(low)
        np.add.at(edge, np.minimum(low, n), 1)
        np.add.at(edge, np.minimum(low + np.asarray(count) + window - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0
