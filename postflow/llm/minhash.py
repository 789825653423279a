"""Near-duplicate documents by improved consistent weighted sampling (operator 4).

A document is a weighted set of shingles of five words.  A shingle's weight is its count in the document times
its idf, 1 + ln((1 + N) / (1 + df)), where df counts the documents with a shingle of the same feature: as with hashed
term frequencies, shingles are hashed to 2**20 features, so all counts fit one array at any size of the
corpus.  A sample of a set is one shingle with a number of its weight, drawn so that two sets give the same sample with
the probability of their weighted Jaccard similarity (Ioffe 2010).  Shingles are dealt to 16 bins in each of 8
rounds and each bin draws one sample, which makes 128 samples for 8 draws a shingle; an empty bin takes that of the
next full one in an order of its own.  Five samples make a band, and documents that agree in one of 25 bands are
candidates.

Documents that candidates connect form a part, and links never leave a part.  All documents of a part are compared by
their exact weighted Jaccard similarity, as products of matrices inside tasks, which give only the edges that
join the linked ones: so a part of n texts is n rows, however many of its pairs are alike.  A part of more than
a block is compared band by band, and a band of more than a block as pairs of blocks.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.llm import text as tx
from postflow.llm.components import components, forest
from postflow.session import materialise

SHINGLE = 5
SIMILARITY = 0.8
ROUNDS, BINS = 8, 16
BANDS, ROWS = 25, 5
#: Shingles are hashed to so many features, a power of two, by the upper bits of their hash.
FEATURE_BITS = 20
#: Texts and shingles of a block.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Bytes of text that a task works on at once.
SLICE_BYTES = 2 << 20
#: Features of a matrix.
_WIDTH = 2048
#: Features whose counts travel together.
_PIECE = 1 << 14

_LOW = np.uint64(64 - FEATURE_BITS)


def feature(keys: np.ndarray) -> np.ndarray:
    """The feature of each shingle."""
    return (keys >> _LOW).astype(np.int64)


def occurrences(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle, in no order; a text of fewer words than ``size`` is one shingle."""
    found = tx.words(texts, tx.LOWER)
    lengths = np.diff(found.offsets)
    word = tx.hashes(found.terms)[found.codes]
    row = np.repeat(np.arange(len(lengths)), lengths)
    # All runs of ``size`` words, those over the end of a text too, which then drop out.
    at = np.arange(max(0, len(word) - size + 1))
    at = at[row[at] == row[at + size - 1]]
    key = word[at]
    for k in range(1, size):
        key = tx.paired(key, word[at + k])
    row = row[at]
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        first = found.offsets[short]
        whole = word[first]
        for k in range(1, size):
            more = lengths[short] > k
            whole = np.where(more, tx.paired(whole, word[np.minimum(first + k, len(word) - 1)]), whole)
        row, key = np.concatenate([row, short]), np.concatenate([key, whole])
    return row, key


class Shingles(NamedTuple):
    """Distinct shingles of each text, in no order: row, hash, count, weight."""

    row: np.ndarray
    key: np.ndarray
    count: np.ndarray
    weight: np.ndarray


def shingles(texts: pa.Array, idf: np.ndarray, size: int = SHINGLE) -> Shingles:
    """The weighted shingles of every text; ``idf`` has a number for each feature."""
    row, key = occurrences(texts, size)
    order = np.argsort(tx.paired(key, row.astype(np.uint64)), kind="stable")
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(row)))
    row, key = row[new], key[new]
    return Shingles(row, key, count, count * idf[feature(key)].astype(np.float64))


def shingle_idf(docs: DataFrame) -> np.ndarray:
    """The idf of every feature, counted over all texts of ``docs`` (id, text): 2**20 numbers at any size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << FEATURE_BITS, np.int64)
        for part in tx.slices(batches, "text", SLICE_BYTES):
            row, key = occurrences(tx.column(part, "text"))
            pair = np.unique(feature(key) * len(part) + row)
            df += np.bincount(pair // len(part), minlength=len(df))
        yield from pieces(df)

    def pieces(df: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(df), _PIECE):
            if df[at : at + _PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([df[at : at + _PIECE].tobytes()])], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << FEATURE_BITS, np.int64)
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                df[at : at + _PIECE] += np.frombuffer(counts.as_buffer(), np.int64)
        yield from pieces(df)

    schema = "piece long, counts binary"
    counted = docs.select("text").mapInArrow(count, schema).repartition("piece").mapInArrow(add, schema)
    df = np.zeros(1 << FEATURE_BITS, np.int64)
    for row in counted.collect():  # 8 MB at any size
        df[row["piece"] : row["piece"] + _PIECE] = np.frombuffer(row["counts"], np.int64)
    return (1 + np.log((1 + docs.count()) / (1 + df))).astype(np.float32)


def _orders() -> np.ndarray:
    """For each bin the bins in the order in which it looks for a sample."""
    rng = np.random.default_rng(20_101)
    return np.array([[b, *rng.permutation([x for x in range(BINS) if x != b])] for b in range(BINS)])


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from the upper 52 bits."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def samples(found: Shingles, n: int) -> np.ndarray:
    """128 samples of each of ``n`` texts, as 64-bit hashes; a text without shingles has none."""
    out = np.zeros((n, ROUNDS * BINS), np.uint64)
    log_weight, order = np.log(found.weight), _orders()
    rows = np.arange(len(found.key))
    for t in range(ROUNDS):
        x = tx.mixed(found.key + np.uint64((t * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) % 2**64))
        place = found.row * BINS + (x & np.uint64(BINS - 1)).astype(np.int64)
        u = []
        for k in range(5):
            x = tx.mixed(x + np.uint64((k + 1) * 0x2545F4914F6CDD1D % 2**64))
            u.append(_uniform(x))
        r = -np.log(u[0] * u[1])  # Gamma(2, 1)
        log_c = np.log(-np.log(u[2] * u[3]))
        step = np.floor(log_weight / r + u[4])
        log_a = log_c - r * (step - u[4]) - r
        best = np.full(n * BINS, np.inf)
        np.minimum.at(best, place, log_a)
        won = rows[log_a == best[place]]
        drawn = np.zeros(n * BINS, np.uint64)
        drawn[place[won]] = tx.paired(found.key[won], step[won].astype(np.int64).view(np.uint64))
        full = np.isfinite(best).reshape(n, BINS)
        source = order[np.arange(BINS), full[:, order].argmax(axis=2)]
        out[:, t * BINS : (t + 1) * BINS] = np.take_along_axis(drawn.reshape(n, BINS), source, axis=1)
    return out


def bands(drawn: np.ndarray) -> np.ndarray:
    """The band hashes of each text; the samples of a band come from five rounds."""
    chosen = drawn[:, (np.arange(BANDS * ROWS) * 37) % drawn.shape[1]].reshape(-1, BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(drawn), 1))
    for k in range(ROWS):
        out = tx.paired(out, chosen[:, :, k])
    return out


def unrolled(found: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every shingle as often as it occurs: its k-th occurrence has a key of its own, of the same feature."""
    row, key = np.repeat(found.row, found.count), np.repeat(found.key, found.count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(found.count) - found.count, found.count)
    low = np.uint64((1 << (64 - FEATURE_BITS)) - 1)
    later = (key & ~low) | (tx.mixed(key + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & low)
    return row, np.where(nth > 0, later, key)


def similarities(keys: list[np.ndarray], left: np.ndarray, right: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weighted Jaccard similarity of the texts ``left`` and ``right``, places in ``keys``, which are unrolled; that of a
    text with itself means nothing.

    The smaller of two counts is the number of occurrences that both texts have, so sums of
    minima are products of matrices of ones and zeros, weighed by idf.
    """
    n = len(keys)
    flat, doc = np.concatenate(keys), np.repeat(np.arange(n), [len(k) for k in keys])
    weight = idf[feature(flat)].astype(np.float64)
    total = np.bincount(doc, weight, n)
    order = np.argsort(flat, kind="stable")
    flat, doc, weight = flat[order], doc[order], weight[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    group = np.cumsum(new) - 1
    often = np.bincount(group) > 1  # what only one text has is in no sum
    use = often[group]
    column = (np.cumsum(often) - 1)[group[use]]
    doc, weight = doc[use], weight[use]
    common = np.zeros((len(left), len(right)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _WIDTH):
        part = slice(*np.searchsorted(column, [at, at + _WIDTH]))
        ones = np.zeros((n, _WIDTH))
        ones[doc[part], column[part] - at] = 1
        value = np.zeros(_WIDTH)
        value[column[part] - at] = weight[part]
        common += (ones[left] * value) @ ones[right].T
    union = total[left][:, None] + total[right][None, :] - common
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def _sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(id, mark, content, bands, size) of every row: a digest of its words in order, its bands and its shingles; null without words."""

    def sketch(batches):
        for part in tx.slices(batches, "text", SLICE_BYTES):
            texts = tx.column(part, "text")
            found = shingles(texts, idf)
            size = np.bincount(found.row, found.count, len(part)).astype(np.int64)
            hashed = bands(samples(found, len(part))).view(np.int64)
            content = [
                xxhash.xxh3_128_digest(b" ".join(t.encode().translate(tx.LOWER).split())) if k else None
                for t, k in zip(texts.to_pylist(), size)
            ]
            yield pa.RecordBatch.from_arrays(
                [tx.column(part, "id"), tx.column(part, "mark"), pa.array(content, pa.binary()),
                 pa.array([h.tolist() if k else None for h, k in zip(hashed, size)], pa.list_(pa.int64())), pa.array(size)],
                ["id", "mark", "content", "bands", "size"],
            )

    return docs.select("id", "mark", "text").mapInArrow(sketch, "id long, mark long, content binary, bands array<long>, size long")


def _packed(texts: DataFrame) -> DataFrame:
    """(rep, keys): the unrolled shingles of each text."""
    flat = np.ones(1 << FEATURE_BITS, np.float32)

    def pack(batches):
        for part in tx.slices(batches, "text", SLICE_BYTES):
            row, key = unrolled(shingles(tx.column(part, "text"), flat))
            order = np.argsort(row, kind="stable")
            ends = np.cumsum(np.bincount(row, minlength=len(part)))
            cut = np.split(key[order], ends[:-1])
            yield pa.RecordBatch.from_arrays([tx.column(part, "rep"), pa.array([k.tobytes() for k in cut], pa.binary())], ["rep", "keys"])

    return texts.select("rep", "text").mapInArrow(pack, "rep long, keys binary")


def _linked(idf: np.ndarray, least: float):
    """(a, b): edges that join the linked texts of every group of rows (cell, i, j, block, rep, keys); rows come sorted by group."""

    def solve(i, j, rows):
        texts = {rep: (block, keys) for block, rep, keys in rows}  # a row may come twice
        reps = np.array(sorted(texts))
        block = np.array([texts[r][0] for r in reps.tolist()])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return []
        keys = [np.frombuffer(texts[r][1], np.uint64) for r in reps.tolist()]
        a, b = np.nonzero(similarities(keys, left, right, idf) >= least - 1e-9)
        own, root = forest(left[a], right[b], len(reps))
        return list(zip(reps[own].tolist(), reps[root].tolist()))

    def links(batches):
        now, held, out = None, [], []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for cell, i, j, *row in zip(*columns):
                if (cell, i, j) != now:
                    if held:
                        out += solve(now[1], now[2], held)
                    now, held = (cell, i, j), []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out = []
        if held:
            out = solve(now[1], now[2], held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return links


def _blocks(cells: DataFrame) -> DataFrame:
    """(cell, blocks): into how many blocks the texts of each cell are dealt."""
    sizes = cells.groupBy("cell").agg(F.count("rep").alias("n"), F.sum("size").alias("shingles"))
    return sizes.select("cell", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).alias("blocks"))


def _groups(banded: DataFrame) -> DataFrame:
    """(cell, i, j, block, rep): what is compared with what; ``banded`` has (rep, size, band).

    Cells are parts, or the bands of a part that is larger than a block.  Those of one block are
    groups with i = j = 0; the others are groups for each pair of blocks.
    """
    heads = banded.groupBy("band").agg(F.min("rep").alias("head"), F.count("rep").alias("n")).filter("n > 1").select("band", "head")
    shared = materialise(banded.join(heads, "band"), "buckets")
    parts = components(shared.filter("rep != head").select(F.col("rep").alias("a"), F.col("head").alias("b")))
    parts = parts.select(F.col("id").alias("rep"), F.col("component").alias("part"))
    sized = materialise(shared.select("rep", "size").distinct().join(parts, "rep"), "parts")
    blocks = _blocks(sized.withColumnRenamed("part", "cell"))
    large = blocks.filter("blocks > 1").select(F.col("cell").alias("part"))
    whole = sized.join(large, "part", "left_anti").select(F.struct(F.lit(0).alias("kind"), F.col("part").alias("key")).alias("cell"), "rep")
    one = F.lit(1).cast("long").alias("blocks")
    spread = shared.join(sized.join(large, "part").select("rep"), "rep")
    spread = spread.select(F.struct(F.lit(1).alias("kind"), F.col("band").alias("key")).alias("cell"), "rep", "size")
    spread = spread.join(_blocks(spread), "cell").select("cell", "rep", "blocks")
    members = whole.select("cell", "rep", one).unionByName(spread)
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("long")
    members = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return members.select(F.xxhash64("cell").alias("cell"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep")


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_copies, kept, mark) of every row.

    A class holds the documents that links of similarity ``least`` or more join; ``class_id`` is its
    smallest id, and ``kept`` marks that document.  Texts of the same words are copies: ``n_copies``
    counts a text's copies, itself included, and they are compared once.  A null text, or one without a
    word, is a class of its own.  Words are split at ASCII white space, A-Z lower-cased.  Rows that repeat an
    id are documents of their own; ``mark``, the xxhash64 of the text, tells them apart, and of those of a class's
    smallest id the one of the smallest mark is kept, with rows that repeat it wholly.  A row without an
    id is not compared: its class is null and it is kept.
    """
    keyed = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].alias("text"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("mark"))
    idf = shingle_idf(keyed)
    sketched = materialise(_sketches(keyed, idf), "sketches")
    first = F.min(F.struct("id", "mark")).alias("first")
    copies = sketched.filter("content is not null and id is not null").groupBy("content").agg(
        first, F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"), F.first("size").alias("size")
    )
    copies = materialise(copies.withColumn("rep", F.monotonically_increasing_id()), "copies")  # numbers must not change
    banded = copies.select("rep", "size", F.explode(F.array_distinct("bands")).alias("band"))
    groups = materialise(_groups(materialise(banded, "bands")), "groups")
    chosen = copies.join(groups.select("rep").distinct(), "rep").select("first.id", "first.mark", "rep")
    texts = keyed.join(chosen, ["id", "mark"]).groupBy("rep").agg(F.min("text").alias("text"))
    packed = materialise(_packed(texts), "shingles")
    ordered = groups.join(packed, "rep").select("cell", "i", "j", "block", "rep", "keys")
    ordered = ordered.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    links = materialise(ordered.mapInArrow(_linked(idf, least), "a long, b long"), "links")
    joined = components(links).withColumnRenamed("id", "rep")
    classed = copies.join(joined, "rep", "left").select("content", "first", "n_copies", F.coalesce("component", "rep").alias("class"))
    heads = classed.groupBy("class").agg(F.min("first").alias("head"))
    classes = classed.join(heads, "class").select("content", "n_copies", "head")
    alone = F.col("id").isNull() | F.col("n_copies").isNull()
    found = sketched.select("id", "mark", "content").join(classes, "content", "left")
    return found.select(
        F.col("id").alias("doc_id"), F.when(F.col("id").isNotNull(), F.coalesce("head.id", "id")).alias("class_id"),
        F.when(alone, 1).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
        F.when(alone, F.lit(True)).otherwise((F.col("id") == F.col("head.id")) & (F.col("mark") == F.col("head.mark"))).alias("kept"),
        "mark",
    )
