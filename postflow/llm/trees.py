"""Substring deduplication of words with prefix-partitioned suffix trees (operator 1).

Every word inside a window of 35 words whose word sequence also starts elsewhere is removed.  Only
suffixes that begin at an anchor (see ``repeats``) enter a tree.  They are split by prefixes of variable
length into groups that fit in memory: by the ``gram`` words at the anchor, or by all 35 words of a
window where the anchor is too common.  The subtree of a group is built level by level: a node is a
distinct sequence of words, its children are told by the next word, and a node with several suffixes
below it is internal.  Windows that begin r words left of their anchors are repeated where the suffixes
meet in an internal node of depth 35 - r or more and the r words on the left, a path in a tree of the
reversed left sides, are the same.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.llm import repeats
from postflow.llm import text as tx

WINDOW = 35
GRAM = 8


def levels(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, root: np.ndarray, depth: int, step: int = 1) -> np.ndarray:
    """Nodes of the suffix tree over ``symbols``, level by level.

    Row d has, for each suffix, the number of its node at depth d: equal for suffixes of one root that
    agree in d symbols, going by ``step`` from ``begin`` and before ``end``.  A suffix that has ended, or
    is alone in its node, gets -1: below a leaf no other suffix follows.
    """
    out = np.full((depth + 1, len(begin)), -1, np.int64)
    node = np.unique(root, return_inverse=True)[1].astype(np.int64)
    out[0] = node
    alive = np.arange(len(begin))
    width = int(symbols.max(initial=0)) + 1
    for d in range(depth):
        place = begin[alive] + step * d
        alive = alive[(place < end[alive]) if step > 0 else (place > end[alive])]
        if not len(alive):
            break
        child = node[alive] * width + symbols[begin[alive] + step * d]
        _, number, size = np.unique(child, return_inverse=True, return_counts=True)
        number = number.astype(np.int64)
        node = np.full(len(begin), -1, np.int64)
        node[alive] = number
        alive = alive[size[number] > 1]
        out[d + 1, alive] = node[alive]
    return out


def solve(keys, chunks, leads, counts, again, window: int = WINDOW) -> np.ndarray:
    """For each chunk, which of its windows are repeated; ``again`` marks chunks that occur twice as a whole."""
    found = tx.words(pa.array([c.decode() for c in chunks], pa.string()))
    begin, end = found.offsets[:-1] + leads, found.offsets[1:]
    right = levels(found.codes, begin, end, keys, window)
    left = levels(found.codes, begin - 1, found.offsets[:-1] - 1, keys, int(leads.max(initial=0)), -1)
    out = np.zeros((len(chunks), int(counts.max(initial=0))), bool)
    for r in range(int(leads.max(initial=-1)) + 1):
        fits = (r <= leads) & (leads - r < counts)
        own = np.flatnonzero(fits & again)
        out[own, leads[own] - r] = True
        own = np.flatnonzero(fits & (right[window - r] >= 0) & (left[r] >= 0))
        pair = right[window - r][own] * len(chunks) + left[r][own]
        _, number, size = np.unique(pair, return_inverse=True, return_counts=True)
        own = own[size[number] > 1]
        out[own, leads[own] - r] = True
    return out


def _word_symbols(texts):
    found = tx.words(texts)
    return found.offsets, tx.hashes(found.terms)[found.codes]


def _word_cutter(text):
    words = text.encode().split()
    return lambda a, b: b" ".join(words[a:b])


def _kind(window):
    gram = min(GRAM, 1 << max(0, (window // 3).bit_length() - 1))
    return repeats.Kind(window, gram, 16 << 20, _word_symbols, _word_cutter, False, lambda *a: solve(*a, window=window))


def dedup_words(docs: DataFrame, doc_id="doc_id", text="text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every row.

    Words are runs of bytes other than the space and 0x09-0x0D.  ``spans`` are the removed runs
    [start, end) in words, ``kept`` the other words joined by one space.  Ids are cast to long; rows
    that repeat an id and a text are one document, so they don't repeat each other; other texts of an id are documents
    of their own; a row without an id stays as it is.
    """

    def cut(batches):
        for part in tx.slices(batches, "text", 8 << 20):
            sizes, removed, spans, kept = [], [], [], []
            columns = (tx.column(part, c).to_pylist() for c in ("text", "low", "count"))
            for own, low, count in zip(*columns):
                words = (own or "").encode().split()
                gone = repeats.inside(len(words), low, count, window)
                step = np.diff(gone.astype(np.int8), prepend=0, append=0)
                sizes.append(len(words))
                removed.append(int(gone.sum()))
                edges = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))
                spans.append([{"start": s, "end": e} for s, e in edges])
                left, pieces = 0, []
                for s, e in edges:
                    pieces += words[left:s]
                    left = e
                kept.append(b" ".join(pieces + words[left:]).decode())
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [tx.column(part, "doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(span)), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    found = repeats.covered(docs, _kind(window), doc_id, text)
    return found.mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
    )


def digest(deduped: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) from ``dedup_words``."""
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
