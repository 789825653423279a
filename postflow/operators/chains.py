"""The n-grams of posts on their way to the tasks that count them, packed by slices of posts.

A packed row holds the grams of some thousand posts that go to one bucket: each distinct gram once, as numbers
of words that the row lists once, and a place in the row's list of keys for every post it occurs in.
"""

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow.operators.ngrams import GLUE

#: Words that are packed at once; a longer post is packed by itself.
SLICE_WORDS = 500_000
#: About as many grams go to one bucket, which a task holds as arrays.
BUCKET_GRAMS = 2_000_000


class Heavy(NamedTuple):
    """Tuples of words that are too frequent for one task, fewer than a thousand, and how often each occurs."""

    words: list[list[str]]
    counts: list[int]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as bytes, the lowest ones of all first, so that they compress."""
    used = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return bytes([used]) + numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:used].tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    parts = np.frombuffer(planes, np.uint8, offset=1).reshape(planes[0], -1)
    return sum(part.astype(np.int64) << (8 * k) for k, part in enumerate(parts))


def _numbered(columns: Sequence[np.ndarray]) -> np.ndarray:
    """A number for each row of the columns: equal rows have equal ones, and they sort like the rows."""
    found = columns[0]
    for more in columns[1:]:
        width = int(more.max(initial=0)) + 1
        if int(found.max(initial=0)) >= 2**62 // width:
            found, more = (np.unique(x, return_inverse=True)[1] for x in (found, more))
            width = int(more.max(initial=0)) + 1
        found = found * width + more
    return found


def _known(columns: Sequence[np.ndarray], terms: pa.Array, heavy: Heavy) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts): a number for every tuple of words, and how often the heavy ones occur, 0 for the others."""
    flat = pa.array([w for words in heavy.words for w in words], terms.type)
    codes = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(columns))
    met = (codes >= 0).all(axis=1)
    size = len(columns[0])
    both = _numbered([np.concatenate([c, codes[met, k]]) for k, c in enumerate(columns)])
    numbers, chosen, counts = both[:size], both[size:], np.zeros(size, np.int64)
    if len(chosen):
        order = np.argsort(chosen)
        at = np.minimum(np.searchsorted(chosen[order], numbers), len(chosen) - 1)
        hit = chosen[order][at] == numbers
        counts[hit] = np.array(heavy.counts, np.int64)[met][order][at[hit]]
    return numbers, counts


def _code(terms: pa.Array, word: str) -> int:
    return pc.index(terms, pa.scalar(word, terms.type)).as_py()


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) ^ y


def _pack(part: pa.RecordBatch, n: int, key: Sequence[str], buckets: int, least: int, heads: Heavy, grams: Heavy) -> pa.RecordBatch | None:
    """The packed rows of a slice of posts, one per bucket."""
    words = part.column("_words")
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    codes, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    place = np.flatnonzero(np.arange(len(codes)) + n <= np.repeat(np.cumsum(lengths), lengths))
    if not len(place):
        return None
    post = np.repeat(np.arange(len(lengths)), lengths)[place]
    columns = [codes[place + k] for k in range(n)]
    _, of = _known(columns[:-1], terms, heads)
    numbers, times = _known(columns, terms, grams)
    hashed = pd.util.hash_array(terms.to_numpy(zero_copy_only=False), categorize=False)
    dealt = hashed[columns[0]]
    for column in columns[1:-1]:
        dealt = _mixed(dealt, hashed[column])
    # Grams of heavy heads are dealt by themselves, and so are those that stand in as their own heads.
    alone = (of > 0) | (columns[0] == _code(terms, ""))
    dealt = np.where(alone, _mixed(dealt, hashed[columns[-1]]), dealt)
    dealt = np.where(times > 0, _mixed(dealt, post.astype(np.uint64)), dealt)
    bucket = (_mixed(dealt, dealt >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    del of, times, alone, dealt, hashed, place, codes, coded

    whole = _numbered([bucket, numbers])
    order = np.argsort(whole, kind="stable")
    whole, post = whole[order], post[order]
    first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
    one = order[first]
    ends = np.append(first, len(order))
    to = bucket[one]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(one))
    used, who, packed = [], [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        own, local = np.unique(np.stack([c[one[a:b]] for c in columns]), return_inverse=True)
        posts, at = np.unique(post[ends[a] : ends[b]], return_inverse=True)
        used.append(own)
        who.append(posts)
        scored = (lengths[posts] >= least).astype(np.uint8).tobytes()
        packed.append((_planes(local.ravel()), _planes(np.diff(ends[a : b + 1])), _planes(at), scored))

    def lists(parts: list[np.ndarray], values: pa.Array) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pa.array(np.concatenate(parts))))

    columns = [pa.array(to[cuts[:-1]]), pc.binary_join(lists(used, terms), GLUE)]
    columns += [pa.array(x, pa.binary()) for x in zip(*packed)]
    columns += [lists(who, part.column(k)) for k in key]
    return pa.RecordBatch.from_arrays(columns, [*_PACKED, *key])


_PACKED = {"_bucket": T.LongType(), "_terms": T.StringType()} | {c: T.BinaryType() for c in ("_grams", "_times", "_posts", "_scored")}


def packed_grams(padded: DataFrame, n: int, key: Sequence[str], buckets: int, least: int, heads: Heavy, grams: Heavy) -> DataFrame:
    """The ``n``-grams of the arrays ``_words``, packed: a row per slice of posts and bucket.

    All grams of a head are in one bucket, but those of heavy heads are dealt by themselves, a heavy one among all
    buckets.  Posts of at least ``least`` words are marked as scored.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_words")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(batch):
                end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_WORDS, side="right")), at + 1)
                rows = _pack(batch.slice(at, end - at), n, key, buckets, least, heads, grams)
                if rows is not None:
                    yield rows
                del rows
                pa.default_memory_pool().release_unused()
                at = end

    fields = [T.StructField(name, kind) for name, kind in _PACKED.items()]
    fields += [T.StructField(k, T.ArrayType(padded.schema[k].dataType)) for k in key]
    return padded.select(*key, "_words").mapInArrow(pack, T.StructType(fields))


def _unpacked(rows: pa.Table, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(columns, times, post, scored, terms): the words and the number of every gram, one post for each of its occurrences."""
    lists = pc.split_pattern(rows["_terms"].combine_chunks(), GLUE)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    scored = rows["_scored"].to_pylist()
    before = np.cumsum([0, *map(len, scored)])
    grams = [_numbers(g).reshape(n, -1) + base for g, base in zip(rows["_grams"].to_pylist(), np.cumsum(sizes) - sizes)]
    columns = [codes[np.concatenate([g[k] for g in grams])] for k in range(n)]
    times = np.concatenate([_numbers(t) for t in rows["_times"].to_pylist()])
    post = np.concatenate([_numbers(p) + base for p, base in zip(rows["_posts"].to_pylist(), before)])
    return columns, times, post, np.frombuffer(b"".join(scored), np.uint8) > 0, coded.dictionary


def _counted(numbers: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often the number of each row occurs in all rows."""
    _, place = np.unique(numbers, return_inverse=True)
    return np.bincount(place, weights=times)[place]


def _values(columns: list[np.ndarray], times: np.ndarray, terms: pa.Array, heads: Heavy, grams: Heavy, posts: int, words: int | None):
    """(chain, head): per gram ``ln c(gram) - ln c(head)`` and, in bigrams, ``ln c(head)``; ``words`` is the vocabulary if counts are smoothed."""
    edge, two = _code(terms, ""), len(columns) == 2
    start, end = columns[0] == edge, columns[-1] == edge
    numbers, known = _known(columns, terms, grams)
    count = np.where(known > 0, known, _counted(numbers, times))
    numbers, known = _known(columns[:-1], terms, heads)
    of = np.where(known > 0, known, _counted(numbers, times))
    of = np.where(start, count, of)
    more = 0 if words is None else 1
    chain = np.log(count + more) - np.log(of + more * (words or 0))
    if two:
        return np.where(start | end, np.log(count / posts), chain), np.where(start, 0.0, np.log(of))
    return np.where(end, 0.0, chain), np.zeros(len(count))


def gram_sums(packed: DataFrame, n: int, key: Sequence[str], heads: Heavy, grams: Heavy, posts: int, words: int | None) -> DataFrame:
    """(key.., chain, heads): the sums of what the grams of a bucket add to each post, without those that add nothing."""

    def sums(rows: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what the bucket before took
        columns, times, post, scored, terms = _unpacked(rows, n)
        values = _values(columns, times, terms, heads, grams, posts, words)
        del columns
        found = [np.bincount(post, weights=np.repeat(value, times), minlength=len(scored)) for value in values]
        del values, times, post
        keep = pa.array((scored & (found[0] != 0)) | (found[1] != 0))
        out = [rows[k].combine_chunks().flatten() for k in key] + [pa.array(found[0], mask=~scored), pa.array(found[1])]
        return pa.Table.from_arrays([c.filter(keep) for c in out], [*key, "chain", "heads"])

    fields = [T.StructField(k, packed.schema[k].dataType.elementType) for k in key]
    fields += [T.StructField(c, T.DoubleType()) for c in ("chain", "heads")]
    return packed.repartition("_bucket").groupBy("_bucket").applyInArrow(sums, T.StructType(fields))
