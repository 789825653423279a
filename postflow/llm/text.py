"""Texts of an Arrow batch as arrays of word codes, without a Python object per word."""

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
SLICE_BYTES = 16 << 20

#: Maps A-Z to a-z and leaves other bytes alone; words are then split at ASCII white space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SAME = bytes(range(256))
#: Lower-cases A-Z and blanks every other ASCII byte that is neither letter nor digit.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def kept(name: str, make: Callable):
    """What ``make()`` gave when first asked for in this Python worker.

    Code travels with every task, so a module's own variables don't outlast a task; this does.
    """
    store = sys.modules.setdefault("_postflow_kept", types.ModuleType("_postflow_kept")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


class Words(NamedTuple):
    """``codes[offsets[i]:offsets[i + 1]]`` are the words of text i, as places in ``terms``."""

    offsets: np.ndarray
    codes: np.ndarray
    terms: pa.Array


def give_back() -> None:
    """Returns memory that Arrow and the C library keep for later to the system; a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator:
    """Tables of neighbouring rows with about ``most`` bytes of text; one row at least.

    Small batches are put together and large ones are cut.  A slice's rows are held once, and what the slice
    before took goes back to the system.
    """
    held, size = [], 0

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        give_back()
        return table

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < len(batch):
            before = total[at - 1] if at else 0
            end = int(np.searchsorted(total, before + most - size, side="right"))
            end = max(end, at if held else at + 1)
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(total[end - 1] - before)
                at = end
            if at < len(batch):
                yield joined()
                size = 0
    if held:
        yield joined()
    give_back()


def column(table: pa.Table, name: str) -> pa.Array:
    """One array of a slice."""
    found = table.column(name).combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of all texts; a null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], body[at[0] : at[-1]]


def words(texts: pa.Array, mapping: bytes = SAME) -> Words:
    """The runs of bytes other than space and 0x09-0x0D, after ``mapping`` of each byte."""
    offsets, data = raw(texts)
    if not len(data):
        return Words(np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string()))
    mapped = pa.py_buffer(data.tobytes().translate(mapping))
    array = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), mapped)
    lists = pc.ascii_split_whitespace(array)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.asarray(lists.offsets).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # what is left and right of white space at the ends
        real = codes != empty
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        codes = codes[real]
    return Words(starts, codes, coded.dictionary)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit integers over all bits, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ordered pair."""
    return mixed(left * np.uint64(0xD6E8FEB86659FD93) + right)


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def hashes(terms: pa.Array) -> np.ndarray:
    """A 64-bit hash of each term: the sum of a random number for every byte at its place."""
    offsets, data = raw(terms)
    lengths = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mixed(_BYTES[data] + place.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)), out=total[1:])
    return mixed(total[offsets[1:]] - total[offsets[:-1]] + lengths.astype(np.uint64))
