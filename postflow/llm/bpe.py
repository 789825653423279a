"""Byte-level BPE encoding and decoding (operator 10).

The text is split by the tokenizer's pattern and every piece is merged on its own.  A segment tree
over the byte positions of a piece holds, in each node, the lowest pair rank below it and the
leftmost place of that rank.  A merge takes the root's place, glues the two parts there and updates
the ranks of the two live neighbours, so each costs O(log n) and a piece of n bytes O(n log n),
however long it is.  Short pieces that are new to a worker are merged side by side, their trees being
the rows of one matrix; pieces that come again are remembered, within a bound.
"""

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from postflow.llm.text import column, kept, slices

#: Pieces remembered by a worker (twice as many at most), and the longest of them in bytes.
MEMO_PIECES = 400_000
MEMO_BYTES = 64
_NONE = 1 << 60


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: the pair of lowest rank is merged first, the leftmost among equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(0, (n - 2).bit_length())
    get = ranks.get
    # A node is rank * n + place, so one comparison finds the lowest rank and then the leftmost place.
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # where the next part begins
    before = list(range(-1, n - 1))
    while tree[1] < _NONE:
        i = tree[1] % n
        gone = after[i]
        j = after[gone]
        after[i] = j
        changed = [(gone, _NONE)]
        if j < n:
            before[j] = i
            rank = get(piece[i : after[j]])
            changed.append((i, _NONE if rank is None else rank * n + i))
        else:
            changed.append((i, _NONE))
        h = before[i]
        if h >= 0:
            rank = get(piece[h:j])
            changed.append((h, _NONE if rank is None else rank * n + h))
        for place, value in changed:
            if place >= n - 1:
                continue  # the last byte starts no pair
            place += size
            if tree[place] == value:
                continue
            tree[place] = value
            place >>= 1
            while place:
                a, b = tree[2 * place], tree[2 * place + 1]
                low = a if a < b else b
                if tree[place] == low:
                    break
                tree[place] = low
                place >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def _coder(path: str, pattern: str) -> "Coder":
    return kept(f"coder {path} {pattern}", lambda: Coder(path, pattern))


class Coder:
    """Encodes and decodes by a rank file (base64 token, rank); every single byte must be a token."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.ids = {rank: rank for rank in self.tokens}  # one object per id, for all remembered pieces
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        get = self.ranks.get
        pairs = {
            (get(token[:k]) << 32) + get(token[k:]): rank
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        }
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[key] for key in self.pairs.tolist()], np.int64)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text; the pieces that are new to the memo are merged together."""
        split = [self.split(t) if t else [] for t in texts]
        memo, older = self.memo, self.older
        new = set()
        for pieces in split:
            for piece in set(pieces).difference(memo):
                found = older.get(piece)
                if found is None:
                    new.add(piece)
                else:
                    memo[piece] = found
        now = {}
        short = [p for p in new if len(p) <= MEMO_BYTES // 4]  # of 4 bytes a character at most
        memo.update(zip(short, self.merge_short([p.encode() for p in short])))
        for piece in new.difference(short):
            now[piece] = merge(piece.encode(), self.ranks)
        out = []
        for pieces in split:
            ids: list[int] = []
            if now:
                for piece in pieces:
                    found = memo.get(piece)
                    ids += now[piece] if found is None else found
            else:
                ids.extend(itertools.chain.from_iterable(map(memo.__getitem__, pieces)))
            out.append(ids)
        if len(memo) > MEMO_PIECES:
            self.older, self.memo = memo, {}
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def merge_short(self, pieces: list[bytes]) -> list[tuple]:
        """``merge`` for many short pieces at once: their trees are rows of a matrix."""
        out: list[tuple] = [()] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        size = 2
        done = 1
        while done < lengths.max(initial=0):
            for chosen in np.array_split(rows := np.flatnonzero((lengths > done) & (lengths <= size + 1)), len(rows) // 20_000 + 1):
                if len(chosen):
                    self._merge_rows([pieces[k] for k in chosen.tolist()], chosen, size, out)
            done, size = size + 1, 2 * size
        for k in np.flatnonzero(lengths == 1).tolist():
            out[k] = (self.ids[self.ranks[pieces[k]]],)
        return out

    def _rank(self, left, right):
        """The rank of each glued pair, _NONE for a pair that isn't a token."""
        key = (left << 32) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], _NONE)

    def _merge_rows(self, pieces, places, size, out):
        """Merges pieces of 2 to size + 1 bytes; node k of a row has the children 2k and 2k + 1."""
        n = np.array([len(p) for p in pieces], np.int64)
        width = size + 1
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        ids = self.byte_ids[data].reshape(-1, width)
        at = np.arange(width)
        live = at < n[:, None]
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        tree = np.full((len(pieces), 2 * size), _NONE, np.int64)
        tree[:, size:] = np.where(live[:, 1:] & (rank < _NONE), rank * size + at[:-1], _NONE)
        half = size // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(
                tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2]
            )
            half //= 2
        after = np.broadcast_to(np.arange(1, width + 1), ids.shape).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), ids.shape).copy()
        flat, row = tree.reshape(-1), np.arange(len(pieces))
        while True:
            root = tree[row, 1]
            going = root < _NONE
            row, root = row[going], root[going]
            if not len(row):
                break
            i, token = root % size, root // size
            ids[row, i] = token
            gone = after[row, i]
            j = after[row, gone]
            after[row, i] = j
            live[row, gone] = False
            right = np.flatnonzero(j < n[row])
            before[row[right], j[right]] = i[right]
            base = row * (2 * size) + size
            inner = np.flatnonzero(gone < size)
            flat[base[inner] + gone[inner]] = _NONE
            rank = np.full(len(row), _NONE, np.int64)
            rank[right] = self._rank(token[right], ids[row[right], j[right]])
            flat[base + i] = np.where(rank < _NONE, rank * size + i, _NONE)
            h = before[row, i]
            left = np.flatnonzero(h >= 0)
            rank = self._rank(ids[row[left], h[left]], token[left])
            flat[base[left] + h[left]] = np.where(rank < _NONE, rank * size + h[left], _NONE)
            for own, place in ((base[inner], gone[inner]), (base, i), (base[left], h[left])):
                own, node = own - size, (place + size) // 2
                while len(node) and node[0]:
                    k = own + 2 * node
                    flat[own + node] = np.minimum(flat[k], flat[k + 1])
                    node = node // 2
        ends = np.cumsum(live.sum(axis=1)).tolist()
        found = [self.ids[x] for x in ids[live].tolist()]
        begin = 0
        for k, end in zip(places.tolist(), ends):
            out[k] = tuple(found[begin:end])
            begin = end

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, ids): the token ids of every text, in order.

    A null or empty text has no ids.  ``path`` must be readable on every executor.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 256):  # the ids of a few documents at a time
                part = batch.slice(at, 256)
                found = coder.encode_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"]
                )

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(ids, f"doc_id {kind}, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of every row of ``encode``; null ids decode to no bytes."""
    kind = coded.schema["doc_id"].dataType.simpleString()

    def texts(batches):
        coder = _coder(path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [coder.decode(ids or ()) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.binary())], ["doc_id", "ids", "decoded"]
                )

    return coded.select("doc_id", "ids").mapInArrow(
        texts, f"doc_id {kind}, ids array<int>, decoded binary"
    )


def digest(docs: DataFrame, path: str, pattern: str, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): a round trip that keeps only digests.

    Encodes and decodes as ``encode`` and ``decode`` do, in one pass over the texts.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(batches):
        coder = _coder(path, pattern)
        for part in slices(batches, "text", 4 << 20):
            counts, ids_sha, bytes_sha = [], [], []
            for ids in coder.encode_all(column(part, "text").to_pylist()):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(bytes_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    found = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return found.mapInArrow(
        rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
