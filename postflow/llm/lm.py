"""Language-model scores from a sharded Elias-Fano n-gram trie (operator 3).

The model is of order 2.  With c the training counts, N training tokens of V kinds and mu a weight,

    p(w) = (c(w) + 1) / (N + V + 1),    p(w | v) = (c(v, w) + mu p(w)) / (c(v) + mu).

Its n-grams are dealt to shards by their context, so it grows with the corpus and no task holds it whole;
the n-grams of a context that makes up a large share of all tokens are dealt by context and word.
Documents are dealt to chunks of some MB.  A chunk sends each shard its distinct n-grams with their
training counts, packed; the shard adds them up, builds its trie, looks the chunk's n-grams up and sends
back one code for each, in the same order.  So every n-gram crosses the network once per chunk.

A trie has two levels.  The contexts are ascending hashes and the pointers to their successors ascending
numbers, both in Elias-Fano form; the successors of a context are ascending and take 6 bytes, because they are
told apart within their context only; beside each stands its quantised ratio c(v, w) / c(v).  All are in
one memory-mapped file.  A look-up finds the context's place, its range of successors, and searches there.
"""

import os
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.llm import text as tx
from postflow.llm import vbyte
from postflow.session import materialise

#: Bytes of text in a chunk, about; there are as many shards as chunks.
CHUNK_BYTES = 9 << 20
#: A word that makes up at least one of so many tokens has its n-grams dealt by word; 4,000 at most.
HOT_SHARE = 4_000
#: Weight of the unigram probability, in tokens.
MU = 100.0
#: Codes per decade of c(v, w) / c(v); code 0 is an unseen n-gram.
CODES = 6_000
_END, _BEGIN = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
_NULL = -(2**63)


# --- compact levels -------------------------------------------------------------------------------


def _bit_places(bits: np.ndarray, counts: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one; ``counts`` has the number of ones before each byte."""
    byte = np.searchsorted(counts, k, side="right") - 1
    ones = np.unpackbits(bits[byte][:, None], axis=1, bitorder="little").cumsum(axis=1)
    return byte * 8 + (ones <= (k - counts[byte])[:, None]).sum(axis=1)


class EliasFano:
    """Ascending integers: low bytes as they are, high parts as gaps in unary.

    ``low`` bytes of each value are stored plainly; value i sets the bit (value >> 8 low) + i.
    """

    @staticmethod
    def pack(values: np.ndarray, top: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(low, low bytes, bits) of ascending values below 2 ** ``top``."""
        spare = max(0, top - max(1, len(values)).bit_length())
        low = -(-spare // 8)
        shift = np.uint64(8 * low)
        values = values.astype(np.uint64)
        high = (values >> shift) if low < 8 else np.zeros(len(values), np.uint64)
        bits = np.zeros(int(high.max(initial=0)) + len(values) + 1, np.uint8)
        bits[high.astype(np.int64) + np.arange(len(values))] = 1
        return low, values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].copy(), np.packbits(bits, bitorder="little")

    def __init__(self, low: int, lows: np.ndarray, bits: np.ndarray):
        self.low, self.lows, self.bits = low, lows, bits
        self.counts = np.concatenate([[0], np.cumsum(np.unpackbits(bits[:, None], axis=1).sum(axis=1, dtype=np.int64))])[:-1]

    def __len__(self):
        return len(self.lows)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values by place."""
        high = (_bit_places(self.bits, self.counts, i) - i).astype(np.uint64)
        wide = np.zeros((len(i), 8), np.uint8)
        wide[:, : self.low] = self.lows[i]
        low = wide.reshape(-1).view("<u8")
        return low | (high << np.uint64(8 * self.low)) if self.low < 8 else low

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = _search(self.get, np.zeros(len(keys), np.int64), np.full(len(keys), len(self), np.int64), keys)
        inner = np.flatnonzero(at < len(self))
        out = np.full(len(keys), -1, np.int64)
        hit = self.get(at[inner]) == keys[inner]
        out[inner[hit]] = at[inner[hit]]
        return out


def _search(get, low: np.ndarray, high: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The first place in each range [low, high) whose value is not below the key, or ``high``."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        less = get(mid) < keys[open_]
        low[open_] = np.where(less, mid + 1, low[open_])
        high[open_] = np.where(less, high[open_], mid)


def ratio_code(ratio: np.ndarray) -> np.ndarray:
    """1 for a ratio of 1 and more for less; 65,535 stands for all below 10 ** -10.9."""
    return np.clip(np.rint(-np.log10(ratio) * CODES) + 1, 1, 65_535).astype(np.uint16)


def code_ratio(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code.astype(np.float64) - 1) / CODES), 0.0)


class Trie:
    """The n-grams of a shard in a memory-mapped file; ``close`` removes it."""

    def __init__(self, contexts: np.ndarray, pointers: np.ndarray, successors: np.ndarray, codes: np.ndarray):
        """Ascending contexts, where the successors of each begin and at last end, 48-bit successors, codes."""
        first, second = EliasFano.pack(contexts, 64), EliasFano.pack(pointers, max(1, int(pointers[-1]).bit_length()))
        wide = successors.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
        parts = [first[1], first[2], second[1], second[2], wide, codes.astype("<u2").view(np.uint8)]
        self.path = tempfile.mkstemp(suffix=".trie")[1]
        with open(self.path, "wb") as file:
            for part in parts:
                np.ascontiguousarray(part).tofile(file)
        whole = np.memmap(self.path, np.uint8, "r") if os.path.getsize(self.path) else np.zeros(0, np.uint8)
        views, at = [], 0
        for part in parts:
            views.append(whole[at : at + part.size].reshape(part.shape))
            at += part.size
        self.contexts = EliasFano(first[0], views[0], views[1])
        self.pointers = EliasFano(second[0], views[2], views[3])
        self.wide, self.codes = views[4], views[5]

    def successor(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), 8), np.uint8)
        out[:, 2:] = self.wide[i]
        return out.reshape(-1).view(">u8").astype(np.uint64)

    def look_up(self, contexts: np.ndarray, owner: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """The code of each n-gram (contexts[owner], successor), 0 if unseen."""
        place = self.contexts.find(contexts)
        known = np.flatnonzero(place >= 0)
        begin, end = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        begin[known] = self.pointers.get(place[known]).astype(np.int64)
        end[known] = self.pointers.get(place[known] + 1).astype(np.int64)
        low, high = begin[owner], end[owner]
        at = _search(self.successor, low, high, successors)
        out = np.zeros(len(owner), np.uint16)
        inner = np.flatnonzero(at < high)
        hit = inner[self.successor(at[inner]) == successors[inner]]
        pair = self.codes.reshape(-1, 2)[at[hit]]
        out[hit] = pair[:, 0].astype(np.uint16) | (pair[:, 1].astype(np.uint16) << np.uint16(8))
        return out

    def close(self):
        os.unlink(self.path)


# --- chunks ---------------------------------------------------------------------------------------


class Grams(NamedTuple):
    """The distinct n-grams of some texts, in the order in which they are sent, and where tokens find theirs."""

    offsets: np.ndarray  # of the tokens of each text
    words: np.ndarray  # hash of each token
    place: np.ndarray  # of each token: its n-gram
    shard: np.ndarray
    context: np.ndarray
    successor: np.ndarray
    count: np.ndarray  # in training texts


def grams(texts: pa.Array, train: np.ndarray, hot: np.ndarray, shards: int) -> Grams:
    found = tx.words(texts, tx.LOWER)
    n = len(found.offsets) - 1
    kinds = len(found.terms)
    lengths = np.diff(found.offsets) + 1
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    token = np.empty(offsets[-1], np.int64)
    ends = offsets[1:] - 1
    token[ends] = kinds
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = found.codes
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[offsets[:-1]] = kinds + 1
    hashed = np.concatenate([tx.hashes(found.terms), [_END, _BEGIN]]).astype(np.uint64)
    pair, place = np.unique(before * (kinds + 2) + token, return_inverse=True)
    left, right = pair // (kinds + 2), pair % (kinds + 2)
    in_train = np.repeat(train, lengths)
    count = np.bincount(place[in_train], minlength=len(pair))
    context, successor = hashed[left], hashed[right]
    is_hot = np.isin(hashed, hot)[left]
    shard = (np.where(is_hot, tx.paired(context, successor), tx.mixed(context)) % np.uint64(shards)).astype(np.int64)
    successor = successor >> np.uint64(16)
    order = np.lexsort((successor, context, shard))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return Grams(offsets, hashed[token], rank[place], shard[order], context[order], successor[order], count[order])


def _send(context, successor, count) -> tuple:
    """The n-grams for one shard as bytes: contexts, numbers of successors, successors, counts."""
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    sizes = np.diff(np.append(first, len(context)))
    wide = successor.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return (context[first].astype("<u8").tobytes(), *vbyte.encode(sizes), wide.tobytes(), *vbyte.encode(count))


_SENT = "contexts binary, size_control binary, size_data binary, successors binary, count_control binary, count_data binary"
_SENT_NAMES = [part.split()[0] for part in _SENT.split(", ")]


def _received(row: dict) -> tuple:
    context = np.frombuffer(row["contexts"], "<u8")
    sizes = vbyte.decode(row["size_control"], row["size_data"])[: len(context)].astype(np.int64)
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, 2:] = np.frombuffer(row["successors"], np.uint8).reshape(-1, 6)
    count = vbyte.decode(row["count_control"], row["count_data"])[: len(wide)].astype(np.int64)
    return context, sizes, wide.reshape(-1).view(">u8").astype(np.uint64), count


def _chunk_sender(hot: np.ndarray, shards: int):
    def send(table):
        found = grams(tx.column(table, "text"), table.column("train").to_numpy(), hot, shards)
        edges = np.searchsorted(found.shard, np.arange(shards + 1))
        used = np.flatnonzero(np.diff(edges))
        rows = [_send(*(x[edges[k] : edges[k + 1]] for x in (found.context, found.successor, found.count))) for k in used]
        chunk = table.column("chunk")[0].as_py()
        columns = [pa.array(list(c), pa.binary()) for c in zip(*rows)]
        return pa.Table.from_arrays([pa.array([chunk] * len(used), pa.int64()), pa.array(used, pa.int64()), *columns], ["chunk", "shard", *_SENT_NAMES])

    return send


def _shard_answers(hot: dict[int, int]):
    """For each chunk: training counts of its contexts, and codes of its n-grams, in its order."""

    def answer(table):
        rows = table.to_pylist()
        parts = [_received(r) for r in rows]
        context = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        successor = np.concatenate([p[2] for p in parts])
        count = np.concatenate([p[3] for p in parts])
        seen = np.flatnonzero(count > 0)
        order = seen[np.lexsort((successor[seen], context[seen]))]
        context, successor, count = context[order], successor[order], count[order]
        if len(order):
            new = np.concatenate([[True], (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])])
            count = np.add.reduceat(count, np.flatnonzero(new))
            context, successor = context[new], successor[new]
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            total = np.add.reduceat(count, first)
            pointers = np.append(first, len(context))
            known = context[first]
        else:
            known, total, pointers = context, count, np.zeros(1, np.int64)
        if hot:  # a hot context has other n-grams in other shards
            total = np.array([hot.get(c, t) for c, t in zip(known.tolist(), total.tolist())], np.int64)
        codes = ratio_code(count / np.repeat(total, np.diff(pointers)))
        trie = Trie(known, pointers, successor, codes)
        try:
            answers = []
            for own, sizes, after, _ in parts:
                place = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                found = np.where(known[place] == own, total[place], 0) if len(known) else np.zeros(len(own), np.int64)
                code = trie.look_up(own, np.repeat(np.arange(len(own)), sizes), after)
                answers.append((*vbyte.encode(np.minimum(found, 2**32 - 1)), code.astype("<u2").tobytes()))
        finally:
            trie.close()
        control, data, code = zip(*answers)
        return pa.table({
            "chunk": table.column("chunk"), "shard": table.column("shard"), "total_control": pa.array(control, pa.binary()),
            "total_data": pa.array(data, pa.binary()), "codes": pa.array(code, pa.binary()),
        })

    return answer


class Totals(NamedTuple):
    """Training texts, training tokens, kinds of tokens, and the counts of hot words by hash."""

    texts: int
    tokens: int
    kinds: int
    hot: dict[int, int]


def _chunk_scores(totals: Totals, shards: int, mu: float):
    hot_words = np.array(sorted(totals.hot), np.uint64)
    hot_counts = np.array([totals.hot[w] for w in sorted(totals.hot)], np.int64)

    def score(docs, answers):
        found = grams(tx.column(docs, "text"), docs.column("train").to_numpy(), hot_words, shards)
        differs = (found.context[1:] != found.context[:-1]) | (found.shard[1:] != found.shard[:-1])
        first = np.flatnonzero(np.concatenate([[True], differs]))
        rows = sorted(answers.to_pylist(), key=lambda r: r["shard"])
        per_shard = np.bincount(found.shard[first], minlength=shards)
        total = np.concatenate([
            vbyte.decode(r["total_control"], r["total_data"])[: per_shard[r["shard"]]] for r in rows
        ]).astype(np.int64)
        code = np.frombuffer(b"".join(r["codes"] for r in rows), "<u2")
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(found.context))))
        context = found.context[first]
        # A word's own count is that of its n-grams; hot words, the begin and the end are known beforehand.
        at = np.minimum(np.searchsorted(hot_words, context), len(hot_words) - 1)
        total = np.where(hot_words[at] == context, hot_counts[at], total)
        order = np.argsort(context, kind="stable")
        sorted_context, sorted_total = context[order], total[order]
        kinds, kind = np.unique(found.words, return_inverse=True)
        place = np.minimum(np.searchsorted(sorted_context, kinds), len(sorted_context) - 1)
        count = np.where(sorted_context[place] == kinds, sorted_total[place], 0)
        count = np.where(kinds == _END, totals.texts, count)[kind]
        base = np.log10((count + 1) / (totals.tokens + totals.kinds + 1))
        weight = mu / (total + mu)
        back = weight[owner][found.place]
        smooth = np.log10((1 - back) * code_ratio(code)[found.place] + back * 10.0**base)
        begin = found.offsets[:-1]
        n = len(begin)
        return pa.table({
            "doc_id": docs.column("doc_id"),
            "n_tokens": pa.array(np.diff(found.offsets), pa.int64()),
            "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), begin) if n else np.zeros(0, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, begin) if n else np.zeros(0)),
            "score": pa.array(np.add.reduceat(smooth, begin) if n else np.zeros(0)),
            "train": docs.column("train"),
        })

    return score


def _totals(train: DataFrame) -> Totals:
    """Counted over all training texts; a row per slice and word is added up before anything is collected."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            found = tx.words(tx.column(part, "text"), tx.LOWER)
            number = np.bincount(found.codes, minlength=len(found.terms))
            word, number = tx.hashes(found.terms)[number > 0], number[number > 0]
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(number)], ["word", "n"])

    words = train.select("text").mapInArrow(counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialise(words, "word-counts")
    texts = train.count()
    kinds, tokens = words.agg(F.count("word"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = {
        r["word"] % 2**64: r["n"]
        for r in words.filter(F.col("n") * HOT_SHARE >= tokens + texts).collect()
    }
    hot[int(_BEGIN)] = texts
    return Totals(texts, tokens + texts, kinds + (texts > 0), hot)


def score(docs: DataFrame, train: Column, doc_id="doc_id", text="text", mu: float = MU) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows where ``train`` is true and scores all.  Tokens are the words between
    ASCII white space, A-Z lower-cased, and one end; a null text has the end alone.  Scores are sums of
    base-10 logarithms: ``base_score`` of p(w), ``score`` of p(w | v), whose ratios are quantised to 1/6,000 of a
    decade.  ``n_known`` counts the tokens that occur in training.  Words are told apart by 64-bit hashes.
    Repeated rows count as often as they come.
    """
    rows = docs.select(
        docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = int(size // CHUNK_BYTES) + 1
    totals = _totals(rows.filter("train"))
    key = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(_NULL)), F.substring("text", 1, 64)), F.lit(chunks))
    dealt = rows.withColumn("chunk", key)
    hot_words = np.array(sorted(totals.hot), np.uint64)
    sent = dealt.groupBy("chunk").applyInArrow(_chunk_sender(hot_words, chunks), f"chunk long, shard long, {_SENT}")
    answers = sent.groupBy("shard").applyInArrow(
        _shard_answers(totals.hot), "chunk long, shard long, total_control binary, total_data binary, codes binary"
    )
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _chunk_scores(totals, chunks, mu), "doc_id long, n_tokens long, n_known long, base_score double, score double, train boolean"
    )
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
        F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
