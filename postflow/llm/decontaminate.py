"""Benchmark decontamination with a positional inverted index (operator 5).

The corpus is indexed in shards of neighbouring documents.  A shard's postings give, for every word,
its ascending positions in the shard, coded as gaps; they are kept in rows by a hash of the word, so
a query reads them by columns.  A document's positions are followed by one that holds no word, so no
phrase crosses documents.  A phrase is found by taking the positions of its rarest word in the shard,
less the word's place in the phrase, and keeping those where every other word, from the next rarest to
the commonest, has a position at its own place.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.llm import text as tx
from postflow.llm import vbyte
from postflow.session import materialise

#: Words of a window.
WINDOW = 13
#: Rows that a shard's words are dealt over.
BUCKETS = 32
#: Words of benchmark items that are looked up at once; more items take more passes over the index.
BLOCK_WORDS = 1_000_000

INDEX = (
    "shard long, bucket int, terms array<string>, counts array<int>, control binary, data binary, "
    "doc_ids array<long>, lengths array<int>"
)
_NAMES = [part.split()[0] for part in INDEX.split(", ")]


def _gaps(counts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Each list's first position and then its gaps."""
    gaps = np.diff(positions, prepend=0)
    begin = np.cumsum(counts) - counts
    gaps[begin] = positions[begin]
    return gaps


def _positions(counts: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """The inverse of ``_gaps``."""
    total = np.cumsum(gaps)
    begin = np.cumsum(counts) - counts
    return total - np.repeat(total[begin] - gaps[begin], counts)


def build_index(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """The index rows of all whole texts; a null text has no words.

    Words are runs of ASCII letters, lower-cased, digits and all other characters beyond ASCII.  Write
    the result once (``materialise``) and query it as often as needed.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, part in enumerate(tx.slices(batches, "text")):
            found = tx.words(tx.column(part, "text"), tx.ALNUM)
            lengths = np.diff(found.offsets)
            position = np.arange(len(found.codes)) + np.repeat(np.arange(len(lengths)), lengths)
            terms = found.terms.to_pylist()
            bucket = tx.hashes(found.terms) % np.uint64(BUCKETS)
            by_term = np.argsort(found.codes, kind="stable")
            counts = np.bincount(found.codes, minlength=len(terms))
            ends = np.cumsum(counts)
            position = position[by_term]
            by_bucket = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by_bucket], np.arange(BUCKETS + 1))
            rows = []
            for k in range(BUCKETS):
                chosen = by_bucket[edges[k] : edges[k + 1]]
                chosen = chosen[counts[chosen] > 0]
                if len(chosen):
                    own = counts[chosen]
                    stops = np.cumsum(own)
                    at = np.arange(stops[-1]) + np.repeat(ends[chosen] - stops, own)
                    coded = vbyte.encode(_gaps(own, position[at]))
                    rows.append((first + number, k, [terms[i] for i in chosen], own.tolist(), *coded, None, None))
            rows.append((first + number, -1, None, None, None, None, tx.column(part, "doc_id").to_pylist(), lengths.tolist()))
            types = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(),
                     pa.list_(pa.int64()), pa.list_(pa.int32())]
            for row in rows:  # a row at a time, so that no Arrow batch is large
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], _NAMES)

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(shards, INDEX)


def _narrowed(index: DataFrame, vocabulary: set[str]) -> DataFrame:
    """The index with the postings of ``vocabulary`` only; rows that tell the documents stay."""
    hashed = tx.hashes(pa.array(sorted(vocabulary), pa.string()))
    buckets = sorted({int(h) for h in hashed % np.uint64(BUCKETS)})

    def narrow(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                if row.column(1)[0].as_py() >= 0:
                    terms = row.column(2)[0].as_py()
                    kept = np.array([t in vocabulary for t in terms], bool)
                    if not kept.any():
                        continue
                    counts = np.array(row.column(3)[0].as_py(), np.int64)
                    values = vbyte.decode(row.column(4)[0].as_py(), row.column(5)[0].as_py())[: counts.sum()]
                    coded = vbyte.encode(values[np.repeat(kept, counts)])
                    row = pa.RecordBatch.from_arrays(
                        [row.column(0), row.column(1), pa.array([[t for t, k in zip(terms, kept) if k]], pa.list_(pa.string())),
                         pa.array([counts[kept].tolist()], pa.list_(pa.int32())), pa.array([coded[0]], pa.binary()),
                         pa.array([coded[1]], pa.binary()), row.column(6), row.column(7)],
                        _NAMES,
                    )
                yield row

    return index.filter(F.col("bucket").isin(-1, *buckets)).mapInArrow(narrow, INDEX)


class _Shard:
    """The postings of one shard, by word."""

    def __init__(self, table: pa.Table):
        self.lists: dict[str, np.ndarray] = {}
        self.doc_ids, self.lengths = [], np.zeros(0, np.int64)
        for row in table.to_pylist():
            if row["bucket"] < 0:
                self.doc_ids, self.lengths = row["doc_ids"], np.array(row["lengths"], np.int64)
                continue
            counts = np.array(row["counts"], np.int64)
            values = vbyte.decode(row["control"], row["data"])[: counts.sum()].astype(np.int64)
            parts = np.split(_positions(counts, values), np.cumsum(counts)[:-1])
            self.lists.update(zip(row["terms"], parts))
        ends = np.cumsum(self.lengths + 1)
        #: Position of the first word of each document.
        self.begin = ends - self.lengths - 1

    def phrase(self, words: tuple[str, ...]) -> np.ndarray:
        """Positions at which the words stand one after another."""
        lists = [(self.lists.get(w), k) for k, w in enumerate(words)]
        if any(at is None for at, _ in lists):
            return np.zeros(0, np.int64)
        lists.sort(key=lambda x: len(x[0]))
        found = lists[0][0] - lists[0][1]
        for at, k in lists[1:]:
            if not len(found):
                break
            place = np.searchsorted(at, found + k)
            place[place == len(at)] = 0
            found = found[at[place] == found + k]
        return found

    def near(self, words: tuple[str, ...], width: int) -> np.ndarray:
        """Positions of query words that begin ``width`` consecutive words of a document with all of them."""
        lists = [self.lists.get(w) for w in set(words)]
        if not lists or any(at is None for at in lists):
            return np.zeros(0, np.int64)
        rarest = min(lists, key=len)
        start = np.unique(np.concatenate(lists))
        place = np.searchsorted(rarest, start)  # one of the rarest must follow soon
        start = start[(place < len(rarest)) & (rarest[np.minimum(place, len(rarest) - 1)] < start + width)]
        last = start.copy()
        for at in lists:
            place = np.searchsorted(at, start)
            value = np.where(place < len(at), at[np.minimum(place, len(at) - 1)], np.iinfo(np.int64).max)
            last = np.maximum(last, value)
        same = self.doc(start) == self.doc(np.minimum(last, start + width))
        return start[(last < start + width) & same]

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, position, side="right") - 1


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, list[str]]]]:
    """The items as (id as text, words), in blocks of about BLOCK_WORDS; ids that are null are dropped."""
    block, size = [], 0
    for row in items.select(items[item_id].cast("string"), items[text]).filter(items[item_id].isNotNull()).toLocalIterator():
        found = tx.words(pa.array([row[1]], pa.string()), tx.ALNUM)
        terms = found.terms.to_pylist()
        block.append((row[0], [terms[c] for c in found.codes]))
        size += len(found.codes)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block or not size:
        yield block


def _matcher(owners):
    """Finds the windows, keys of ``owners``, in all documents of a shard."""

    def match(table):
        shard = _Shard(table)
        size = int((shard.lengths + 1).sum())
        edge = np.zeros(size + 1, np.int32)
        found: dict[int, set] = defaultdict(set)
        for words, names in owners.items():
            at = shard.phrase(words)
            if len(at):
                np.add.at(edge, at, 1)
                np.add.at(edge, at + len(words), -1)
                for doc in np.unique(shard.doc(at)).tolist():
                    found[doc] |= names
        inside = np.cumsum(edge[:-1]) > 0
        step = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        spans = defaultdict(list)
        for doc, a, b in zip(shard.doc(begin).tolist(), begin.tolist(), end.tolist()):
            spans[doc].append({"start": a - int(shard.begin[doc]), "end": b - int(shard.begin[doc])})
        n = len(shard.doc_ids)
        return pa.table({
            "doc_id": pa.array(shard.doc_ids, pa.int64()),
            "shard": pa.array([table.column("shard")[0].as_py()] * n, pa.int64()),
            "place": pa.array(range(n), pa.int32()),
            "n_words": pa.array(shard.lengths, pa.int64()),
            "spans": pa.array([spans[k] for k in range(n)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "items": pa.array([sorted(found[k]) for k in range(n)], pa.list_(pa.string())),
        })

    return match


def phrase_matches(index: DataFrame, items: DataFrame, item_id="item_id", text="text", window: int = WINDOW) -> DataFrame:
    """(doc_id, shard, place, n_words, spans, items) of every indexed document.

    ``spans`` are the maximal runs of words [start, end) that lie inside an occurrence of a window of any
    item, ``items`` the sorted ids, as text, of the items with such a window.  A window is ``window``
    consecutive words of an item, or all words of a shorter one; an item without words has none.  Items
    are taken from the driver in blocks against all rows.
    """
    schema = "doc_id long, shard long, place int, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    parts = []
    for block in _blocks(items, item_id, text):
        owners: dict[tuple, set] = defaultdict(set)
        for name, own in block:
            for k in range(max(1, len(own) - window + 1)):
                if own:
                    owners[tuple(own[k : k + window])].add(name)

        vocabulary = {w for words in owners for w in words}
        parts.append(_narrowed(index, vocabulary).groupBy("shard").applyInArrow(_matcher(dict(owners)), schema))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    if len(parts) > 1:  # the spans of several blocks are merged per document
        found = found.groupBy("doc_id", "shard", "place", "n_words").agg(
            _merged(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return found


def _merged(spans):
    """Sorted spans with those that overlap or touch made one."""

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))),
        )
        return F.when(last.isNotNull() & (last["end"] >= x["start"]), joined).otherwise(F.concat(done, F.array(x)))

    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(spans, empty, step)


def proximity_matches(index: DataFrame, queries: dict[str, list[str]], width: int) -> DataFrame:
    """(doc_id, query, position): where ``width`` consecutive words hold all words of a query.

    A position is that of the first of the query's words in such a span.  Queries are few and given
    by name.
    """
    wanted = {name: tuple(w.lower() for w in own) for name, own in queries.items() if own}

    def match(table):
        shard = _Shard(table)
        out = []
        for name, own in wanted.items():
            at = shard.near(own, width)
            doc = shard.doc(at)
            out += [(shard.doc_ids[d], name, int(p - shard.begin[d])) for d, p in zip(doc.tolist(), at.tolist())]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "query": pa.array(columns[1], pa.string()), "position": pa.array(columns[2], pa.int32())})

    vocabulary = {w for own in wanted.values() for w in own}
    return _narrowed(index, vocabulary).groupBy("shard").applyInArrow(match, "doc_id long, query string, position int")


def contamination(matches: DataFrame, one_in: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from ``phrase_matches``.

    A document is contaminated if at least one of ``one_in`` words is hit.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return matches.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def contaminated_docs(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``contamination`` of all documents (doc_id, text) by all items (item_id, text)."""
    index = materialise(build_index(docs), "positional-index")
    return contamination(phrase_matches(index, items, window=window))
