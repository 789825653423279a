"""Token ids in compact binary files (operator 2).

Ids are replaced by their frequency rank, so the commonest 256 take one byte and the next 65,280 take
two, and are coded as ``vbyte`` does.  A set of files is a folder with ``ranks``, the id of every rank,
and ``blocks``, whose rows each hold one file image in the column ``payload``:

    magic b"PFT1", documents (u4), for each document its id (i8), whether that is null (u1) and its
    number of ids (u4), each kind of number together; then the control bytes and the data bytes of all documents.

All numbers are little-endian.  Every document begins a new quad.  Files are ordered by shard and
block, and hold the documents in ascending id order, null ids first.  They are rows of a table, not
files of their own, because only Spark's writers reach every kind of shared storage.
"""

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postflow.llm import text as tx
from postflow.llm import vbyte

MAGIC = b"PFT1"
#: Bytes of control and data after which a file ends.
FILE_BYTES = 1 << 20
#: Words whose ids a worker remembers between slices.
MEMO_WORDS = 400_000
#: Letters that stay one letter when lower-cased and composed; a blank after them parts no word and no accent.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{400}-\x{481}\x{4E00}-\x{9FA5}"


def _places(begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, places): ``counts[i]`` numbers from ``begin[i]`` on for every i, and where those of each end."""
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return ends, np.arange(ends[-1]) + np.repeat(begin - ends[:-1], counts)


class Encoder:
    """A tokenizer and the ids of the words that it has met most often, as arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.terms = pa.array([], pa.large_string())
        self.sizes, self.flat, self.met = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int32)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _batches(self, texts: list[str], size: int) -> Iterator[list[int]]:
        for at in range(0, len(texts), size):
            for coded in self.tokenizer.encode_batch_fast(texts[at : at + size], add_special_tokens=False):
                yield coded.ids

    def _encode(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of new terms.

        A term of letters only is one word to the tokenizer, whose last id tells its end if there is an
        end-of-word suffix.  Many such terms are encoded as one text; should the ends not be as many as the
        terms, and for all other terms, each is encoded by itself.
        """
        plain = np.zeros(len(terms), bool)
        if self.ends.any():
            plain = pc.ascii_is_alpha(terms).to_numpy(zero_copy_only=False).copy()
            wide = np.flatnonzero(~plain & ~pc.string_is_ascii(terms).to_numpy(zero_copy_only=False))
            plain[wide] = [t.isalpha() and t.lower().isalpha() for t in terms.take(pa.array(wide)).to_pylist()]
        order, sizes, found, single = [], [], [], [np.flatnonzero(~plain)]
        where = np.flatnonzero(plain)
        words = terms.take(pa.array(where)).to_pylist()
        texts = [" ".join(words[at : at + 50]) for at in range(0, len(words), 50)]
        del words
        for at, coded in zip(range(0, len(where), 50), self._batches(texts, 100)):
            part, ids = where[at : at + 50], np.array(coded, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                single.append(part)
                continue
            order.append(part)
            sizes.append(np.diff(ends, prepend=0))
            found.append(ids)
        single = np.concatenate(single)
        for coded in self._batches(terms.take(pa.array(single)).to_pylist(), 5_000):
            sizes.append(np.array([len(coded)]))
            found.append(np.array(coded, np.uint32))
        order = np.concatenate([*order, single])
        sizes, found = np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, np.uint32), *found])
        back = np.argsort(order)
        return sizes[back], found[_places((np.cumsum(sizes) - sizes)[back], sizes[back])[1]]

    def _keep(self, chosen: np.ndarray) -> None:
        begin = np.cumsum(self.sizes) - self.sizes
        self.flat = self.flat[_places(begin[chosen], self.sizes[chosen])[1]]
        self.terms, self.sizes, self.met = self.terms.take(pa.array(chosen)), self.sizes[chosen], self.met[chosen] // 2

    def __call__(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, sizes, flat): the ids of term i are ``flat[begin[i]:begin[i] + sizes[i]]``; terms are distinct."""
        at = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        sizes, flat = self._encode(terms.take(pa.array(new)))
        at[new] = len(self.terms) + np.arange(len(new))
        self.terms = pa.concat_arrays([self.terms, terms.take(pa.array(new))])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
        self.met[at] += 1
        out = (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at], self.flat
        if len(self.terms) > MEMO_WORDS:
            # Those met in most slices stay, so that the next slices can add as many as go.
            self._keep(np.sort(np.argsort(-self.met, kind="stable")[: MEMO_WORDS // 2]))
        return out


def encode_words(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of every text, for a tokenizer that never joins across ASCII white space.

    Then a text's ids are those of its words, and each distinct word is encoded once.  The tokenizer is
    also taken to lower-case and to part letters and digits from punctuation, so A-Z are lower-cased and
    a blank is put before punctuation that follows a letter or digit; both leave the ids as they are and
    make far fewer words distinct.  Where special tokens may be spelled out, words stay as they are.
    """
    if pc.any(pc.match_substring(texts, "<|")).as_py():
        found = tx.words(texts)
    else:
        found = tx.words(pc.replace_substring_regex(texts, rf"([0-9{LETTERS}])([.,;:!?])", r"\1 \2"), tx.LOWER)
    begin, sizes, flat = tx.kept(f"encoder {path}", lambda: Encoder(path))(found.terms)
    ends, at = _places(begin[found.codes], sizes[found.codes])
    return ends[found.offsets], flat[at]


def token_ids(docs: DataFrame, path: str, end_id: int, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text and ``end_id``, as little-endian 32-bit integers.

    A null text has only the end id.  ``path`` must be readable on every executor.
    """

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text", 4 << 20):
            offsets, flat = encode_words(tx.column(part, "text"), path)
            end = np.array([end_id], "<u4").tobytes()
            out = [flat[a:b].tobytes() + end for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([tx.column(part, "doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(ids, "doc_id long, ids binary")


def ranked_ids(coded: DataFrame, end_id: int) -> np.ndarray:
    """All ids that occur, the commonest first; equally common ones by id.

    Ids are counted per task before the shuffle; what reaches the driver is a row per id of the
    vocabulary.
    """

    def counts(batches):
        total = np.zeros(end_id + 1, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                flat = np.frombuffer(b"".join(batch.column(0).slice(at, 1000).to_pylist()), "<u4")
                found = np.bincount(flat, minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    found = coded.select("ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r["id"] for r in sorted(found.collect(), key=lambda r: (-r["n"], r["id"]))], np.uint32)


def _payload(rows: list[tuple]) -> bytes:
    ids = np.array([0 if r[0] is None else r[0] for r in rows], "<i8")
    null = np.array([r[0] is None for r in rows], np.uint8)
    counts = np.array([r[1] for r in rows], "<u4")
    head = MAGIC + np.array([len(rows)], "<u4").tobytes()
    return b"".join([head, ids.tobytes(), null.tobytes(), counts.tobytes(), *[r[2] for r in rows], *[r[3] for r in rows]])


def read_payload(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, offsets, ranks) of one file image."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token file")
    n = int(np.frombuffer(payload, "<u4", 1, 4)[0])
    ids = np.frombuffer(payload, "<i8", n, 8)
    null = np.frombuffer(payload, np.uint8, n, 8 + 8 * n)
    counts = np.frombuffer(payload, "<u4", n, 8 + 9 * n).astype(np.int64)
    quads = -(-counts // 4)
    body = 8 + 13 * n
    control, data = payload[body : body + int(quads.sum())], payload[body + int(quads.sum()) :]
    values = vbyte.decode(control, data)
    begin = np.cumsum(quads * 4) - quads * 4
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], counts)
    return [None if z else i for i, z in zip(ids.tolist(), null)], offsets, values[at]


def write_files(coded: DataFrame, path: str, end_id: int, shards: int) -> None:
    """Write the rows of ``token_ids`` as a set of files below ``path``.

    Shards are ranges of document ids with about as many documents each; all rows of an id are in
    one shard, and a shard is cut into files of a few MB.
    """
    spark = coded.sparkSession
    order = ranked_ids(coded, end_id)
    table = pa.array(order.tolist(), pa.int64())
    spark.createDataFrame(
        [(table.to_pylist(),)], "ids array<long>"
    ).coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    cuts = coded.agg(
        F.percentile_approx("doc_id", F.array(*[F.lit(k / shards) for k in range(1, shards + 1)]), 10_000)
    ).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def streams(batches):
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                keys = np.searchsorted(cuts, np.where(np.isnan(ids), -(2**63), ids) if ids.dtype.kind == "f" else ids)
                keys = np.where(np.asarray(part.column(0).is_null()), -1, keys)
                counts, control, data = [], [], []
                for value in part.column(1).to_pylist():
                    found = rank[np.frombuffer(value, "<u4")]
                    a, b = vbyte.encode(found)
                    counts.append(len(found))
                    control.append(a)
                    data.append(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), part.column(0), pa.array(counts, pa.int64()),
                     pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                    ["shard", "doc_id", "n", "control", "data"],
                )

    def files(batches):
        shard, block, rows, size = None, 0, [], 0

        def image():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([block], pa.int64()),
                 pa.array([sum(r[1] for r in rows)], pa.int64()), pa.array([_payload(rows)], pa.binary())],
                ["shard", "block", "n_tokens", "payload"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (row[0] != shard or size >= FILE_BYTES):
                    yield image()
                    block = block + 1 if row[0] == shard else 0
                    rows, size = [], 0
                shard = row[0]
                rows.append(row[1:])
                size += len(row[3]) + len(row[4])
        if rows:
            yield image()

    out = (
        coded.mapInArrow(streams, "shard long, doc_id long, n long, control binary, data binary")
        .repartition("shard")
        .sortWithinPartitions("shard", "doc_id", "n", "control", "data")
        .mapInArrow(files, "shard long, block long, n_tokens long, payload binary")
    )
    out.write.parquet(f"{path}/blocks")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files below ``path``.

    ``start`` counts the ids of all documents before it; rows of one document id follow each other in
    a fixed order.
    """
    order = np.array(spark.read.parquet(f"{path}/ranks").first()["ids"], "<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row per shard, then one per file: prefix sums of the numbers of ids, without the images.
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    inside = Window.partitionBy("shard").orderBy("block")
    own = blocks.select("shard", "block", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("own"))
    starts = own.join(before, "shard").select("shard", "block", (F.col("own") + F.col("before")).alias("start"))

    def documents(batches):
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, offsets, ranks = read_payload(payload.as_py())
                flat = order[ranks]
                for at in range(0, len(ids), 1000):
                    ends = list(zip(offsets[at : at + 1000], offsets[at + 1 : at + 1001]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at : at + 1000], pa.int64()),
                         pa.array([start + int(a) for a, _ in ends], pa.int64()),
                         pa.array([flat[a:b].tobytes() for a, b in ends], pa.binary())],
                        ["doc_id", "start", "ids"],
                    )

    rows = blocks.select("shard", "block", "payload").join(starts, ["shard", "block"]).select("start", "payload")
    return rows.mapInArrow(documents, "doc_id long, start long, ids binary")


def checksums(found: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the rows of ``read_files``, in JVM expressions."""
    return found.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
