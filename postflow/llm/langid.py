"""Language identification by hyperdimensional profiles (operator 9).

Every letter has a random vector of +1 and -1.  A trigram's vector binds its letters: the product of
their vectors, the first rotated by two places and the second by one.  A text's vector bundles (sums)
its trigrams, a language's prototype bundles the unit vectors of its texts, and a text takes the
language whose prototype has the largest cosine with it.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.llm.text import column, slices

#: Components of a vector.
SIZE = 1024
#: Labelled texts that a language's prototype is learned from, about; a language with fewer gives all.
TRAIN_TEXTS = 4_000
#: Trigrams whose vectors are made at once.
_BLOCK = 4096


class Profiles(NamedTuple):
    """Languages and their prototypes, unit vectors as rows."""

    langs: list[str]
    prototypes: np.ndarray


def _letter_vectors(letters: np.ndarray, size: int) -> np.ndarray:
    """A row of +1 and -1 for each code point, the same on every machine."""
    with np.errstate(over="ignore"):
        x = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = x + np.arange(1, size // 64 + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    bits = np.unpackbits(x.view(np.uint8).reshape(len(letters), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1



def bundles(texts: list[str | None], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, has): the bundled trigrams of each text, and whether it holds a letter.

    Letters are lower-cased, every run of other characters is one blank, and a blank stands at both
    ends.  Letters are Unicode's.
    """
    joined = " ".join(t.lower() if t else "" for t in texts)  # for the set of characters only
    table = {c: c if c.isalpha() else " " for c in set(joined)}
    letters = np.array(sorted({ord(c) for c in table.values()} | {32}), np.int64)
    lookup = np.full(max(map(ord, table), default=32) + 1, np.searchsorted(letters, 32), np.int64)
    for c, to in table.items():
        lookup[ord(c)] = np.searchsorted(letters, ord(to))
    blank = int(np.searchsorted(letters, 32))
    parts = [f" {t.lower()} " if t else " " for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = lookup[points]
    doc = np.repeat(np.arange(len(texts)), lengths)
    # A text begins and ends with a blank, so no run of blanks is cut between two texts.
    same = np.concatenate([[False], (ids[1:] == blank) & (ids[:-1] == blank) & (doc[1:] == doc[:-1])])
    ids, doc = ids[~same], doc[~same]
    has = np.bincount(doc[ids != blank], minlength=len(texts)) > 0
    vectors = np.zeros((len(texts), size), np.float32)
    whole = doc[2:] == doc[:-2]
    n = len(letters)
    codes = ((ids[:-2] * n + ids[1:-1]) * n + ids[2:])[whole]
    if not len(codes):
        return vectors, has
    kinds, place = np.unique(codes, return_inverse=True)
    keys, counts = np.unique(doc[:-2][whole] * len(kinds) + place, return_counts=True)
    row, kind = keys // len(kinds), keys % len(kinds)
    base = _letter_vectors(letters, size)
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    order = np.argsort(kind, kind="stable")
    row, kind, counts = row[order], kind[order], counts[order]
    for low in range(0, len(kinds), _BLOCK):
        part = kinds[low : low + _BLOCK]
        bound = first[part // n // n] * second[part // n % n] * base[part % n]
        a, b = np.searchsorted(kind, [low, low + len(part)])
        matrix = np.zeros((len(texts), len(part)), np.float32)
        matrix[row[a:b], kind[a:b] - low] = counts[a:b]
        vectors += matrix @ bound
    return vectors, has


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def learn(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    most: int = TRAIN_TEXTS,
    size: int = SIZE,
    seed: str = "doc_id",
) -> Profiles:
    """The profiles of all non-null languages of ``labelled``.

    Each language learns from about ``most`` texts, picked by a hash of the column ``seed``; this bound
    is the only sample taken.  A language without a letter in its texts is not learned.  The number
    of languages is taken to be small, each costs ``size`` numbers on the driver.
    """
    rows = labelled.select(
        labelled[text].alias("text"), labelled[lang].alias("lang"), F.xxhash64(F.coalesce(labelled[seed].cast("string"), F.lit(""))).alias("pick")
    ).filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return Profiles([], np.zeros((0, size), np.float32))
    share = {r["lang"]: min(1.0, most / r["count"]) for r in counts}
    if all(s == 1 for s in share.values()):
        kept = rows
    else:  # the hash is uniform over all long values
        below = F.create_map(*[F.lit(x) for k, s in share.items() for x in (k, s)])
        kept = rows.filter(F.pmod("pick", F.lit(1 << 30)) < below[F.col("lang")] * F.lit(1 << 30))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in slices(batches, "text", 1 << 20):
            vectors, has = bundles(column(part, "text").to_pylist(), size)
            langs = np.array(column(part, "lang").to_pylist(), object)
            units = _unit(vectors)
            for name in set(langs[has]):
                total[name] = total.get(name, 0) + units[has & (langs == name)].sum(axis=0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)), pa.array([v.tolist() for v in total.values()])], ["lang", "sums"]
            )

    # A row for each task and language; they are added up on the driver, a few kB each.
    bundled = kept.select("text", "lang").mapInArrow(sums, "lang string, sums array<double>")
    folded = (
        bundled.select("lang", F.posexplode("sums").alias("at", "value"))
        .groupBy("lang", "at").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("sums"))
        .orderBy("lang").collect()
    )
    matrix = np.array([[x["value"] for x in r["sums"]] for r in folded], np.float64)
    return Profiles([r["lang"] for r in folded], _unit(matrix.reshape(len(folded), size)).astype(np.float32))


def predict(
    docs: DataFrame, profiles: Profiles, doc_id="doc_id", text="text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, lang_pred, score) and the columns ``keep`` of every row.

    The score is the cosine with the predicted language, 0 if negative.  A text that is null or has
    no letter is ``und`` with score 0, and so is every text where no language was learned.  Equal
    cosines go to the language that sorts first.
    """
    names = [doc_id, *[c for c in keep if c != doc_id]]
    rows = docs.select(*[docs[c] for c in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    read = text if text in names else "_text"  # a text that is kept goes to the task once
    if read not in names:
        rows = docs.select(*[docs[c] for c in names], docs[text].alias(read))
    langs, prototypes = list(profiles.langs), profiles.prototypes

    def label(batches):
        for part in slices(batches, read, 1 << 19):
            vectors, has = bundles(column(part, read).to_pylist(), prototypes.shape[1])
            if langs:
                cosine = _unit(vectors) @ prototypes.T
                best = cosine.argmax(axis=1)
                score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0)
                found = [langs[k] if h else "und" for k, h in zip(best, has)]
            else:
                score, found = np.zeros(len(has)), ["und"] * len(has)
            yield pa.RecordBatch.from_arrays(
                [column(part, c) for c in names] + [pa.array(found, pa.string()), pa.array(score, pa.float64())],
                [*names, "lang_pred", "score"],
            )

    return rows.mapInArrow(label, f"{schema}, lang_pred string, score double")
