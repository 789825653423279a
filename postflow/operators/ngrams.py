"""N-grams and their frequencies.

Inside the engine a gram is one string, its words joined by ``GLUE``.  ``GLUE`` counts as a blank
when text is split, so no token contains it, and a string is a cheaper shuffle key than an array.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GLUE = "\x1f"


def ngram_arrays(tokens: str, n: int) -> Column:
    """The sliding word tuples of a token array; empty when it is shorter than ``n``."""
    tokens = F.col(tokens)
    starts = F.sequence(F.lit(1), F.size(tokens) - F.lit(n - 1))
    grams = F.transform(starts, lambda i: F.slice(tokens, i, n))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<array<string>>"))


def ngram_terms(tokens: str, n: int) -> Column:
    """The same tuples as glued strings.

    ``tokens`` must be a column: an expression would be evaluated again for every gram.
    """
    tokens = F.col(tokens)
    if n == 1:
        return tokens
    heads = F.slice(tokens, 1, F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0)))
    return F.transform(
        heads,
        lambda word, i: F.concat_ws(GLUE, word, *[F.get(tokens, i + F.lit(k)) for k in range(1, n)]),
    )


def with_ngrams(df: DataFrame, n: int, tokens: str = "stem_tokens", out=None) -> DataFrame:
    """T15 as a column of tuples."""
    return df.withColumn(out or f"grams_{n}", ngram_arrays(tokens, n))


def each_term(df: DataFrame, terms: Column) -> DataFrame:
    """(term), one row for each.

    The outer form keeps the optimizer from deriving a filter on the array, which it would push
    down and compute the whole cleaning for a second time.
    """
    return df.select(F.explode_outer(terms).alias("term")).filter(F.col("term").isNotNull())


def count_terms(df: DataFrame, terms: Column) -> DataFrame:
    """A5: (term, frequency).  Partial counts are merged per task before the one shuffle."""
    return each_term(df, terms).groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))


def gram_runs(df: DataFrame, n: int, tokens: str) -> DataFrame:
    """(least, run): the texts cut into runs of neighbouring ``n``-grams with the same least hash of two neighbouring words.

    A run is a string of words, so words that grams share travel once.  The hash depends on the gram alone, so all copies
    of a gram are in runs of the same ``least``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hashes = batch.column(0).drop_null(), batch.column(1).drop_null()
            flat, hashed = words.flatten(), hashes.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            starts = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            at = np.concatenate([np.zeros(0, np.int64), *[np.arange(a, b - n + 1) for a, b in zip(starts, starts[1:]) if b - a >= n]])
            if not len(at):
                continue
            pairs = (hashed[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashed[1:] + np.uint64(0x7F4A7C15))
            pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            least = np.lib.stride_tricks.sliding_window_view(pairs, n - 1)[at].min(axis=1)
            first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)]))
            last = np.concatenate([first[1:], [len(at)]]) - 1
            begin, size = at[first], at[last] - at[first] + n
            offsets = np.concatenate([[0], np.cumsum(size)])
            place = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.take(pa.array(place)))
            yield pa.RecordBatch.from_arrays([pa.array(least[first].view(np.int64)), pc.binary_join(runs, GLUE)], ["least", "run"])

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return df.select(F.col(tokens).alias("words"), hashed.alias("hashes")).mapInArrow(cut, "least long, run string")


def count_grams(df: DataFrame, n: int, tokens: str) -> DataFrame:
    """A5: (term, frequency) of the ``n``-grams; long ones travel as ``gram_runs``, about half of their words."""
    if n < 4:
        return count_terms(df, ngram_terms(tokens, n))
    dealt = gram_runs(df, n, tokens).repartition("least").select("least", F.split("run", GLUE).alias("words"))
    grams = dealt.select("least", F.explode(ngram_terms("words", n)).alias("term"))
    return grams.groupBy("least", "term").agg(F.count(F.lit(1)).alias("frequency")).drop("least")


def distinct_terms(counts: DataFrame) -> Column:
    """The number of rows of a count table, as a scalar.

    It reads ``frequency``, so the plan equals the one that computes the counts and its shuffle
    output is reused instead of being computed twice.
    """
    return counts.agg(F.count_if(F.col("frequency") > 0)).scalar()


def gram_frequency(
    df: DataFrame, n: int, tokens: str = "stem_tokens", denominator: str = "distinct"
) -> DataFrame:
    """Every n-gram with its frequency and relative frequency.

    The relative frequency divides by the number of distinct grams (Q1); ``denominator="total"``
    divides by the number of grams instead, so that the values sum to one.
    """
    counts = count_grams(df, n, tokens)
    if denominator == "distinct":
        size = distinct_terms(counts)
    elif denominator == "total":
        size = counts.agg(F.sum("frequency")).scalar()
    else:
        raise ValueError(f"unknown denominator {denominator!r}")
    return counts.select(
        F.lit(n).alias("n"),
        F.split("term", GLUE).alias("gram"),
        "frequency",
        (F.col("frequency") / size).alias("relative_frequency"),
    )


def edge_words(df: DataFrame, tokens: str = "stem_tokens") -> DataFrame:
    """How often each word starts and ends a post; posts without words drop out."""
    t = F.col(tokens)
    edges = F.array(
        F.struct(F.lit("first").alias("side"), F.get(t, F.lit(0)).alias("word")),
        F.struct(F.lit("last").alias("side"), F.try_element_at(t, F.lit(-1)).alias("word")),
    )
    return (
        df.select(F.inline(edges))
        .filter(F.col("word").isNotNull())
        .groupBy("side", "word")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
