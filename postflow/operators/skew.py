"""Joins that keep a hot key from landing in one task."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.session import materialise

#: A hot dictionary entry is one that covers at least this fraction of all rows, so there can be
#: no more than ``HOT_ENTRIES`` of them, whatever the size of the data.
HOT_ENTRIES = 100_000
#: Characters of a hot term that are broadcast; a hash stands for the rest of a longer one, which
#: bounds the broadcast part in bytes.
HEAD = 64


def _term_key(term: str = "term") -> list[Column]:
    """A term of any length as two columns of bounded size: exact up to HEAD characters."""
    head = F.substring(term, 1, HEAD)
    tail = F.when(F.length(term) > HEAD, F.xxhash64(term)).otherwise(F.lit(0).cast("long"))
    return [head.alias("_head"), tail.alias("_tail")]


def _split(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hot, cold): the entries that are broadcast, by ``_term_key``, and the others, by term."""
    rows = table.agg(F.sum("frequency")).scalar()
    is_hot = F.col("frequency") * F.lit(HOT_ENTRIES) >= rows
    # At most HOT_ENTRIES rows of at most HEAD characters: a few megabytes.
    hot = F.broadcast(table.filter(is_hot).select(*_term_key(), "value"))
    return hot, table.filter(~is_hot).select("term", "value")


def lookup(terms: DataFrame, table: DataFrame) -> DataFrame:
    """``terms`` with the ``value`` of each, joined in the two ways of ``sum_of_lookups``."""
    hot, cold = _split(table)
    keyed, on = terms.select("*", *_term_key()), ["_head", "_tail"]
    far = keyed.join(hot, on, "left_anti").drop(*on).join(cold, "term")
    return keyed.join(hot, on).drop(*on).unionByName(far)


def sum_of_lookups(
    terms: DataFrame,
    table: DataFrame,
    key: Sequence[str],
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per ``key``, the number of its terms and the sum of their values.

    ``terms`` holds (key.., term), with one null term for a key without any, and ``table`` holds
    (term, frequency, value) with one row per term, where ``frequency`` counts the term in all of
    the corpus.  The result is (key.., terms, total); ``totals`` names several sums instead, each
    over the terms that meet its condition.  Word frequencies are steeply skewed, so the join is
    split exactly in two:

    * entries above ``1 / HOT_ENTRIES`` of all rows, at most ``HOT_ENTRIES`` of them, are broadcast.
      They cover most rows, which are summed per key before anything is shuffled;
    * the terms that miss are counted per key and term in the same pass, and joined by a shuffle in
      which no term can be hot any more.
    """
    totals = totals or {"total": F.lit(True)}
    hot, cold = _split(table)
    found = terms.select("*", *_term_key()).join(
        hot.withColumn("_hit", F.lit(True)), ["_head", "_tail"], "left"
    )
    missed = F.when(F.col("_hit").isNull(), F.col("term"))
    sums = {name: F.sum(F.when(meets, F.col("value"))) for name, meets in totals.items()}
    once = materialise(
        found.withColumn("_missed", missed).groupBy(*key, "_missed").agg(
            F.count("term").alias("terms"), *[total.alias(name) for name, total in sums.items()]
        ),
        "lookups",
    )
    near = once.filter("_missed is null").drop("_missed")
    weighted = F.col("value") * F.col("terms")
    far = (
        once.filter("_missed is not null").select(*key, F.col("_missed").alias("term"), "terms")
        .join(cold, "term")
        .groupBy(*key)
        .agg(
            F.sum("terms").alias("terms"),
            *[F.sum(F.when(meets, weighted)).alias(name) for name, meets in totals.items()],
        )
    )
    return (
        near.unionByName(far)
        .groupBy(*key)
        .agg(F.sum("terms").alias("terms"), *[F.sum(name).alias(name) for name in totals])
    )
