"""The long table and its keys."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NATURAL_KEY = ("date", "twitter_ticker")


def to_long(features: DataFrame) -> DataFrame:
    """One row per day and column; empty cells stay as null values."""
    cells = {c: F.col(f"`{c}`") for c in features.columns if c != "date"}
    doubles = features.select("date", *[cell.cast("double").alias(c) for c, cell in cells.items()])
    return doubles.unpivot("date", list(cells.values()), "twitter_ticker", "value")


def stable_uuid(*columns: str) -> Column:
    """L1: a UUID-shaped digest of the natural key, the same in every retry and every run."""
    digest = F.md5(F.concat_ws("~", *[F.col(c).cast("string") for c in columns]))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")


def with_keys(
    long: DataFrame, previous: DataFrame | None = None, random: bool = False
) -> DataFrame:
    """Give each row a ``uuid``, the stored one where the row is known.

    Rows are matched on their natural key and carry the current value.  Random keys are not stable
    when a task is retried: write the result before using it twice.
    """
    new = F.uuid() if random else stable_uuid(*NATURAL_KEY)
    if previous is None:
        return long.withColumn("uuid", new)
    known = previous.select(*NATURAL_KEY, F.col("uuid").alias("_known"))
    return (
        long.join(known, [*NATURAL_KEY], "left")
        .withColumn("uuid", F.coalesce("_known", new))
        .drop("_known")
    )
