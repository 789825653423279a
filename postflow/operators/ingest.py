"""Rosters and incremental loads.

Joins by user are plain: rosters and marks are small, so they are broadcast when their measured size
allows; beyond that, adaptive execution splits a user with a large part of the rows over more tasks as
the data grows, which needs no fixed number of salts.  Repeats are dropped after the old posts.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.schemas import POST_KEY


def roster_long(wide: DataFrame) -> DataFrame:
    """The (group, user) pairs of a roster with one column per group."""
    pairs = wide.unpivot([], wide.columns, "group", "user")
    return pairs.filter(F.col("user") != "").distinct()


def keep_roster(posts: DataFrame, roster: DataFrame) -> DataFrame:
    """The posts of users who are listed."""
    return posts.join(roster, ["group", "user"], "left_semi")


def pruned(posts: DataFrame, roster: DataFrame) -> DataFrame:
    """The posts of users who are listed no more."""
    return posts.join(roster, ["group", "user"], "left_anti")


def id_marks(history: DataFrame, key: Sequence[str] = ("group", "user")) -> DataFrame:
    """The newest and oldest stored id of each user."""
    return history.groupBy(*key).agg(F.max("id").alias("max_id"), F.min("id").alias("min_id"))


def new_posts(history: DataFrame, batch: DataFrame) -> DataFrame:
    """The posts of a batch above each user's stored maximum, one row per post.

    All of them are kept, however many pages they came in (Q8).
    """
    marks = id_marks(history).select("group", "user", "max_id")
    fresh = batch.join(marks, ["group", "user"], "left")
    fresh = fresh.filter(F.col("max_id").isNull() | (F.col("id") > F.col("max_id"))).drop("max_id")
    return fresh.dropDuplicates([*POST_KEY])


def append_new(history: DataFrame, batch: DataFrame) -> DataFrame:
    """The history with the new posts of a batch."""
    return new_posts(history, batch).unionByName(history, allowMissingColumns=True)


def since(posts: DataFrame, start: str, column: str = "created_at") -> DataFrame:
    """posts after a point in time.  The column is left bare so that the filter is pushed."""
    return posts.filter(F.col(column) > F.lit(start).cast(posts.schema[column].dataType))


def until_id(posts: DataFrame, max_id: int) -> DataFrame:
    """posts up to an id."""
    return posts.filter(F.col("id") <= max_id)
