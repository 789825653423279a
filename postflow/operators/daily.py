"""Counts and scores per user and per local day."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.functions.dates import closing_monday, is_weekend_block

COUNTS = ("favorite_count", "retweet_count")
SCORES = {"unigram": "unigram_probability", "bigram": "bigram_probability"}


def group_sizes(posts: DataFrame) -> DataFrame:
    """A1: posts per group."""
    return posts.groupBy("group").agg(F.count(F.lit(1)).alias("posts"))


def oldest_users(posts: DataFrame, n: int = 5) -> DataFrame:
    """A2, O2: the users with the oldest first posts; instants are compared, not texts (Q13)."""
    first = posts.groupBy("user").agg(F.min("created_at").alias("first_post"))
    return first.orderBy("first_post", "user").limit(n)


def user_counts(posts: DataFrame) -> DataFrame:
    """A3: posts per user.  Order the result at the sink."""
    return posts.groupBy("user").agg(F.count(F.lit(1)).alias("posts"))


def distinct_users(posts: DataFrame, approximate: bool = False) -> DataFrame:
    """A4: the number of users."""
    if approximate:
        return posts.agg(F.approx_count_distinct("user").alias("users"))
    return posts.select("user").distinct().agg(F.count("user").alias("users"))


def daily_totals(posts: DataFrame, columns: Sequence[str] = COUNTS) -> DataFrame:
    """The sums of a day."""
    return posts.groupBy("date").agg(*[F.sum(c).alias(c) for c in columns])


def daily_by_user(
    posts: DataFrame, scores=None, counts: Sequence[str] = COUNTS
) -> DataFrame:
    """The sums of a day and user, in long form.

    This is the only pass over the posts; totals and the wide table are made from its result.
    """
    scores = SCORES if scores is None else scores
    sums = [F.sum(column).alias(name) for name, column in scores.items()]
    return posts.groupBy("date", "user").agg(*sums, *[F.sum(c).alias(c) for c in counts])


def daily_wide(
    by_user: DataFrame,
    users: Sequence[str],
    measures: Sequence[str] = tuple(SCORES),
    counts: Sequence[str] = COUNTS,
) -> DataFrame:
    """One row per day with the day's totals and one column per measure and user.

    ``users`` fixes the schema and saves a job.  For more users than a table can have columns stay
    with the long form, which holds the same values.
    """
    sums = [F.sum(m).alias(m) for m in measures]
    cells = by_user.groupBy("date").pivot("user", list(users)).agg(*sums)
    names = {f"{user}_{m}": f"{m}_{user}" for user in users for m in measures}
    if len(measures) == 1:
        names = {user: f"{measures[0]}_{user}" for user in users}
    cells = cells.withColumnsRenamed(names).na.fill(0)
    return daily_totals(by_user, counts).join(cells, "date")


def roll_weekend(
    daily: DataFrame, by: Sequence[str] = (), fill_calendar: bool = True
) -> DataFrame:
    """Add Saturday, Sunday and Monday up into that Monday.

    The other days pass unchanged.  ``fill_calendar`` adds the Mondays between the first and the
    last one that have no rows, with zeros, for each ``by`` series.
    """
    measures = [c for c in daily.columns if c != "date" and c not in by]
    block = daily.filter(is_weekend_block(F.col("date")))
    block = block.withColumn("date", closing_monday(F.col("date")))
    if fill_calendar:
        # One row per series, exploded to its Mondays: zero rows which the sum then absorbs.
        span = block.groupBy(*by).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
        weeks = F.sequence(F.lit(0), (F.date_diff("hi", "lo") / 7).cast("int"))
        mondays = F.transform(weeks, lambda week: F.date_add("lo", week * 7))
        span = span.filter(F.col("lo").isNotNull()).select(*by, F.explode(mondays).alias("date"))
        block = block.unionByName(span, allowMissingColumns=True)
    zero = {c: F.lit(0).cast(daily.schema[c].dataType) for c in measures}
    rolled = block.groupBy("date", *by).agg(
        *[F.coalesce(F.sum(c), zero[c]).alias(c) for c in measures]
    )
    rest = daily.filter(~is_weekend_block(F.col("date")))
    return rest.unionByName(rolled.select(*daily.columns))


def newest_first(df: DataFrame, *then: str) -> DataFrame:
    """O1: the order of a stored table; to be used at the sink only."""
    return df.orderBy(F.desc("date"), *then)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """O3: the newest ``n`` rows."""
    return newest_first(df).limit(n)
