"""The four stages, parse, curate, condition and load, as one chain of DataFrames.

Stages are cut only where a result has several consumers: the tokens, the scored posts and the
daily sums.  Those cuts are Parquet tables in the shared folder.  Values per user stay in long form,
one row per day, user and measure, so any number of users will do; ``widen`` makes columns of some.
"""

import datetime
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.functions.dates import ZONE, with_local_day
from postflow.functions.entities import with_entities
from postflow.functions.text import ENGLISH_STOP_WORDS, stop_list
from postflow.operators import daily as dy
from postflow.operators import features as ft
from postflow.operators import prices as pr
from postflow.operators.ingest import append_new, keep_roster
from postflow.operators.keys import to_long, with_keys
from postflow.operators.ngrams import with_ngrams
from postflow.operators.scoring import post_scores, share_of_log_total
from postflow.operators.tokens import clean_text
from postflow.schemas import POST_KEY, POSTS
from postflow.session import materialise
from postflow.sources.posts import flatten_posts, quarantine

#: What is summed per user.
MEASURES = ("unigram", "bigram")


@dataclass(frozen=True)
class Config:
    """What the stages need to know.

    ``labels`` maps ticker symbols to column names and ``today`` ends the price range.  ``users`` selects
    whose scores are reported, all users when None; the totals of a day, and the statistics that scores
    rest on, are always those of all posts.  ``stems`` off scores words instead of stems.
    """

    labels: Mapping[str, str]
    users: Sequence[str] | None = None
    target: str = "SandP_500"
    target_days: int = 5
    zone: str = ZONE
    today: datetime.date | None = None
    stop_words: Sequence[str] = field(default_factory=stop_list)
    library_stop_words: Sequence[str] = tuple(ENGLISH_STOP_WORDS)
    keep_text: bool = False
    stems: bool = True


@dataclass(frozen=True)
class Stages:
    """The tables of a run.

    ``rolled``, ``features``, ``normalized`` and ``latest`` have one row per day, with prices and totals;
    ``cells`` and ``latest_cells`` hold the users' values of the days of ``features`` and ``latest`` as
    (date, user, measure, value), 0 on a day without posts of a user.
    """

    tokens: DataFrame
    scored: DataFrame
    by_user: DataFrame
    rolled: DataFrame
    features: DataFrame
    normalized: DataFrame
    cells: DataFrame
    latest: DataFrame
    latest_cells: DataFrame
    long: DataFrame


def parse(
    raw: DataFrame, roster: DataFrame | None = None, history: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(posts, bad): landed raw records as posts with their entities, and those without a usable id.

    Reposts are dropped.  With a ``roster`` (group, user) only listed users stay, in the history too;
    with a ``history`` the result is the history and the posts that are newer than a user's last.
    Records that can't be used never stop the others.
    """
    good, bad = quarantine(raw)
    posts = with_entities(flatten_posts(good)).select(*POSTS.fieldNames())
    posts = posts.dropDuplicates([*POST_KEY]) if history is None else append_new(history, posts)
    return (posts if roster is None else keep_roster(posts, roster)), bad


def curate(posts: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Clean and score posts: (tokens, scored), both with a ``row_id``.

    Row identity is the position in the stored tokens table, so copies of a post are scored one by
    one, and an 8-byte key is all that the scoring shuffles carry.
    """
    cleaned = clean_text(
        with_local_day(posts, zone=config.zone),
        stop=config.stop_words,
        library_stop=config.library_stop_words,
        **({} if config.stems else {"stem_fn": None}),
    )
    words = "stem_tokens" if config.stems else "nonstem_tokens"
    if not config.keep_text:
        cleaned = cleaned.drop("text")
    tokens = materialise(cleaned.withColumn("row_id", F.monotonically_increasing_id()), "tokens")
    key = ["row_id"]
    narrow = tokens.select("row_id", "date", "group", "user", "id", *dy.COUNTS)
    scored = materialise(narrow.join(post_scores(tokens, key, words), key), "scored")
    for name in ("unigram", "bigram"):
        scored = share_of_log_total(scored, f"{name}_logprob", f"{name}_share")
    return tokens, scored


def scored_posts(tokens: DataFrame, scored: DataFrame) -> DataFrame:
    """Every column of a post with its tokens, its 2- to 5-grams and its scores."""
    scores = [c for c in scored.columns if c not in tokens.columns]
    # The grams are made after the join: they are many times as large as the tokens.
    wide = tokens.join(scored.select("row_id", *scores), "row_id")
    grams = {f"{name}_sentence": n for n, name in enumerate(("bigram", "trigram", "quadgram", "pentagram"), start=2)}
    for name, n in grams.items():
        wide = with_ngrams(wide, n, out=name)
    return wide.select(*[c for c in tokens.columns if c != "row_id"], *grams, *scores)


def user_cells(by_user: DataFrame, days: DataFrame, users: Sequence[str] | None = None) -> DataFrame:
    """R2, P7, A14 in long form: (date, user, measure, value) of the users that posted, on each of ``days``.

    Weekends are rolled into Monday.  A cell that is not there is zero, as a pivot would fill it: rows grow with the
    posts, not with users times days, and ``widen`` fills what it makes columns of.  ``days`` has one row per day, so
    their list is small.  Named ``users`` are the only ones that are returned.
    """
    own = by_user.select("date", "user", *MEASURES).filter("user is not null")
    if users is not None:
        own = own.filter(F.col("user").isin(list(users)))
    rolled = dy.roll_weekend(own, by=["user"], fill_calendar=False)
    dates = days.agg(F.collect_set("date")).scalar()
    return rolled.filter(F.array_contains(dates, F.col("date"))).unpivot(["date", "user"], [*MEASURES], "measure", "value")


def filled_cells(by_user: DataFrame, days: DataFrame, users: Sequence[str] | None = None) -> DataFrame:
    """R2, P7, A14 in long form: the ``user_cells`` of every user on each of ``days``, 0 where a user has none.

    Named ``users`` without posts have zeros.
    """
    spark = by_user.sparkSession
    cells = user_cells(by_user, days, users)
    if users is None:
        who = by_user.filter("user is not null").select("user").distinct()
    else:
        who = spark.createDataFrame([(u,) for u in dict.fromkeys(users)], "user string")
    dates = days.agg(F.array_sort(F.collect_set("date"))).scalar()
    measures = F.array(*[F.lit(m) for m in MEASURES])
    grid = who.select("user", F.explode(dates).alias("date")).select("date", "user", F.explode(measures).alias("measure"))
    found = grid.join(cells, ["date", "user", "measure"], "left")
    return found.select("date", "user", "measure", F.coalesce("value", F.lit(0.0)).alias("value"))


def widen(daily: DataFrame, cells: DataFrame, users: Sequence[str]) -> DataFrame:
    """R2: ``daily`` with a column per measure and user, 0 where there is no cell; for as many users as a table can have columns."""
    name = F.concat_ws("_", "measure", "user")
    columns = [f"{m}_{u}" for u in users for m in MEASURES]
    wide = cells.withColumn("_name", name).groupBy("date").pivot("_name", columns).agg(F.first("value"))
    found = daily.join(wide, "date", "left")
    return found.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in columns})


def condition(scored: DataFrame, bars: DataFrame, config: Config) -> dict[str, DataFrame]:
    """Daily features next to prices, plain and scaled, and those of the latest price."""
    shares = {"unigram": "unigram_share", "bigram": "bigram_share"}
    by_user = materialise(dy.daily_by_user(scored, shares), "by_user")
    rolled = dy.roll_weekend(dy.daily_totals(by_user))

    first_day = by_user.agg(F.min("date")).scalar()
    today = config.today or datetime.date.today()
    closes = pr.in_range(pr.daily_close(bars), first_day, today)
    prices = pr.price_wide(closes, config.labels)
    features = materialise(ft.build_features(prices, rolled), "features")

    scaled = [*dict.fromkeys(label for label in config.labels.values() if label.strip()), *dy.COUNTS]
    normalized = ft.normalize_columns(features, scaled)
    if config.target in features.columns:
        target = ft.with_target(features, config.target_days, config.target).select("date", "y")
        normalized = normalized.join(target, "date")
    latest = ft.latest_features(pr.latest_wide(bars, config.labels), rolled, features, scaled)
    return {
        "by_user": by_user,
        "rolled": rolled,
        "features": features,
        "normalized": normalized,
        "cells": filled_cells(by_user, features.select("date"), config.users),
        "latest": latest,
        "latest_cells": filled_cells(by_user, latest.select("date"), config.users),
    }


def load(
    normalized: DataFrame, cells: DataFrame | None = None, previous: DataFrame | None = None
) -> DataFrame:
    """The scaled features and the users' values in long form, with keys."""
    long = to_long(normalized.drop("y"))
    if cells is not None:
        name = F.concat_ws("_", "measure", "user").alias("twitter_ticker")
        long = long.unionByName(cells.select("date", name, F.col("value").cast("double").alias("value")))
    return with_keys(long, previous)


def run(
    posts: DataFrame, bars: DataFrame, config: Config, previous: DataFrame | None = None
) -> Stages:
    """All stages from posts and price bars (ts, date, ticker_name, close) to the long table.

    Raw records become posts by ``parse``.  Without posts every table is empty.
    """
    tokens, scored = curate(posts, config)
    tables = condition(scored, bars, config)
    return Stages(tokens, scored, long=load(tables["normalized"], tables["cells"], previous), **tables)
