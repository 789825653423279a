"""The four stages at once, against a pandas version of the same definitions."""

import collections
import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postflow.plans.pipeline import Config, filled_cells, load, parse, run, scored_posts, user_cells, widen
from postflow.schemas import RAW_POSTS

LABELS = {"^G": "SandP_500", "^I": "NASDAQ"}
WORDS = ["market", "rally", "bond", "yield", "stocks", "falling", "rises", "tech"]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    posts = []
    for i in range(150):
        when = dt.datetime(2024, 1, 1, 6) + dt.timedelta(hours=7 * i % 700, minutes=i)
        text = " ".join(rng.choices(WORDS, k=rng.randrange(7)))
        posts.append(("g", f"user{i % 4}", i, when, i % 9, i % 5, text))
    posts.append(posts[0])  # a copy is a post of its own
    bars = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=20), t, 100.0 + (d * 7 + k * 3) % 11)
            for d in range(31) for k, t in enumerate(LABELS) if d % 7 < 5]
    return posts, bars


@pytest.fixture(scope="module")
def stages(spark, data):
    posts = spark.createDataFrame(
        data[0], "group string, user string, id long, created_at timestamp_ntz, "
        "favorite_count long, retweet_count long, text string",
    )
    posts = posts.withColumn("created_at", F.col("created_at").cast("timestamp"))
    bars = spark.createDataFrame(data[1], "ts timestamp_ntz, ticker_name string, close double")
    bars = bars.withColumn("date", F.to_date("ts"))
    config = Config(labels=LABELS, today=dt.date(2024, 1, 30), keep_text=True)
    return run(posts, bars, config)


def expected(data):
    """The daily features in pandas."""
    frame = pd.DataFrame(data[0], columns="group user id created favorite_count retweet_count text".split())
    local = frame.created.dt.tz_localize("UTC").dt.tz_convert("US/Eastern")
    frame["date"] = pd.to_datetime(local.dt.strftime("%Y-%m-%d"))
    stem = {"stocks": "stock", "falling": "fall", "rises": "rise"}
    tokens = [[stem.get(w, w) for w in t.split()] for t in frame.text]
    uni = collections.Counter(w for t in tokens for w in t)
    bi = collections.Counter(p for t in tokens for p in zip(t, t[1:]))
    first = collections.Counter(t[0] for t in tokens if t)
    last = collections.Counter(t[-1] for t in tokens if t)
    n = len(tokens)
    frame["unigram"] = [math.prod(uni[w] / len(uni) for w in t) for t in tokens]
    frame["bigram"] = [
        math.prod(bi[p] / uni[p[0]] for p in zip(t, t[1:])) * first[t[0]] * last[t[-1]] / n / n if len(t) > 1 else 0
        for t in tokens
    ]
    for c in ("unigram", "bigram"):
        frame[c] /= frame[c].sum()
    totals = frame.groupby("date")[["favorite_count", "retweet_count"]].sum()
    cells = frame.pivot_table(index="date", columns="user", values=["unigram", "bigram"], aggfunc="sum", fill_value=0)
    cells.columns = ["_".join(c) for c in cells.columns]
    wide = totals.join(cells).reset_index()
    block = wide.date.dt.day_name().isin(["Saturday", "Sunday", "Monday"])
    rolled = wide[block].groupby(pd.Grouper(key="date", freq="W-MON")).sum().reset_index()
    rolled = pd.concat([wide[~block], rolled])
    bars = pd.DataFrame(data[1], columns=["ts", "t", "close"])
    bars["date"] = bars.ts.dt.normalize()
    bars = bars[bars.date < "2024-01-30"]
    prices = bars.pivot(index="date", columns="t", values="close").rename(columns=LABELS).fillna(0).reset_index()
    return prices.merge(rolled, on="date").sort_values("date").reset_index(drop=True)


def test_features(stages, data):
    wanted = expected(data)
    found = widen(stages.features, stages.cells, [f"user{i}" for i in range(4)]).orderBy("date").toPandas()
    found["date"] = pd.to_datetime(found.date)
    pd.testing.assert_frame_equal(
        found[sorted(found.columns)], wanted[sorted(wanted.columns)], check_dtype=False, rtol=1e-9
    )
    scaled = stages.normalized.orderBy("date").toPandas()
    for c in [*LABELS.values(), "favorite_count", "retweet_count"]:
        want = (wanted[c] - wanted[c].min()) / (wanted[c].max() - wanted[c].min())
        assert scaled[c].tolist() == pytest.approx(want.tolist())
    mean = wanted.SandP_500.shift(-1).rolling(5).sum() / 5
    assert scaled.y.tolist() == (wanted.SandP_500 > mean).astype(int).tolist()


def test_scores_keep_every_post(stages, data):
    assert stages.scored.count() == stages.tokens.count() == len(data[0])
    sums = stages.scored.agg(F.sum("unigram_share"), F.sum("bigram_share")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)
    full = scored_posts(stages.tokens, stages.scored)
    assert {"text", "stem_tokens", "nonstem_tokens", "bigram_sentence", "pentagram_sentence",
            "unigram_probability", "bigram_probability", "date"} <= set(full.columns)
    assert full.count() == len(data[0])


def test_long_and_reload(stages, data):
    wanted = expected(data)
    series = [c for c in wanted.columns if c != "date"]
    daily = [c for c in series if not c.startswith(("unigram_", "bigram_"))]
    assert stages.long.count() == len(wanted) * len(daily) + stages.cells.count()
    assert {r.twitter_ticker for r in stages.long.select("twitter_ticker").distinct().collect()} == set(series)
    assert stages.long.select("uuid").distinct().count() == stages.long.count()
    previous = stages.long.withColumn("uuid", F.concat(F.lit("p-"), "uuid"))
    assert load(stages.normalized, stages.cells, previous).filter("uuid not like 'p-%'").count() == 0


def test_latest_uses_the_last_bar(stages):
    assert stages.latest.count() in (0, 1)
    assert {"SandP_500", "NASDAQ", "favorite_count"} <= set(stages.latest.columns)
    assert stages.latest_cells.count() <= 8 * stages.latest.count()


def test_users_are_selected_and_totals_stay(stages):
    some = filled_cells(stages.by_user, stages.features.select("date"), ["user1", "nobody"])
    both = {(r.date, r.user, r.measure): r.value for r in stages.cells.collect()}
    for r in some.collect():
        assert r.value == both.get((r.date, r.user, r.measure), 0)
    assert some.count() == stages.cells.count() / 2


def test_cells_are_the_days_with_posts(spark, stages):
    own = spark.createDataFrame(
        [(dt.date(2024, 1, 3), "a", 0.5, 0.0), (dt.date(2024, 1, 6), "b", 0.25, 0.5), (dt.date(2024, 1, 7), "b", 0.25, 0.0),
         (dt.date(2024, 1, 9), "a", 1.0, 1.0), (dt.date(2024, 1, 3), None, 9.0, 9.0)],
        "date date, user string, unigram double, bigram double",
    )
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (3, 5, 8)], "date date")
    cells = user_cells(own, days)
    found = {(r.date.day, r.user, r.measure): r.value for r in cells.collect()}
    assert found == {(3, "a", "unigram"): 0.5, (3, "a", "bigram"): 0.0, (8, "b", "unigram"): 0.5, (8, "b", "bigram"): 0.5}
    wide = {r.date.day: (r.unigram_a, r.bigram_b, r.unigram_c) for r in widen(days, cells, ["a", "b", "c"]).collect()}
    assert wide == {3: (0.5, 0.0, 0.0), 5: (0.0, 0.0, 0.0), 8: (0.0, 0.5, 0.0)}


def test_many_users_and_no_posts(spark, stages):
    """Nothing depends on how many users there are."""
    many = spark.range(6000).select(
        F.lit(dt.date(2024, 1, 3)).alias("date"), F.concat(F.lit("u"), "id").alias("user"),
        F.lit(0.5).alias("unigram"), F.lit(0.25).alias("bigram"),
    )
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (3, 4)], "date date")
    assert user_cells(many, days).count() == 6000 * 2  # none on the day without posts
    assert user_cells(many.limit(0), stages.features.select("date")).count() == 0


def test_parse(spark):
    when = dt.datetime(2024, 1, 1)
    rows = [("g", "a", "1", when, "x #t", 1, 2, False), ("g", "a", "1", when, "x #t", 1, 2, False),
            ("g", "a", "bad", when, "y", 1, 2, False), ("g", "a", None, when, "y", 1, 2, None),
            ("g", "b", "2", when, "re", 1, 2, True), ("g", "c", "3", when, None, None, None, None)]
    raw = spark.createDataFrame(rows, RAW_POSTS)
    posts, bad = parse(raw)
    assert sorted((r.user, r.id, r.hashtags) for r in posts.collect()) == [("a", 1, "#t"), ("c", 3, None)]
    assert bad.count() == 2
    listed = spark.createDataFrame([("g", "a")], "group string, user string")
    history, _ = parse(raw, listed)
    assert [r.user for r in history.collect()] == ["a"]
    later = spark.createDataFrame([("g", "a", "0", when, "old", 1, 2, False), ("g", "a", "9", when, "new", 1, 2, False)], RAW_POSTS)
    assert sorted(r.id for r in parse(later, listed, history)[0].collect()) == [1, 9]
    assert parse(raw.limit(0))[0].count() == 0


def test_every_user_has_a_cell_on_every_day(spark, stages):
    own = spark.createDataFrame(
        [(dt.date(2024, 1, 3), "a", 0.5, 0.0), (dt.date(2024, 1, 6), "b", 0.25, 0.5), (dt.date(2024, 1, 3), None, 9.0, 9.0)],
        "date date, user string, unigram double, bigram double",
    )
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (3, 8)], "date date")
    found = {(r.date.day, r.user, r.measure): r.value for r in filled_cells(own, days).collect()}
    assert found == {(d, u, m): 0.0 for d in (3, 8) for u in "ab" for m in ("unigram", "bigram")} | {
        (3, "a", "unigram"): 0.5, (8, "b", "unigram"): 0.25, (8, "b", "bigram"): 0.5,
    }
    assert {(r.user, r.value) for r in filled_cells(own, days, ["c"]).collect()} == {("c", 0.0)}
    assert stages.cells.count() == 2 * 4 * stages.features.count()


def test_grams_are_not_shuffled_with_the_scores(spark, stages):
    plan = scored_posts(stages.tokens, stages.scored)._jdf.queryExecution().optimizedPlan().toString()
    assert "pentagram_sentence" not in plan[plan.index("Join"):]
