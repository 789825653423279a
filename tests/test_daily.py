"""T17-T19, A1-A4, A12-A14, R2, S10, S11, J3, J4, N5-N8, W1-W3."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postflow.functions.dates import day_name, local_day_of_instant, with_local_day
from postflow.operators import daily as dy
from postflow.operators import features as ft
from postflow.operators import prices as pr


def day(text):
    return dt.date.fromisoformat(text)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Los_Angeles"])
def test_local_day_does_not_depend_on_the_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        instants = ["2024-01-02T04:59:59Z", "2024-01-02T05:00:00Z", "2024-07-02T03:59:59.999999Z",
                    "2024-07-02T04:00:00Z", "1969-12-31T23:00:00Z"]
        df = spark.createDataFrame([(i,) for i in instants], "s string")
        found = df.select(local_day_of_instant(F.col("s").cast("timestamp"))).collect()
        assert [r[0].isoformat() for r in found] == [
            "2024-01-01", "2024-01-02", "2024-07-01", "2024-07-02", "1969-12-31",
        ]
        naive = df.select(F.substring("s", 1, 19).cast("timestamp_ntz").alias("t"))
        assert [r.date.isoformat() for r in with_local_day(naive, "t").collect()][:2] == ["2024-01-01", "2024-01-02"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_day_name(spark):
    df = spark.createDataFrame([(day("2024-01-01"),)], "date date")
    assert rows(df.select(day_name("date"))) == [("Monday",)]


def test_user_statistics(spark):
    df = spark.createDataFrame(
        [("a", "g", 3), ("b", "g", 1), ("a", "h", 2), ("c", "h", 1)], "user string, group string, t int"
    ).withColumn("created_at", F.timestamp_seconds("t"))
    assert [r.user for r in dy.oldest_users(df, 2).collect()] == ["b", "c"]
    assert rows(dy.user_counts(df)) == [("a", 2), ("b", 1), ("c", 1)]
    assert rows(dy.distinct_users(df)) == rows(dy.distinct_users(df, approximate=True)) == [(3,)]
    assert rows(dy.group_sizes(df)) == [("g", 2), ("h", 2)]
    plan = dy.oldest_users(df)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_daily_wide(spark):
    df = spark.createDataFrame(
        [(day("2024-01-02"), "u", 1.0, 1.0, 5, 1), (day("2024-01-02"), "w", 2.0, None, 7, 1),
         (day("2024-01-03"), "u", 3.0, 5.0, 1, 1)],
        "date date, user string, unigram_probability double, bigram_probability double, "
        "favorite_count long, retweet_count long",
    )
    wide = dy.daily_wide(dy.daily_by_user(df), ["u", "w"])
    assert wide.columns == [
        "date", "favorite_count", "retweet_count", "unigram_u", "bigram_u", "unigram_w", "bigram_w",
    ]
    assert rows(wide) == [
        (day("2024-01-02"), 12, 2, 1.0, 1.0, 2.0, 0.0),
        (day("2024-01-03"), 1, 1, 3.0, 5.0, 0.0, 0.0),
    ]
    one = dy.daily_wide(dy.daily_by_user(df), ["u"], measures=["unigram"], counts=["favorite_count"])
    assert rows(one) == [(day("2024-01-02"), 12, 1.0), (day("2024-01-03"), 1, 3.0)]


ROLL = [("2023-01-01", 1), ("2023-01-02", 2), ("2023-01-06", 4), ("2023-01-07", 8),
        ("2023-01-08", 16), ("2023-01-23", 32)]


def test_roll_weekend(spark):
    df = spark.createDataFrame([(day(d), x) for d, x in ROLL], "date date, x long")
    wanted = [("2023-01-02", 3), ("2023-01-06", 4), ("2023-01-09", 24), ("2023-01-16", 0), ("2023-01-23", 32)]
    assert rows(dy.roll_weekend(df)) == [(day(d), x) for d, x in wanted]
    bare = dy.roll_weekend(df, fill_calendar=False)
    assert rows(bare) == [(day(d), x) for d, x in wanted if x]


def test_roll_weekend_equals_pandas(spark):
    dates = pd.date_range("2023-03-01", "2023-05-20").delete([10, 11, 12, 30, 31, 32, 33])
    frame = pd.DataFrame({"date": dates, "x": range(len(dates)), "y": [0.5 * i for i in range(len(dates))]})
    block = frame.date.dt.day_name().isin(["Saturday", "Sunday", "Monday"])
    rolled = frame[block].groupby([pd.Grouper(key="date", freq="W-MON")]).sum().reset_index()
    wanted = pd.merge(frame[~block], rolled, how="outer").sort_values("date").reset_index(drop=True)
    df = spark.createDataFrame(frame.assign(date=frame.date.dt.date))
    found = dy.roll_weekend(df).orderBy("date").toPandas()
    assert found.x.tolist() == wanted.x.tolist() and found.y.tolist() == wanted.y.tolist()
    assert [str(d) for d in found.date] == [str(d.date()) for d in wanted.date]


def test_roll_weekend_without_weekend_and_without_rows(spark):
    df = spark.createDataFrame([(day("2023-01-04"), 1)], "date date, x long")
    assert rows(dy.roll_weekend(df)) == [(day("2023-01-04"), 1)]
    assert rows(dy.roll_weekend(df.filter("false"))) == []


def test_roll_weekend_by_user_keeps_each_calendar(spark):
    data = [(day("2023-01-01"), "a", 1), (day("2023-01-16"), "a", 2), (day("2023-01-07"), "b", 3)]
    df = spark.createDataFrame(data, "date date, user string, x long")
    assert rows(dy.roll_weekend(df, by=["user"]), "user", "date") == [
        (day("2023-01-02"), "a", 1), (day("2023-01-09"), "a", 0), (day("2023-01-16"), "a", 2),
        (day("2023-01-09"), "b", 3),
    ]


@pytest.fixture
def bars(spark):
    data = [("2024-01-02 10:00", "A", 1.0), ("2024-01-02 16:00", "A", 2.0), ("2024-01-02 15:00", "B", 5.0),
            ("2024-01-03 10:00", "A", 3.0), ("2024-01-03 09:00", "B", 6.0), ("2024-01-03 10:00", "X", 9.0)]
    df = spark.createDataFrame(data, "ts string, ticker_name string, close double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return df.withColumn("date", F.to_date("ts"))


LABELS = {"A": "SandP_500", "B": "NASDAQ"}


def test_prices(spark, bars):
    closes = pr.daily_close(bars)
    assert rows(closes, "date", "ticker_name")[:2] == [(day("2024-01-02"), "A", 2.0), (day("2024-01-02"), "B", 5.0)]
    assert {r.date for r in pr.in_range(closes, "2024-01-02", "2024-01-03").collect()} == {day("2024-01-02")}
    wide = pr.price_wide(closes.filter("not (ticker_name = 'B' and close = 5)"), LABELS)
    assert rows(wide) == [(day("2024-01-02"), 2.0, 0.0), (day("2024-01-03"), 3.0, 6.0)]
    assert wide.columns == ["date", "SandP_500", "NASDAQ"]
    unfilled = pr.price_wide(closes.filter("close <> 5"), LABELS, fill=None)
    assert rows(unfilled)[0] == (day("2024-01-02"), 2.0, None)


def test_latest(spark, bars):
    assert rows(pr.latest_price(bars).select("ticker_name", "close")) == [("A", 3.0), ("X", 9.0)]
    assert rows(pr.latest_price(bars, per_ticker=True).select("ticker_name", "close")) == [
        ("A", 3.0), ("B", 6.0), ("X", 9.0),
    ]
    assert rows(pr.latest_wide(bars, LABELS)) == [(day("2024-01-03"), 3.0, None)]
    assert rows(pr.latest_wide(bars, LABELS, per_ticker=True)) == [(day("2024-01-03"), 3.0, 6.0)]


def test_ticker_labels(spark):
    df = spark.createDataFrame([("A", "x"), ("B", None)], "ticker_name string, ticker_label string")
    assert pr.ticker_labels(df) == {"A": "x", "B": ""}
    many = spark.range(12_000).selectExpr("'t' || id as ticker_name", "'l' as ticker_label")
    assert len(pr.ticker_labels(many)) == 12_000


def test_features_and_scaling(spark):
    prices = spark.createDataFrame([(day("2024-01-02"), 1.0), (day("2024-01-03"), 3.0)], "date date, p double")
    data = [(day("2024-01-02"), 2, None), (day("2024-01-03"), 2, 5.0), (day("2024-01-04"), 9, 1.0)]
    daily = spark.createDataFrame(data, "date date, favorite_count long, unigram_u double")
    features = ft.build_features(prices, daily)
    assert rows(features) == [(day("2024-01-02"), 1.0, 2, 0.0), (day("2024-01-03"), 3.0, 2, 5.0)]
    scaled = ft.normalize_columns(features, ["p", "favorite_count"])
    assert rows(scaled) == [(day("2024-01-02"), 0.0, None, 0.0), (day("2024-01-03"), 1.0, None, 5.0)]
    latest = spark.createDataFrame([(day("2024-01-04"), 4.0)], "date date, p double")
    assert rows(ft.latest_features(latest, daily, features, ["p"])) == [(day("2024-01-04"), 1.5, 9, 1.0)]
    late = latest.withColumn("date", F.lit("2024-02-01").cast("date"))
    assert rows(ft.latest_features(late, daily, features, ["p"])) == []


def test_scaling_takes_names_with_dots(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "`BRK.B` double")
    assert rows(ft.normalize_columns(df, ["BRK.B"]), "`BRK.B`") == [(0.0,), (1.0,)]


SERIES = [[1, 2, 3, 4, 5, 4, 3, 10], [9, 1, 8, 2, 7, 3, 6, 4, 5, 5, 5, 1], [3], [2, 5]]


@pytest.mark.parametrize("days", [1, 2, 3, 4, 5])
def test_target_equals_pandas(spark, days):
    data, wanted = [], []
    for k, values in enumerate(SERIES):
        x = pd.Series(values, dtype=float)
        mean = x.shift(-1).rolling(days).sum().div(days)
        wanted += (x > mean).astype(int).tolist()
        data += [(f"s{k}", day("2024-01-01") + dt.timedelta(i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "k string, date date, x int")
    found = ft.with_target(df, days, "x", by=["k"])
    assert [r.y for r in found.orderBy("k", "date").collect()] == wanted


def test_target_of_one_series(spark):
    data = [(day("2024-01-01") + dt.timedelta(i), v) for i, v in enumerate(SERIES[0])]
    found = ft.with_target(spark.createDataFrame(data, "date date, close int"), 3)
    assert [r.y for r in found.orderBy("date").collect()] == [0, 0, 0, 0, 1, 0, 0, 0]
