"""Sources, sinks, rosters, increments, keys and items."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postflow.operators import ingest as ig
from postflow.operators import keys as ky
from postflow.operators import prices as pr
from postflow.schemas import POSTS, RAW_POSTS
from postflow.sources import posts as sp
from postflow.sources import sinks as sk

NOW = dt.datetime(2024, 1, 2, 3, 4, 5)
RAW = [
    ("g", "bob", "7", NOW, "hi #x", 1, 2, False),
    ("g", "bob", "8", NOW, "repost", 1, 2, True),
    ("h", "eve", "9", NOW, "yo", 3, None, None),
]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_flatten(spark):
    flat = sp.flatten_posts(spark.createDataFrame(RAW, RAW_POSTS))
    assert rows(flat, "id") == [
        ("g", "bob", 7, NOW, sp.URL_PREFIX + "7", 1, 2, "hi #x"),
        ("h", "eve", 9, NOW, sp.URL_PREFIX + "9", 3, None, "yo"),
    ]
    assert sp.flatten_posts(spark.createDataFrame(RAW, RAW_POSTS), keep_reposts=True).count() == 3


def test_read_raw_json(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"group": "g", "user": "u", "id_str": "1", "full_text": "t"}) + "\n")
    assert [r.id_str for r in sp.read_raw(spark, str(path)).collect()] == ["1"]


def test_quarantine_and_lenient_casts(spark):
    raw = spark.createDataFrame([("1", "x"), ("oops", "y"), (None, "z")], "id_str string, v string")
    good, bad = sp.quarantine(raw)
    assert rows(good) == [("1", "x")] and bad.count() == 2
    cast = sp.cast_columns(raw, {"id_str": "bigint"}, strict=False)
    assert cast.schema["id_str"].dataType.simpleString() == "bigint"
    assert sorted(r.id_str for r in cast.collect() if r.id_str is not None) == [1]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sp.cast_columns(raw, {"id_str": "bigint"}).collect()


@pytest.fixture
def stored(spark, tmp_path):
    data = [(g, u, i, NOW, "", 0, 0, "", "", "", "", "", f"t{i}")
            for g, u, i in [("g", "bob", 1), ("g", "bob", 2), ("h", "bob", 2), ("h", "eve", 3)]]
    path = str(tmp_path / "posts")
    sp.write_posts(spark.createDataFrame(data, POSTS), path)
    return path


def test_posts_round_trip(spark, stored):
    posts = sp.read_posts(spark, stored)
    assert posts.schema.fieldNames() == POSTS.fieldNames()
    assert rows(posts.select("group", "user", "id")) == [
        ("g", "bob", 1), ("g", "bob", 2), ("h", "bob", 2), ("h", "eve", 3),
    ]
    assert sp.read_posts(spark, stored, distinct=True).count() == 3
    pruned = sp.read_posts(spark, stored, groups=["h"], users=["eve"])
    assert rows(pruned.select("id")) == [(3,)]
    assert len(pruned.inputFiles()) <= 3
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters: [" in line)
    filters = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "group#" in filters and "bucket#" in filters


@pytest.mark.parametrize("buckets", [1, 64])
def test_any_number_of_buckets_is_read(spark, tmp_path, buckets):
    data = [("g", f"u{i}", i, NOW, "", 0, 0, "", "", "", "", "", "t") for i in range(40)]
    df, path = spark.createDataFrame(data, POSTS), str(tmp_path / "p")
    sp.write_posts(df, path, buckets=buckets)
    sp.write_posts(df, path)
    assert sp.read_posts(spark, path, users=[f"u{i}" for i in range(40)]).count() == 80
    assert sp.read_posts(spark, path, users=["u7"]).count() == 2


def test_files_of_another_writer(spark, tmp_path):
    names = [f for f in POSTS.fieldNames() if f not in ("group", "user")]
    texts = ['he said "hi, there"\nand "left"', "plain", 'ends with a backslash \\', '"', ""]
    frame = pd.DataFrame([[i, "2024-01-02 03:04:05", "u", 1, 2, "#a", "", "", "", "", t] for i, t in enumerate(texts)], columns=names)
    frame.to_csv(tmp_path / "bob.csv", index=False)
    found = sp.read_user_files(spark, str(tmp_path))
    assert found.columns == ["user", *names]
    assert [(r.user, r.id, r.text or "") for r in found.orderBy("id").collect()] == [("bob", i, t) for i, t in enumerate(texts)]
    sk.write_csv(found.drop("user").coalesce(1), str(tmp_path / "out"))
    again = pd.concat(pd.read_csv(f, keep_default_na=False) for f in (tmp_path / "out").glob("*.csv"))
    assert sorted(again.text) == sorted(texts)


def test_labels(spark):
    dimension = spark.createDataFrame([("^A", "a"), ("^A", "z"), ("^B", ""), ("^C", None), ("^D", "z")], "ticker_name string, ticker_label string")
    labels = pr.ticker_labels(dimension)
    assert labels == {"^A": "z", "^B": "", "^C": "", "^D": "z"}
    prices = spark.createDataFrame([(NOW.date(), "^A", 1.0), (NOW.date(), "^D", 3.0)], "date date, ticker_name string, close double")
    assert rows(pr.price_wide(prices, labels)) == [(NOW.date(), 2.0)]


def test_daily_close_sorts_nothing(spark):
    bars = spark.createDataFrame([(NOW.date(), "a", NOW, 1, 2.0), (NOW.date(), "a", NOW, 2, 5.0)], "date date, ticker_name string, ts timestamp_ntz, seq int, close double")
    plain = pr.daily_close(bars)
    assert "SortAggregate" not in plain._jdf.queryExecution().executedPlan().toString()
    assert rows(pr.daily_close(bars, ["ts", "seq"])) == [(NOW.date(), "a", 5.0)]


def test_user_files(spark, tmp_path):
    (tmp_path / "bob.csv").write_text("id,text\n1,\"two\nlines\"\n")
    (tmp_path / "eve.csv").write_text("id,text\n2,x\n")
    found = sp.read_user_files(spark, str(tmp_path), "id long, text string")
    assert rows(found) == [("bob", 1, "two\nlines"), ("eve", 2, "x")]


def test_merge_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, id int")
    assert rows(sp.merge(a, b, a), "id") == [(1, "x", None), (1, "x", None), (2, None, "y")]


def test_roster(spark, tmp_path):
    (tmp_path / "r.csv").write_text("g,h\nbob,eve\nann,\n")
    roster = ig.roster_long(sp.read_roster(spark, str(tmp_path / "r.csv")))
    assert rows(roster) == [("g", "ann"), ("g", "bob"), ("h", "eve")]
    posts = spark.createDataFrame([("g", "bob", 1), ("h", "bob", 2), ("h", "eve", 3)], "group string, user string, id long")
    assert rows(ig.keep_roster(posts, roster).select("id")) == [(1,), (3,)]
    assert rows(ig.pruned(posts, roster).select("id")) == [(2,)]


def test_new_posts_takes_everything_above_the_mark_once(spark):
    columns = "group string, user string, id long"
    history = spark.createDataFrame([("g", "a", 5), ("g", "a", 9), ("h", "a", 1)], columns)
    batch = [("g", "a", 9), ("g", "a", 7), ("g", "a", 10), ("g", "a", 10), ("h", "a", 2), ("g", "new", 1)]
    fresh = ig.new_posts(history, spark.createDataFrame(batch, columns))
    assert rows(fresh.select("group", "user", "id")) == [("g", "a", 10), ("g", "new", 1), ("h", "a", 2)]
    assert ig.append_new(history, spark.createDataFrame(batch, columns)).count() == 6


def test_since_is_pushed_to_the_scan(spark, stored):
    recent = ig.since(sp.read_posts(spark, stored), "2024-01-02")
    assert recent.count() == 4 and ig.since(sp.read_posts(spark, stored), "2025-01-01").count() == 0
    assert "GreaterThan(created_at" in recent._jdf.queryExecution().executedPlan().toString()
    assert ig.until_id(recent, 2).count() == 3


DAY = dt.date(2024, 1, 2)


def test_long_keeps_empty_cells(spark):
    wide = spark.createDataFrame([(DAY, 3, None)], "date date, x int, `a.b` double")
    assert rows(ky.to_long(wide)) == [(DAY, "a.b", None), (DAY, "x", 3.0)]


def test_pivot_and_unpivot_are_inverse(spark):
    long = spark.createDataFrame([(DAY, t, v) for t, v in [("a", 1.0), ("b", 2.0)]], "date date, twitter_ticker string, value double")
    wide = long.groupBy("date").pivot("twitter_ticker", ["a", "b"]).agg(F.first("value"))
    assert rows(ky.to_long(wide)) == rows(long)


def test_keys_are_stable_and_old_keys_stay(spark):
    long = spark.createDataFrame([(DAY, "a", 1.0), (DAY, "b", 2.0)], "date date, twitter_ticker string, value double")
    first = rows(ky.with_keys(long))
    assert first == rows(ky.with_keys(long.repartition(3)))
    assert all(len(r[3]) == 36 and r[3].count("-") == 4 for r in first) and first[0][3] != first[1][3]
    previous = spark.createDataFrame([(DAY, "a", 7.0, "old")], "date date, twitter_ticker string, value double, uuid string")
    again = rows(ky.with_keys(long, previous))
    assert again == [(DAY, "a", 1.0, "old"), first[1]]
    assert len({r[3] for r in rows(ky.with_keys(long, random=True))}) == 2


def test_items_and_sinks(spark, tmp_path):
    long = spark.createDataFrame([(DAY, "a", 1.5, "k")], "date date, twitter_ticker string, value double, uuid string")
    items = sk.to_items(long)
    sk.write_items(items, str(tmp_path / "items"))
    line = spark.read.text(str(tmp_path / "items")).first()[0]
    assert json.loads(line) == {
        "uuid": {"S": "k"}, "date": {"S": "2024-01-02"}, "twitter_ticker": {"S": "a"}, "value": {"N": "1.5"},
    }
    folder = tmp_path / "put"
    folder.mkdir()

    def put(batch):
        for item in batch:
            (folder / f"{item['uuid']['S']}-{len(batch)}").write_text(item["value"]["N"])

    many = long.withColumn("uuid", F.explode(F.array(*[F.lit(f"u{i}") for i in range(7)]))).coalesce(1)
    sk.write_items(sk.to_items(many), put_batch=put, size=3)
    assert sorted(p.name[-1] for p in folder.iterdir()) == list("1333333")


def test_csv_stage_table_and_view(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, t array<string>")
    sk.write_csv(df, str(tmp_path / "c"))
    assert rows(spark.read.options(**sp.CSV).csv(str(tmp_path / "c"))) == [("1", '["a","b"]')]
    assert rows(sk.write_stage(df, str(tmp_path / "s"))) == [(1, ["a", "b"])]
    assert rows(sp.read_table(spark, str(tmp_path / "s"))) == [(1, ["a", "b"])]
    sk.register(df, "posts_view")
    assert spark.sql("select size(t) from posts_view").first()[0] == 2
    sk.save_table(df, "posts_table")
    assert rows(sk.save_table(df, "posts_table")) == [(1, ["a", "b"])]
    spark.sql("drop table posts_table")
