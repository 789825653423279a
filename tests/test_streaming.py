"""A stream gives what a batch gives, whole and once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postflow.operators import keys as ky
from postflow.schemas import POSTS, RAW_POSTS
from postflow.sources import posts as sp
from postflow.streaming import posts as st

NOW = dt.datetime(2024, 1, 2)


def raw(spark, ids, start=NOW):
    data = [("g", f"u{i % 3}", str(i), start + dt.timedelta(hours=i), f"#t{i} 👍", i, 0, False) for i in ids]
    return spark.createDataFrame(data, RAW_POSTS).coalesce(1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("delay", [None, "30 days"])
def test_stream_equals_batch(spark, tmp_path, delay):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    for ids in (range(0, 30), range(20, 50), range(0, 10)):
        raw(spark, ids).write.mode("append").json(landing)
        st.stream_posts(spark, landing, out, str(tmp_path / "cp"), delay, files_per_batch=1).awaitTermination()
    found = sp.read_posts(spark, out)
    assert rows(found) == rows(st.prepare(raw(spark, range(50))).select(*POSTS.fieldNames()))


def test_files_of_a_stream_with_state_grow_with_folders_not_with_tasks(spark, tmp_path):
    """a task of the state holds rows of all folders, but does not write a file for each."""
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    raw(spark, range(400)).write.json(landing)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        st.stream_posts(spark, landing, out, str(tmp_path / "cp"), "30 days").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = sp.read_posts(spark, out)
    assert found.count() == 400
    assert len(found.inputFiles()) == spark.read.schema(sp.STORED_POSTS).parquet(out).select(*sp.FOLDERS).distinct().count()


def test_late_posts_are_kept_and_replays_add_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    append = st.append_unseen(out)
    new, old = raw(spark, range(5)), raw(spark, range(5, 9), NOW - dt.timedelta(days=900))
    for batch_id, batch in enumerate([new, old, old, new]):
        append(st.prepare(batch), batch_id)
    assert sp.read_posts(spark, out).count() == 9


def test_entities_are_found_in_new_posts_only(spark, tmp_path):
    """neither copies within a batch nor stored posts reach the costly step."""
    out, seen = str(tmp_path / "out"), []

    def then(posts):
        seen.append(posts.count())
        return st.finish(posts)

    append = st.append_unseen(out, then)
    for batch_id, ids in enumerate([range(6), range(4, 9)]):
        batch = sp.flatten_posts(raw(spark, ids))
        append(batch.unionByName(batch), batch_id)
    assert seen == [6, 3]
    assert rows(sp.read_posts(spark, out)) == rows(st.prepare(raw(spark, range(9))).select(*POSTS.fieldNames()))


def test_touched_folders(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9)], "g string, b int")
    assert df.filter(st._touched(df.filter("b < 3"), "g", "b")).count() == 2
    assert df.filter(st._touched(df.limit(0), "g", "b")).count() == 0


@pytest.mark.parametrize("delay", [None, "30 days"])
def test_bad_ids_stop_nothing(spark, tmp_path, delay):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    good = raw(spark, range(6))
    bad = good.withColumn("id_str", F.expr("if(cast(id_str as int) < 3, 'x' || id_str, null)"))
    good.unionByName(bad).coalesce(1).write.json(landing)
    st.stream_posts(spark, landing, out, str(tmp_path / "cp"), delay).awaitTermination()
    assert sp.read_posts(spark, out).count() == 6
    assert spark.read.schema(RAW_POSTS).parquet(f"{out}-bad").count() == 6


def test_the_later_version_wins(spark, tmp_path):
    columns = "date date, twitter_ticker string, value double, version int"
    day = dt.date(2024, 1, 2)
    batch = spark.createDataFrame([(day, "a", 1.0, 2), (day, "a", 9.0, 1), (day, "b", 3.0, 1), (day, "b", 4.0, 1)], columns)
    for turned in (batch, batch.orderBy("version"), batch.orderBy(F.desc("version"))):
        assert rows(st.latest_rows(turned, ["version"])) == [(day, "a", 1.0), (day, "b", 4.0)]
        assert rows(st.latest_rows(turned)) == [(day, "a", 9.0), (day, "b", 4.0)]
    path = str(tmp_path / "long")
    st.upsert_long(path, ["version"])(batch, 0)
    assert rows(st.read_long(spark, path).select("twitter_ticker", "value")) == [("a", 1.0), ("b", 4.0)]


def test_upsert_keeps_keys_and_untouched_days(spark, tmp_path):
    columns = "date date, twitter_ticker string, value double"
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    upsert = st.upsert_long(str(tmp_path / "long"))
    first = spark.createDataFrame([(d, t, 1.0) for d in days[:2] for t in "ab"], columns)
    second = spark.createDataFrame([(days[1], "a", 5.0), (days[2], "c", 7.0)], columns)
    upsert(first, 0)
    keys = {r[:2]: r[3] for r in rows(st.read_long(spark, str(tmp_path / "long")).select("date", "twitter_ticker", "value", "uuid"))}
    for batch_id in (1, 1, 2):
        upsert(second, batch_id)
        found = st.read_long(spark, str(tmp_path / "long")).select("date", "twitter_ticker", "value", "uuid")
        values = {r[:2]: r[2] for r in rows(found)}
        assert values == {
            (days[0], "a"): 1.0, (days[0], "b"): 1.0, (days[1], "a"): 5.0, (days[1], "b"): 1.0, (days[2], "c"): 7.0,
        }
        assert all(keys.get(r[:2], r[3]) == r[3] for r in rows(found))
    assert rows(found) == rows(ky.with_keys(found.drop("uuid")).select("date", "twitter_ticker", "value", "uuid"))
