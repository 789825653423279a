"""Versioned tables, the delivery ledger and user files: nothing is lost, doubled or half seen."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from postflow.operators.keys import with_keys
from postflow.schemas import LONG
from postflow.sources import posts as sp
from postflow.sources.delivery import arrived, deliver, ledger
from postflow.sources.sinks import to_items
from postflow.sources.snapshots import SnapshotTable
from postflow.streaming import posts as st

DAY = dt.date(2024, 1, 2)
VALUES = "date date, twitter_ticker string, value double"


def values(df):
    return sorted((r["date"], r["twitter_ticker"], r["value"]) for r in df.collect())


def simple(spark, path):
    return SnapshotTable(spark, str(path), spark.createDataFrame([], "k string, v long").schema)


def frame(spark, *rows):
    return spark.createDataFrame(rows, "k string, v long")


def test_states_are_whole_and_old_ones_stay_readable(spark, tmp_path):
    table = simple(spark, tmp_path / "t")
    assert table.read().count() == 0 and table.manifest().version == 0
    table.append(frame(spark, ("a", 1), ("b", 2)), F.col("k"))
    table.append(frame(spark, ("a", 3), ("x=/ %+ü", 4), (None, 5), ("", 6)), F.col("k"))
    old = table.read()
    assert table.read(["a"]).count() == 2 and table.read(["x=/ %+ü"]).count() == 1 and table.read(["none"]).count() == 2
    table.rewrite(["a"], lambda rows: rows.withColumn("v", F.col("v") * 10), F.col("k"))
    assert sorted(r["v"] for r in table.read().collect()) == [2, 4, 5, 6, 10, 30]
    assert sorted(r["v"] for r in old.collect()) == [1, 2, 3, 4, 5, 6]  # a reader that started before
    table.replace(table.read().filter("v > 5"))
    assert sorted(r["v"] for r in table.read().collect()) == [6, 10, 30]
    assert sorted(r["v"] for r in table.read(manifest=table.manifest(2)).collect()) == [1, 2, 3, 4, 5, 6]
    table.vacuum(keep=1)
    assert sorted(r["v"] for r in table.read().collect()) == [6, 10, 30] and table.manifest(2).version == 0


def test_a_write_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    table = simple(spark, tmp_path / "t")
    table.append(frame(spark, ("a", 1)))
    boom = F.raise_error(F.lit("lost"))
    with pytest.raises(Exception, match="lost"):
        table.append(frame(spark, ("b", 2)).withColumn("v", boom.cast("long")))
    monkeypatch.setattr(type(table.files), "create", lambda *a: (_ for _ in ()).throw(OSError("gone before the switch")))
    with pytest.raises(OSError):
        table.append(frame(spark, ("c", 3)))
    monkeypatch.undo()
    assert [r["v"] for r in table.read().collect()] == [1]
    table.append(frame(spark, ("d", 4)))
    assert sorted(r["v"] for r in table.read().collect()) == [1, 4]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    table = simple(spark, tmp_path / "t")
    threads = [threading.Thread(target=lambda k=k: table.append(frame(spark, ("a", k)))) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["v"] for r in table.read().collect()) == list(range(6)) and table.manifest().version == 6


def test_batches_of_a_stream_count_once_and_other_streams_are_new(spark, tmp_path):
    table = simple(spark, tmp_path / "t")
    for batch in (("s", 0), ("s", 0), ("s", 1), ("other", 0)):
        table.append(frame(spark, ("a", 1)), batch=batch)
    assert table.read().count() == 3


def test_compaction(spark, tmp_path):
    table = simple(spark, tmp_path / "t")
    for k in range(3):
        table.append(frame(spark, ("a", k), ("b", k)) if k else frame(spark, ("a", k)), F.col("k"))
    table.compact(F.col("k"), 2, lambda rows: rows.groupBy("k").agg(F.sum("v").alias("v")))
    assert {p: len(f) for p, f in table.manifest().parts.items()} == {"a": 1, "b": 2}
    assert [r["v"] for r in table.read(["a"]).collect()] == [3]


def _land(spark, tmp_path, place, checkpoint, *rows):
    spark.createDataFrame(rows, VALUES).coalesce(1).write.mode("append").parquet(str(tmp_path / place))
    landed = spark.readStream.schema(VALUES).parquet(str(tmp_path / place))
    st.stream_long(landed, str(tmp_path / "long"), str(tmp_path / checkpoint)).awaitTermination()


def test_a_new_checkpoint_loses_no_batch(spark, tmp_path):
    _land(spark, tmp_path, "in", "cp1", (DAY, "a", 1.0), (DAY, "b", 2.0))
    _land(spark, tmp_path, "other", "cp2", (DAY, "a", 5.0), (DAY + dt.timedelta(1), "a", 7.0))
    expected = [(DAY, "a", 5.0), (DAY, "b", 2.0), (DAY + dt.timedelta(1), "a", 7.0)]
    assert values(st.read_long(spark, str(tmp_path / "long"))) == expected
    batches = st.long_table(spark, str(tmp_path / "long")).manifest().batches
    assert sorted(batches.values()) == [0, 0]  # two streams, each at its first batch
    assert values(st.read_long(spark, str(tmp_path / "long"), [str(DAY)])) == expected[:2]


def test_a_batch_that_broke_off_after_the_switch_is_known(spark, tmp_path):
    """The stream fails between the switch and its own record of the batch, and runs the batch again."""
    path = str(tmp_path / "long")
    spark.createDataFrame([(DAY, "a", 1.0)], VALUES).coalesce(1).write.parquet(str(tmp_path / "in"))
    upsert = st.upsert_long(path)

    def run(after):
        def handle(batch, batch_id):
            upsert(batch, batch_id)
            after()

        landed = spark.readStream.schema(VALUES).parquet(str(tmp_path / "in"))
        query = landed.writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="broke off"):
        run(lambda: (_ for _ in ()).throw(RuntimeError("broke off")))
    assert st.long_table(spark, path).manifest().version == 1
    run(lambda: None)
    assert st.long_table(spark, path).manifest().version == 1 and values(st.read_long(spark, path)) == [(DAY, "a", 1.0)]


def _items(spark, n, factor=1.0):
    rows = [(DAY, f"t{k}", k * factor) for k in range(n)]
    return to_items(with_keys(spark.createDataFrame(rows, VALUES)))


def _store(folder, refuse):
    """A store of one file per put, which refuses what ``refuse`` tells."""
    import json
    import uuid

    folder.mkdir()

    def put(items, attempt):
        bad = [i["uuid"]["S"] for i in items if refuse(i, attempt)]
        taken = [i for i in items if i["uuid"]["S"] not in bad]
        (folder / uuid.uuid4().hex).write_text(json.dumps(taken))
        return bad

    def sent():
        return [i["twitter_ticker"]["S"] for f in folder.iterdir() for i in json.loads(f.read_text())]

    return put, sent


def test_every_item_arrives_and_none_is_sent_again(spark, tmp_path):
    put, sent = _store(tmp_path / "store", lambda item, attempt: attempt == 1 and item["twitter_ticker"]["S"].endswith("7"))
    items = _items(spark, 60)
    assert deliver(items, str(tmp_path / "ledger"), put, size=7).count() == 0
    assert sorted(sent()) == sorted(f"t{k}" for k in range(60))
    found = {r["uuid"]: r["attempt"] for r in arrived(spark, str(tmp_path / "ledger")).collect()}
    assert sorted(found.values()) == [1] * 54 + [2] * 6
    assert ledger(spark, str(tmp_path / "ledger")).read(["failed"]).count() == 6
    assert deliver(items.unionByName(_items(spark, 70)), str(tmp_path / "ledger"), put).count() == 0
    assert sorted(sent()) == sorted(f"t{k}" for k in range(70))
    assert deliver(_items(spark, 3, 2.0), str(tmp_path / "ledger"), put).count() == 0  # t0 is as it was, the others changed
    assert len(sent()) == 72


def test_what_never_arrives_is_returned(spark, tmp_path):
    def put(items, attempt):
        if any(i["twitter_ticker"]["S"] == "t3" for i in items):
            raise ConnectionError("no answer")

    left = deliver(_items(spark, 9).coalesce(1), str(tmp_path / "ledger"), put, size=1)
    assert [r["twitter_ticker"]["S"] for r in left.collect()] == ["t3"]
    failed = ledger(spark, str(tmp_path / "ledger")).read(["failed"]).collect()
    assert [(r["attempt"], r["error"]) for r in sorted(failed, key=lambda r: r["attempt"])] == [(k, "ConnectionError: no answer") for k in (1, 2, 3)]


HEADER = ",".join(sp.USER_FILE.fieldNames())


def _line(i, text, likes=1, at="2024-01-02T00:00:00Z"):
    return f"{i},{at},u,{likes},0,,,,,,{text}"


def test_user_files(spark, tmp_path):
    files = {
        "g 1/ann.lee.csv": [HEADER, _line(1, '"two\nlines, ""quoted"""'), _line("x2", "bad id"), _line(3, "", likes="1e2x"), _line(4, "ok")],
        "g 1/bob%20x.csv": ["id,text", "5,whole file"],
        "g+2/c.csv": ["﻿" + HEADER, _line("", "no id"), "6,short", _line(7, "a,b,c,d"), _line(8, "x", at="yesterday"), _line(9, "fine"), _line(10, '"open'), _line(11, "x")],
        "g+2/empty.csv": [],
        "g+2/only.csv": [HEADER],
        "g+2/notes.txt": ["not a posts file"],
    }
    for name, lines in files.items():
        place = tmp_path / "users" / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text("".join(f"{line}\n" for line in lines))
    good, bad = sp.read_user_files(spark, str(tmp_path / "users"))
    assert sorted((r["group"], r["user"], r["id"], r["text"]) for r in good.collect()) == [
        ("g 1", "ann.lee", 1, 'two\nlines, "quoted"'), ("g 1", "ann.lee", 4, "ok"), ("g+2", "c", 9, "fine"),
    ]
    found = sorted((r["user"], r["cause"], r["record"].strip()) for r in bad.collect())
    assert found == sorted([
        ("ann.lee", "id", _line("x2", "bad id")), ("ann.lee", "favorite_count", _line(3, "", likes="1e2x")),
        ("bob x", "header", "id,text"), ("bob x", "header", "5,whole file"),
        ("c", "id", next(f[2] for f in found if "no id" in f[2])), ("c", "fields", "6,short"),
        ("c", "fields", _line(7, "a,b,c,d")), ("c", "created_at", _line(8, "x", at="yesterday")), ("c", "quote", next(f[2] for f in found if f[1] == "quote")),
    ])
    assert all(word in next(f[2] for f in found if f[1] == "quote") for word in ("10,", "open", "11,"))
    assert {r["group"] for r in bad.collect()} == {"g 1", "g+2"} and all(r["file"].endswith(".csv") for r in bad.collect())


def test_users_folders_and_no_files(spark, tmp_path):
    posts = spark.createDataFrame([("g/1", "a b%", 1, "x"), ("h", "ü=+", 2, None)], "group string, user string, id long, text string")
    for field in sp.USER_FILE:
        if field.name not in posts.columns:
            posts = posts.withColumn(field.name, F.lit(None).cast(field.dataType))
    sp.write_user_files(posts, str(tmp_path / "out"))
    good, bad = sp.read_user_files(spark, str(tmp_path / "out"))
    assert sorted((r["group"], r["user"], r["id"], r["text"]) for r in good.collect()) == [("g/1", "a b%", 1, "x"), ("h", "ü=+", 2, None)]
    assert bad.count() == 0
    (tmp_path / "none").mkdir()
    good, bad = sp.read_user_files(spark, str(tmp_path / "none"))
    assert good.count() == bad.count() == 0


def test_long_schema(spark, tmp_path):
    assert st.read_long(spark, str(tmp_path / "nothing")).schema == LONG
