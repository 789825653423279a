"""The incremental loads as Structured Streaming queries."""

import functools
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postflow.functions.entities import with_entities
from postflow.operators.keys import NATURAL_KEY, with_keys
from postflow.schemas import LONG, POST_KEY, POSTS, RAW_POSTS
from postflow.sources.posts import (
    FOLDERS, STORED_POSTS, USER_BUCKETS, flatten_posts, quarantine, with_folders, write_posts,
)
from postflow.sources.snapshots import SnapshotTable, part_name, stream_of


def raw_stream(
    spark: SparkSession, path: str, format: str = "json", files_per_batch: int | None = None
) -> DataFrame:
    """The landing zone as a stream."""
    reader = spark.readStream.schema(RAW_POSTS).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def finish(posts: DataFrame) -> DataFrame:
    """Flattened posts with their entities: the costly step, so it comes after repeats are dropped."""
    return with_entities(posts).select(*POSTS.fieldNames())


def prepare(raw: DataFrame) -> DataFrame:
    """The same row-local steps for a batch and for a stream."""
    return finish(flatten_posts(raw))


def drop_repeats(posts: DataFrame, delay: str) -> DataFrame:
    """A post that lands again within ``delay`` is dropped, with state bounded by ``delay``.

    As with every watermark, a post that lands later than ``delay`` behind the newest one is lost.
    """
    return posts.withWatermark("created_at", delay).dropDuplicatesWithinWatermark([*POST_KEY])


def gathered(posts: DataFrame) -> DataFrame:
    """A stream of posts with each folder's rows in few tasks, which write a file per folder they hold.

    Streams know no rebalance hint, and the tasks of the state hold rows of all folders: their files would be tasks times
    folders.  A folder is dealt to one task for each ``USER_BUCKETS`` tasks, so that a hot one is split.
    """
    tasks = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, tasks // USER_BUCKETS)))
    return posts.repartition(tasks, *FOLDERS, part)


def _stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table at ``path``, or None before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _touched(batch: DataFrame, *columns: str) -> Column:
    """A filter for the folders a batch touches.  It selects too much rather than too little.

    There are as many values as folders of one level, and a table has to list its folders anyway.
    """
    found = batch.agg(*[F.collect_set(c).alias(c) for c in columns]).first()
    return functools.reduce(Column.__and__, [F.col(c).isin(found[c]) for c in columns])


def append_unseen(path: str, then: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends the posts that are not stored yet, after the row-local step ``then``.

    Nothing is lost, however late it lands, and a batch that is run again adds nothing.  Of the
    stored table only the key columns are read, in the folders the batch touches: those of its months,
    so the look-up does not grow with the history.  The join is on the whole key, so a user with many
    posts is spread over all tasks.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        batch = with_folders(batch).persist()
        fresh = batch.dropDuplicates([*POST_KEY])
        stored = _stored(batch.sparkSession, path, STORED_POSTS)
        if stored is not None:
            known = stored.filter(_touched(batch, *FOLDERS)).select(*POST_KEY)
            fresh = fresh.join(known, [*POST_KEY], "left_anti")
        fresh = fresh if then is None else then(fresh)
        write_posts(fresh.select(*POSTS.fieldNames()), path)
        batch.unpersist()

    return append


def stream_posts(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    delay: str | None = None,
    format: str = "json",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Ingest what has landed since the last run, then stop.

    Without ``delay`` repeats are found in the stored table; with it, in the state of the stream.
    Records without a usable id go to ``out`` + "-bad" by a stream of their own, which ends first, so
    they stop neither this run nor the next.
    """
    good, bad = quarantine(raw_stream(spark, source, format, files_per_batch))
    (
        bad.writeStream.format("parquet").option("path", f"{out}-bad")
        .option("checkpointLocation", f"{checkpoint}-bad")
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    )
    posts = flatten_posts(good)
    if delay is None:
        writer = posts.writeStream.foreachBatch(append_unseen(out, finish))
    else:
        writer = (
            gathered(with_folders(finish(drop_repeats(posts, delay))))
            .writeStream.format("parquet")
            .partitionBy(*FOLDERS)
            .option("path", out)
        )
    return (
        writer.option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def latest_rows(batch: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the one that is last by the columns ``order``, then by value.

    Without an order the largest value wins, so the result never depends on the order of rows.
    """
    last = F.max_by("value", F.struct(*order, "value")) if order else F.max("value")
    return batch.groupBy(*NATURAL_KEY).agg(last.alias("value"))


def long_table(spark: SparkSession, path: str) -> SnapshotTable:
    """The long table at ``path``; its parts are days."""
    return SnapshotTable(spark, path, LONG)


def upsert_long(path: str, order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """I4: a ``foreachBatch`` function that merges a batch into the long table at ``path``.

    Known rows keep their key and take the batch's value, the last one by ``order`` if it has several.
    Only the touched days are read and written anew, and the table goes over to them at once: a crash at any
    point and a reader at any time see the old state or the new one.  The table remembers the stream and the
    batch, so a batch that runs again changes nothing, and one of a new checkpoint is a new one.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = stream_of(spark)
        rows = latest_rows(batch, order).persist()
        day = part_name(F.col("date"))
        days = [r[0] for r in rows.select(day).distinct().collect()]  # as many as the table has folders

        def merged(stored: DataFrame) -> DataFrame:
            others = stored.join(rows, [*NATURAL_KEY], "left_anti")
            return with_keys(rows, stored).select(*LONG.fieldNames()).unionByName(others)

        long_table(spark, path).rewrite(days, merged, day, (stream, batch_id) if stream else None)
        rows.unpersist()

    return upsert


def read_long(spark: SparkSession, path: str, days: Sequence[str] | None = None) -> DataFrame:
    """I4: the long table at ``path``, or the rows of some days."""
    return long_table(spark, path).read(days)


def stream_long(
    long: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, order: Sequence[str] = ()
) -> StreamingQuery:
    """I4: keep the long table at ``path`` up to date with a stream of (date, ticker, value).

    ``order`` names columns of the stream that tell which of two versions of a row is the later one.
    """
    return (
        long.withColumn("date", F.col("date").cast("date"))
        .writeStream.foreachBatch(upsert_long(path, order))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
