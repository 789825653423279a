"""K1, K3-K6, L3: writers."""

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.sources.posts import CSV

PutBatch = Callable[[list[dict]], None]


def write_csv(df: DataFrame, path: str) -> None:
    """K1: CSV with a header, replacing what was there.  Nested columns are written as JSON."""
    flat = [
        F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c)
        for c, t in df.dtypes
    ]
    df.select(*flat).write.mode("overwrite").options(**CSV).csv(path)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """K3: store a stage as Parquet and go on from the stored copy."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_table(df: DataFrame, name: str) -> DataFrame:
    """K5: a managed table that replaces its predecessor, read back for SQL."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def register(df: DataFrame, name: str) -> DataFrame:
    """K6: make a frame available to ``spark.sql``."""
    df.createOrReplaceTempView(name)
    return df


def to_items(long: DataFrame) -> DataFrame:
    """L3: each row as a key-value item whose attributes are typed strings."""

    def attribute(name: str, kind: str):
        return F.struct(F.col(name).cast("string").alias(kind)).alias(name)

    return long.select(
        attribute("uuid", "S"),
        attribute("date", "S"),
        attribute("twitter_ticker", "S"),
        attribute("value", "N"),
    )


def write_items(
    items: DataFrame, path: str | None = None, put_batch: PutBatch | None = None, size: int = 25
) -> None:
    """K4: write items as JSON lines, or hand them to ``put_batch`` in lists of ``size``.

    ``put_batch`` runs on the executors and may see an item again after a retry, so it has to
    overwrite by ``uuid``; the keys are the same in every attempt.
    """
    if put_batch is None:
        items.write.mode("overwrite").json(path)
        return

    def put_partition(rows: Iterable) -> None:
        batch = []
        for row in rows:
            batch.append(row.asDict(recursive=True))
            if len(batch) == size:
                put_batch(batch)
                batch = []
        if batch:
            put_batch(batch)

    items.foreachPartition(put_partition)
