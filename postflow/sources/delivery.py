"""K4: items handed to a key-value store, with a ledger of what has arrived."""

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow.session import materialise
from postflow.sources.snapshots import SnapshotTable

#: Hands a list of items to the store, told which attempt this is; returns the uuids that it did not take, or raises.
Put = Callable[[list[dict], int], Sequence[str] | None]

#: What is known of every put: the item, a digest of what was sent, the attempt, and why it failed, if it did.
LEDGER = T.StructType(
    [
        T.StructField("uuid", T.StringType()),
        T.StructField("digest", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)


def ledger(spark: SparkSession, path: str) -> SnapshotTable:
    """The ledger at ``path``: the puts that arrived and the puts that failed are parts of their own."""
    return SnapshotTable(spark, path, LEDGER)


def arrived(spark: SparkSession, path: str) -> DataFrame:
    """(uuid, digest, attempt) of every item that has arrived, once for each version of it."""
    found = ledger(spark, path).read(["arrived"])
    return found.groupBy("uuid", "digest").agg(F.min("attempt").alias("attempt"))


def _sent(put: Put, attempt: int, size: int):
    """Hands the rows (uuid, digest, item) of a task over in lists of ``size``; one ledger row for each."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                ids, errors = part.column("uuid").to_pylist(), {}
                try:
                    errors = dict.fromkeys(put(part.column("item").to_pylist(), attempt) or (), "not taken")
                except Exception as error:  # the store's own failure: the items stay to be sent
                    errors = dict.fromkeys(ids, f"{type(error).__name__}: {error}"[:500])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("uuid"), part.column("digest"), pa.array([attempt] * len(part), pa.int32()),
                        pa.array([errors.get(i) for i in ids], pa.string()),
                    ],
                    names=LEDGER.fieldNames(),
                )

    return send


def deliver(items: DataFrame, path: str, put: Put, size: int = 25, attempts: int = 3) -> DataFrame:
    """K4: send those ``items`` that the ledger at ``path`` does not know to have arrived; returns those that still have not.

    Items are those of ``to_items``, each with a uuid.  Every attempt is one job: what is left after an anti-join with the ledger is sent
    by the tasks in lists of ``size``, and the outcome of each put becomes a row of the ledger when the job is done.
    An item recorded as arrived is never sent again, whatever run asks for it, unless its content changed.  An item
    whose task was lost after the put, before the record, is sent twice with the same uuid, so the
    store has to overwrite by it.  The attempts of an item go on counting from run to run.
    """
    spark = items.sparkSession
    table = ledger(spark, path)
    named = items.select(F.col("uuid.S").alias("uuid"), F.xxhash64(*items.columns).alias("digest"), F.struct(*items.columns).alias("item"))
    named = materialise(named.dropDuplicates(["uuid", "digest"]), "items")  # what is sent must not change between attempts
    outcome = F.when(F.col("error").isNull(), "arrived").otherwise("failed")
    left = named.join(arrived(spark, path), ["uuid", "digest"], "left_anti")
    for _ in range(attempts):
        if left.isEmpty():
            break
        attempt = table.manifest().version + 1
        table.append(left.mapInArrow(_sent(put, attempt, size), LEDGER), outcome)
        left = named.join(arrived(spark, path), ["uuid", "digest"], "left_anti")
    return left.select("item.*")
