"""Session settings and the one place where lineage is cut."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app="postflow", master=None, **conf) -> SparkSession:
    """A session with the settings the library relies on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Joins whose partitions are known to be small need no sort.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    In local mode an unset value is replaced by a fresh temporary folder.  On a cluster there is no
    safe default, because executors do not share a local disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIRS:
        _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="postflow-"))
    return _LOCAL_DIRS[0]


#: The temporary folder of this process, once there is one.
_LOCAL_DIRS: list[str] = []


#: Whether Spark removes the shuffle files of a query when it ends, not when the driver's garbage collector finds them unused.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it.

    Later readers get column pruning and filter pushdown, a lost executor costs a re-read instead
    of a recomputation, and an expensive input with several consumers is computed once.  The shuffle files
    of the write go with it, so the disk holds those of one step at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/postflow/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash a small input over all cores before CPU-heavy work on its rows.

    A large table has more splits than the cluster has cores and passes through untouched; only one
    that would leave cores idle is shuffled, which is cheap because it is small.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(4 * cores, *columns)
