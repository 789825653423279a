"""Statistics that follow an increment without going through the corpus again."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.group import GroupedData

from postflow.operators.ngrams import GLUE, each_term, ngram_terms
from postflow.sources.snapshots import SnapshotTable

#: Grams are dealt to so many parts of a table by their hash.
BUCKETS = 64
#: Tasks that a bucket is dealt to, at most, when its grams are counted.
SPREAD = 32

_COUNTS = T.StructType([T.StructField("term", T.StringType()), T.StructField("frequency", T.LongType())])


class GramCounts:
    """The counts of all ``n``-grams at ``path``, to which increments are added.

    An increment counts its own posts and adds a file for each bucket of grams; sums are taken when counts are
    read.  Compaction rewrites the buckets that have gathered many files, one row for each gram.
    """

    def __init__(self, spark: SparkSession, path: str, n: int, buckets: int = BUCKETS):
        self.n, self.buckets = n, buckets
        self.table = SnapshotTable(spark, path, _COUNTS)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets))

    def _dealt(self, rows: DataFrame) -> GroupedData:
        """The rows by term, after the one shuffle that also puts those of a bucket together for its files."""
        part = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(SPREAD))
        return rows.withColumns({"_bucket": self._bucket(), "_spread": part}).repartition("_bucket", "_spread").groupBy("_bucket", "_spread", "term")

    def add(self, posts: DataFrame, tokens: str = "stem_tokens", batch: tuple[str, int] | None = None) -> None:
        """Add the grams of these posts; a ``batch`` (name, number) that was added before is left out."""
        grams = self._dealt(each_term(posts, ngram_terms(tokens, self.n)))
        self.table.append(grams.agg(F.count(F.lit(1)).alias("frequency")), self._bucket(), batch, dealt=True)

    def counts(self) -> DataFrame:
        """(term, frequency) over all increments; partial counts meet in one small shuffle."""
        return self.table.read().groupBy("term").agg(F.sum("frequency").alias("frequency"))

    def frequency(self, denominator: str = "distinct") -> DataFrame:
        """As ``gram_frequency`` over all posts that were ever added."""
        counts = self.counts()
        if denominator not in ("distinct", "total"):
            raise ValueError(f"unknown denominator {denominator!r}")
        size = counts.agg(F.count_if(F.col("frequency") > 0) if denominator == "distinct" else F.sum("frequency")).scalar()
        return counts.select(
            F.lit(self.n).alias("n"), F.split("term", GLUE).alias("gram"), "frequency",
            (F.col("frequency") / size).alias("relative_frequency"),
        )

    def compact(self, most: int = 4) -> None:
        """Make one file of every bucket that has more than ``most``."""
        self.table.compact(self._bucket(), most, lambda rows: self._dealt(rows).agg(F.sum("frequency").alias("frequency")), dealt=True)


#: The error of a sketch of 2**12 registers: one standard deviation, as a share of the number.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def user_sketches(posts: DataFrame, by: tuple[str, ...] = ("group",), user: str = "user") -> DataFrame:
    """A4: (by.., date, sketch) of the users of each day, a few kB a row, which can be put together for any days."""
    return posts.groupBy(*by, "date").agg(F.hll_sketch_agg(user, F.lit(SKETCH_BITS)).alias("sketch"))


def users_between(sketches: DataFrame, first: str, last: str, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """A4: (by.., users): about how many users posted from ``first`` to ``last``, without the posts."""
    days = sketches.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return days.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))
