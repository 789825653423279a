"""A stored dictionary of stems, made by expressions of the engine.

Distinct words are few beside the words of a corpus, so a dictionary is made once, and an increment adds only the
words that it does not hold yet.  The steps of the published algorithm are a chain of projections over the
new words; no row of posts goes through Python.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postflow.functions import stem as st
from postflow.operators.skew import lookup
from postflow.session import materialise
from postflow.sources.snapshots import SnapshotTable

_V = "[aeiouy]"
_C = "[^aeiouy]"
_REGION = f"(?s)^.*?{_V}{_C}"
_SHORT = f"(?s)^(?:.*{_C}{_V}[^aeiouywxY]|{_V}{_C})$"


def _head(word: str, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.length(suffix))


def _suffix(word: str, suffixes) -> Column:
    """The longest of ``suffixes`` that ends a word, or an empty string."""
    return F.regexp_extract(word, f"({'|'.join(suffixes)})$", 1)


def _mapped(values: dict[str, str], key: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(key))


def with_stems(words: DataFrame, word: str = "word", out: str = "stem") -> DataFrame:
    """``words`` with the stem of each lower-case word; a null word has none.

    Every step is a projection of its own, in which the word so far is a plain column.
    """
    ends, has_vowel = (lambda c, pattern: F.col(c).rlike(pattern)), (lambda c: c.rlike(_V))
    size = F.length("_w")
    start = size - F.length("_s")
    df = words.withColumn("_given", F.col(word)).withColumn("_w", F.regexp_replace(word, "^'", ""))
    df = df.withColumn("_w", F.regexp_replace("_w", f"^y|(?<={_V})y", "Y"))
    special, first = F.length(F.regexp_extract("_w", "^(?:gener|commun|arsen)", 0)), F.length(F.regexp_extract("_w", _REGION, 0))
    df = df.withColumn("_r1", F.when(special > 0, special).when(first > 0, first).otherwise(size))
    rest = F.length(F.regexp_extract(F.substring("_w", F.col("_r1") + 1, size), _REGION, 0))
    df = df.withColumn("_r2", F.when(rest > 0, F.col("_r1") + rest).otherwise(size))
    df = df.withColumn("_w", F.regexp_replace("_w", "(?:'s'|'s|')$", ""))

    def cut(frame, suffixes):
        frame = frame.withColumn("_s", _suffix("_w", suffixes))
        return frame.withColumn("_h", _head("_w", "_s"))

    s, h, w = F.col("_s"), F.col("_h"), F.col("_w")
    df = cut(df, ["sses", "ied", "ies", "us", "ss", "s"])
    plural = (
        F.when(s == "sses", F.concat(h, F.lit("ss")))
        .when(s.isin("ied", "ies"), F.concat(h, F.when(F.length(h) > 1, "i").otherwise("ie")))
        .when((s == "s") & has_vowel(F.substring(h, F.lit(1), F.length(h) - 1)), h)
        .otherwise(w)
    )
    df = df.withColumn("_w", plural)
    df = df.withColumn("_fixed", F.when(w.isin(*sorted(st._INVARIANT)), w))
    df = cut(df, ["eedly", "eed", "edly", "ed", "ingly", "ing"])
    past = (
        F.when(s == "", w)
        .when(s.isin("eed", "eedly"), F.when(F.length(h) >= F.col("_r1"), F.concat(h, F.lit("ee"))).otherwise(w))
        .when(~has_vowel(h), w)
        .when(ends("_h", "(?:at|bl|iz)$"), F.concat(h, F.lit("e")))
        .when(ends("_h", "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.substring(h, F.lit(1), F.length(h) - 1))
        .when((F.length(h) <= F.col("_r1")) & ends("_h", _SHORT), F.concat(h, F.lit("e")))
        .otherwise(h)
    )
    df = df.withColumn("_w", past).withColumn("_w", F.regexp_replace("_w", f"(?<=.{_C})[yY]$", "i"))
    df = cut(df, st._STEP_2)
    kept = (s == "") | (start < F.col("_r1")) | ((s == "ogi") & ~ends("_h", "l$")) | ((s == "li") & ~ends("_h", "[cdeghkmnrt]$"))
    df = df.withColumn("_w", F.when(kept, w).otherwise(F.concat(h, _mapped(st._STEP_2, "_s"))))
    df = cut(df, st._STEP_3)
    kept = (s == "") | (start < F.when(s == "ative", F.col("_r2")).otherwise(F.col("_r1")))
    df = df.withColumn("_w", F.when(kept, w).otherwise(F.concat(h, _mapped(st._STEP_3, "_s"))))
    df = cut(df, st._STEP_4)
    kept = (s == "") | (start < F.col("_r2")) | ((s == "ion") & ~ends("_h", "[st]$"))
    df = df.withColumn("_w", F.when(kept, w).otherwise(h))
    shorter, last = F.substring("_w", F.lit(1), size - 1), size - 1
    drop = (ends("_w", "e$") & ((last >= F.col("_r2")) | ((last >= F.col("_r1")) & ~shorter.rlike(_SHORT)))) | (
        ends("_w", "ll$") & (last >= F.col("_r2"))
    )
    df = df.withColumn("_w", F.lower(F.when(drop, shorter).otherwise(w)))
    given = F.col("_given")
    stem = F.when(F.length(given) <= 2, given).when(given.isin(*st._IRREGULAR), _mapped(st._IRREGULAR, "_given"))
    return df.withColumn(out, F.coalesce(stem, F.lower("_fixed"), "_w")).drop("_given", "_w", "_s", "_h", "_r1", "_r2", "_fixed")


class StemDictionary:
    """The table of (word, stem) at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = SnapshotTable(spark, path, spark.createDataFrame([], "word string, stem string").schema)

    def read(self) -> DataFrame:
        return self.table.read()

    def add(self, posts: DataFrame, tokens: str = "nonstem_tokens", batch: tuple[str, int] | None = None) -> int:
        """Stem the words of these posts that the dictionary lacks; returns how many there were."""
        words = posts.select(F.explode(tokens).alias("word")).filter("word is not null").distinct()
        new = materialise(words.join(self.read(), "word", "left_anti"), "new-words")
        found = new.count()
        if found:
            self.table.append(with_stems(new), batch=batch)
        return found

    def stemmed(self, posts: DataFrame, key: str, tokens: str = "nonstem_tokens", out: str = "stem_tokens") -> DataFrame:
        """(key, out): the stems of each post's tokens in their order, by a look-up that no common word can burden."""
        words = posts.select(key, F.posexplode(tokens).alias("_place", "term"))
        counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))
        entries = counts.join(self.read().withColumnRenamed("word", "term"), "term").select("term", "frequency", F.col("stem").alias("value"))
        found = lookup(words, materialise(entries, "stems"))
        lists = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_place", "value"))).alias("_stems"))
        stems = F.coalesce("_stems.value", F.array().cast("array<string>"))
        return posts.select(key).join(lists, key, "left").select(key, stems.alias(out))
