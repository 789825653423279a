"""Probabilities of posts under the n-gram statistics of the whole corpus.

Products of hundreds of ratios underflow, so logarithms are primary (Q4) and the plain value is
derived from them.  Each score reads ``df`` several times (to count words, then to send grams): pass a
written table, see ``postflow.session.materialise``.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.operators import chains
from postflow.operators.chains import Heavy
from postflow.operators.ngrams import GLUE, count_terms, distinct_terms, ngram_terms
from postflow.operators.skew import lookup, sum_of_lookups
from postflow.session import materialise


def _terms(df: DataFrame, key, terms: Column) -> DataFrame:
    """(key.., term), with one null term for a post that has none."""
    return df.select(*key, F.explode_outer(terms).alias("term"))


def unigram_score(
    df: DataFrame, key: Sequence[str], tokens: str = "stem_tokens", counts: DataFrame | None = None
) -> DataFrame:
    """Per post the product of ``frequency / distinct words`` over its words.

    A post without words scores 1 (Q5).  ``counts`` may pass in a (term, frequency) table.
    """
    if counts is None:
        counts = materialise(count_terms(df, F.col(tokens)), "unigrams")
    table = counts.select(
        "term", "frequency", F.ln(F.col("frequency") / distinct_terms(counts)).alias("value")
    )
    found = sum_of_lookups(_terms(df, key, F.col(tokens)), table, key)
    logprob = F.coalesce("total", F.lit(0.0))
    return found.select(
        *key,
        logprob.alias("unigram_logprob"),
        F.exp(logprob).alias("unigram_probability"),
    )


def _between_edges(t: Column, left: bool = True) -> Column:
    """The words of a post between empty words that stand for its edges; no words, no edges."""
    edge = F.array(F.lit(""))
    padded = F.concat(edge, t, edge) if left else F.concat(t, edge)
    return F.when(F.size(t) > 0, padded).otherwise(t)


def chain_counts(df: DataFrame, n: int, tokens: str = "stem_tokens") -> DataFrame:
    """(term, frequency, head) of the n-grams, a head being a gram without its last word.

    The grams reach over the end of a post, and for bigrams over its start, where the head is empty;
    such a gram stands in as its own head, which keeps it apart from the others in a join.
    """
    padded = df.select(_between_edges(F.col(tokens), left=n == 2).alias("_words"))
    heads = F.substring_index("term", GLUE, n - 1)
    head = F.when(F.col("term").startswith(GLUE), F.col("term")).otherwise(heads)
    return count_terms(padded, ngram_terms("_words", n)).withColumn("head", head)


def head_counts(counts: DataFrame) -> DataFrame:
    """(head, of): how often each head occurs.

    A head is followed by some word or by the end of its post, so its count is the sum over those
    grams.  The heads of bigrams are the words of the corpus.
    """
    return counts.groupBy("head").agg(F.sum("frequency").alias("of"))


def chain_table(
    df: DataFrame,
    counts: DataFrame,
    heads: DataFrame,
    n: int,
    tokens: str = "stem_tokens",
    smoothing: bool = False,
) -> DataFrame:
    """(term, frequency, value) of stored ``chain_counts`` and ``head_counts``.

    ``value`` is the log factor of a score, ``ln c(gram) - ln c(head)``.  Dividing here, once per
    distinct gram, saves a second lookup per word of the corpus.  The two edges of a post have the
    value ``ln (c / posts)`` in bigrams.
    """
    posts = df.agg(F.count(F.lit(1))).scalar()
    of, frequency = F.col("of"), F.col("times")
    if smoothing:
        # The heads of bigrams are the vocabulary; for longer grams the words are counted.
        own = heads.filter(~F.col("head").startswith(GLUE)) if n == 2 else count_terms(df, F.col(tokens))
        of = of + own.agg(F.count(F.lit(1))).scalar()
        frequency = frequency + 1
    # A word may head a large part of all bigrams, so heads are looked up like any frequent term.
    divisors = heads.select(
        F.col("head").alias("term"), F.col("of").alias("frequency"), F.ln(of).alias("value")
    )
    grams = counts.select(
        F.col("term").alias("gram"), F.col("frequency").alias("times"), F.col("head").alias("term")
    )
    value = F.ln(frequency) - F.col("value")
    if n == 2:
        at_edge = F.col("gram").startswith(GLUE) | F.col("gram").endswith(GLUE)
        value = F.when(at_edge, F.ln(F.col("times") / posts)).otherwise(value)
    return lookup(grams, divisors).select(
        F.col("gram").alias("term"), F.col("times").alias("frequency"), value.alias("value")
    )


def bigram_score(
    df: DataFrame,
    key: Sequence[str],
    tokens: str = "stem_tokens",
    smoothing: bool = False,
    table: DataFrame | None = None,
) -> DataFrame:
    """The product of ``c(w1 w2) / c(w1)``, times the shares of posts that start and end alike.

    A post of fewer than two words scores 0, its logarithm is null (Q5).  ``smoothing`` uses
    ``(c(w1 w2) + 1) / (c(w1) + V)`` (M6).  ``table`` may pass in a written ``chain_table``.
    """
    return _chain_score(df, 2, key, tokens, smoothing, table, "bigram")


def trigram_score(
    df: DataFrame,
    key: Sequence[str],
    tokens: str = "stem_tokens",
    smoothing: bool = False,
    table: DataFrame | None = None,
) -> DataFrame:
    """M5: the product of ``c(w1 w2 w3) / c(w1 w2)``; fewer than three words score 0."""
    return _chain_score(df, 3, key, tokens, smoothing, table, "trigram")


#: A word or gram is heavy if it covers more than this fraction of all rows, so there are fewer than ``HEAVY`` of them.
HEAVY = 1_000


def _heavy(counts: DataFrame, rows: int) -> Heavy:
    """The heavy terms: few enough for every task to know them."""
    found = counts.filter(F.col("frequency") * F.lit(HEAVY) > F.lit(rows)).select("term", "frequency").collect()
    return Heavy([r["term"].split(GLUE) for r in found], [r["frequency"] for r in found])


def _chain_sums(df: DataFrame, key: Sequence[str], tokens: str, n: int, smoothing: bool, words: DataFrame) -> DataFrame:
    """(key.., chain, heads): parts of the sums of ``ln c(gram) - ln c(head)`` and, in bigrams, of ``ln c(word)`` of a key.

    A gram travels once, to the task of its head, where both counts are known, and a sum per post comes back unless it
    is zero.  Heads and grams are those of ``chain_counts``.  Grams travel packed, see ``chains``, and are counted in
    arrays, so no task sorts them as rows.  A head above ``1 / HEAVY`` of all grams would make its task a large one:
    every task knows its count, and its grams are dealt by themselves, a heavy gram among them by post.  Only grams of
    heavy words can be heavy, so few are counted to find those.  ``words`` are the stored word counts.
    """
    t, spark = F.col(tokens), df.sparkSession
    rows, vocabulary = words.agg(F.coalesce(F.sum("frequency"), F.lit(0)), F.count(F.lit(1))).first()
    posts = df.count()
    padded = df.select(*key, _between_edges(t, left=n == 2).alias("_words"))
    heavy_words = _heavy(words, rows)
    # The edges are in as many grams as there are posts.
    often = spark.createDataFrame([*map(tuple, heavy_words.words), ("",)], "term string")

    def heavy_grams(m: int) -> Heavy:
        starts = F.slice("_words", 1, F.greatest(F.size("_words") - F.lit(m - 1), F.lit(0)))
        tuples = F.transform(starts, lambda w, i: F.struct(*[F.get("_words", i + F.lit(k)).alias(f"w{k}") for k in range(m)]))
        found = padded.select(F.inline(tuples))
        for k in range(m):
            found = found.join(F.broadcast(often.withColumnRenamed("term", f"w{k}")), f"w{k}", "left_semi")
        return _heavy(count_terms(found, F.array(F.concat_ws(GLUE, *[f"w{k}" for k in range(m)]))), rows)

    heads, grams = heavy_words if n == 2 else heavy_grams(n - 1), heavy_grams(n)
    buckets = max(spark.sparkContext.defaultParallelism, -(-(rows + posts) // chains.BUCKET_GRAMS))
    # Both edges are among the words of a bigram's post, the end among those of others.
    packed = chains.packed_grams(padded, n, key, buckets, n + 2 if n == 2 else n + 1, heads, grams)
    return chains.gram_sums(packed, n, key, heads, grams, posts, vocabulary if smoothing else None)


def _chain_score(df, n, key, tokens, smoothing, table, name) -> DataFrame:
    t = F.col(tokens)
    if table is None:
        words = materialise(count_terms(df, t), "unigrams")
        sums = _chain_sums(df, key, tokens, n, smoothing, words).select(*key, F.col("chain").alias("total"))
        own = df.select(*key, F.when(F.size(t) >= n, F.lit(0.0)).alias("total"))
        found = own.unionByName(sums).groupBy(*key).agg(F.sum("total").alias("total"))
    else:
        words = F.when(F.size(t) >= n, _between_edges(t) if n == 2 else t)
        terms = _terms(df.select(*key, words.alias("_words")), key, ngram_terms("_words", n))
        found = sum_of_lookups(terms, table, key)
    # A post that is too short has no terms, so its total is null.
    return found.select(
        *key,
        F.col("total").alias(f"{name}_logprob"),
        F.coalesce(F.exp("total"), F.lit(0.0)).alias(f"{name}_probability"),
    )


def post_scores(df: DataFrame, key: Sequence[str], tokens: str = "stem_tokens") -> DataFrame:
    """N1 and N2 together: the unigram counts are the head counts of the bigrams, so a bigram travels once for both."""
    size = F.size(tokens)
    words = materialise(count_terms(df, F.col(tokens)), "unigrams")
    sums = _chain_sums(df, key, tokens, 2, False, words)
    # Each word of a post is the head of one gram: the divisor is the same in all.
    less = -F.greatest(size, F.lit(0)) * F.ln(words.agg(F.count(F.lit(1))).scalar().cast("double"))
    own = df.select(*key, F.when(size > 1, F.lit(0.0)).alias("chain"), F.when(size > 0, less).otherwise(0.0).alias("heads"))
    found = own.unionByName(sums).groupBy(*key).agg(F.sum("chain").alias("bigram"), F.sum("heads").alias("unigram"))
    return found.select(
        *key,
        F.col("unigram").alias("unigram_logprob"),
        F.exp("unigram").alias("unigram_probability"),
        F.col("bigram").alias("bigram_logprob"),
        F.coalesce(F.exp("bigram"), F.lit(0.0)).alias("bigram_probability"),
    )


def relative_score(
    df: DataFrame, key: Sequence[str], tokens: str = "stem_tokens", counts: DataFrame | None = None
) -> DataFrame:
    """The mean word weight of a post as a share of the sum over all posts."""
    if counts is None:
        counts = materialise(count_terms(df, F.col(tokens)), "unigrams")
    table = counts.select(
        "term", "frequency", (F.col("frequency") / distinct_terms(counts)).alias("value")
    )
    found = sum_of_lookups(_terms(df, key, F.col(tokens)), table, key)
    mean = F.coalesce(F.try_divide("total", "terms"), F.lit(0.0))
    return share_of_total(
        found.select(*key, mean.alias("relative_probability")), ["relative_probability"]
    )


def drop_unscored(scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """leave out posts that lack one of the scores."""
    return scored.na.drop(subset=list(columns))


def share_of_total(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Each column divided by its sum; null when the sum is 0.

    The sums are one scalar subquery, not a window, which would pull all rows into one task.
    """
    sums = df.agg(F.struct(*[F.sum(c).alias(c) for c in columns])).scalar()
    return df.withColumns({c + suffix: F.try_divide(F.col(c), sums[c]) for c in columns})


def share_of_log_total(df: DataFrame, column: str, out: str) -> DataFrame:
    """N4 for log scores: ``exp(x - max)`` over its sum, which does not underflow as a whole.

    A null log score stands for probability 0 and gets share 0.
    """
    top = df.agg(F.max(column)).scalar()
    scaled = F.exp(F.col(column) - top)
    total = df.select(scaled.alias("_scaled")).agg(F.sum("_scaled")).scalar()
    return df.withColumn(out, F.coalesce(F.try_divide(scaled, total), F.lit(0.0)))
