"""M1-M4, M7: term weights, word vectors, clusters and principal components.

The iterative models but the fuzzy clusters, ``word_vectors`` and ``cooccurrence_vectors`` come with Spark.  What they keep on
the driver does not grow with the number of posts: cluster centres and a covariance matrix.
"""

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.operators.skew import HEAD, HOT_ENTRIES, lookup
from postflow.session import materialise


def tf_idf(df: DataFrame, key: Sequence[str], tokens: str = "stem_tokens") -> DataFrame:
    """M7: (key.., term, frequency, tf_idf) with ``idf = ln((posts + 1) / (posts with term + 1))``."""
    words = df.select(*key, F.explode(tokens).alias("term"))
    counts = materialise(
        words.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("frequency")), "term-counts"
    )
    holders = counts.groupBy("term").agg(F.count(F.lit(1)).alias("holders"))
    posts = df.agg(F.count(F.lit(1))).scalar()
    table = holders.select(
        "term",
        F.col("holders").alias("frequency"),
        F.ln((posts + 1) / (F.col("holders") + 1)).alias("value"),
    )
    weighted = lookup(counts, materialise(table, "idf"))
    return weighted.select(*key, "term", "frequency", (F.col("frequency") * F.col("value")).alias("tf_idf"))


#: Words that a task trains on at once; their vectors are all it keeps.
SLICE_WORDS = 500_000
#: Neighbours of a word on either side, other words that a pair is held against, the first rate of learning, pairs a step.
WINDOW, OTHERS, RATE, STEP = 5, 5, 0.025, 4_096


def _first_vectors(words: pa.Array, size: int, seed: int) -> np.ndarray:
    """The vectors that training starts from: digests of the words, so that every task has the same."""
    seeds = np.array([zlib.crc32(f"{seed}:{w}".encode()) for w in words.to_pylist()], np.uint64)
    mixed = (seeds[:, None] + np.uint64(1)) * (np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(11)).astype(float) / (1 << 53) - 0.5) / size


def _add_means(to: np.ndarray, rows: np.ndarray, steps: np.ndarray) -> None:
    """Add to each row the mean of its steps, times the root of their number, which keeps common words from running away."""
    order = np.argsort(rows, kind="stable")
    found, first, n = np.unique(rows[order], return_index=True, return_counts=True)
    to[found] += np.add.reduceat(steps[order], first, axis=0) / np.sqrt(n)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_words(codes: np.ndarray, post: np.ndarray, vectors: np.ndarray, outer: np.ndarray, rate: float, rng: np.random.Generator) -> None:
    """Train ``vectors`` and ``outer`` in place: skip-grams with negative samples over the words of one slice.

    ``codes`` are the words in order, ``post`` the number of the post of each.  A pair ``d`` places apart is taken with
    probability (WINDOW + 1 - d) / WINDOW, in both directions; others are drawn by their frequency to the power 0.75.
    """
    weights = np.bincount(codes, minlength=len(vectors)) ** 0.75
    drawn = np.cumsum(weights / weights.sum())
    for d in range(1, WINDOW + 1):
        near = np.flatnonzero(post[:-d] == post[d:]) if len(codes) > d else np.zeros(0, np.int64)
        near = near[rng.random(len(near)) < (WINDOW + 1 - d) / WINDOW]
        pairs = np.concatenate([np.stack([codes[near], codes[near + d]]), np.stack([codes[near + d], codes[near]])], axis=1)
        pairs = pairs[:, rng.permutation(pairs.shape[1])]
        for at in range(0, pairs.shape[1], STEP):
            a, b = pairs[:, at : at + STEP]
            other = np.minimum(np.searchsorted(drawn, rng.random(64)), len(drawn) - 1)
            x, y, z = vectors[a], outer[b], outer[other]
            pull = 1 - _sigmoid((x * y).sum(axis=1, keepdims=True))
            push = -_sigmoid(x @ z.T) * (OTHERS / len(other))
            _add_means(vectors, a, rate * (pull * y + push @ z))
            _add_means(outer, b, rate * pull * x)
            _add_means(outer, other, rate * (push.T @ x) / np.sqrt(len(a)))


def _trained(numbers: np.ndarray, texts: list, known: dict | None, size: int, rate: float, seed: int) -> pa.RecordBatch:
    """(word, n, vector, outer) of the words of the posts ``texts``, trained on them from ``known`` or the first vectors."""
    flat = pa.concat_arrays(texts).dictionary_encode()
    words, codes = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
    vectors, outer = _first_vectors(words, size, seed), np.zeros((len(words), size))
    if known is not None:
        place = {w: i for i, w in enumerate(words.to_pylist())}
        for w, x, y in zip(known["word"], known["vector"], known["outer"]):
            if w in place:
                vectors[place[w]], outer[place[w]] = x, y
    train_words(codes, numbers, vectors, outer, rate, np.random.default_rng(seed))
    return pa.RecordBatch.from_arrays(
        [words, pa.array(np.bincount(codes, minlength=len(words))), *[pa.array(list(v), pa.list_(pa.float64())) for v in (vectors, outer)]],
        ["word", "n", "vector", "outer"],
    )


def _trainer(size: int, rate: float, seed: int, fresh: bool):
    """The function that trains one slice of posts beside the vectors of its words."""

    def train(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [x.values for x in left.column("t")]
        if not texts:
            return _ARROW.empty_table()
        numbers = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        known = None if fresh else {c: right.column(c).to_pylist() for c in ("word", "vector", "outer")}
        return pa.Table.from_batches([_trained(numbers, texts, known, size, rate, seed)])

    return train


_TRAINED = "word string, n long, vector array<double>, outer array<double>"
_ARROW = pa.schema([("word", pa.string()), ("n", pa.int64()), ("vector", pa.list_(pa.float64())), ("outer", pa.list_(pa.float64()))])


def _met(parts: DataFrame, size: int) -> DataFrame:
    """(word, n, vector, outer): the means of what the slices made of a word, weighted by how often they have it."""
    sums = [F.sum(F.col(c)[k] * F.col("n")).alias(f"{c}{k}") for c in ("vector", "outer") for k in range(size)]
    total = parts.groupBy("word").agg(F.sum("n").alias("n"), *sums)
    means = [F.array(*[F.col(f"{c}{k}") / F.col("n") for k in range(size)]).alias(c) for c in ("vector", "outer")]
    return total.select("word", "n", *means)


def word_vectors(
    df: DataFrame, tokens: str = "stem_tokens", size: int = 100, min_count: int = 1, seed: int = 0,
    iterations: int = 1, partitions: int | None = None,
) -> DataFrame:
    """M1: (word, vector) of the words that occur ``min_count`` times, skip-grams with negative samples.

    Tasks train on slices of ``SLICE_WORDS`` words, for which they hold the vectors of the words of the slice alone; after
    each iteration the vectors of a word are averaged by a shuffle.  Neither the driver nor a task ever has the
    vocabulary.  ``partitions`` deals the posts anew.  Results are the same for the same slices.
    """
    posts = df.select(F.filter(tokens, lambda w: w.isNotNull()).alias("t")).filter("size(t) > 0")
    if partitions:
        posts = posts.repartition(partitions)
    if min_count > 1:
        # Rare words are left out before neighbours are told.
        posts = materialise(posts.withColumn("post", F.monotonically_increasing_id()), "posts")
        each = posts.select("post", F.posexplode("t").alias("i", "word"))
        often = each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count).select("word")
        kept = each.join(often, "word").groupBy("post").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("kept"))
        posts = kept.select(F.col("kept.word").alias("t"))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, texts, held = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                numbers.append(np.full(len(text.values), len(numbers)))
                texts.append(text.values)
                held += len(text.values)
                if held >= SLICE_WORDS:
                    yield _trained(np.concatenate(numbers), texts, None, size, RATE, seed)
                    numbers, texts, held = [], [], 0
        if texts:
            yield _trained(np.concatenate(numbers), texts, None, size, RATE, seed)

    if iterations == 1:
        return _met(posts.mapInArrow(sliced, _TRAINED), size).select("word", "vector")

    # Later iterations need the vectors of a slice's words beside it, so posts are dealt to numbered slices.
    counted = materialise(posts.withColumn("n", F.size("t")), "counted")
    slices = 1 + (counted.agg(F.sum("n")).first()[0] or 0) // SLICE_WORDS
    slices = max(slices, partitions or 1)
    dealt = materialise(counted.select("t", F.pmod(F.xxhash64("t", F.monotonically_increasing_id()), F.lit(slices)).alias("slice")), "dealt")
    needed = materialise(dealt.select("slice", F.explode("t").alias("word")).distinct(), "needed")
    now = None
    for r in range(iterations):
        rate = RATE * (1 - r / iterations)
        if now is None:
            beside = needed.select("slice", F.lit(None).cast("string").alias("word"), F.array().cast("array<double>").alias("vector"), F.array().cast("array<double>").alias("outer")).limit(0)
        else:
            beside = needed.join(now.drop("n"), "word").select("slice", "word", "vector", "outer")

        parts = dealt.groupBy("slice").cogroup(beside.groupBy("slice")).applyInArrow(_trainer(size, rate, seed, now is None), _TRAINED)
        now = materialise(_met(parts, size), "vectors")
    return now.select("word", "vector")


def _neighbours(df: DataFrame, tokens: str, window: int) -> DataFrame:
    """(a, b): the words that stand at most ``window`` places apart, once, in their order."""
    pairs = [
        F.arrays_zip(F.slice(tokens, 1, F.greatest(F.size(tokens) - d, F.lit(0))).alias("a"), F.slice(tokens, 1 + d, F.greatest(F.size(tokens) - d, F.lit(0))).alias("b"))
        for d in range(1, window + 1)
    ]
    return df.select(F.explode(F.concat(*pairs)).alias("p")).select("p.a", "p.b").filter("a is not null and b is not null")


def cooccurrences(df: DataFrame, tokens: str = "stem_tokens", window: int = 2) -> DataFrame:
    """M1: (word, other, n), how often two words stand at most ``window`` places apart; each pair counts in both directions."""
    flat = _neighbours(df, tokens, window)
    # Both directions have one count, so a pair is counted once and doubled after the shuffle.
    once = flat.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    own = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), (F.col("n") * 2).alias("n")))
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), "n"), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), "n"))
    return once.select(F.inline(F.when(F.col("a") == F.col("b"), own).otherwise(both)))


def _information(n: str, every: Column, m: str, o: str) -> Column:
    """``ln(n * every / (m * o))`` where that is above 0, judged in whole numbers, and null elsewhere."""
    whole = [c.cast("decimal(19,0)") for c in (F.col(n), every, F.col(m), F.col(o))]
    ratio = F.col(n).cast("double") * every / (F.col(m).cast("double") * F.col(o))
    return F.when(whole[0] * whole[1] > whole[2] * whole[3], F.ln(ratio))


def positive_information(counts: DataFrame) -> DataFrame:
    """M1: (word, other, weight) where ``weight = ln(n * all / (n of word * n of other))`` is above 0, judged in whole numbers."""
    of = counts.groupBy("word").agg(F.sum("n").alias("m"))
    total = F.broadcast(of.agg(F.sum("m").alias("all")))  # one row
    rows = counts.join(of, "word").join(of.select(F.col("word").alias("other"), F.col("m").alias("o")), "other").join(total)
    return rows.select("word", "other", _information("n", F.col("all"), "m", "o").alias("weight")).filter("weight is not null")


def _counted_words(df: DataFrame, tokens: str, window: int) -> DataFrame:
    """(word, times, m): how often a word occurs and how many neighbours it has, counted without a pair."""
    t = F.col(tokens)

    def around(i: Column) -> Column:
        return sum((F.get(t, i + F.lit(d)).isNotNull().cast("long") for d in range(-window, window + 1) if d), F.lit(0).cast("long"))

    each = df.select(F.inline(F.transform(t, lambda w, i: F.struct(w.alias("word"), around(i).alias("m"))))).filter("word is not null")
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("times"), F.sum("m").alias("m"))


def _often(words: DataFrame, rows: Column) -> list[str]:
    """The most frequent words, ``HOT_ENTRIES`` at most.

    They are few letters too: a word of more than ``HEAD`` is one only if it covers 1 / HOT_ENTRIES of the text.
    """
    sizes = words.groupBy("times").agg(F.count(F.lit(1)).alias("n")).collect()  # as many rows as frequencies, a root of the text
    least, held = 0, 0
    for r in sorted(sizes, reverse=True):
        held += r["n"]
        if held > HOT_ENTRIES:
            least = r["times"] + 1
            break
    short = (F.col("times") >= least) & (F.length("word") <= HEAD)
    return sorted(r["word"] for r in words.filter(short | (F.col("times") * F.lit(HOT_ENTRIES) >= rows)).select("word").collect())


def _coded(df: DataFrame, tokens: str, hot: Sequence[str]) -> DataFrame:
    """(t, c): the words of a post, and for each its place in ``hot``, -1 for a word that is not there, null for a null."""
    kind = df.schema[tokens].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(hot, pa.string())
        for batch in batches:
            posts = batch.column(0)
            flat = posts.flatten()
            codes = pc.if_else(pc.is_valid(flat), pc.fill_null(pc.index_in(flat, value_set=known), -1), pa.scalar(None, pa.int32()))
            sizes = pc.fill_null(pc.list_value_length(posts), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, codes)], ["t", "c"])

    return df.select(tokens).mapInArrow(code, f"t {kind}, c array<int>")


def _pair_tables(df: DataFrame, tokens: str, window: int, hot: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hot pairs, mixed, cold pairs): the counts of ``cooccurrences``, each pair once, in three tables.

    Two words of ``hot`` are one number (pair, n).  A cold word covers less than ``1 / HOT_ENTRIES`` of all words; it
    goes with the codes of all hot words near it, one row an occurrence, and has them in one row in the end: (word, codes, ns).
    Two cold words are (word, other, n).
    """
    coded = _coded(df, tokens, hot)
    n, offsets = F.count(F.lit(1)), [d for d in range(-window, window + 1) if d]
    a, b = F.col("a"), F.col("b")
    pair = (F.least(a, b).cast("long") * HOT_ENTRIES + F.greatest(a, b)).alias("pair")
    near = _neighbours(coded, "c", window).filter("a >= 0 and b >= 0").groupBy(pair).agg(n.alias("n"))

    def beside(w: Column, i: Column) -> Column:
        codes = F.filter(F.array(*[F.get("c", i + F.lit(d)) for d in offsets]), lambda x: x >= 0)
        return F.struct(w.alias("word"), F.get("c", i).alias("code"), codes.alias("codes"))

    mixed = coded.select(F.inline(F.transform("t", beside))).filter("code = -1 and size(codes) > 0")
    mixed = mixed.repartition("word").select("word", F.explode("codes").alias("code")).groupBy("word", "code").agg(n.cast("int").alias("n"))
    mixed = mixed.groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("all"))

    def after(w: Column, i: Column) -> Column:
        cold = [F.when((F.get("c", i) == -1) & (F.get("c", i + F.lit(d)) == -1), F.struct(w.alias("a"), F.get("t", i + F.lit(d)).alias("b"))) for d in offsets if d > 0]
        return F.filter(F.array(*cold), lambda x: x.isNotNull())

    cold = coded.select(F.inline(F.flatten(F.transform("t", after))))
    cold = cold.groupBy(F.least("a", "b").alias("word"), F.greatest("a", "b").alias("other")).agg(n.alias("n"))
    return materialise(near, "hot-pairs"), materialise(mixed.select("word", F.col("all.code").alias("codes"), F.col("all.n").alias("ns")), "mixed-pairs"), materialise(cold, "cold-pairs")


def _shares(pairs: DataFrame, every: Column) -> DataFrame:
    """(word, w, x): what each of two words, (word, m, x) and (other, o, y) that meet ``n`` times, gets of the other's vector; a word with itself once."""
    same = F.col("word") == F.col("other")
    pairs = pairs.withColumn("n", F.when(same, F.col("n") * 2).otherwise(F.col("n")))
    pairs = pairs.withColumn("w", _information("n", every, "m", "o")).filter("w is not null")
    one = F.struct("word", "w", F.col("y").alias("x"))
    two = F.struct(F.col("other").alias("word"), "w", "x")
    return pairs.select(F.inline(F.when(same, F.array(one)).otherwise(F.array(one, two))))


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """The products of all pairs of components, summed over the vectors ``x``: tasks add up their own, width ** 2 rows come back."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["place", "s"])

    total = np.zeros(width * width)
    for r in rows.select("x").mapInArrow(add, "place long, s double").groupBy("place").agg(F.sum("s").alias("s")).collect():
        total[r["place"]] = r["s"]
    return total.reshape(width, width)


def _turned(rows: DataFrame, width: int, power: float) -> tuple[DataFrame, int]:
    """``rows`` with x as left singular vectors times singular values to ``power``, and how many there are: directions without extent go."""
    values, directions = np.linalg.eigh(_gram(rows, width))
    keep = np.flatnonzero(values > max(values.max(initial=0.0), 0.0) * 1e-14)[::-1]
    turn = directions[:, keep] * np.sqrt(values[keep]) ** (power - 1)
    place = rows.columns.index("x")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(place).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) @ turn
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(keep), pa.int32())
            columns = batch.columns
            columns[place] = pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows.mapInArrow(apply, rows.schema), len(keep)


def cooccurrence_vectors(
    df: DataFrame, tokens: str = "stem_tokens", size: int = 100, window: int = 2, rounds: int = 4, power: float = 0.5, seed: int = 0
) -> DataFrame:
    """M1: (word, vector) of all words, from a block power iteration over their ``positive_information``.

    What the driver sees are ``size`` x ``size`` products, whatever the vocabulary.  Pairs travel once, to be counted; in a round
    the vectors of hot words, at most ``HOT_ENTRIES``, are broadcast, and those of the others meet all pairs of their word in one row.
    Weights are made anew from the counts in each round.  Vectors are orthogonal directions times the strength of each to ``power``,
    the strongest first; at power 0 their products are those of the projection on the space that the rounds end in.
    The first vectors are digests of the words, so a run can be repeated.  There are fewer than ``size`` components where the weights
    have fewer directions.  A word without a positive weight has the zero vector; null words are none.
    """
    words = materialise(_counted_words(df, tokens, window), "words")
    rows, every = words.agg(F.sum("times")).scalar(), words.agg(F.sum("m")).scalar()
    often = _often(words, rows)
    hot = F.broadcast(df.sparkSession.createDataFrame([(w, i) for i, w in enumerate(often)], "word string, code int"))
    near, mixed, cold = _pair_tables(df, tokens, window, often)
    number = [F.conv(F.substring(F.md5(F.concat(F.col("word"), F.lit(f":{k}:{seed}"))), 1, 8), 16, 10).cast("double") / (1 << 32) - 0.5 for k in range(size)]
    now, width = words.select("word", "m", F.array(*number).alias("x")), size
    near = near.select(F.floor(F.col("pair") / HOT_ENTRIES).cast("int").alias("code"), (F.col("pair") % HOT_ENTRIES).cast("int").alias("with"), "n")
    for r in range(rounds):
        far = now.join(hot, "word", "left_anti")
        known = now.join(hot, "word")
        others = far.select(F.col("word").alias("other"), F.col("m").alias("o"), F.col("x").alias("y"))
        first, second = F.broadcast(known), F.broadcast(known.select(F.col("code").alias("with"), F.col("word").alias("other"), F.col("m").alias("o"), F.col("x").alias("y")))
        met = [
            near.join(first, "code").join(second, "with"),
            mixed.join(far, "word").select("word", "m", "x", F.inline(F.arrays_zip(F.col("codes").alias("with"), F.col("ns").alias("n")))).join(second, "with"),
            cold.join(far, "word").join(others, "other"),
        ]
        sums = now.select("word", "m", F.lit(0.0).alias("w"), "x")
        for pairs in met:
            sums = sums.unionByName(_shares(pairs, every), allowMissingColumns=True)
        sums = sums.groupBy("word").agg(F.max("m").alias("m"), *[F.sum(F.col("w") * F.col("x")[k]).alias(f"s{k}") for k in range(width)])
        stepped = materialise(sums.select("word", "m", F.array(*[f"s{k}" for k in range(width)]).cast("array<double>").alias("x")), "stepped")
        now, width = _turned(stepped, width, power if r == rounds - 1 else 0.0)
        now = materialise(now, "vectors")
        if not width:
            break
    return now.select("word", F.col("x").alias("vector"))


def _features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))


def hard_clusters(
    df: DataFrame, vector: str, k: int, seed: int = 0, centers: str | None = None
) -> DataFrame:
    """M2: add the number of the nearest of ``k`` centres as ``cluster``, and with a name all ``centers``."""
    rows = _features(df, vector)
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(rows)
    found = model.transform(rows).drop("_features")
    if centers is None:
        return found
    points = [F.array(*[F.lit(float(x)) for x in center]) for center in model.clusterCenters()]
    return found.withColumn(centers, F.array(*points))


def soft_clusters(df: DataFrame, vector: str, k: int, seed: int = 0) -> DataFrame:
    """M4: add the degrees of membership in ``k`` clusters, which sum to 1, as ``membership``."""
    rows = _features(df, vector)
    model = GaussianMixture(
        k=k, seed=seed, featuresCol="_features", predictionCol="_cluster", probabilityCol="_degrees"
    ).fit(rows)
    fitted = model.transform(rows).withColumn("membership", vector_to_array("_degrees"))
    return fitted.drop("_features", "_cluster", "_degrees")


def degrees(points: np.ndarray, centers: np.ndarray, fuzzy: float) -> np.ndarray:
    """The degrees of each point: 1 / sum over l of (d_j / d_l) ** (2 / (fuzzy - 1)); a point on centres belongs to those alone."""
    away = ((points[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    on = away == 0
    inverse = np.where(on, 1.0, away) ** (-1 / (fuzzy - 1))
    inverse = np.where(on.any(axis=1)[:, None], on.astype(float), inverse)
    return inverse / inverse.sum(axis=1)[:, None]


def fuzzy_centers(
    df: DataFrame, vector: str, k: int, fuzzy: float = 2.0, tolerance: float = 1e-6, rounds: int = 100, seed: int = 0
) -> np.ndarray:
    """M4: the ``k`` centres of fuzzy c-means, the means of all points weighted by their degrees to the power ``fuzzy``.

    A round is one aggregate: every task adds up weights and weighted points batch by batch, and k rows come back.  Rounds end
    when no component of a centre moves by more than ``tolerance``, or after ``rounds``.  The first centres are the
    k different vectors of smallest hash.  Null vectors, and those that hold a null or non-finite number, are left out.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).filter(F.coalesce(finite, F.lit(False)))
    first = rows.distinct().orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(k).collect()
    centers = np.array([r["v"] for r in first], float)
    if not len(centers):
        return centers
    dim = centers.shape[1]

    def summed(now):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, sums = np.zeros(len(now)), np.zeros((len(now), dim))
            for batch in batches:
                points = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                for at in range(0, len(points), 4096):
                    w = degrees(points[at : at + 4096], now, fuzzy) ** fuzzy
                    weights += w.sum(axis=0)
                    sums += w.T @ points[at : at + 4096]
            place = np.repeat(np.arange(len(now)), dim + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(np.tile(np.arange(dim + 1), len(now))), pa.array(np.hstack([sums, weights[:, None]]).ravel())],
                ["cluster", "place", "x"],
            )

        return add

    stored = materialise(rows.filter(F.size("v") == dim), "points")
    for _ in range(rounds):
        parts = stored.mapInArrow(summed(centers), "cluster long, place long, x double").groupBy("cluster", "place").agg(F.sum("x").alias("x"))
        total = np.zeros((len(centers), dim + 1))
        for r in parts.collect():  # as many as the centres have components
            total[r["cluster"], r["place"]] = r["x"]
        new = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1e-300), centers)
        moved = np.abs(new - centers).max()
        centers = new
        if moved <= tolerance:
            break
    return centers


def fuzzy_clusters(df: DataFrame, vector: str, k: int, fuzzy: float = 2.0, centers: str | None = None, **options) -> DataFrame:
    """M4: add the degrees of membership in ``k`` fuzzy clusters as ``membership``, and with a name all ``centers``.

    Degrees are the closed formula for the centres that ``fuzzy_centers`` ends with; those of a vector that it leaves out are null.
    """
    found = fuzzy_centers(df, vector, k, fuzzy, **options)
    points = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in found]) if len(found) else F.array().cast("array<array<double>>")
    own = F.col(vector).cast("array<double>")
    fits = F.coalesce((F.size(own) == (found.shape[1] if len(found) else -1)) & F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    away = F.transform(points, lambda c: F.aggregate(F.zip_with(own, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    rows = df.withColumn("_away", F.when(fits, away))
    on = F.array_contains("_away", F.lit(0.0))
    inverse = F.transform("_away", lambda d: F.when(on, (d == 0).cast("double")).otherwise(F.pow(d, F.lit(-1 / (fuzzy - 1)))))
    rows = rows.withColumn("_inverse", inverse)
    total = F.aggregate("_inverse", F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("membership", F.transform("_inverse", lambda x: x / total)).drop("_away", "_inverse")
    return rows.withColumn(centers, points) if centers else rows


def principal_components(df: DataFrame, vector: str, k: int) -> DataFrame:
    """M3: add the first ``k`` principal components as ``components``."""
    rows = _features(df, vector)
    model = PCA(k=k, inputCol="_features", outputCol="_components").fit(rows)
    fitted = model.transform(rows).withColumn("components", vector_to_array("_components"))
    return fitted.drop("_features", "_components")
