"""One query per operator, each over whole given tables.  Dates are returned as text."""

import datetime
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.functions import entities as en
from postflow.functions import text as tx
from postflow.functions.dates import day_name
from postflow.operators import counts as ct
from postflow.operators import daily as dy
from postflow.operators import features as ft
from postflow.operators import ingest as ig
from postflow.operators import keys as ky
from postflow.operators import ngrams as ng
from postflow.operators import prices as pr
from postflow.operators import scoring as sc
from postflow.operators import vectors as ve
from postflow.operators.counts import GramCounts
from postflow.operators.stems import StemDictionary
from postflow.operators.tokens import clean_text, map_text
from postflow.plans import tables as tb
from postflow.plans.pipeline import Config, parse, run
from postflow.plans.pipeline import scored_posts as attach_scores
from postflow.schemas import POSTS
from postflow.session import materialise, shared_dir, spread
from postflow.sources import posts as sp
from postflow.sources.delivery import arrived, deliver
from postflow.sources.sinks import register, save_table, to_items, write_csv, write_items, write_stage
from postflow.sources.snapshots import SnapshotTable
from postflow.streaming import posts as st

KEY = ["doc_id"]
QUERIES = {}


def query(build):
    """Register a (spark, folder) -> DataFrame function under its name."""
    QUERIES[build.__name__] = build
    return build


def _digest(c):
    return F.md5(F.col(c) if isinstance(c, str) else c)


def _dated(df: DataFrame, *rounded: str, places: int = 4) -> DataFrame:
    df = df.withColumn("date", F.col("date").cast("string"))
    return df.withColumns({c: F.round(c, places) for c in rounded})


def _round_doubles(df: DataFrame, places: int = 4) -> DataFrame:
    return _dated(df, *[c for c, t in df.dtypes if t == "double"], places=places)


def _words(spark, folder) -> DataFrame:
    """(doc_id, tokens) of all documents, not stemmed."""
    docs = clean_text(tb.documents(spark, folder), stem_fn=None)
    return docs.select("doc_id", F.col("nonstem_tokens").alias("tokens"))


def _stored_words(spark, folder) -> DataFrame:
    return materialise(_words(spark, folder), "tokens")


# --- entities ------------------------------------------------------------------------------------


@query
def hashtags(spark, folder):
    """T1"""
    return tb.text_posts(spark, folder).select("id", en.hashtags("text").alias("hashtags"))


@query
def mentions(spark, folder):
    """T2"""
    docs = tb.documents(spark, folder)
    return docs.select("doc_id", en.mentions("text").alias("usernames"))


@query
def links(spark, folder):
    """T3"""
    pages = spread(tb.table(spark, folder, "pages").select("page_id", "html"), "page_id")
    found = en.links("html")
    return pages.select("page_id", F.length(found).alias("size"), _digest(found).alias("links"))


@query
def emoji(spark, folder):
    """T4"""
    return tb.text_posts(spark, folder).select("id", en.emoji("text").alias("emojis"))


@query
def emoji_names(spark, folder):
    """T5"""
    return tb.text_posts(spark, folder).select("id", en.emoji_names("text").alias("emoji_text"))


@query
def flat_posts(spark, folder):
    """S8, F4, P1-P3"""
    flat = sp.flatten_posts(tb.raw_posts(spark, folder))
    return flat.select(
        "group", "user", "id", "url", "favorite_count", "retweet_count",
        _digest("text").alias("text"),
    )


@query
def cast_columns(spark, folder):
    """P3"""
    docs = tb.table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    types = {"doc_id": "string", "source": "double", "n_chars": "double"}
    return sp.cast_columns(docs, types, strict=False)


@query
def quarantined(spark, folder):
    """Q10, Q21"""
    docs = tb.table(spark, folder, "documents")
    number = F.col("doc_id").cast("string")
    raw = docs.select(F.when(F.col("lang") == "en", number).otherwise(F.col("lang")).alias("id_str"))
    good, bad = sp.quarantine(raw)
    both = good.withColumn("kind", F.lit("good")).unionByName(bad.withColumn("kind", F.lit("bad")))
    return both.groupBy("id_str", "kind").agg(F.count(F.lit(1)).alias("records"))


# --- text ----------------------------------------------------------------------------------------


@query
def strip_noise(spark, folder):
    """T6, T7"""
    clean = tx.strip_noise(F.lower("text"))
    return tb.documents(spark, folder).select("doc_id", _digest(clean).alias("digest"))


@query
def strip_noise_spaced(spark, folder):
    """T7 with the blank-keeping option of Q2"""
    clean = tx.strip_noise(F.lower("text"), whitespace="space")
    return tb.documents(spark, folder).select("doc_id", _digest(clean).alias("digest"))


@query
def drop_stop_words(spark, folder):
    """T8, T14"""
    clean = tx.drop_stop_words(F.lower("text"), tx.stop_list())
    return tb.documents(spark, folder).select("doc_id", _digest(clean).alias("digest"))


@query
def strip_emoji(spark, folder):
    """T9"""
    clean = tx.strip_emoji(F.col("text"))
    return tb.text_posts(spark, folder).select("id", _digest(clean).alias("digest"))


@query
def fold_accents(spark, folder):
    """T10"""
    clean = tx.fold_accents(tx.punctuation_to_space(F.lower("text")))
    return tb.documents(spark, folder).select("doc_id", _digest(clean).alias("digest"))


def _token_digest(df, key, tokens):
    return df.select(
        key,
        F.size(tokens).cast("long").alias("words"),
        _digest(F.array_join(tokens, " ")).alias("digest"),
    )


@query
def clean_tokens(spark, folder):
    """T13 without stems"""
    return _token_digest(_words(spark, folder), "doc_id", "tokens")


@query
def clean_tokens_pages(spark, folder):
    """T13 on raw web pages"""
    pages = spread(tb.table(spark, folder, "pages").select("page_id", "html"), "page_id")
    return _token_digest(clean_text(pages, "html", stem_fn=None), "page_id", "nonstem_tokens")


@query
def clean_tokens_posts(spark, folder):
    """T13 on posts with tags, links and emoji"""
    posts = tb.text_posts(spark, folder).select("id", "text")
    return _token_digest(clean_text(posts, stem_fn=None), "id", "nonstem_tokens")


@query
def stem_tokens(spark, folder):
    """T12"""
    stems = clean_text(tb.documents(spark, folder))
    return _token_digest(stems, "doc_id", "stem_tokens")


@query
def stem_dictionary(spark, folder):
    """The stems of all words of the documents, kept in a dictionary that is made in two increments"""
    docs = clean_text(tb.table(spark, folder, "documents").select("doc_id", "text", "lang"), stem_fn=None)
    docs = materialise(docs.select("doc_id", "lang", "nonstem_tokens"), "tokens")
    words = StemDictionary(spark, f"{_root(spark, 'stems')}/words")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    words.add(docs.filter(english))
    words.add(docs.filter(~english))
    return words.read()


@query
def dictionary_stems(spark, folder):
    """The stems of all documents by a look-up in the dictionary"""
    docs = materialise(clean_text(tb.documents(spark, folder), stem_fn=None).select("doc_id", "nonstem_tokens"), "tokens")
    words = StemDictionary(spark, f"{_root(spark, 'stems')}/words")
    words.add(docs)
    return _token_digest(words.stemmed(docs, "doc_id"), "doc_id", "stem_tokens")


@query
def mapped_text(spark, folder):
    """T16"""

    def bracket(pieces: pd.Series) -> pd.Series:
        return "<" + pieces + ">"

    docs = map_text(tb.documents(spark, folder), bracket, chunk=512)
    return docs.select("doc_id", _digest("text").alias("digest"))


# --- n-grams -------------------------------------------------------------------------------------


def _frequency(spark, folder, n, denominator="distinct"):
    grams = ng.gram_frequency(_words(spark, folder), n, "tokens", denominator)
    return grams.select(
        F.array_join("gram", " ").alias("gram"),
        "frequency",
        F.round("relative_frequency", 9).alias("relative_frequency"),
    )


@query
def ngrams(spark, folder):
    """T15"""
    words = ng.with_ngrams(_words(spark, folder), 3, "tokens", "grams")
    joined = F.transform("grams", lambda gram: F.array_join(gram, " "))
    return words.select(
        "doc_id",
        F.size("grams").cast("long").alias("grams"),
        _digest(F.array_join(joined, "|")).alias("digest"),
    )


@query
def unigram_freq(spark, folder):
    """T15, A5, A6"""
    return _frequency(spark, folder, 1)


@query
def unigram_freq_of_total(spark, folder):
    """A6 with the other denominator of Q1"""
    return _frequency(spark, folder, 1, "total")


@query
def bigram_freq(spark, folder):
    """T15, A5, A6"""
    return _frequency(spark, folder, 2)


@query
def trigram_freq(spark, folder):
    """T15, A5, A6"""
    return _frequency(spark, folder, 3)


@query
def quadgram_freq(spark, folder):
    """T15, A5, A6"""
    return _frequency(spark, folder, 4)


@query
def pentagram_freq(spark, folder):
    """T15, A5, A6"""
    return _frequency(spark, folder, 5)


@query
def incremental_bigrams(spark, folder):
    """Bigrams counted in three increments, compacted in between"""
    docs = clean_text(tb.table(spark, folder, "documents").select("doc_id", "text", "lang"), stem_fn=None)
    docs = materialise(docs.select("lang", "nonstem_tokens"), "tokens")
    counts = GramCounts(spark, f"{_root(spark, 'counts')}/bigrams", 2, buckets=8)
    lang = F.coalesce("lang", F.lit("none"))
    for number, part in enumerate((lang == "en", lang == "de", ~lang.isin("en", "de"))):
        for _ in range(2):  # an increment that comes again is known
            counts.add(docs.filter(part), "nonstem_tokens", ("load", number))
        counts.compact(1)
    return counts.frequency().select(
        F.array_join("gram", " ").alias("gram"), "frequency", F.round("relative_frequency", 9).alias("relative_frequency")
    )


@query
def first_last_words(spark, folder):
    """A7, T20"""
    return ng.edge_words(_words(spark, folder), "tokens")


# --- scores --------------------------------------------------------------------------------------


def _logprob(scores, name):
    return scores.select("doc_id", F.round(f"{name}_logprob", 4).alias(f"{name}_logprob"))


@query
def unigram_score(spark, folder):
    """N1, J5, A9"""
    return _logprob(sc.unigram_score(_stored_words(spark, folder), KEY, "tokens"), "unigram")


@query
def bigram_score(spark, folder):
    """N2, J6, J7, A8, A9"""
    return _logprob(sc.bigram_score(_stored_words(spark, folder), KEY, "tokens"), "bigram")


@query
def post_scores(spark, folder):
    """N1 and N2 in one pass"""
    scores = sc.post_scores(_stored_words(spark, folder), KEY, "tokens")
    return scores.select(
        "doc_id",
        F.round("unigram_logprob", 4).alias("unigram_logprob"),
        F.round("bigram_logprob", 4).alias("bigram_logprob"),
    )


@query
def bigram_score_smoothed(spark, folder):
    """M6"""
    words = _stored_words(spark, folder)
    return _logprob(sc.bigram_score(words, KEY, "tokens", smoothing=True), "bigram")


@query
def trigram_score(spark, folder):
    """M5"""
    return _logprob(sc.trigram_score(_stored_words(spark, folder), KEY, "tokens"), "trigram")


@query
def relative_score(spark, folder):
    """N3, A10, J11"""
    scores = sc.relative_score(_stored_words(spark, folder), KEY, "tokens")
    return scores.select(
        "doc_id", F.round("relative_probability", 10).alias("relative_probability")
    )


@query
def score_share(spark, folder):
    """N4"""
    scores = materialise(
        sc.unigram_score(_stored_words(spark, folder), KEY, "tokens"), "scores"
    )
    shares = sc.share_of_log_total(scores, "unigram_logprob", "share")
    # The logarithm of a share tells every document's, also where the share itself is next to nothing.
    top = scores.agg(F.max("unigram_logprob")).scalar()
    total = scores.agg(F.log(F.sum(F.exp(F.col("unigram_logprob") - top))) + F.max("unigram_logprob")).scalar()
    return shares.select("doc_id", F.round("share", 8).alias("share"), F.round(F.col("unigram_logprob") - total, 4).alias("log_share"))


@query
def tf_idf(spark, folder):
    """M7"""
    weights = ve.tf_idf(_stored_words(spark, folder), KEY, "tokens")
    return weights.withColumn("tf_idf", F.round("tf_idf", 6))


@query
def word_vectors(spark, folder):
    """M1"""
    vectors = ve.word_vectors(_stored_words(spark, folder), "tokens", size=8)
    return vectors.select("word", F.size("vector").alias("size"))


@query
def cooccurrence_vectors(spark, folder):
    """M1: the product of each word's vector with itself and with that of the first word, on the plane of two rounds"""
    found = materialise(ve.cooccurrence_vectors(_stored_words(spark, folder), "tokens", size=2, rounds=2, power=0.0), "vectors")
    first = found.agg(F.min_by("vector", "word")).scalar()

    def product(a, b):
        return F.round(a[0] * b[0] + a[1] * b[1], 8) + F.lit(0.0)

    vector = F.col("vector")
    return found.select("word", product(vector, vector).alias("own"), product(vector, first).alias("with_first"))


def _vectors(spark, folder):
    return tb.table(spark, folder, "embeddings").select("vec_id", "embedding")


def _squared(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


@query
def hard_clusters(spark, folder):
    """M2: whether no other centre is nearer than a vector's own"""
    clusters = ve.hard_clusters(_vectors(spark, folder), "embedding", 5, centers="centers")
    away = F.transform("centers", lambda c: _squared(F.col("embedding").cast("array<double>"), c))
    return clusters.select("vec_id", (F.get(away, F.col("cluster")) <= F.array_min(away) + 1e-9).alias("nearest"))


@query
def soft_clusters(spark, folder):
    """M4: the sum of a vector's degrees, and whether each is between 0 and 1"""
    near = ve.principal_components(_vectors(spark, folder), "embedding", 3)
    degrees = ve.soft_clusters(near, "components", 3)
    total = F.aggregate("membership", F.lit(0.0), lambda total, degree: total + degree)
    bounded = F.forall("membership", lambda degree: (degree >= 0) & (degree <= 1 + 1e-9))
    return degrees.select("vec_id", F.round(total, 6).alias("total"), bounded.alias("bounded"))


@query
def fuzzy_clusters(spark, folder):
    """M4: whether a vector's degrees sum to 1 and follow from its distances to the centres, and whether the centres are the weighted means"""
    found = materialise(ve.fuzzy_clusters(_vectors(spark, folder), "embedding", 4, centers="centers"), "degrees")
    own = F.col("embedding").cast("array<double>")
    away = F.transform("centers", lambda c: F.sqrt(_squared(own, c)))
    # Two centres and their degrees stand in the inverse ratio of the squared distances.
    ratio = F.forall(F.arrays_zip(away.alias("d"), F.col("membership").alias("u")), lambda x: F.abs(x["u"] * x["d"] * x["d"] - F.col("membership")[0] * F.col("away")[0] * F.col("away")[0]) < 1e-6)
    checked = found.withColumn("away", away).withColumn("follows", ratio)
    weight = lambda j: F.pow(F.col("membership")[j], 2)
    means = found.select(F.posexplode(own).alias("place", "x"), "membership", "centers")
    means = means.groupBy("place", "centers").agg(*[(F.sum(weight(j) * F.col("x")) / F.sum(weight(j))).alias(f"m{j}") for j in range(4)])
    off = F.greatest(*[F.abs(F.col(f"m{j}") - F.get(F.get("centers", F.lit(j)), F.col("place"))) for j in range(4)])
    still = means.agg((F.max(off) < 1e-4).alias("still")).scalar()
    total = F.aggregate("membership", F.lit(0.0), lambda total, degree: total + degree)
    return checked.select("vec_id", F.round(total, 6).alias("total"), "follows", still.alias("still"))


@query
def principal_components(spark, folder):
    """M3: all components together have the variance of the vectors"""
    vectors = _vectors(spark, folder)
    size = F.size("embedding")
    found = ve.principal_components(vectors, "embedding", vectors.agg(F.max(size)).first()[0])
    parts = found.select(F.posexplode("components").alias("k", "x")).groupBy("k").agg(F.var_samp("x").alias("v"))
    return parts.agg(F.round(F.sum("v"), 6).alias("variance"))


@query
def share_of_total(spark, folder):
    """A11, W4"""
    posts = tb.event_posts(spark, folder).select("id", "value", "retweet_count")
    shares = sc.share_of_total(posts, ["value", "retweet_count"], "_share")
    return shares.select(
        "id",
        F.round("value_share", 12).alias("value_share"),
        F.round("retweet_count_share", 12).alias("retweet_count_share"),
    )


# --- users and days ------------------------------------------------------------------------------


@query
def oldest_users(spark, folder):
    """A2, O2"""
    users = dy.oldest_users(tb.event_posts(spark, folder))
    return users.select("user", F.col("first_post").cast("string").alias("first_post"))


@query
def posts_per_user(spark, folder):
    """A3"""
    return dy.user_counts(tb.event_posts(spark, folder))


@query
def posts_per_group(spark, folder):
    """A1"""
    return dy.group_sizes(tb.event_posts(spark, folder))


@query
def distinct_users(spark, folder):
    """A4"""
    return dy.distinct_users(tb.event_posts(spark, folder))


@query
def users_between(spark, folder):
    """A4: the users of each group in a range of days, exactly, and whether the sketches are within four standard deviations"""
    posts = tb.event_posts(spark, folder)
    sketches = materialise(ct.user_sketches(posts), "sketches")
    about = ct.users_between(sketches, "2024-01-05", "2024-01-20").withColumnRenamed("users", "about")
    days = posts.filter(F.col("date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")))
    exact = days.select("group", "user").distinct().groupBy("group").agg(F.count("user").alias("users"))
    close = F.abs(F.col("about") - F.col("users")) <= 4 * ct.SKETCH_ERROR * F.col("users") + 1
    return exact.join(about, "group").select("group", "users", close.alias("close"))


@query
def local_day(spark, folder):
    """T17, T18"""
    posts = tb.event_posts(spark, folder)
    return posts.select("id", F.col("date").cast("string").alias("date"))


@query
def posts_per_day_name(spark, folder):
    """T19"""
    days = tb.event_posts(spark, folder).groupBy(day_name("date").alias("day"))
    return days.agg(F.count(F.lit(1)).alias("posts"))


@query
def daily_totals(spark, folder):
    """A12"""
    return _dated(dy.daily_totals(tb.event_posts(spark, folder)))


@query
def daily_by_user(spark, folder):
    """A13 in long form"""
    posts = tb.event_posts(spark, folder)
    return _round_doubles(dy.daily_by_user(posts, {"unigram": "value"}))


def _wide(spark, folder):
    """The only scan of the events; what follows reads the stored daily sums several times."""
    by_user = materialise(dy.daily_by_user(tb.channel_posts(spark, folder)), "by_user")
    return dy.daily_wide(by_user, tb.EVENT_TYPES)


@query
def daily_pivot(spark, folder):
    """R2, P7, J1"""
    return _round_doubles(_wide(spark, folder))


@query
def weekend_roll(spark, folder):
    """F6, A14, J2"""
    return _round_doubles(dy.roll_weekend(_wide(spark, folder)))


@query
def weekend_roll_by_user(spark, folder):
    """A14 in long form, with a calendar for each user"""
    by_user = dy.daily_by_user(tb.event_posts(spark, folder), {"unigram": "value"})
    return _round_doubles(dy.roll_weekend(materialise(by_user, "by_user"), by=["user"]))


@query
def latest_days(spark, folder):
    """O1, O3"""
    return _dated(dy.preview(dy.daily_totals(tb.event_posts(spark, folder))))


# --- prices and features -------------------------------------------------------------------------


def _closes(spark, folder):
    return pr.daily_close(tb.bars(spark, folder), ("ts", "seq"))


@query
def prices_daily(spark, folder):
    """S10, A2"""
    return _dated(_closes(spark, folder))


@query
def price_range(spark, folder):
    """F7"""
    return _dated(pr.in_range(_closes(spark, folder), "2024-01-05", "2024-01-20"))


@query
def prices_wide(spark, folder):
    """R3, J8, P4, P6"""
    return _dated(pr.price_wide(_closes(spark, folder), tb.LABELS))


@query
def latest_price(spark, folder):
    """S11, F8"""
    last = pr.latest_price(tb.bars(spark, folder))
    return last.select("ticker_name", "close", F.col("ts").cast("string").alias("ts"))


@query
def latest_price_per_ticker(spark, folder):
    """S11 with the last bar of each ticker"""
    last = pr.latest_price(tb.bars(spark, folder), per_ticker=True)
    return last.select("ticker_name", "close", F.col("ts").cast("string").alias("ts"))


def _features(spark, folder):
    prices = pr.price_wide(_closes(spark, folder), tb.LABELS)
    return ft.build_features(prices, dy.roll_weekend(_wide(spark, folder)))


SCALED = [*tb.LABELS.values(), *dy.COUNTS]


@query
def features(spark, folder):
    """J3, P10"""
    return _round_doubles(_features(spark, folder))


@query
def minmax(spark, folder):
    """N5, N8, A15"""
    stored = materialise(_features(spark, folder), "features")
    return _round_doubles(ft.normalize_columns(stored, SCALED), 8)


@query
def minmax_stats(spark, folder):
    """The fitted statistics"""
    stats = ft.fit_minmax(_features(spark, folder), SCALED)
    pairs = [F.struct(F.lit(c).alias("name"), F.col(f"{c}.lo").cast("double").alias("lo"),
                      F.col(f"{c}.hi").cast("double").alias("hi")) for c in SCALED]
    return stats.select(F.inline(F.array(*pairs)))


@query
def minmax_ref(spark, folder):
    """Days scaled by the statistics of the days with prices"""
    stored = materialise(_features(spark, folder), "features")
    totals = dy.daily_totals(tb.event_posts(spark, folder))
    scaled = ft.apply_minmax(totals, ft.fit_minmax(stored, dy.COUNTS), dy.COUNTS)
    return _round_doubles(scaled, 8)


@query
def latest_features(spark, folder):
    """N7, F9, J4"""
    rolled = materialise(dy.roll_weekend(_wide(spark, folder)), "rolled")
    original = materialise(_features(spark, folder), "features")
    latest = pr.latest_wide(tb.bars(spark, folder), tb.LABELS, per_ticker=True)
    return _round_doubles(ft.latest_features(latest, rolled, original, SCALED), 8)


@query
def target(spark, folder):
    """W1-W3, T21 for every ticker"""
    return _dated(ft.with_target(_closes(spark, folder), 5, by=["ticker_name"]))


@query
def target_wide(spark, folder):
    """W1-W3 on one column of the wide table"""
    prices = pr.price_wide(_closes(spark, folder), tb.LABELS)
    return _dated(ft.with_target(prices, 3, "px_view"))


# --- keys and items ------------------------------------------------------------------------------


@query
def features_long(spark, folder):
    """R4, L4"""
    return _round_doubles(ky.to_long(_features(spark, folder)))


def _previous(long):
    """The table of an earlier run: its first days, under other keys."""
    return long.filter(F.col("date") < F.lit("2024-01-15").cast("date")).select(
        "date", "twitter_ticker", F.concat(F.lit("old-"), "twitter_ticker").alias("uuid")
    )


@query
def keyed_long(spark, folder):
    """L1, L2, J10, U4"""
    long = materialise(ky.to_long(_features(spark, folder)), "long")
    return _round_doubles(ky.with_keys(long, _previous(long)))


@query
def items(spark, folder):
    """L3, K4"""
    totals = ky.to_long(dy.daily_totals(tb.event_posts(spark, folder)))
    encoded = to_items(ky.with_keys(totals))
    return encoded.select(
        F.col("uuid.S").alias("uuid_s"), F.col("date.S").alias("date_s"),
        F.col("twitter_ticker.S").alias("ticker_s"),
        F.col("value.N").cast("double").alias("value_n"),
    )


# --- rosters and increments ----------------------------------------------------------------------


@query
def roster_long(spark, folder):
    """S6, R1, F1"""
    return ig.roster_long(tb.wide_roster(spark, folder))


@query
def roster_keep(spark, folder):
    """F2, J9"""
    roster = ig.roster_long(tb.wide_roster(spark, folder))
    return ig.keep_roster(tb.event_posts(spark, folder), roster).select("group", "user", "id")


@query
def roster_pruned(spark, folder):
    """F2, J9"""
    roster = ig.roster_long(tb.wide_roster(spark, folder))
    return ig.pruned(tb.event_posts(spark, folder), roster).select("group", "user", "id")


def _early_and_late(spark, folder):
    """A history and a batch that overlaps it."""
    posts = tb.event_posts(spark, folder).select("group", "user", "id", "created_at")
    return (
        posts.filter(F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz")),
        posts.filter(F.col("created_at") >= F.lit("2024-01-13").cast("timestamp_ntz")),
    )


@query
def incremental_new(spark, folder):
    """S9, F3, I1"""
    return ig.new_posts(*_early_and_late(spark, folder)).select("group", "user", "id")


@query
def incremental_append(spark, folder):
    """I1, U1"""
    return ig.append_new(*_early_and_late(spark, folder)).select("group", "user", "id")


@query
def id_marks(spark, folder):
    """A15"""
    return ig.id_marks(tb.event_posts(spark, folder))


@query
def since(spark, folder):
    """posts after a point in time up to the newest id of the first user"""
    posts = tb.event_posts(spark, folder)
    newest = ig.id_marks(posts, ["user"]).agg(F.max_by("max_id", "user")).first()[0]
    return ig.until_id(ig.since(posts, "2024-01-10 12:00:00"), newest).select("group", "user", "id")


@query
def user_concat(spark, folder):
    """U1-U3"""
    posts = tb.event_posts(spark, folder)
    liked = posts.filter("group in ('click', 'view')").select("group", "id", "favorite_count")
    others = posts.filter("group not in ('click', 'view')").select("id", "group", "retweet_count")
    counts = {c: "double" for c in dy.COUNTS}
    return sp.cast_columns(sp.merge(liked, others), counts)


@query
def distinct_posts(spark, folder):
    """Posts that were stored twice, read once each"""
    early, late = _early_and_late(spark, folder)
    path = f"{_root(spark, 'twice')}/posts"
    posts = early.unionByName(late).withColumn("created_at", F.col("created_at").cast("timestamp"))
    for field in POSTS:
        if field.name not in posts.columns:
            posts = posts.withColumn(field.name, F.lit(None).cast(field.dataType))
    sp.write_posts(posts.select(*POSTS.fieldNames()), path)
    return sp.read_posts(spark, path, distinct=True).select("user", "id")


# --- whole runs ----------------------------------------------------------------------------------


def _root(spark, name) -> str:
    return f"{shared_dir(spark)}/postflow/{name}-{uuid.uuid4().hex}"


def _landed(spark, folder) -> str:
    """A landing zone of JSON files in which every post has arrived twice, and each of one group
    once more under an id that is none."""
    root = _root(spark, "stream")
    raw = tb.raw_posts(spark, folder)
    raw = raw.withColumn("created_at", F.col("created_at").cast("timestamp"))
    bad = raw.filter("group = 'click'").withColumn("id_str", F.concat(F.lit("n/a "), "id_str"))
    raw.unionByName(raw).unionByName(bad).write.option("compression", "gzip").json(f"{root}/raw")
    return root


@query
def stream_ingest(spark, folder):
    """Land the raw posts twice, with bad ids among them, ingest them as a stream and read the result"""
    root = _landed(spark, folder)
    st.stream_posts(
        spark, f"{root}/raw", f"{root}/posts", f"{root}/checkpoint", files_per_batch=40
    ).awaitTermination()
    posts = sp.read_posts(spark, f"{root}/posts")
    return posts.select(
        "group", "user", "id", "favorite_count", "hashtags", "emojis", "usernames", "links",
        _digest("text").alias("text"),
    )


@query
def stream_dedup(spark, folder):
    """The same landing zone, its repeats found in the state of the stream, within a watermark"""
    root = _landed(spark, folder)
    st.stream_posts(
        spark, f"{root}/raw", f"{root}/posts", f"{root}/checkpoint", delay="60 days"
    ).awaitTermination()
    return sp.read_posts(spark, f"{root}/posts").select("group", "user", "id", _digest("text").alias("text"))


@query
def stream_upsert(spark, folder):
    """I4: the long table kept up to date by two streams with checkpoints of their own; a batch holds two versions of many rows"""
    root = _root(spark, "upsert")
    long = ky.to_long(dy.daily_totals(tb.event_posts(spark, folder))).withColumn("version", F.lit(1))

    def land(rows, place):
        rows.write.mode("append").parquet(f"{root}/{place}")
        landed = spark.readStream.schema(long.schema).parquet(f"{root}/{place}")
        st.stream_long(landed, f"{root}/long", f"{root}/checkpoint-{place}", order=["version"]).awaitTermination()

    later = long.filter(F.col("date") >= F.lit("2024-01-10").cast("date"))
    wrong = later.withColumns({"value": F.col("value") * 9, "version": F.lit(2)})
    later = later.withColumns({"value": F.col("value") * 2, "version": F.lit(3)})
    land(long.filter(F.col("date") < F.lit("2024-01-20").cast("date")), "first")
    land(later.unionByName(long).unionByName(wrong), "first")
    land(long.filter(F.col("date") >= F.lit("2024-01-25").cast("date")).withColumn("value", F.col("value") * 3), "second")
    return _dated(st.read_long(spark, f"{root}/long").select("date", "twitter_ticker", "value", "uuid"))


@query
def parsed_posts(spark, folder):
    """The parse stage on raw records with bad ids among them"""
    raw = tb.raw_posts(spark, folder)
    bad = raw.withColumn("id_str", F.concat(F.lit("n/a "), "id_str"))
    posts, _ = parse(raw.unionByName(bad), ig.roster_long(tb.wide_roster(spark, folder)))
    return posts.select("group", "user", "id", _digest("text").alias("text"))


@query
def pipeline_long(spark, folder):
    """The stages after parsing, from posts and prices of all users to the keyed long table"""
    config = Config(labels=tb.LABELS, target="px_view", today=datetime.date(2024, 2, 1), stems=False)
    posts = tb.text_posts(spark, folder).drop("date")
    return _round_doubles(run(posts, tb.bars(spark, folder), config).long, 10)


# --- files, stages and tables --------------------------------------------------------------------


def _user_lines(spark, folder):
    """(group, user, place, value): lines of a CSV file per language and source of the documents, some of them broken."""
    docs = tb.table(spark, folder, "documents").select("doc_id", "text", "n_chars", F.coalesce("lang", F.lit("none")).alias("group"), F.coalesce("source", F.lit("none")).alias("user"))
    columns = {f.name: F.lit(None).cast("string").alias(f.name) for f in sp.USER_FILE}
    number = F.when(F.col("doc_id") % 7 == 1, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    columns |= {"id": number.alias("id"), "text": F.col("text"), "favorite_count": F.when(F.col("doc_id") % 7 == 2, "many").otherwise(F.col("n_chars").cast("string")).alias("favorite_count")}
    line = F.to_csv(F.struct(*columns.values()), {"quote": '"', "escape": '"'})
    short = F.concat(F.col("doc_id").cast("string"), F.lit(",2024-01-01"))
    docs = docs.select("group", "user", (F.col("doc_id") + 1).alias("place"), F.when(F.col("doc_id") % 7 == 3, short).otherwise(line).alias("value"))
    users = docs.select("group", "user").distinct()
    heads = users.select("group", "user", F.lit(0).alias("place"), F.lit(",".join(columns)).alias("value"))
    ends = users.select("group", "user", F.lit((1 << 63) - 1).alias("place"), F.lit('77,"it never ends').alias("value"))
    return docs.unionByName(heads).unionByName(ends)


@query
def user_files(spark, folder):
    """A CSV file per user, with bad numbers, short lines and an open quote, read as posts and bad records"""
    path = f"{_root(spark, 'users')}/posts"
    lines = _user_lines(spark, folder).repartition("group", "user").sortWithinPartitions("group", "user", "place")
    lines.select("group", "user", "value").write.option("compression", "gzip").partitionBy("group", "user").text(path)
    good, bad = sp.read_user_files(spark, path, pattern="*.txt.gz")
    good = good.select("group", "user", "id", _digest("text").alias("text"), F.col("favorite_count").cast("double").alias("favorite_count"), F.lit(None).cast("string").alias("cause"))
    return good.unionByName(bad.select("group", "user", F.lit(None).cast("double").alias("favorite_count"), _digest("record").alias("text"), "cause", F.lit(-1).cast("long").alias("id")))


@query
def user_csv(spark, folder):
    """All documents written as users' CSV files and read back"""
    docs = tb.table(spark, folder, "documents")
    columns = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in sp.USER_FILE}
    columns |= {"id": F.col("doc_id").alias("id"), "text": F.col("text"), "favorite_count": F.col("n_chars").alias("favorite_count")}
    path = f"{_root(spark, 'users')}/posts"
    owner = [F.coalesce("lang", F.lit("none")).alias("group"), F.coalesce("source", F.lit("none")).alias("user")]
    sp.write_user_files(docs.select(*owner, *columns.values()), path)
    good, bad = sp.read_user_files(spark, path)
    return good.select("group", "user", "id", _digest("text").alias("text"), "favorite_count").unionByName(
        bad.select("group", "user", F.lit(None).cast("long").alias("id"), F.col("record").alias("text"), F.lit(None).cast("long").alias("favorite_count"))
    )


@query
def roster_files(spark, folder):
    """The wide roster as a CSV file"""
    path = f"{_root(spark, 'roster')}/roster"
    write_csv(tb.wide_roster(spark, folder), path)
    return ig.roster_long(sp.read_roster(spark, path))


@query
def ticker_table(spark, folder):
    """The symbols of the events with their labels, stored and read as a dimension"""
    named = tb.bars(spark, folder).select("ticker_name").distinct()
    rows = named.select("ticker_name", F.concat(F.lit("px_"), "ticker_name").alias("ticker_label"))
    stored = write_stage(rows, f"{_root(spark, 'tickers')}/tickers")
    return spark.createDataFrame(list(pr.ticker_labels(stored).items()), "ticker_name string, ticker_label string")


@query
def stage_copy(spark, folder):
    """K3: a stage is stored, and the run goes on from the copy"""
    totals = dy.daily_totals(tb.event_posts(spark, folder))
    return _dated(write_stage(totals, f"{_root(spark, 'stage')}/totals"))


@query
def item_files(spark, folder):
    """K4, L3: items written as JSON lines"""
    path = f"{_root(spark, 'items')}/items"
    totals = ky.to_long(dy.daily_totals(tb.event_posts(spark, folder)))
    encoded = to_items(ky.with_keys(totals))
    write_items(encoded, path)
    found = spark.read.schema(encoded.schema).json(path)
    return found.select(
        F.col("uuid.S").alias("uuid_s"), F.col("date.S").alias("date_s"), F.col("twitter_ticker.S").alias("ticker_s"),
        F.col("value.N").cast("double").alias("value_n"),
    )


@query
def versioned_posts(spark, folder):
    """K2, K3: posts added to a versioned table in two batches, one of which runs twice, and rewritten in one group; each state as it was"""
    posts = tb.event_posts(spark, folder).select("group", "user", "id", "value")
    table = SnapshotTable(spark, f"{_root(spark, 'versions')}/posts", posts.schema)
    table.append(posts.filter("value < 50"), F.col("group"), ("load", 0))
    for _ in range(2):
        table.append(posts.filter("value >= 50"), F.col("group"), ("load", 1))
    table.rewrite(["click"], lambda rows: rows.filter("value < 10"), F.col("group"))
    states = [table.read(manifest=table.manifest(k)).withColumn("version", F.lit(k).cast("long")) for k in (1, 2, 3)]
    every = states[0].unionByName(states[1]).unionByName(states[2])
    return every.groupBy("version", "group").agg(F.count("id").alias("posts"), F.round(F.sum("value"), 4).alias("value"))


@query
def delivered_items(spark, folder):
    """K4: items put into a store that refuses a tenth of them at first, with the attempt at which each arrived"""
    path = f"{_root(spark, 'items')}/ledger"
    by_user = dy.daily_by_user(tb.event_posts(spark, folder), {"unigram": "value"})
    totals = by_user.select("date", F.concat(F.lit("unigram_"), "user").alias("twitter_ticker"), F.col("unigram").cast("double").alias("value"))
    encoded = to_items(ky.with_keys(totals))

    def put(items, attempt):
        return [i["uuid"]["S"] for i in items if attempt == 1 and i["uuid"]["S"][0] in "07"]

    left = deliver(encoded, path, put)
    found = arrived(spark, path).select("uuid", F.col("attempt").cast("long").alias("attempt"))
    return found.unionByName(left.select(F.col("uuid.S").alias("uuid"), F.lit(-1).cast("long").alias("attempt")))


@query
def saved_table(spark, folder):
    """K5: a managed table, read back with SQL"""
    name = f"postflow_documents_{uuid.uuid4().hex}"
    save_table(tb.table(spark, folder, "documents").select("doc_id", "lang"), name)
    return spark.sql(f"SELECT lang, count(*) AS documents FROM {name} GROUP BY lang")


@query
def sql_view(spark, folder):
    """K6"""
    register(tb.table(spark, folder, "documents"), "postflow_view")
    return spark.sql("SELECT source, max(n_chars) AS longest FROM postflow_view GROUP BY source")


@query
def scored_posts(spark, folder):
    """Posts with their words, grams and scores in one table, without the row key"""
    words = _words(spark, folder).withColumnsRenamed({"doc_id": "id", "tokens": "stem_tokens"})
    tokens = materialise(words.withColumn("row_id", F.monotonically_increasing_id()), "tokens")
    full = attach_scores(tokens, materialise(sc.post_scores(tokens, ["row_id"]), "scores"))
    return full.select(
        "id", F.size("stem_tokens").cast("long").alias("words"), F.size("bigram_sentence").cast("long").alias("bigrams"),
        F.size("pentagram_sentence").cast("long").alias("pentagrams"), F.round("unigram_logprob", 4).alias("unigram_logprob"),
    )


@query
def unscored_left_out(spark, folder):
    """F10"""
    scores = sc.bigram_score(_stored_words(spark, folder), KEY, "tokens")
    return sc.drop_unscored(scores, ["bigram_logprob"]).select("doc_id")
