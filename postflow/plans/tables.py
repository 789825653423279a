"""The given tables in the shape of posts, price bars and rosters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postflow.functions.dates import with_local_day
from postflow.session import spread

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
#: The event types as ticker symbols and their labels.
LABELS = {name: f"px_{name}" for name in EVENT_TYPES}
EMOJI_SAMPLES = ["👍🏽", "❤️", "👩‍💻", "🇫🇷", "1️⃣", "🎉🎉", "", "⏰⌚ ⬛", "🆕🆗 ⭕🀄", "★ ♪ ✓ ➜", "☀ ☝🏽 ©"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder) -> DataFrame:
    """(doc_id, text), over all cores."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def event_posts(spark, folder) -> DataFrame:
    """Every event as a post without text; a group is an event type."""
    posts = table(spark, folder, "events").select(
        F.col("event_type").alias("group"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.floor("value").alias("favorite_count"),
        F.get_json_object("props", "$.k").cast("long").alias("retweet_count"),
        "value",
    )
    return with_local_day(posts)


def channel_posts(spark, folder) -> DataFrame:
    """Every event as a scored post of one of five accounts, the event types."""
    return event_posts(spark, folder).select(
        "date",
        F.col("group").alias("user"),
        "favorite_count",
        "retweet_count",
        F.col("value").alias("unigram_probability"),
        (F.col("retweet_count") / F.lit(64)).alias("bigram_probability"),
    )


def text_posts(spark, folder) -> DataFrame:
    """Every event as a post: the text of the document of its number, if any, tags, a link and an emoji."""
    docs = documents(spark, folder).withColumnRenamed("doc_id", "id")
    events = event_posts(spark, folder).drop("value")
    samples = F.array(*[F.lit(e) for e in EMOJI_SAMPLES])
    emoji = F.get(samples, F.pmod("id", F.lit(len(EMOJI_SAMPLES))).cast("int"))
    text = F.concat_ws(
        " ",
        F.col("text"),
        F.concat(F.lit("#"), "group"),
        F.concat(F.lit("@"), "user"),
        F.concat(F.lit("https://x.example/"), F.col("id").cast("string")),
        emoji,
    )
    return events.join(docs, "id", "left").select(
        "group", "user", "id", "created_at", "date", "favorite_count", "retweet_count",
        text.alias("text"),
    )


def raw_posts(spark, folder) -> DataFrame:
    """The same posts as they land, before they are flattened; those of one group are reposts."""
    posts = text_posts(spark, folder)
    return posts.select(
        "group", "user", F.col("id").cast("string").alias("id_str"), "created_at",
        F.col("text").alias("full_text"), "favorite_count", "retweet_count",
        (F.col("group") == "view").alias("is_repost"),
    )


def bars(spark, folder) -> DataFrame:
    """Every event as a price tick; a ticker is an event type."""
    ticks = table(spark, folder, "events").select(
        "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("ticker_name"),
        F.col("value").alias("close"),
    )
    return with_local_day(ticks, "ts")


def wide_roster(spark, folder) -> DataFrame:
    """One column per group; a cell names a user who once had a value of 60 or more there."""
    posts = event_posts(spark, folder).filter("value >= 60")
    cells = posts.groupBy("user").pivot("group", EVENT_TYPES).agg(F.first("user"))
    return cells.drop("user").na.fill("")
