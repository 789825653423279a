"""Table schemas.  Reading with a declared schema avoids an inference pass over the data."""

from pyspark.sql import types as T

RAW_POSTS = T.StructType(
    [
        T.StructField("group", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("id_str", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("favorite_count", T.LongType()),
        T.StructField("retweet_count", T.LongType()),
        T.StructField("is_repost", T.BooleanType()),
    ]
)

POSTS = T.StructType(
    [
        T.StructField("group", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("url", T.StringType()),
        T.StructField("favorite_count", T.LongType()),
        T.StructField("retweet_count", T.LongType()),
        T.StructField("hashtags", T.StringType()),
        T.StructField("emojis", T.StringType()),
        T.StructField("emoji_text", T.StringType()),
        T.StructField("usernames", T.StringType()),
        T.StructField("links", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

TICKERS = T.StructType(
    [
        T.StructField("ticker_name", T.StringType()),
        T.StructField("ticker_label", T.StringType()),
    ]
)

BARS = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("ticker_name", T.StringType()),
        T.StructField("close", T.DoubleType()),
    ]
)

LONG = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("twitter_ticker", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("uuid", T.StringType()),
    ]
)

#: A post is identified by these columns; ``id`` alone repeats when a user sits in two groups.
POST_KEY = ("group", "user", "id")
