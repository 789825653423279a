"""Market prices."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def ticker_labels(tickers: DataFrame) -> dict[str, str]:
    """The symbol-to-label dimension, which names columns and so belongs to the driver.

    A symbol listed twice takes the label that sorts last; one without a label has a blank one.
    """
    rows = tickers.select("ticker_name", "ticker_label").na.fill("").distinct()
    return dict(sorted((row.ticker_name, row.ticker_label) for row in rows.collect()))


def daily_close(bars: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """The last price of each day and ticker; ``order`` breaks ties.

    One order column aggregates by hash.  More of them are tie keys: only the bars at a day's last
    point in time, found by such an aggregate, are compared by all.
    """
    first, *more = order
    day = ["date", "ticker_name"]
    if not more:
        return bars.groupBy(*day).agg(F.max_by("close", first).cast("double").alias("close"))
    last = bars.groupBy(*day).agg(F.max(first).alias("_last"))
    ties = bars.join(last, day).filter(F.col(first) == F.col("_last"))
    return ties.groupBy(*day).agg(F.max_by("close", F.struct(*more)).cast("double").alias("close"))


def in_range(prices: DataFrame, start, end) -> DataFrame:
    """days from ``start`` up to but not including ``end``."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    return prices.filter((F.col("date") >= lo) & (F.col("date") < hi))


def label_tickers(prices: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Add ``ticker_label``; prices of unlisted symbols drop out."""
    spark = prices.sparkSession
    dimension = spark.createDataFrame(
        list(labels.items()), "ticker_name string, ticker_label string"
    )
    return prices.join(F.broadcast(dimension), "ticker_name")


def price_wide(prices: DataFrame, labels: Mapping[str, str], fill=0.0) -> DataFrame:
    """One column per ticker label; a missing price becomes ``fill``.

    Symbols that share a label share its column, which has their mean price; a blank label names none.
    """
    named = {symbol: label for symbol, label in labels.items() if label.strip()}
    wide = (
        label_tickers(prices, named)
        .groupBy("date")
        .pivot("ticker_label", list(dict.fromkeys(named.values())))
        .agg(F.avg("close"))
    )
    return wide if fill is None else wide.na.fill(fill)


def latest_price(bars: DataFrame, per_ticker: bool = False) -> DataFrame:
    """The rows at the latest point in time, or the last price of each ticker."""
    if per_ticker:
        return bars.groupBy("ticker_name").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))
    return bars.filter(F.col("ts") == bars.agg(F.max("ts")).scalar())


def latest_wide(bars: DataFrame, labels: Mapping[str, str], per_ticker: bool = False) -> DataFrame:
    """One row with the latest price of every ticker and its day."""
    prices = latest_price(bars, per_ticker).select("ticker_name", "close")
    day = bars.agg(F.max("date")).scalar()
    return price_wide(prices.withColumn("date", F.lit(day)), labels, fill=None)
