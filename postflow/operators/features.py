"""Feature tables, scaling and the target."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_features(prices: DataFrame, daily: DataFrame, fill=0) -> DataFrame:
    """Prices and daily features of the days that have both; missing values are filled."""
    joined = prices.join(daily, "date")
    return joined if fill is None else joined.na.fill(fill)


def _cell(name: str) -> Column:
    """A column whose name may hold dots, as ticker symbols do."""
    return F.col(f"`{name}`")


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row holding a (lo, hi) pair for each column, from a single pass."""
    return df.agg(
        *[F.struct(F.min(_cell(c)).alias("lo"), F.max(_cell(c)).alias("hi")).alias(c) for c in columns]
    )


def apply_minmax(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale by fitted statistics; a column that was constant becomes null (Q16)."""
    fitted = stats.select(F.struct(*[_cell(c) for c in columns])).scalar()
    return df.withColumns(
        {
            c: F.try_divide(_cell(c) - fitted[c]["lo"], fitted[c]["hi"] - fitted[c]["lo"])
            for c in columns
        }
    )


def normalize_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale each column to [0, 1] by its own minimum and maximum."""
    return apply_minmax(df, fit_minmax(df, columns), columns)


def latest_features(
    latest: DataFrame, daily: DataFrame, original: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """The latest prices with the features of their day, scaled as ``original`` was.

    The result is empty when that day has no posts yet.
    """
    return apply_minmax(latest.join(daily, "date"), fit_minmax(original, columns), columns)


def with_target(
    df: DataFrame, day: int = 5, value: str = "close", by: Sequence[str] = (), out: str = "y"
) -> DataFrame:
    """1 where ``value`` exceeds the mean of a window of ``day`` rows, else 0.

    The window ends one row **after** the current one (Q17), in date order; a row without a full
    window gets 0.  ``df`` has one row per day and ``by`` key, so a partition of the window is
    bounded by the number of days, whatever the number of posts behind it.
    """
    series = Window.partitionBy(*by).orderBy("date")
    frame = series.rowsBetween(2 - day, 1)
    full = (
        (F.row_number().over(series) >= day)
        & F.lead(value, 1).over(series).isNotNull()
        & (F.count(value).over(frame) == day)
    )
    mean = F.sum(value).over(frame) / F.lit(day)
    return df.withColumn(out, F.when(full & (F.col(value) > mean), 1).otherwise(0))
