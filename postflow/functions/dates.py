"""Local wall clock, local day and weekday, independent of the session time zone."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZONE = "America/New_York"
_DAY_MICROS = 86_400_000_000


def local_time(c, zone: str = ZONE, source: str = "UTC") -> Column:
    """T17 for a zoneless timestamp that holds ``source`` time."""
    return F.convert_timezone(F.lit(source), F.lit(zone), c)


def local_day_of_instant(c, zone: str = ZONE) -> Column:
    """T18 for an instant: the calendar day in ``zone``."""
    wall = F.unix_micros(F.from_utc_timestamp(c, zone))
    midnight = wall - F.pmod(wall, F.lit(_DAY_MICROS))
    return F.date_from_unix_date((midnight / F.lit(_DAY_MICROS)).cast("int"))


def with_local_day(df: DataFrame, ts: str = "created_at", zone: str = ZONE, out="date") -> DataFrame:
    """Add the local day of ``ts``, which is an instant or zoneless UTC."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df.withColumn(out, F.to_date(local_time(ts, zone)))
    return df.withColumn(out, local_day_of_instant(ts, zone))


def day_name(c) -> Column:
    """The English name of the weekday."""
    return F.date_format(c, "EEEE")


def is_weekend_block(c) -> Column:
    """Saturday, Sunday and Monday, the days that are summed into one Monday."""
    return F.dayofweek(c).isin(7, 1, 2)


def closing_monday(c) -> Column:
    """The Monday on or after a day."""
    return F.next_day(F.date_sub(c, 1), "MON")
