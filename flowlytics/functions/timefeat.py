"""Calendar and clock features. Day of week starts at 0 on Monday."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_epoch(seconds: Column | str) -> Column:
    return F.timestamp_seconds(_col(seconds))


def to_epoch(ts: Column | str) -> Column:
    return F.unix_timestamp(_col(ts).cast("timestamp"))


def day_of(seconds: Column | str) -> Column:
    return F.to_date(from_epoch(seconds))


def dow(c: Column | str) -> Column:
    return F.weekday(_col(c))


def dom(c: Column | str) -> Column:
    return F.dayofmonth(_col(c))


def hour_bin(c: Column | str) -> Column:
    """Eight buckets of three hours."""
    return F.least(F.floor(F.hour(_col(c)) / 3), F.lit(7)).cast("int")


def is_month_end(c: Column | str) -> Column:
    d = F.to_date(_col(c))
    return (d == F.last_day(d)).cast("int")


def is_quarter_end(c: Column | str) -> Column:
    d = F.to_date(_col(c))
    return ((d == F.last_day(d)) & (F.month(d) % 3 == 0)).cast("int")


def compact_text(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyyMMddHHmmss")


def whole_days(first_seconds: Column, last_seconds: Column) -> Column:
    """Full 24-hour spans between two epoch values."""
    return F.floor((last_seconds - first_seconds) / 86400).cast("int")


def calendar(date: Column | str) -> list[Column]:
    """The four day-level features of a roll-up."""
    return [
        dow(date).alias("dow"),
        dom(date).alias("dom"),
        is_month_end(date).alias("is_month_end"),
        is_quarter_end(date).alias("is_quarter_end"),
    ]


def time_features(df: DataFrame, seconds: str = "txn_ts") -> DataFrame:
    """Adds date, dow, dom, hour, hour_bin and the period-end flags from epoch seconds."""
    ts = from_epoch(seconds)
    return df.select(
        "*",
        F.to_date(ts).alias("date"),
        dow(ts).alias("dow"),
        dom(ts).alias("dom"),
        F.hour(ts).alias("hour"),
        hour_bin(ts).alias("hour_bin"),
        is_month_end(ts).alias("is_month_end"),
        is_quarter_end(ts).alias("is_quarter_end"),
    )
