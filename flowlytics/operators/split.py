"""Leakage-safe time splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlytics.operators.series import row_index


def distinct_dates(df: DataFrame, date: str = "date") -> DataFrame:
    return df.select(F.col(date).alias("date")).distinct().orderBy("date")


def split_bounds(df: DataFrame, train: float = 0.8, val: float = 0.1, gap_days: int = 7,
                 date: str = "date") -> DataFrame:
    """One row: train_end, val_start, val_end, test_start from the distinct dates.

    The distinct dates are a calendar (thousands of rows), so ranking them needs one small task.
    """
    days = df.select(F.col(date).alias("date")).where("date is not null").distinct()
    w = W.partitionBy(F.lit(0))
    ranked = days.select("date", F.row_number().over(w.orderBy("date")).alias("_i"),
                         F.count(F.lit(1)).over(w).alias("_n"))
    n_train = F.floor(F.col("_n") * train)
    n_val = F.floor(F.col("_n") * val)
    bounds = ranked.agg(
        F.max(F.when(F.col("_i") == n_train, F.col("date"))).alias("train_end"),
        F.max(F.when(F.col("_i") == n_train + n_val, F.col("date"))).alias("val_end"),
    )
    return bounds.select(
        "train_end", F.date_add("train_end", gap_days).alias("val_start"),
        "val_end", F.date_add("val_end", 1).alias("test_start"))


def assign_split(df: DataFrame, bounds: DataFrame, date: str = "date") -> DataFrame:
    """Adds train / val / test / gap.

    The one row of bounds is fetched first (a job on the dates), so the split is a comparison with
    literal days and a filter on a split reaches the scan. A bound that does not exist matches nothing.
    """
    b = {name: F.lit(day).cast("date") for name, day in bounds.first().asDict().items()}
    d = F.col(date)
    name = (
        F.when(d <= b["train_end"], "train")
        .when(d.between(b["val_start"], b["val_end"]), "val")
        .when(d >= b["test_start"], "test")
        .otherwise("gap")
    )
    return df.withColumn("split", name)


def date_split(df: DataFrame, train: float = 0.70, val: float = 0.15, date: str = "date") -> DataFrame:
    """70/15/15 over the distinct dates without a gap."""
    return assign_split(df, split_bounds(df, train, val, 1, date), date)


def sample_split(df: DataFrame, order: Sequence[str], train: float = 0.70, val: float = 0.15, **cut) -> DataFrame:
    """70/15/15 over the ordered samples themselves."""
    rows = row_index(df, [], order, "_i", **cut)
    n = df.agg(F.count(F.lit(1))).scalar()
    rows = rows.withColumn("_n", n)
    first = F.floor(F.col("_n") * train)
    second = first + F.floor(F.col("_n") * val)
    name = F.when(F.col("_i") < first, "train").when(F.col("_i") < second, "val").otherwise("test")
    return rows.withColumn("split", name).drop("_i", "_n")


def require_nonempty(df: DataFrame, split: str = "train") -> DataFrame:
    """Raises when a split has no rows (runs a job that stops at the first row)."""
    if df.where(F.col("split") == split).isEmpty():
        raise ValueError(f"split {split!r} is empty; use a longer ledger or other ratios")
    return df
