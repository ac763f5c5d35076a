"""Ledger to daily flows. One aggregation per output, nothing joined back to itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlytics.functions import timefeat as tf
from flowlytics.functions import values as v
from flowlytics.operators.joins import with_defaults
from flowlytics.operators.series import lagged_mean, lead_labels

HORIZONS = (1, 7, 30)


def flow_sum(direction: int, amount: str = "amount", only: Column | None = None,
             column: str = "direction") -> Column:
    """Aggregate: amount moved in one direction, 0 when there is none."""
    hit = F.col(column) == direction
    if only is not None:
        hit = hit & only
    total = F.sum(F.when(hit, F.col(amount)))
    return F.coalesce(total.cast("double"), F.lit(0.0))


def direction_totals(df: DataFrame, keys: Sequence[str], amount: str = "amount") -> DataFrame:
    """Long form: amount per key and direction over successful rows."""
    return (df.where("status = 1").groupBy(*keys, "direction")
            .agg(F.sum(amount).cast("double").alias("amount")))


def daily_flow(df: DataFrame, keys: Sequence[str] = ("product_id", "date"), ok_only: bool = True,
               names: tuple[str, str, str] = ("purchase_amt", "redemption_amt", "net_amt")) -> DataFrame:
    """Wide form: purchase, redemption and net per key. A filter reaches the scan, then one shuffle."""
    rows = df.where("status = 1") if ok_only else df
    bought, sold, net = names
    return rows.groupBy(*keys).agg(flow_sum(0).alias(bought), flow_sum(1).alias(sold)).withColumn(
        net, F.col(bought) - F.col(sold))


def end_of_day(value: str, order: Sequence[str]) -> Column:
    """Aggregate: last non-null value in the order given."""
    key = F.struct(*order)
    return F.max_by(value, F.when(F.col(value).isNotNull(), key))


def failure_mean(df: DataFrame, keys: Sequence[str] = ("product_id", "date")) -> DataFrame:
    return df.groupBy(*keys).agg(v.share(F.col("status") == 0).alias("fail_rate"))


def daily_context(df: DataFrame, order: Sequence[str] = ("txn_ts",), balance: str = "aum_after",
                  horizons: Sequence[int] = HORIZONS, calendar: bool = False,
                  between: Callable[[DataFrame], DataFrame] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Product x day: flows of successful rows, closing balance, period ends, lagged failure rate
    and labels.

    Flows, balance and failure rate come from one aggregation over all statuses; a day on which
    nothing succeeded feeds the failure rate of the following days and is then left out. ``between`` may stage the days of that
    aggregation or deal them out before the windows over a product; ``keep`` names columns that it adds.
    """
    ok = F.col("status") == 1
    day = df.groupBy("product_id", "date").agg(
        flow_sum(0, only=ok).alias("purchase_amt"),
        flow_sum(1, only=ok).alias("redemption_amt"),
        end_of_day(balance, order).cast("double").alias("aum_eod"),
        v.share(F.col("status") == 0).alias("_fail"),
        F.count_if(ok).alias("_ok"),
    )
    if between:
        day = between(day)
    day = lagged_mean(day, ["product_id"], "date", "_fail", 7, "fail_rate_7d").where("_ok > 0")
    day = day.select(
        "product_id", "date", "purchase_amt", "redemption_amt",
        (F.col("purchase_amt") - F.col("redemption_amt")).alias("net_amt"), "aum_eod",
        tf.is_month_end("date").alias("is_month_end"),
        tf.is_quarter_end("date").alias("is_quarter_end"),
        "fail_rate_7d", F.lit(0.0).alias("yield_rate"), *keep,
    )
    return lead_labels(day, ["product_id"], "date",
                       {"purchase_amt": "label_purchase", "redemption_amt": "label_redemption"},
                       horizons, calendar)


def demo_daily(df: DataFrame, order: Sequence[str] = ("ts",), balance: str = "aum_after") -> DataFrame:
    """Product x day over all statuses, with the flat placeholder yield."""
    day = df.groupBy("product_id", "date").agg(
        flow_sum(0).alias("purchase_amt"), flow_sum(1).alias("redemption_amt"),
        end_of_day(balance, order).cast("double").alias("aum_eod"),
    )
    return day.select(
        "product_id", "date", "purchase_amt", "redemption_amt",
        (F.col("purchase_amt") - F.col("redemption_amt")).alias("net_amt"), "aum_eod",
        v.placeholder_yield("product_id").alias("yield_rate"),
    )


def summed_balance(df: DataFrame, order: Sequence[str], holder: Sequence[str]) -> DataFrame:
    """Stricter closing balance: the last balance of each holder that day, summed per product x day."""
    per_holder = df.groupBy("product_id", "date", *holder).agg(end_of_day("aum_after", order).alias("_b"))
    return per_holder.groupBy("product_id", "date").agg(F.sum("_b").cast("double").alias("aum_eod"))


def group_daily(df: DataFrame, meta: DataFrame | None = None, direction: str = "direction") -> DataFrame:
    """Product x group x day features and log labels (all statuses, as one aggregation)."""
    defaults = {}
    if "group_id" not in df.columns:
        defaults["group_id"] = F.lit(0)
    rate = (F.coalesce(v.mean("yield_rate"), F.lit(0.02)) if "yield_rate" in df.columns else F.lit(0.02))
    day = (df.withColumns(defaults) if defaults else df).groupBy("product_id", "group_id", "date").agg(
        flow_sum(0, column=direction).alias("purchase"),
        flow_sum(1, column=direction).alias("redemption"),
        F.count(F.lit(1)).alias("n_txn"),
        rate.alias("yield_rate"),
    ).withColumn("net", F.col("purchase") - F.col("redemption"))
    day = day.select(
        "product_id", "group_id", "date", "purchase", "redemption", "net", "n_txn", "yield_rate",
        *tf.calendar("date"),
        v.direction_from_net("net").alias("direction"),
        v.log_amount(F.abs("net")).alias("amount_log1p"),
        v.log_amount("purchase").alias("purchase_log1p"),
        v.log_amount("redemption").alias("redemption_log1p"),
    )
    if meta is None:
        return day.withColumns({"product_type": F.lit(1), "risk_level": F.lit(2)})
    return with_defaults(day, meta, "product_id", {"product_type": 1, "risk_level": 2},
                         {"product_type": "int", "risk_level": "int"})


def corpus_daily(df: DataFrame) -> DataFrame:
    """Product x group x day x direction totals; a missing group counts as group 0."""
    group = F.coalesce(F.col("group_id"), F.lit(0)) if "group_id" in df.columns else F.lit(0)
    return df.withColumn("group_id", group.cast("int")).groupBy(
        "product_id", "group_id", "date", "direction"
    ).agg(
        F.sum("amount").cast("double").alias("amount"),
        F.min("product_type").alias("product_type"),
        F.min("risk_level").alias("risk_level"),
    )


def label_coverage(daily: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Share of rows that have each label, one row per label."""
    one = daily.agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in labels])
    return one.unpivot([], list(labels), "label", "coverage")


