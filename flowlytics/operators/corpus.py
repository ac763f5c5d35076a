"""Token corpus from client and market ledgers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlytics.functions import timefeat as tf
from flowlytics.functions import tokens as tk
from flowlytics.functions import values as v
from flowlytics.operators.cleaning import require_columns
from flowlytics.operators.joins import with_defaults
from flowlytics.operators.quantile import apply_bins, fit_bins
from flowlytics.operators.rollup import corpus_daily
from flowlytics.sources.stage import materialise

CORPUS_COLUMNS = ["product_id", "group_id", "date", "direction", "amount_bin", "product_type", "risk_level"]
SERIES = ["product_id", "group_id", "direction"]
AMOUNT_BINS = 16


def from_client(df: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Client ledger: type and risk looked up per product (defaults 1 and 2), absent group is 0."""
    out = df.withColumnRenamed("txn_type", "direction")
    if "txn_ts" in out.columns:
        out = out.withColumn("date", tf.day_of("txn_ts"))
    elif "date" not in out.columns:
        out = out.withColumn("date", F.lit(None).cast("date"))
    group = F.coalesce(F.col("group_id"), F.lit(0)) if "group_id" in out.columns else F.lit(0)
    out = out.select("product_id", group.cast("int").alias("group_id"), "date",
                     F.col("direction").cast("int").alias("direction"), _amount(out))
    if meta is None:
        return out.withColumns({"product_type": F.lit(1), "risk_level": F.lit(2)})
    return with_defaults(out, meta, "product_id", {"product_type": 1, "risk_level": 2},
                         {"product_type": "int", "risk_level": "int"})


def from_market(df: DataFrame) -> DataFrame:
    """Market ledger: type and risk come with it and are clamped to the token domains."""
    require_columns(df, ["product_id", "date", "direction", "amount", "product_type", "risk_level"])
    return df.select(
        "product_id", F.to_date("date").alias("date"), F.col("direction").cast("int").alias("direction"),
        _amount(df),
        tk.clamp_field("product_type", F.col("product_type").cast("int")).alias("product_type"),
        tk.clamp_field("risk_level", F.col("risk_level").cast("int")).alias("risk_level"))


def _amount(df: DataFrame):
    kind = df.schema["amount"].dataType.typeName()
    if kind == "decimal":
        return F.coalesce(F.col("amount"), F.lit(0)).alias("amount")
    return v.to_number("amount", 0.0).alias("amount")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def series_bins(df: DataFrame, by: Sequence[str] = tuple(SERIES), bins: int = AMOUNT_BINS,
                codes: Sequence[int] | None = None, **cut) -> DataFrame:
    """Quantile bucket of log1p(amount) within each series; short or constant series get 0."""
    logged = df.withColumn("amount_log1p", v.log_amount("amount"))
    edges = fit_bins(logged, list(by), "amount_log1p", bins, min_rows=bins, **cut)
    return apply_bins(logged, edges, list(by), "amount_log1p", bins, missing=0, codes=codes)


def harmonise(frames: Sequence[DataFrame], **cut) -> DataFrame:
    """Union, daily roll-up, buckets per series, clamps. Real amounts are kept.

    The roll-up is written once: fitting and applying the buckets both read it.
    """
    if not frames:
        raise ValueError("no corpus given")
    daily = materialise(corpus_daily(union_all(frames)))
    binned = series_bins(daily, **cut)
    clamped = binned.withColumns({c: tk.clamp_field(c, c) for c in tk.FIELD_RANGE})
    return clamped.select(*CORPUS_COLUMNS)
