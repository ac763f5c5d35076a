"""Foreign sources to the wide transaction ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlytics.functions import timefeat as tf
from flowlytics.functions import values as v
from flowlytics.operators.joins import require_unique
from flowlytics.operators.quantile import DIRECTIONS, apply_bins, fit_bins
from flowlytics.operators.segments import Segmented, segmented
from flowlytics.operators.series import row_index, running_balance, signed_amount, time_gap

WIDE_COLUMNS = [
    "product_id", "cust_id", "ts", "date", "direction", "status", "amount", "amount_log1p", "amount_bin",
    "aum_after", "dow", "dom", "hour", "hour_bin", "is_month_end", "is_quarter_end", "dt_prev_sec",
    "product_type", "risk_level", "term_type", "channel", "cust_type", "yield_rate",
]
WIDE_BINS = 24
MIN_BIN_ROWS = 32


def _direction_bins(df: DataFrame, **cut) -> DataFrame:
    """24 buckets per direction; a direction with fewer than 32 rows gets 0."""
    logged = df.withColumn("amount_log1p", v.log_amount("amount"))
    edges = fit_bins(logged, ["direction"], "amount_log1p", WIDE_BINS, min_rows=MIN_BIN_ROWS, **cut)
    return apply_bins(logged, edges, ["direction"], "amount_log1p", WIDE_BINS, missing=0, codes=DIRECTIONS)


def _per_product(df: DataFrame, tie: list[str], row_id: bool, **cut) -> Segmented:
    """Number of the row, gap to the previous row and clipped running balance within each product, on one range partitioning.

    The number comes first: its sort of whole segments then serves gap and balance.
    """
    order = ["ts", *tie]
    seg = segmented(df, ["product_id"], order, **cut)
    if row_id:
        whole = seg.whole(seg.rows)
        seg = seg.map(row_index(seg.rows, [], whole.order, "__row_id__", seg=whole))
    gapped = time_gap(seg.rows, ["product_id"], "ts", tie, seg=seg)
    return seg.map(running_balance(gapped, ["product_id"], order, signed_amount(), "clip", seg=seg))


def _numbered(rows: DataFrame, tie: list[str], row_id: bool, *added: dict[str, Column], **cut) -> DataFrame:
    """The ledger's columns in its order; the number of a row, gap and balance come from the same segments.

    ``added`` are columns made of others at the end, so that they are neither dealt out nor staged.
    """
    seg = _per_product(rows, tie, row_id, **cut)
    wide = _direction_bins(seg.rows, **cut)
    for columns in added:
        wide = wide.withColumns(columns)
    wide = wide.withColumns({c: F.col(c).cast("double") for c in ("amount", "aum_after")})
    return wide.select(*WIDE_COLUMNS, *(["__row_id__"] if row_id else []))


def from_orders(df: DataFrame, tie: list[str] = ("InvoiceNo", "CustomerID", "Quantity", "UnitPrice"),
                row_id: bool = True, **cut) -> DataFrame:
    """Order lines (InvoiceNo, InvoiceDate, StockCode, Quantity, UnitPrice, CustomerID) to the ledger.

    A negative quantity is a redemption, an invoice starting with C is a failed row. Type, term,
    channel, customer type and yield are stable placeholders from salted hashes.
    """
    tie = list(tie)
    quantity, price = F.col("Quantity"), F.col("UnitPrice")
    if dict(df.dtypes)["Quantity"] == "string":
        quantity = v.to_number("Quantity")
    if dict(df.dtypes)["UnitPrice"] == "string":
        price = v.to_number("UnitPrice")
    rows = (df.withColumns({"Quantity": quantity, "UnitPrice": price})
            .na.drop(subset=["CustomerID", "StockCode", "InvoiceDate", "Quantity", "UnitPrice"])
            .where((F.col("Quantity") != 0) & (F.col("UnitPrice") >= 0)))
    when = F.col("InvoiceDate")
    rows = rows.select(
        *tie,
        F.col("StockCode").cast("string").alias("product_id"),
        F.col("CustomerID").cast("bigint").alias("cust_id"),
        tf.to_epoch(when).alias("ts"),
        F.to_date(when).alias("date"),
        v.direction_from_quantity("Quantity").alias("direction"),
        v.status_from_prefix("InvoiceNo").alias("status"),
        (F.abs("Quantity") * F.col("UnitPrice")).alias("amount"),
        *tf.calendar(when),
        F.hour(when).alias("hour"),
        tf.hour_bin(when).alias("hour_bin"),
    )
    kind = {"product_type": v.hash_bucket("product_id", 6, "ptype")}
    risk = {"risk_level": F.least(F.col("product_type") + 1, F.lit(5))}
    others = {
        "term_type": v.hash_bucket("product_id", 4, "term"),
        "channel": v.hash_bucket("product_id", 4, "ch"),
        "cust_type": v.hash_bucket("cust_id", 3, "cust"),
        "yield_rate": v.placeholder_yield("product_id", "risk_level"),
    }
    return _numbered(rows, tie, row_id, kind, risk, others, **cut)


def from_quotes(prices: DataFrame, quotes: DataFrame, rules=v.FUND_NAME_RULES, row_id: bool = True,
                **cut) -> DataFrame:
    """Daily prices (code, date, open, close, amount) with a quote snapshot (code, name, main_net).

    One row per code and day: a close at or above the open is inflow, the traded amount is the
    amount, type and risk come from the name, the investor kind from the main net inflow. A code with
    two quotes is an error (runs a job on the quotes).
    """
    when = F.to_date("date")
    known = require_unique(quotes.select("code", "name", "main_net"), ["code"])
    rows = prices.where(v.to_number("amount") > 0).join(known, "code", "left")
    kind = v.classify(F.coalesce("name", F.lit("")), rules)
    rows = rows.select(
        F.col("code").cast("string").alias("product_id"),
        F.lit(None).cast("bigint").alias("cust_id"),
        (F.unix_date(when) * F.lit(86400).cast("bigint")).alias("ts"),
        when.alias("date"),
        v.direction_from_prices(v.to_number("open"), v.to_number("close")).alias("direction"),
        F.lit(1).alias("status"),
        F.col("amount").alias("amount") if dict(prices.dtypes)["amount"].startswith("decimal")
        else v.to_number("amount").alias("amount"),
        *tf.calendar(when),
        F.lit(15).alias("hour"),
        F.lit(5).alias("hour_bin"),
        kind["type"].alias("product_type"),
        kind["risk"].alias("risk_level"),
        v.hash_bucket("code", 4, "term").alias("term_type"),
        v.hash_bucket("code", 4, "ch").alias("channel"),
        v.investor_kind("main_net").alias("cust_type"),
        v.intraday_yield(v.to_number("open"), v.to_number("close")).alias("yield_rate"),
    )
    return _numbered(rows, [], row_id, **cut)
