"""The given tables as ledgers.

lineitem is the transaction ledger: a returned line is a redemption, an untaxed line a failed
transaction, the discounted price the amount (decimal, so sums are exact). The joins to part,
orders and customer are made only when an attribute of theirs is asked for. They are left joins: a
line with an unknown part, order or customer keeps its row, with nulls. They carry no hint, so
a small dimension is broadcast by the size check of the optimizer and a large one is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlytics.session import pin_utc

# Code lists of the given tables, in sorted order; the position is the code.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def position(col: str, names: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(n) for n in names]), F.col(col)) - 1).cast("int")


def net_price() -> Column:
    return F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))


def ledger(spark: SparkSession, sf_dir: str, product: str = "type", group: bool = False,
           customer: bool = False, tie: bool = False, ok_only: bool = False) -> DataFrame:
    """Transactions: product_id, txn_ts, date, direction, status, amount, yield_rate
    (+ cust_id; + group_id, group_name; + tie-break columns). ``ok_only`` leaves failed rows out
    in the scan: a filter on the derived status would not reach the parquet reader."""
    rows = table(spark, sf_dir, "lineitem")
    if ok_only:
        rows = rows.where("l_tax <> 0 OR l_tax IS NULL")
    columns = [
        F.to_date("l_shipdate").alias("date"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("txn_ts"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("direction"),
        F.when(F.col("l_tax") == 0, 0).otherwise(1).alias("status"),
        net_price().alias("amount"),
        F.col("l_discount").cast("decimal(4,2)").alias("yield_rate"),
    ]
    if product == "type":
        part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        columns = [F.col("p_type").alias("product_id"), *columns]
    else:
        columns = [F.col("l_partkey").cast("string").alias("product_id"), *columns]
    if group or customer:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        columns.append(F.col("o_custkey").alias("cust_id"))
    if group:
        people = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        rows = rows.join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
        columns += [position("c_mktsegment", SEGMENTS).alias("group_id"), F.col("c_mktsegment").alias("group_name")]
    if tie:
        columns += TIE
    return rows.select(*columns)


def product_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per p_type: product_type and the most common risk class, from part."""
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_type").alias("product_id")).agg(
        F.min(position("p_type", PART_TYPES)).alias("product_type"),
        (F.min(F.col("p_size")) % 5 + 1).alias("risk_level"))


def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        position("p_type", PART_TYPES).alias("product_type"),
        F.col("p_type").alias("product_type_name"),
        (F.col("p_size") % 5 + 1).alias("risk_level"),
        F.col("p_retailprice").alias("min_purchase"))


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: product_id = event type, cust_id = user, ts in whole seconds, event_id breaks ties."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("cust_id"), F.col("event_type").alias("product_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("txn_ts"),
        F.to_date("ts").alias("date"),
        F.when(F.col("event_type").isin("click", "signup"), 1).otherwise(0).alias("direction"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("status"),
        F.col("value").cast("decimal(12,2)").alias("amount"))


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as a client would export it: local column names, text everywhere, mixed words."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_partkey").cast("string").alias("产品代码"),
        F.date_format("l_shipdate", "yyyyMMddHHmmss").alias("交易时间"),
        F.when(F.col("l_returnflag") == "R", " Redeem ").when(F.col("l_returnflag") == "A", "申购")
        .when(F.col("l_linestatus") == "O", "0.0").otherwise("unknown").alias("业务类型"),
        F.when(F.col("l_tax") == 0, "failed").when(F.col("l_linestatus") == "O", " Success ")
        .otherwise("确认成功").alias("交易状态"),
        F.when(F.col("l_discount") == 0, "n/a").otherwise(
            F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("确认金额"),
        F.col("l_linestatus").alias("__src_file__"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order as shop order lines."""
    rows = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return joined.select(
        F.concat(F.when(F.col("l_tax") == 0, "C").otherwise(""), F.col("l_orderkey").cast("string")).alias("InvoiceNo"),
        F.col("l_shipdate").alias("InvoiceDate"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        (F.col("l_quantity").cast("bigint") * sign).alias("Quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("UnitPrice"),
        F.col("o_custkey").alias("CustomerID"),
        "l_linenumber", "l_suppkey", "l_discount")


def code_of(number: str) -> Column:
    """Six digits at least: shorter numbers are padded, longer ones stay whole."""
    return F.format_string("%06d", number).alias("code")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, high, low, close, volume and traded amount per customer-facing code and day, from events."""
    e = event_ledger(spark, sf_dir)
    at = F.struct("ts", "event_id")
    return e.groupBy(code_of("cust_id"), "date").agg(
        F.min_by("amount", at).cast("double").alias("open"), F.max("amount").cast("double").alias("high"),
        F.min("amount").cast("double").alias("low"), F.max_by("amount", at).cast("double").alias("close"),
        F.count(F.lit(1)).alias("volume"), F.sum("amount").alias("amount"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, turnover and main net inflow per code, from customers (name) and events (flows)."""
    e = event_ledger(spark, sf_dir)
    signed = F.when(F.col("direction") == 0, F.col("amount")).otherwise(-F.col("amount"))
    flows = e.groupBy("cust_id").agg(F.sum("amount").cast("double").alias("turnover"),
                                     F.sum(signed).cast("double").alias("main_net"))
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cust_id"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"))
    return flows.join(people, "cust_id", "left").select(
        code_of("cust_id"), "name", "turnover", "main_net")
