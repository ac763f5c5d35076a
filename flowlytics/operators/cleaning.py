"""Bringing dirty, differently named input to the ledger schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlytics.functions import timefeat as tf
from flowlytics.functions import values as v
from flowlytics.operators.series import row_index

# Accepted column names, in order of preference.
COLUMN_CANDIDATES = {
    "product": ["product_id", "产品id", "产品ID", "产品代码", "产品编码", "产品号", "product",
                "prd_code", "fund_code", "prod_id"],
    "time": ["txn_time", "trans_time", "time", "timestamp",
             "交易时间", "流水时间", "下单时间", "申请时间", "确认时间"],
    "type": ["txn_type", "trans_type", "type", "trade_type",
             "交易类型", "流水类型", "业务类型", "申赎类型"],
    "status": ["status", "txn_status", "trans_status",
               "交易状态", "流水状态", "确认状态", "状态"],
    "amount": ["amount", "txn_amount", "trans_amount", "confirm_amount", "confirmed_amount",
               "确认金额", "交易金额", "成交金额", "发生金额", "金额"],
}
# Columns that our own steps add and that are never input.
DERIVED_COLUMNS = {"txn_ts", "date", "direction", "split", "__row_id__", "__src_file__"}
REQUIRED = ["product", "time", "type", "amount"]


def detect_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """Per candidate in order: a column of that name, else one that contains it (case ignored)."""
    usable = [c for c in columns if c not in DERIVED_COLUMNS]
    for candidate in candidates:
        want = candidate.lower()
        for accept in (lambda c: c.lower() == want, lambda c: want in c.lower()):
            found = next((c for c in usable if accept(c)), None)
            if found is not None:
                return found
    return None


def detect_columns(columns: Sequence[str], overrides: Mapping[str, str] | None = None) -> dict[str, str | None]:
    chosen = dict(overrides or {})
    return {role: chosen.get(role) or detect_column(columns, names)
            for role, names in COLUMN_CANDIDATES.items()}


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; have {df.columns}")
    return df


def canonicalise(df: DataFrame, mapping: Mapping[str, str], defaults: Mapping[str, object] | None = None,
                 keep: Sequence[str] | None = None) -> DataFrame:
    """Renames source to target names, fills absent or null optional columns, optionally projects."""
    out = df.withColumnsRenamed({k: t for k, t in mapping.items() if k in df.columns and k != t})
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in out.columns else F.lit(value))
    return out.select(*keep) if keep else out


def drop_columns(df: DataFrame, names: Sequence[str] = ("product_type_name",)) -> DataFrame:
    return df.drop(*names)


def parse_time(df: DataFrame, col: str, out: str = "ts") -> DataFrame:
    """Reads a text time column whose format the whole column decides.

    All numeric and mostly 14 digits: yyyyMMddHHmmss. All numeric and mostly epoch-sized: seconds.
    Otherwise ISO text. What does not parse becomes null.
    """
    text = F.trim(F.col(col).cast("string"))
    number = text.try_cast("double")
    size = F.abs(number)
    fact = df.agg(
        F.struct(
            F.coalesce(F.every(number.isNotNull()), F.lit(False)).alias("numeric"),
            F.coalesce(v.share(size.between(1e13, 1.01e14)), F.lit(0.0)).alias("digits"),
            F.coalesce(v.share(size.between(1e9, 1e11)), F.lit(0.0)).alias("epoch"),
        ).alias("f")
    ).scalar()
    whole = F.col("_whole")
    # 14 digits are cut by arithmetic, which is much cheaper than a format; other lengths go by the format
    y, mo, d, h, mi, s = [F.pmod(F.floor(whole / 10 ** p), F.lit(10 ** n)).cast("int") for p, n in ((10, 4), (8, 2), (6, 2), (4, 2), (2, 2), (0, 2))]
    compact = F.when(whole.between(10 ** 13, 10 ** 14 - 1), F.when(s < 60, F.try_make_timestamp(y, mo, d, h, mi, s))).otherwise(
        F.try_to_timestamp(whole.cast("string"), F.lit("yyyyMMddHHmmss")))
    parsed = (
        F.when(F.col("_f.numeric") & (F.col("_f.digits") > 0.5), compact)
        .when(F.col("_f.numeric") & (F.col("_f.epoch") > 0.5), F.timestamp_seconds(whole))
        .otherwise(text.try_cast("timestamp"))
    )
    return df.withColumns({"_f": fact, "_whole": number.try_cast("bigint")}).withColumn(out, parsed).drop("_f", "_whole")


def normalise_success(df: DataFrame, col: str, out: str = "status") -> DataFrame:
    """Success words decide; only when no row carries one, a numeric 1 does."""
    any_word = df.agg(F.coalesce(F.bool_or(v.success_word(col)), F.lit(False))).scalar()
    flagged = df.withColumn("_w", any_word)
    ok = F.when(F.col("_w"), v.success_word(col)).otherwise(v.success_number(col))
    return flagged.withColumn(out, ok.cast("int")).drop("_w")


def canonical_ledger(raw: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Any raw ledger to product_id, ts, date, direction, status, amount (+ source tag if present)."""
    roles = detect_columns(raw.columns, overrides)
    missing = [r for r in REQUIRED if roles[r] is None]
    if missing:
        raise ValueError(f"no column found for {missing}; name them explicitly")
    renames = {roles["product"]: "product_id", roles["time"]: "txn_time_raw",
               roles["type"]: "type_raw", roles["amount"]: "amount"}
    if roles["status"]:
        renames[roles["status"]] = "status_raw"
    df = parse_time(canonicalise(raw, renames), "txn_time_raw")
    df = df.select(
        "*",
        F.to_date("ts").alias("date"),
        v.normalise_direction("type_raw").alias("direction"),
    ).withColumn("amount", v.to_number("amount"))
    if roles["status"]:
        df = normalise_success(df, "status_raw")
    else:
        df = df.withColumn("status", F.lit(1))
    tags = ["__src_file__"] if "__src_file__" in df.columns else []
    return df.select("product_id", "ts", "date", "direction", "status", "amount", *tags)


def valid_amount(amount: str = "amount") -> Column:
    return F.col(amount).isNotNull() & (F.col(amount) > 0)


def clean_basic(df: DataFrame, amount: str = "amount", balance: str | None = "aum_after",
                seconds: str | None = "txn_ts") -> DataFrame:
    """Keeps positive amounts, floors the balance at zero, adds the day."""
    out = df.where(valid_amount(amount))
    if balance and balance in df.columns:
        out = out.withColumn(balance, v.winsorise(balance, lo=0))
    if seconds and "date" not in df.columns:
        out = out.withColumn("date", tf.day_of(seconds))
    return out


def dropped_facts(amount: str = "amount") -> list[Column]:
    """How many rows clean_basic keeps and drops, as aggregates."""
    ok = F.coalesce(valid_amount(amount), F.lit(False))
    return [F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped")]


def dropped_rows(df: DataFrame, keys: Sequence[str] = (), amount: str = "amount") -> DataFrame:
    """How many rows clean_basic keeps and drops."""
    return df.groupBy(*keys).agg(*dropped_facts(amount))


def date_range(df: DataFrame, col: str, end: str, years: int) -> DataFrame:
    """Rows of the last ``years`` years up to and including the day ``end``."""
    last = F.lit(end).cast("date")
    return df.where(F.col(col).between(F.add_months(last, -12 * years), last))


def dense_row_id(df: DataFrame, order: Sequence[str], out: str = "__row_id__", **cut) -> DataFrame:
    """0, 1, ... n-1 in a total order over all rows."""
    return row_index(df, [], order, out, **cut)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Input row cap in a stated order (a distributed top-n)."""
    return df.orderBy(*order).limit(n)
