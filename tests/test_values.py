"""Column expressions against hand-made cases."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from flowlytics.functions import timefeat as tf
from flowlytics.functions import tokens as tk
from flowlytics.functions import values as v


def one(spark, *cols, data=None, schema=None):
    df = spark.createDataFrame(data, schema) if data is not None else spark.range(1)
    return [tuple(r) for r in df.select(*cols).collect()]


def test_direction_words(spark):
    data = [(" Buy ",), ("赎回",), ("1",), ("2",), ("x",), (None,), ("0.0",), ("申购",), ("OUT",), ("",)]
    got = [r[0] for r in one(spark, v.normalise_direction("s"), data=data, schema="s string")]
    assert got == [0, 1, 1, -1, -1, None, 0, 0, 1, -1]


def test_numbers(spark):
    data = [("1.5",), (" 2 ",), ("n/a",), (None,), ("NaN",)]
    got = one(spark, v.to_number("s"), v.to_number("s", 0.0), data=data, schema="s string")
    assert got == [(1.5, 1.5), (2.0, 2.0), (None, 0.0), (None, 0.0), (None, 0.0)]


def test_hash_bucket_matches_md5(spark):
    keys = [("10002",), ("AB",), ("日",)]
    got = [r[0] for r in one(spark, v.hash_bucket("k", 6, "ptype"), data=keys, schema="k string")]
    want = [int(hashlib.md5(f"ptype:{k}".encode()).hexdigest()[:8], 16) % 6 for (k,) in keys]
    assert got == want and got[0] == 0


def test_winsorise_keeps_null(spark):
    data = [(-5,), (3,), (99,), (None,)]
    assert [r[0] for r in one(spark, v.winsorise("x", 0, 10), data=data, schema="x int")] == [0, 3, 10, None]


def test_prices_and_signs(spark):
    data = [(10.0, 11.0), (10.0, 9.0), (0.0, 5.0), (None, 5.0), (10.0, 10.0)]
    got = one(spark, v.direction_from_prices("o", "c"), v.intraday_yield("o", "c"), data=data, schema="o double, c double")
    assert got == [(0, pytest.approx(0.1)), (1, pytest.approx(-0.1)), (0, None), (1, None), (0, 0.0)]
    got = one(spark, v.direction_from_net("x"), v.direction_from_quantity("x"), data=[(-1,), (0,), (2,)], schema="x int")
    assert got == [(1, 1), (0, 0), (0, 0)]


def test_status_prefix_and_shape(spark):
    got = one(spark, v.status_from_prefix("s"), v.is_six_digits("s"), data=[("C536",), ("510300",), ("5103001",)], schema="s string")
    assert got == [(0, False), (1, True), (1, False)]


def test_fund_names_first_match_wins(spark):
    names = ["华宝添益货币", "中证红利ETF", "沪深300ETF", "医药ETF", "黄金ETF", "纳指ETF", "其他", "信用债300"]
    c = v.classify("s")
    got = one(spark, c["type"], c["risk"], data=[(n,) for n in names], schema="s string")
    assert got == [(0, 1), (4, 4), (2, 4), (2, 5), (5, 5), (6, 5), (2, 4), (1, 2)]


def test_placeholder_yield_range(spark):
    df = spark.range(200).select(v.placeholder_yield("id").alias("y"), v.placeholder_yield("id", F.lit(5)).alias("z"))
    lo, hi, zlo, zhi = df.agg(F.min("y"), F.max("y"), F.min("z"), F.max("z")).first()
    assert lo >= 0.03 - 0.05 - 1e-12 and hi < 0.03 + 0.05 and zlo >= 0.12 - 0.05 - 1e-12 and zhi < 0.17


def test_investor_kind(spark):
    assert [r[0] for r in one(spark, v.investor_kind("s"), data=[("5",), ("-1",), (None,), ("x",)], schema="s string")] == [1, 0, 0, 0]


@pytest.mark.parametrize("day, month_end, quarter_end", [("2024-02-29", 1, 0), ("2024-03-31", 1, 1), ("2024-03-30", 0, 0)])
def test_period_ends(spark, day, month_end, quarter_end):
    d = F.lit(day).cast("date")
    assert one(spark, tf.is_month_end(d), tf.is_quarter_end(d)) == [(month_end, quarter_end)]


def test_clock(spark):
    assert one(spark, tf.dow(F.lit("2024-01-01").cast("date"))) == [(0,)]
    hours = [(f"2024-01-01 {h:02d}:00:00",) for h in (0, 2, 3, 23)]
    assert [r[0] for r in one(spark, tf.hour_bin(F.col("s").cast("timestamp")), data=hours, schema="s string")] == [0, 0, 1, 7]
    assert one(spark, tf.day_of(F.lit(1291193100)), tf.compact_text(tf.from_epoch(F.lit(1291193100)))) == [
        (dt.date(2010, 12, 1), "20101201084500")]
    assert one(spark, tf.whole_days(F.lit(0), F.lit(2 * 86400 - 1))) == [(1,)]


def test_tokens(spark):
    got = one(spark, tk.compose_token(F.lit(0), tk.bin_label(F.lit(3)), F.lit(1), F.lit(2)),
              tk.compose_token(F.lit(1), tk.bin_label(F.lit(-1)), F.lit(9), F.lit(7)))
    assert got == [("PUR_A03_BOND_R2", "RED_A-1_UNK_UNK")]
    wide = tk.compose_wide_token(F.lit("T"), F.lit(6), F.lit("A01"), F.lit("A02"))
    with_channel = tk.compose_wide_token(F.lit("T"), F.lit(6), F.lit("A01"), F.lit("A02"), F.lit(3))
    assert one(spark, wide, with_channel) == [("T_NA_D6_A01_A02", "T_3RD_D6_A01_A02")]


def test_packed_token_is_dense(spark):
    space = spark.sql("""SELECT d AS direction, a AS amount_bin, p AS product_type, r AS risk_level FROM
        (SELECT explode(sequence(0, 1)) d), (SELECT explode(sequence(0, 15)) a),
        (SELECT explode(sequence(0, 5)) p), (SELECT explode(sequence(1, 5)) r)""")
    lo, hi, n = space.select(tk.pack_token().alias("t")).agg(F.min("t"), F.max("t"), F.count_distinct("t")).first()
    assert (lo, hi, n) == (0, 959, 960)
