"""Registered queries: normalisation, calendar, joins and daily roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlytics.functions import timefeat as tf
from flowlytics.functions import values as v
from flowlytics.operators import cleaning, joins, mapping, rollup, series, vocab
from flowlytics.plans.catalog import (
    E, FACT, L, LG, LK, META, NET, TIE_COLUMNS, TYPE_CODE, calendar, is_month_end, is_quarter_end, log_amount,
    md5_bucket, register, rounded, total, bin_of, fit_edges,
)
from flowlytics.sources import readers, tables as t

# ---- normalisation ----------------------------------------------------------------------------

RAW = """raw AS (SELECT CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_shipdate AS TIMESTAMP) AS ts,
  CAST(l_shipdate AS DATE) AS date,
  CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 WHEN l_linestatus = 'O' THEN 0 ELSE -1 END
    AS direction,
  CASE WHEN l_tax = 0 THEN 0 ELSE 1 END AS status,
  CASE WHEN l_discount = 0 THEN NULL ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) END AS amount,
  l_linestatus AS __src_file__ FROM lineitem)"""


@register("canonical_ledger", f"""WITH {RAW}
SELECT product_id, epoch(ts)::BIGINT AS ts_sec, date, direction, status, amount, __src_file__ FROM raw""")
def canonical_ledger(spark, d):
    rows = cleaning.canonical_ledger(t.raw_ledger(spark, d))
    return rows.select("product_id", F.unix_timestamp("ts").alias("ts_sec"), "date", "direction", "status",
                       "amount", "__src_file__")


@register("dropped_rows", f"""WITH {RAW} SELECT direction, count(*) FILTER (amount IS NOT NULL AND amount > 0) AS kept,
  count(*) FILTER (amount IS NULL OR amount <= 0) AS dropped FROM raw GROUP BY direction""")
def dropped_rows(spark, d):
    return cleaning.dropped_rows(cleaning.canonical_ledger(t.raw_ledger(spark, d)), ["direction"])


@register("clean_basic", f"""SELECT c_custkey AS cust_id, c_acctbal AS amount,
  greatest(c_acctbal - 5000, 0) AS aum_after FROM customer WHERE c_acctbal > 0""")
def clean_basic(spark, d):
    rows = t.table(spark, d, "customer").select(
        F.col("c_custkey").alias("cust_id"), F.col("c_acctbal").alias("amount"),
        (F.col("c_acctbal") - 5000).alias("aum_after"))
    return cleaning.clean_basic(rows, seconds=None)


@register("optional_columns", f"""SELECT CAST(l_partkey AS VARCHAR) AS product_id, 0 AS group_id,
  CAST(l_discount AS DOUBLE) AS yield_rate, 1 AS status, 2 AS risk_level, 0 AS min_purchase_bin FROM lineitem""")
def optional_columns(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("code"), "l_discount")
    return cleaning.canonicalise(
        rows, {"code": "product_id", "l_discount": "yield_rate"},
        {"group_id": 0, "yield_rate": 0.0, "status": 1, "risk_level": 2, "min_purchase_bin": 0},
        ["product_id", "group_id", "yield_rate", "status", "risk_level", "min_purchase_bin"])


PART_RULES = [("^(red|green)", 0, 1), ("widget|gear", 1, 2), ("ring$", 4, 4), ("blue|bolt", 3, 5)]


@register("hash_placeholders", f"""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id,
  {md5_bucket('CAST(p_partkey AS VARCHAR)', 6, 'ptype')} AS product_type FROM part)
SELECT product_id, product_type, least(product_type + 1, 5) AS risk_level,
  {md5_bucket('product_id', 4, 'term')} AS term_type, {md5_bucket('product_id', 4, 'ch')} AS channel,
  round((CASE least(product_type + 1, 5) WHEN 1 THEN 0.022 WHEN 2 THEN 0.03 WHEN 3 THEN 0.05 WHEN 4 THEN 0.08
    ELSE 0.12 END)::DOUBLE + ({md5_bucket('product_id', 200, 'y')} - 100) / 2000.0::DOUBLE, 9) AS yield_rate FROM p""")
def hash_placeholders(spark, d):
    p = t.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("product_id"))
    p = p.withColumn("product_type", v.hash_bucket("product_id", 6, "ptype"))
    p = p.withColumn("risk_level", F.least(F.col("product_type") + 1, F.lit(5)))
    return rounded(p.withColumns({
        "term_type": v.hash_bucket("product_id", 4, "term"), "channel": v.hash_bucket("product_id", 4, "ch"),
        "yield_rate": v.placeholder_yield("product_id", "risk_level")}), 9, "yield_rate")


@register("name_classes", """SELECT p_name AS name,
  CASE WHEN regexp_matches(p_name, '^(red|green)') THEN 0 WHEN regexp_matches(p_name, 'widget|gear') THEN 1
    WHEN regexp_matches(p_name, 'ring$') THEN 4 WHEN regexp_matches(p_name, 'blue|bolt') THEN 3 ELSE 2 END AS type,
  CASE WHEN regexp_matches(p_name, '^(red|green)') THEN 1 WHEN regexp_matches(p_name, 'widget|gear') THEN 2
    WHEN regexp_matches(p_name, 'ring$') THEN 4 WHEN regexp_matches(p_name, 'blue|bolt') THEN 5 ELSE 4 END AS risk,
  count(*) AS n FROM part GROUP BY ALL""")
def name_classes(spark, d):
    p = t.table(spark, d, "part").select(F.col("p_name").alias("name"), v.classify("p_name", PART_RULES).alias("c"))
    return p.groupBy("name", F.col("c.type").alias("type"), F.col("c.risk").alias("risk")).agg(
        F.count(F.lit(1)).alias("n"))


@register("code_labels", """SELECT
  CASE WHEN l_returnflag = 'R' THEN 'RED' ELSE 'PUR' END AS direction_name,
  CASE WHEN l_linenumber BETWEEN 1 AND 5 THEN 'R' || l_linenumber ELSE 'UNK' END AS risk_name,
  CASE l_linenumber WHEN 0 THEN 'APP' WHEN 1 THEN 'WEB' WHEN 2 THEN 'BR' WHEN 3 THEN '3RD' ELSE 'UNK' END
    AS channel_name, count(*) AS n FROM lineitem GROUP BY ALL""")
def code_labels(spark, d):
    rows = t.table(spark, d, "lineitem").select(
        v.label_of(F.when(F.col("l_returnflag") == "R", 1).otherwise(0), v.DIRECTION_NAMES).alias("direction_name"),
        v.label_of("l_linenumber", v.RISK_NAMES).alias("risk_name"),
        v.label_of("l_linenumber", v.CHANNEL_NAMES).alias("channel_name"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


# ---- calendar ---------------------------------------------------------------------------------

@register("time_features", f"""WITH {E} SELECT event_id, txn_ts, date, CAST(isodow(ts) - 1 AS INTEGER) AS dow,
  CAST(day(ts) AS INTEGER) AS dom, CAST(hour(ts) AS INTEGER) AS hour,
  CAST(least(hour(ts) // 3, 7) AS INTEGER) AS hour_bin, {is_month_end('date')} AS is_month_end,
  {is_quarter_end('date')} AS is_quarter_end, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  strftime(ts, '%Y%m%d%H%M%S') AS txn_time FROM e""")
def time_features(spark, d):
    e = t.event_ledger(spark, d).select("event_id", "txn_ts", "ts")
    return tf.time_features(e).select(
        "*", F.year("ts").alias("year"), F.month("ts").alias("month"), tf.compact_text("ts").alias("txn_time")
    ).drop("ts")


@register("active_span", f"""WITH {E} SELECT cust_id, min(txn_ts) AS first_ts, max(txn_ts) AS last_ts,
  CAST(floor((max(txn_ts) - min(txn_ts)) / 86400) AS INTEGER) AS days_total FROM e GROUP BY cust_id""")
def active_span(spark, d):
    lo, hi = F.min("txn_ts"), F.max("txn_ts")
    return t.event_ledger(spark, d).groupBy("cust_id").agg(
        lo.alias("first_ts"), hi.alias("last_ts"), tf.whole_days(lo, hi).alias("days_total"))


@register("recent_years", f"""WITH {LK}, r AS (SELECT * FROM lk WHERE date BETWEEN
  CAST(DATE '2001-06-30' - INTERVAL 24 MONTH AS DATE) AND DATE '2001-06-30')
SELECT product_id, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM r GROUP BY product_id""")
def recent_years(spark, d):
    return cleaning.date_range(t.ledger(spark, d, "key"), "date", "2001-06-30", 2).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


# ---- joins ------------------------------------------------------------------------------------

@register("dimension_join", f"""SELECT {TYPE_CODE} AS product_type, CAST(p_size % 5 + 1 AS INTEGER) AS risk_level,
  c_mktsegment AS cust_segment, count(*) AS n, CAST(sum({NET}) AS DOUBLE) AS amount
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def dimension_join(spark, d):
    fact = t.ledger(spark, d, "key", customer=True)
    people = t.table(spark, d, "customer").select(
        F.col("c_custkey").alias("cust_id"), F.col("c_mktsegment").alias("cust_segment"))
    wide = joins.join_dims(fact, cleaning.drop_columns(t.dim_product(spark, d)), people, customer_key="cust_id")
    return wide.groupBy("product_type", "risk_level", "cust_segment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


@register("join_miss_rate", """WITH j AS (SELECT s_name, n_name FROM events LEFT JOIN supplier ON user_id = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey)
SELECT count(*) AS n_rows, count(*) FILTER (s_name IS NULL OR n_name IS NULL) AS n_missed,
  count(*) FILTER (s_name IS NULL OR n_name IS NULL) / count(*) AS miss_ratio,
  count(*) FILTER (s_name IS NULL OR n_name IS NULL) / count(*) > 0.05 AS warn FROM j""")
def join_miss_rate(spark, d):
    desks = t.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("n_nationkey"), "s_name")
    nations = t.table(spark, d, "nation").select("n_nationkey", "n_name")
    events = t.table(spark, d, "events").select("user_id")
    wide = joins.join_dims(events, desks, nations, product_key="user_id", customer_key="n_nationkey")
    return joins.miss_rate(wide, ["s_name", "n_name"])


@register("dimension_keys", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY ALL HAVING count(*) > 1""")
def dimension_keys(spark, d):
    return joins.repeated_keys(t.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("metadata_lookup", f"""WITH {LK}, m AS (SELECT CAST(s_suppkey AS VARCHAR) AS product_id,
  s_nationkey % 6 AS product_type, s_nationkey % 5 + 1 AS risk_level FROM supplier),
j AS (SELECT coalesce(m.product_type, 1) AS product_type, coalesce(m.risk_level, 2) AS risk_level
  FROM lk LEFT JOIN m USING (product_id))
SELECT product_type, risk_level, count(*) AS n FROM j GROUP BY ALL""")
def metadata_lookup(spark, d):
    meta = t.table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("product_id"), (F.col("s_nationkey") % 6).alias("product_type"),
        (F.col("s_nationkey") % 5 + 1).alias("risk_level"))
    wide = joins.with_defaults(t.ledger(spark, d, "key"), meta, "product_id", {"product_type": 1, "risk_level": 2})
    return wide.groupBy("product_type", "risk_level").agg(F.count(F.lit(1)).alias("n"))


@register("product_metadata", """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_type AS product_type_name,
  p_size % 6 AS product_type, p_size % 5 + 1 AS risk_level, p_size AS min_holding_days,
  p_retailprice AS annualized_yield FROM part""")
def product_metadata(spark, d):
    """Metadata objects keyed by product id, written as JSON text and read back."""
    text = t.table(spark, d, "part").select(F.to_json(F.create_map(
        F.col("p_partkey").cast("string"),
        F.struct(F.col("p_type").alias("product_type_name"), (F.col("p_size") % 6).alias("product_type_id"),
                 (F.col("p_size") % 5 + 1).alias("risk_level"), F.col("p_size").alias("min_holding_days"),
                 F.col("p_retailprice").alias("annualized_yield")))).alias("value"))
    return readers.parse_meta(text).select("product_id", "product_type_name", "product_type", "risk_level",
                                           "min_holding_days", "annualized_yield")


# ---- roll-ups ---------------------------------------------------------------------------------

FLOW = f"""WITH {L}, f AS (SELECT product_id, date, {total(0)} AS purchase_amt, {total(1)} AS redemption_amt
  FROM l WHERE status = 1 GROUP BY product_id, date)
SELECT *, purchase_amt - redemption_amt AS net_amt FROM f"""


@register("daily_flow", FLOW)
def daily_flow(spark, d):
    return rollup.daily_flow(t.ledger(spark, d, ok_only=True))


@register("daily_flow_by_part", f"""WITH {LK}, f AS (SELECT product_id, date, {total(0)} AS purchase_amt,
  {total(1)} AS redemption_amt FROM lk WHERE status = 1 GROUP BY product_id, date)
SELECT *, purchase_amt - redemption_amt AS net_amt FROM f""")
def daily_flow_by_part(spark, d):
    return rollup.daily_flow(t.ledger(spark, d, "key", ok_only=True))


@register("direction_totals", f"""WITH {L} SELECT product_id, date, direction, CAST(sum(amount) AS DOUBLE) AS amount
FROM l WHERE status = 1 GROUP BY product_id, date, direction""")
def direction_totals(spark, d):
    return rollup.direction_totals(t.ledger(spark, d, ok_only=True), ["product_id", "date"])


@register("failure_mean", f"""WITH {L} SELECT product_id, date, avg(CASE WHEN status = 0 THEN 1 ELSE 0 END) AS fail_rate
FROM l GROUP BY product_id, date""")
def failure_mean(spark, d):
    return rollup.failure_mean(t.ledger(spark, d))


BALANCE = f"""b AS (SELECT *, greatest(sum(CASE WHEN direction = 0 THEN amount ELSE -amount END) OVER
  (PARTITION BY product_id ORDER BY txn_ts, {TIE_COLUMNS} ROWS UNBOUNDED PRECEDING), 0) AS aum_after FROM l)"""
LAST = f"(txn_ts, {TIE_COLUMNS})"


def with_balance(spark, d, product="type"):
    return series.running_balance(t.ledger(spark, d, product, tie=True), ["product_id"], ["txn_ts", *t.TIE],
                                  series.signed_amount(), "clip")


def label_sql(names=(("purchase_amt", "label_purchase"), ("redemption_amt", "label_redemption"))):
    return ", ".join(f"lead({c}, {h}) OVER w AS {p}_{h}d" for c, p in names for h in (1, 7, 30))


@register("daily_context", f"""WITH {L}, {BALANCE}, g AS (SELECT product_id, date, {total(0, only='status = 1')} AS purchase_amt,
  {total(1, only='status = 1')} AS redemption_amt, CAST(arg_max(aum_after, {LAST}) AS DOUBLE) AS aum_eod,
  avg(CASE WHEN status = 0 THEN 1 ELSE 0 END) AS fail, count(*) FILTER (status = 1) AS ok FROM b GROUP BY product_id, date),
h AS (SELECT *, CASE WHEN count(fail) OVER f = 7 THEN avg(fail) OVER f ELSE 0 END AS fail_rate_7d FROM g
  WINDOW f AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT product_id, date, purchase_amt, redemption_amt, purchase_amt - redemption_amt AS net_amt, aum_eod,
  {is_month_end('date')} AS is_month_end, {is_quarter_end('date')} AS is_quarter_end,
  round(fail_rate_7d, 9) AS fail_rate_7d, 0.0::DOUBLE AS yield_rate, {label_sql()}
FROM h WHERE ok > 0 WINDOW w AS (PARTITION BY product_id ORDER BY date)""")
def daily_context(spark, d):
    return rounded(rollup.daily_context(with_balance(spark, d), ["txn_ts", *t.TIE]), 9, "fail_rate_7d")


@register("demo_daily", f"""WITH {L}, {BALANCE}, g AS (SELECT product_id, date, {total(0)} AS purchase_amt,
  {total(1)} AS redemption_amt, CAST(arg_max(aum_after, {LAST}) AS DOUBLE) AS aum_eod FROM b GROUP BY product_id, date)
SELECT *, purchase_amt - redemption_amt AS net_amt,
  round(0.03::DOUBLE + ({md5_bucket('product_id', 200, 'y')} - 100) / 2000.0::DOUBLE, 9) AS yield_rate FROM g""")
def demo_daily(spark, d):
    return rounded(rollup.demo_daily(with_balance(spark, d), ["txn_ts", *t.TIE]), 9, "yield_rate")


@register("end_of_day_balance", f"""WITH {LG}, b AS (SELECT *, sum(CASE WHEN direction = 0 THEN amount ELSE -amount END) OVER
  (PARTITION BY cust_id, product_id ORDER BY txn_ts, {TIE_COLUMNS} ROWS UNBOUNDED PRECEDING) AS aum_after FROM lg),
h AS (SELECT product_id, date, cust_id, arg_max(aum_after, {LAST}) AS last_balance FROM b GROUP BY ALL)
SELECT product_id, date, CAST(sum(last_balance) AS DOUBLE) AS aum_eod FROM h GROUP BY product_id, date""")
def end_of_day_balance(spark, d):
    ledger = t.ledger(spark, d, customer=True, tie=True).drop("status", "yield_rate")
    rows = series.running_balance(ledger, ["cust_id", "product_id"], ["txn_ts", *t.TIE], series.signed_amount())
    return rollup.summed_balance(rows, ["txn_ts", *t.TIE], ["cust_id"])


GROUP_DAILY = f"""{LG}, {META}, g AS (SELECT product_id, group_id, date, {total(0)} AS purchase, {total(1)} AS redemption,
  count(*) AS n_txn, CAST(sum(yield_rate) AS DOUBLE) / count(yield_rate) AS yield_rate FROM lg GROUP BY product_id, group_id, date),
gd AS (SELECT g.product_id, group_id, date, purchase, redemption, purchase - redemption AS net, n_txn, yield_rate,
  {calendar('date')}, CASE WHEN purchase - redemption < 0 THEN 1 ELSE 0 END AS direction,
  {log_amount('abs(purchase - redemption)')} AS amount_log1p, {log_amount('purchase')} AS purchase_log1p,
  {log_amount('redemption')} AS redemption_log1p, coalesce(meta.product_type, 1) AS product_type,
  coalesce(meta.risk_level, 2) AS risk_level FROM g LEFT JOIN meta USING (product_id))"""


def group_days(spark, d):
    return rollup.group_daily(t.ledger(spark, d, group=True), t.product_meta(spark, d))


@register("group_daily", f"WITH {GROUP_DAILY} SELECT * FROM gd")
def group_daily(spark, d):
    return group_days(spark, d)


@register("lead_labels", f"""WITH {L}, f AS (SELECT product_id, date, {total(0)} AS purchase_amt, {total(1)} AS redemption_amt
  FROM l WHERE status = 1 GROUP BY product_id, date)
SELECT product_id, date, {label_sql()} FROM f WINDOW w AS (PARTITION BY product_id ORDER BY date)""")
def lead_labels(spark, d):
    rows = series.lead_labels(rollup.daily_flow(t.ledger(spark, d, ok_only=True)), ["product_id"], "date",
                              {"purchase_amt": "label_purchase", "redemption_amt": "label_redemption"}, (1, 7, 30))
    return rows.drop("purchase_amt", "redemption_amt", "net_amt")


@register("calendar_labels", f"""WITH {L}, f AS (SELECT product_id, date, {total(0)} AS purchase_amt
  FROM l WHERE status = 1 GROUP BY product_id, date)
SELECT a.product_id, a.date, b.purchase_amt AS label_1d, c.purchase_amt AS label_7d, x.purchase_amt AS label_30d FROM f a
LEFT JOIN f b ON a.product_id = b.product_id AND b.date = a.date + 1
LEFT JOIN f c ON a.product_id = c.product_id AND c.date = a.date + 7
LEFT JOIN f x ON a.product_id = x.product_id AND x.date = a.date + 30""")
def calendar_labels(spark, d):
    rows = series.lead_labels(rollup.daily_flow(t.ledger(spark, d, ok_only=True)), ["product_id"], "date",
                              {"purchase_amt": "label"}, (1, 7, 30), calendar=True)
    return rows.select("product_id", "date", "label_1d", "label_7d", "label_30d")


@register("lagged_fail_rate", f"""WITH {L}, f AS (SELECT product_id, date, avg(CASE WHEN status = 0 THEN 1 ELSE 0 END) AS fail
  FROM l GROUP BY product_id, date)
SELECT product_id, date, round(CASE WHEN count(fail) OVER w = 7 THEN avg(fail) OVER w ELSE 0 END, 9) AS fail_rate_7d
FROM f WINDOW w AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def lagged_fail_rate(spark, d):
    rows = series.lagged_mean(rollup.failure_mean(t.ledger(spark, d)), ["product_id"], "date", "fail_rate", 7, "fail_rate_7d")
    return rounded(rows, 9, "fail_rate_7d").drop("fail_rate")


@register("label_coverage", f"""WITH {L}, f AS (SELECT product_id, date, {total(0)} AS purchase_amt
  FROM l WHERE status = 1 GROUP BY product_id, date),
g AS (SELECT lead(purchase_amt, 1) OVER w AS a, lead(purchase_amt, 7) OVER w AS b, lead(purchase_amt, 30) OVER w AS c
  FROM f WINDOW w AS (PARTITION BY product_id ORDER BY date))
SELECT 'label_1d' AS label, count(a) / count(*) AS coverage FROM g UNION ALL
SELECT 'label_7d', count(b) / count(*) FROM g UNION ALL SELECT 'label_30d', count(c) / count(*) FROM g""")
def label_coverage(spark, d):
    rows = series.lead_labels(rollup.daily_flow(t.ledger(spark, d, ok_only=True)), ["product_id"], "date", {"purchase_amt": "label"}, (1, 7, 30))
    return rollup.label_coverage(rows, ["label_1d", "label_7d", "label_30d"])


# ---- mappings ---------------------------------------------------------------------------------

ORDER_TIE = "InvoiceNo, CustomerID, Quantity, UnitPrice, l_linenumber, l_suppkey, l_discount"


@register("orders_to_ledger", f"""WITH o AS (SELECT (CASE WHEN l_tax = 0 THEN 'C' ELSE '' END) || l_orderkey AS InvoiceNo,
  l_shipdate AS InvoiceDate, CAST(l_partkey AS VARCHAR) AS product_id,
  CAST(l_quantity AS BIGINT) * (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS Quantity,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS UnitPrice, o_custkey AS CustomerID, l_linenumber, l_suppkey, l_discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT *, CustomerID AS cust_id, CAST(epoch(InvoiceDate) AS BIGINT) AS ts, CAST(InvoiceDate AS DATE) AS date,
  CASE WHEN Quantity >= 0 THEN 0 ELSE 1 END AS direction, CASE WHEN InvoiceNo LIKE 'C%' THEN 0 ELSE 1 END AS status,
  abs(Quantity) * UnitPrice AS amount, {md5_bucket('product_id', 6, 'ptype')} AS product_type FROM o
  WHERE Quantity <> 0 AND UnitPrice >= 0),
x AS (SELECT *, {log_amount('amount')} AS amount_log1p FROM m),
ed AS ({fit_edges('x', 'direction', 'amount_log1p', 24)})
SELECT product_id, cust_id, ts, date, x.direction, status, CAST(amount AS DOUBLE) AS amount, amount_log1p,
  {bin_of('amount_log1p', "(CASE WHEN n >= 32 THEN edges END)", 0)} AS amount_bin,
  CAST(greatest(sum(CASE WHEN x.direction = 0 THEN amount ELSE -amount END) OVER w, 0) AS DOUBLE) AS aum_after,
  {calendar('date')}, CAST(hour(InvoiceDate) AS INTEGER) AS hour, CAST(least(hour(InvoiceDate) // 3, 7) AS INTEGER) AS hour_bin,
  CAST(least(greatest(coalesce(ts - lag(ts) OVER w, 0), 0), 2592000) AS INTEGER) AS dt_prev_sec, product_type,
  least(product_type + 1, 5) AS risk_level, {md5_bucket('product_id', 4, 'term')} AS term_type,
  {md5_bucket('product_id', 4, 'ch')} AS channel, {md5_bucket('cust_id', 3, 'cust')} AS cust_type,
  round((CASE least(product_type + 1, 5) WHEN 1 THEN 0.022 WHEN 2 THEN 0.03 WHEN 3 THEN 0.05 WHEN 4 THEN 0.08 ELSE 0.12 END)::DOUBLE
    + ({md5_bucket('product_id', 200, 'y')} - 100) / 2000.0::DOUBLE, 9) AS yield_rate,
  row_number() OVER (ORDER BY product_id, ts, {ORDER_TIE}) - 1 AS __row_id__
FROM x LEFT JOIN ed ON x.direction = ed.direction
WINDOW w AS (PARTITION BY product_id ORDER BY ts, {ORDER_TIE} ROWS UNBOUNDED PRECEDING)""")
def orders_to_ledger(spark, d):
    wide = mapping.from_orders(t.order_lines(spark, d), [c.strip() for c in ORDER_TIE.split(",")])
    return rounded(wide, 9, "yield_rate")


PRICES = f"""{E}, px AS (SELECT printf('%06d', cust_id) AS code, date,
  CAST(arg_min(amount, (ts, event_id)) AS DOUBLE) AS open, CAST(max(amount) AS DOUBLE) AS high,
  CAST(min(amount) AS DOUBLE) AS low, CAST(arg_max(amount, (ts, event_id)) AS DOUBLE) AS close,
  count(*) AS volume, sum(amount) AS amount FROM e GROUP BY code, date),
qt AS (SELECT printf('%06d', e.cust_id) AS code, any_value(c_mktsegment || ' ' || c_name) AS name,
  CAST(sum(amount) AS DOUBLE) AS turnover,
  CAST(sum(CASE WHEN direction = 0 THEN amount ELSE -amount END) AS DOUBLE) AS main_net
  FROM e LEFT JOIN customer ON e.cust_id = c_custkey GROUP BY 1)"""
SEGMENT_RULES = [("^AUTO", 0, 1), ("^BUILD", 1, 2), ("^(FURN|HOUSE)", 4, 4)]


@register("quotes_to_ledger", f"""WITH {PRICES}, j AS (SELECT px.*, name, main_net FROM px LEFT JOIN qt USING (code) WHERE amount > 0),
x AS (SELECT code AS product_id, CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) AS ts, date,
  CASE WHEN close >= open THEN 0 ELSE 1 END AS direction, amount, {log_amount('amount')} AS amount_log1p,
  CASE WHEN name LIKE 'AUTO%' THEN 0 WHEN name LIKE 'BUILD%' THEN 1 WHEN name LIKE 'FURN%' OR name LIKE 'HOUSE%' THEN 4
    ELSE 2 END AS product_type,
  CASE WHEN name LIKE 'AUTO%' THEN 1 WHEN name LIKE 'BUILD%' THEN 2 ELSE 4 END AS risk_level,
  CASE WHEN main_net > 0 THEN 1 ELSE 0 END AS cust_type,
  CASE WHEN open > 0 THEN round((close - open) / open, 9) END AS yield_rate FROM j),
ed AS ({fit_edges('x', 'direction', 'amount_log1p', 24)})
SELECT product_id, CAST(NULL AS BIGINT) AS cust_id, ts, date, x.direction, 1 AS status, CAST(amount AS DOUBLE) AS amount,
  amount_log1p, {bin_of('amount_log1p', "(CASE WHEN n >= 32 THEN edges END)", 0)} AS amount_bin,
  CAST(greatest(sum(CASE WHEN x.direction = 0 THEN amount ELSE -amount END) OVER w, 0) AS DOUBLE) AS aum_after,
  {calendar('date')}, 15 AS hour, 5 AS hour_bin,
  CAST(least(greatest(coalesce(ts - lag(ts) OVER w, 0), 0), 2592000) AS INTEGER) AS dt_prev_sec, product_type, risk_level,
  {md5_bucket('product_id', 4, 'term')} AS term_type, {md5_bucket('product_id', 4, 'ch')} AS channel, cust_type, yield_rate,
  row_number() OVER (ORDER BY product_id, ts) - 1 AS __row_id__
FROM x LEFT JOIN ed ON x.direction = ed.direction
WINDOW w AS (PARTITION BY product_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def quotes_to_ledger(spark, d):
    wide = mapping.from_quotes(t.prices(spark, d), t.quotes(spark, d), SEGMENT_RULES)
    return rounded(wide, 9, "yield_rate")


@register("most_traded", f"""WITH {PRICES} SELECT code, turnover FROM qt WHERE turnover > 0
AND regexp_full_match(code, '[0-9]{{6}}') ORDER BY turnover DESC, code LIMIT 20""")
def most_traded(spark, d):
    return vocab.top_n(t.quotes(spark, d), "turnover", ["code"], 20, v.is_six_digits("code")).select("code", "turnover")


@register("row_ids", f"""WITH {LK} SELECT product_id, date, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
  row_number() OVER (ORDER BY product_id, txn_ts, {TIE_COLUMNS}) - 1 AS __row_id__ FROM lk""")
def row_ids(spark, d):
    rows = t.ledger(spark, d, "key", tie=True)
    return cleaning.dense_row_id(rows, ["product_id", "txn_ts", *t.TIE]).select(
        "product_id", "date", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "__row_id__")


@register("first_rows", f"""WITH {LK} SELECT product_id, date, direction, CAST(amount AS DOUBLE) AS amount FROM lk
ORDER BY txn_ts, {TIE_COLUMNS} LIMIT 50""")
def first_rows(spark, d):
    rows = cleaning.first_rows(t.ledger(spark, d, "key", tie=True), ["txn_ts", *t.TIE], 50)
    return rows.select("product_id", "date", "direction", F.col("amount").cast("double").alias("amount"))
