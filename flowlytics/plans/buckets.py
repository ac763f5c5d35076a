"""Registered queries: quantile buckets and time splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlytics.functions import tokens as tk
from flowlytics.functions import values as v
from flowlytics.operators import corpus, quality, quantile as q, rollup, series, split
from flowlytics.plans.catalog import (
    E, L, LG, LK, TIE_COLUMNS, bin_of, fit_edges, log_amount, register, total,
)
from flowlytics.plans.flows import GROUP_DAILY, group_days
from flowlytics.sources import readers, tables as t
from flowlytics.sources.stage import materialise


def edge_list(edges, *keys):
    """Edges as rows (position, value), so that they compare without array types."""
    return edges.select(*keys, F.posexplode("edges").alias("pos", "edge"))


def bounds_sql(source: str, train: float, val: float, gap: int) -> str:
    return f"""days AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT date FROM {source})),
bounds AS (SELECT max(date) FILTER (i = floor(n * {train}::DOUBLE)) AS train_end,
  CAST(max(date) FILTER (i = floor(n * {train}::DOUBLE)) + {gap} AS DATE) AS val_start,
  max(date) FILTER (i = floor(n * {train}::DOUBLE) + floor(n * {val}::DOUBLE)) AS val_end,
  CAST(max(date) FILTER (i = floor(n * {train}::DOUBLE) + floor(n * {val}::DOUBLE)) + 1 AS DATE) AS test_start FROM days)"""


SPLIT_CASE = ("CASE WHEN date <= train_end THEN 'train' WHEN date BETWEEN val_start AND val_end THEN 'val' "
              "WHEN date >= test_start THEN 'test' ELSE 'gap' END")


def logged(df):
    return df.withColumn("amount_log1p", v.log_amount("amount"))


LOGGED = f"x AS (SELECT *, {log_amount('amount')} AS amount_log1p FROM lk)"


@register("amount_edges", f"""WITH {LK}, {LOGGED}, ed AS ({fit_edges('x', 'direction', 'amount_log1p', 16)})
SELECT direction, CAST(i - 1 AS INTEGER) AS pos, edges[i] AS edge FROM ed, unnest(range(1, len(edges) + 1)) AS u(i)""")
def amount_edges(spark, d):
    return edge_list(q.fit_bins(logged(t.ledger(spark, d, "key")), ["direction"], "amount_log1p", 16), "direction")


@register("amount_bins", f"""WITH {LK}, {bounds_sql('lk', 0.8, 0.1, 7)},
x AS (SELECT *, {log_amount('amount')} AS amount_log1p, {SPLIT_CASE} AS split FROM lk, bounds),
ed AS ({fit_edges("(SELECT * FROM x WHERE split = 'train')", 'direction', 'amount_log1p', 16)})
SELECT split, x.direction, {bin_of('amount_log1p', 'edges')} AS amount_bin, count(*) AS n,
  CAST(sum(amount) AS DOUBLE) AS amount FROM x LEFT JOIN ed ON x.direction = ed.direction GROUP BY ALL""")
def amount_bins(spark, d):
    """Edges fitted on the train part only, applied to every part."""
    rows = logged(t.ledger(spark, d, "key"))
    rows = split.assign_split(rows, split.split_bounds(t.ledger(spark, d, "key")))
    edges = q.fit_bins(rows.where("split = 'train'"), ["direction"], "amount_log1p", 16)
    return q.apply_bins(rows, edges, ["direction"], "amount_log1p", 16, codes=q.DIRECTIONS).groupBy(
        "split", "direction", "amount_bin").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


@register("gap_bins", f"""WITH {E}, g AS (SELECT *, round(ln(1 + least(greatest(coalesce(txn_ts - lag(txn_ts) OVER w, 0), 0), 2592000)), 9) AS x
  FROM e WINDOW w AS (PARTITION BY cust_id ORDER BY txn_ts, event_id)),
{bounds_sql('e', 0.8, 0.1, 7)}, h AS (SELECT *, {SPLIT_CASE} AS split FROM g, bounds),
ed AS ({fit_edges("(SELECT * FROM h WHERE split = 'train')", '', 'x', 8)})
SELECT event_id, split, {bin_of('x', 'edges')} AS dt_bin FROM h, ed""")
def gap_bins(spark, d):
    rows = series.time_gap(t.event_ledger(spark, d), ["cust_id"], "txn_ts", ["event_id"])
    rows = rows.withColumn("x", v.log_amount("dt_prev_sec"))
    rows = split.assign_split(rows, split.split_bounds(t.event_ledger(spark, d)))
    edges = q.fit_bins(rows.where("split = 'train'"), [], "x", 8)
    return q.apply_bins(rows, edges, [], "x", 8, "dt_bin").select("event_id", "split", "dt_bin")


@register("min_purchase_bins", f"""WITH x AS (SELECT l_partkey, p_retailprice AS p, {log_amount('p_retailprice')} AS x
  FROM lineitem JOIN part ON l_partkey = p_partkey), ed AS ({fit_edges('x', '', 'x', 4)})
SELECT l_partkey AS part, {bin_of('x', 'edges', 0)} AS min_purchase_bin, count(*) AS n FROM x, ed GROUP BY ALL""")
def min_purchase_bins(spark, d):
    """Weighted by ledger rows: a product counts as often as it trades."""
    rows = t.table(spark, d, "lineitem").select("l_partkey").join(
        t.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    rows = rows.select(F.col("l_partkey").alias("part"), v.log_amount("p_retailprice").alias("x"))
    edges = q.fit_bins(rows, [], "x", 4)
    return q.apply_bins(rows, edges, [], "x", 4, "min_purchase_bin", missing=0).groupBy("part", "min_purchase_bin").agg(
        F.count(F.lit(1)).alias("n"))


@register("direction_bins_24", f"""WITH {LK}, {LOGGED}, ed AS ({fit_edges('x', 'direction', 'amount_log1p', 24)})
SELECT x.direction, {bin_of('amount_log1p', '(CASE WHEN n >= 32 THEN edges END)', 0)} AS amount_bin, count(*) AS n,
  CAST(min(amount) AS DOUBLE) AS lo, CAST(max(amount) AS DOUBLE) AS hi FROM x LEFT JOIN ed ON x.direction = ed.direction GROUP BY ALL""")
def direction_bins_24(spark, d):
    rows = logged(t.ledger(spark, d, "key"))
    edges = q.fit_bins(rows, ["direction"], "amount_log1p", 24, min_rows=32)
    return q.apply_bins(rows, edges, ["direction"], "amount_log1p", 24, missing=0, codes=q.DIRECTIONS).groupBy(
        "direction", "amount_bin").agg(F.count(F.lit(1)).alias("n"), F.min("amount").cast("double").alias("lo"),
                                       F.max("amount").cast("double").alias("hi"))


CORPUS_DAYS = f"""{LG}, cd AS (SELECT product_id, group_id, date, direction, CAST(sum(amount) AS DOUBLE) AS amount,
  min(product_type) AS product_type, CAST(min(1 + l_partkey % 5) AS INTEGER) AS risk_level FROM lg GROUP BY product_id, group_id, date, direction)"""


def market_rows(spark, d):
    """Ledger rows with type and risk of their product."""
    rows = t.ledger(spark, d, group=True, tie=True)
    return rows.select("product_id", "group_id", "date", "direction", "amount",
                       t.position("product_id", t.PART_TYPES).alias("product_type"),
                       (F.col("l_partkey") % 5 + 1).cast("int").alias("risk_level"))


def corpus_days(spark, d):
    return materialise(rollup.corpus_daily(market_rows(spark, d)))


@register("corpus_daily", f"WITH {CORPUS_DAYS} SELECT * FROM cd")
def corpus_daily(spark, d):
    return rollup.corpus_daily(market_rows(spark, d))


SERIES_BINS = f"""{CORPUS_DAYS}, cx AS (SELECT *, {log_amount('amount')} AS amount_log1p FROM cd),
ced AS ({fit_edges('cx', 'product_id, group_id, direction', 'amount_log1p', 16)}),
cb AS (SELECT product_id, group_id, date, direction, amount, amount_log1p, product_type, risk_level,
  {bin_of('amount_log1p', '(CASE WHEN n >= 16 THEN edges END)', 0)} AS amount_bin
  FROM cx LEFT JOIN ced USING (product_id, group_id, direction))"""


@register("series_bins", f"WITH {SERIES_BINS} SELECT * FROM cb")
def series_bins(spark, d):
    return corpus.series_bins(corpus_days(spark, d))


@register("direction_bins", f"""WITH {CORPUS_DAYS}, x AS (SELECT *, {log_amount('amount')} AS amount_log1p FROM cd),
ed AS ({fit_edges('x', 'direction', 'amount_log1p', 16)})
SELECT product_id, group_id, date, x.direction, {bin_of('amount_log1p', '(CASE WHEN n >= 16 THEN edges END)', 0)} AS amount_bin
FROM x LEFT JOIN ed ON x.direction = ed.direction""")
def direction_bins(spark, d):
    binned = corpus.series_bins(corpus_days(spark, d), ["direction"], codes=q.DIRECTIONS)
    return binned.select("product_id", "group_id", "date", "direction", "amount_bin")


@register("net_bins", f"""WITH {GROUP_DAILY}, {bounds_sql('gd', 0.7, 0.15, 1)}, x AS (SELECT gd.*, {SPLIT_CASE} AS split FROM gd, bounds),
ed AS ({fit_edges("(SELECT * FROM x WHERE split = 'train')", '', 'amount_log1p', 16)})
SELECT product_id, group_id, date, split, {bin_of('amount_log1p', 'edges', -1, 1)} AS amount_bin FROM x, ed""")
def net_bins(spark, d):
    """One encoding: 0 is unknown, 1..16 are the buckets."""
    return binned_group_days(spark, d).select("product_id", "group_id", "date", "split", "amount_bin")


def binned_group_days(spark, d):
    """Group days with their split and bucket; the roll-up is computed once for bounds, edges and rows."""
    days = split.date_split(materialise(group_days(spark, d)))
    edges = q.fit_bins(days.where("split = 'train'"), [], "amount_log1p", 16)
    return q.apply_bins(days, edges, [], "amount_log1p", 16, missing=-1, offset=1)


ADAPTIVE = """ad AS (SELECT direction, count(DISTINCT qty) AS nd, greatest(least(count(DISTINCT qty), 16), 1) AS k,
  list_sort(list(qty)) AS a FROM v GROUP BY direction),
ed AS (SELECT direction, list_sort(list_distinct(list_transform(range(0, k + 1), lambda i:
  round(a[1 + CAST(floor(i / k::DOUBLE * (len(a) - 1)) AS BIGINT)]
    + (a[1 + CAST(ceil(i / k::DOUBLE * (len(a) - 1)) AS BIGINT)] - a[1 + CAST(floor(i / k::DOUBLE * (len(a) - 1)) AS BIGINT)])
    * (i / k::DOUBLE * (len(a) - 1) - floor(i / k::DOUBLE * (len(a) - 1))), 9)))) AS edges FROM ad)"""


@register("bin_labels", f"""WITH v AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS direction,
  round(l_tax + 0, 9) AS qty FROM lineitem), {ADAPTIVE},
b AS (SELECT v.direction, qty, {bin_of('qty', 'edges')} AS bin FROM v JOIN ed ON v.direction = ed.direction)
SELECT direction, qty, CASE WHEN bin < 0 THEN 'A' || bin ELSE 'A' || printf('%02d', bin) END AS label, count(*) AS n
FROM b GROUP BY ALL""")
def bin_labels(spark, d):
    """Tax has nine values, so nine buckets are asked for in place of sixteen."""
    rows = t.table(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("direction"), F.round("l_tax", 9).alias("qty"))
    edges = q.fit_adaptive_bins(rows, ["direction"], "qty", 16)
    rows = q.apply_bins(rows, edges, ["direction"], "qty", 16, "bin", codes=q.DIRECTIONS)
    return rows.select("direction", "qty", tk.bin_label(F.col("bin")).alias("label")).groupBy(
        "direction", "qty", "label").agg(F.count(F.lit(1)).alias("n"))


@register("stored_edges", f"""WITH {LK}, {LOGGED}, ed AS ({fit_edges('x', 'direction', 'amount_log1p', 16)})
SELECT x.direction, {bin_of('amount_log1p', 'edges')} AS amount_bin, count(*) AS n
FROM x LEFT JOIN ed ON x.direction = ed.direction GROUP BY ALL""")
def stored_edges(spark, d):
    """Edges in the stored layout (feature, key, bins, edges) applied again, as at inference."""
    rows = logged(t.ledger(spark, d, "key"))
    state = readers.edge_state(q.fit_bins(rows, ["direction"], "amount_log1p", 16), "amount", 16, "direction")
    edges = readers.edges_for(state, "amount", "direction")
    return q.apply_bins(rows, edges, ["direction"], "amount_log1p", 16, codes=q.DIRECTIONS).groupBy(
        "direction", "amount_bin").agg(F.count(F.lit(1)).alias("n"))


# ---- splits -----------------------------------------------------------------------------------

@register("distinct_dates", f"WITH {LK} SELECT DISTINCT date FROM lk")
def distinct_dates(spark, d):
    return split.distinct_dates(t.ledger(spark, d, "key"))


@register("split_bounds", f"WITH {LK}, {bounds_sql('lk', 0.8, 0.1, 7)} SELECT * FROM bounds")
def split_bounds(spark, d):
    return split.split_bounds(t.ledger(spark, d, "key"))


@register("time_split", f"""WITH {L}, {bounds_sql('l', 0.8, 0.1, 7)}
SELECT product_id, {SPLIT_CASE} AS split, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM l, bounds GROUP BY ALL""")
def time_split(spark, d):
    rows = t.ledger(spark, d)
    return split.assign_split(rows, split.split_bounds(t.ledger(spark, d, "key"))).groupBy("product_id", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@register("date_split", f"""WITH {LK}, {bounds_sql('lk', 0.7, 0.15, 1)}
SELECT {SPLIT_CASE} AS split, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM lk, bounds GROUP BY ALL""")
def date_split(spark, d):
    return split.date_split(t.ledger(spark, d, "key")).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@register("sample_split", f"""WITH {LK}, r AS (SELECT *, row_number() OVER (ORDER BY date, product_id, {TIE_COLUMNS}) - 1 AS i,
  count(*) OVER () AS n FROM lk),
s AS (SELECT *, CASE WHEN i < floor(n * 0.70::DOUBLE) THEN 'train' WHEN i < floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val'
  ELSE 'test' END AS split FROM r)
SELECT split, count(*) AS n, min(date) AS first_day, max(date) AS last_day, CAST(sum(amount) AS DOUBLE) AS amount FROM s GROUP BY split""")
def sample_split(spark, d):
    rows = t.ledger(spark, d, "key", tie=True)
    return split.sample_split(rows, ["date", "product_id", *t.TIE]).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.sum("amount").cast("double").alias("amount"))


@register("split_masked_labels", f"""WITH {L}, {bounds_sql('l', 0.8, 0.1, 7)}, f AS (SELECT product_id, date, {total(0)} AS purchase_amt
  FROM l WHERE status = 1 GROUP BY product_id, date), s AS (SELECT *, {SPLIT_CASE} AS split FROM f, bounds)
SELECT product_id, date, split, {', '.join(f"CASE WHEN lead(split, {h}) OVER w = split THEN lead(purchase_amt, {h}) OVER w END AS label_{h}d" for h in (1, 7, 30))}
FROM s WINDOW w AS (PARTITION BY product_id ORDER BY date)""")
def split_masked_labels(spark, d):
    """Labels that would reach into another split are left out."""
    days = split.assign_split(rollup.daily_flow(t.ledger(spark, d, ok_only=True)), split.split_bounds(t.ledger(spark, d, "key")))
    rows = series.lead_labels(days, ["product_id"], "date", {"purchase_amt": "label"}, (1, 7, 30), within="split")
    return rows.select("product_id", "date", "split", "label_1d", "label_7d", "label_30d")


@register("bin_row_gates", f"""WITH {LK}, c AS (SELECT unnest([0, 1, -1]) AS d), n AS (SELECT direction, CAST(count(*) AS DOUBLE) AS n FROM lk GROUP BY direction)
SELECT 'bin_rows_' || d AS gate, coalesce(n, 0) AS value, 20000.0::DOUBLE AS lo, coalesce(n, 0) >= 20000 AS passed FROM c LEFT JOIN n ON direction = d""")
def bin_row_gates(spark, d):
    """Whether each direction has two rows for each of 10,000 buckets, and one that doesn't occur."""
    edges = q.fit_bins(logged(t.ledger(spark, d, "key")), ["direction"], "amount_log1p", 16)
    return quality.bin_rows(edges, 10_000, (0, 1, -1)).select("gate", "value", "lo", "passed")
