"""Registered queries: distribution profiles and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlytics.operators import cleaning, joins, profile as p, quality, rollup, series, split
from flowlytics.functions import timefeat as tf
from flowlytics.functions import values as v
from flowlytics.plans.buckets import SERIES_BINS, SPLIT_CASE, bounds_sql, corpus_days
from flowlytics.plans.catalog import E, L, LG, LK, at, is_month_end, is_quarter_end, register, rounded, total
from flowlytics.plans.flows import BALANCE, label_sql, with_balance
from flowlytics.operators.quantile import PROFILE_NAMES, PROFILE_PROBS
from flowlytics.operators import corpus
from flowlytics.sources import tables as t

PROBS_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in PROFILE_PROBS) + "]"


def spread(df, keys, array, prefix="", digits=6):
    """An eleven-point array as columns p00..p100."""
    return df.select(*keys, *[F.round(at(array, i), digits).alias(prefix + n) for i, n in enumerate(PROFILE_NAMES)])


def spread_sql(array, prefix="", digits=6):
    return ", ".join(f"round({array}[{i + 1}], {digits}) AS {prefix}{n}" for i, n in enumerate(PROFILE_NAMES))


@register("value_counts", f"""WITH {LK}, s AS (SELECT CAST(direction AS VARCHAR) AS direction, CAST(status AS VARCHAR) AS status,
  CAST(year(date) AS VARCHAR) AS y, CAST(month(date) AS VARCHAR) AS m FROM lk)
SELECT 'direction' AS field, direction AS value, count(*) AS n FROM s GROUP BY direction UNION ALL
SELECT 'status', status, count(*) FROM s GROUP BY status UNION ALL
SELECT 'year', y, count(*) FROM s GROUP BY y UNION ALL SELECT 'month', m, count(*) FROM s GROUP BY m""")
def value_counts(spark, d):
    rows = t.ledger(spark, d, "key").select("direction", "status", F.year("date").alias("year"), F.month("date").alias("month"))
    return p.long_counts(rows, ["direction", "status", "year", "month"])


@register("dow_counts", f"""WITH {L}, k AS (SELECT DISTINCT product_id FROM l), c AS (SELECT product_id, isodow(date) - 1 AS dow, count(*) AS n FROM l GROUP BY ALL)
SELECT k.product_id, CAST(r.i AS INTEGER) AS dow, coalesce(c.n, 0) AS n FROM k CROSS JOIN range(7) AS r(i)
LEFT JOIN c ON c.product_id = k.product_id AND c.dow = r.i""")
def dow_counts(spark, d):
    return p.dow_counts(t.ledger(spark, d), keys=["product_id"])


@register("shares", f"""WITH {LK} SELECT product_id, avg(CASE WHEN direction = 0 THEN 1 ELSE 0 END) AS purchase,
  avg(CASE WHEN direction = 1 THEN 1 ELSE 0 END) AS redemption, avg(CASE WHEN status = 1 THEN 1 ELSE 0 END) AS success,
  avg({is_month_end('date')}) AS month_end, avg({is_quarter_end('date')}) AS quarter_end FROM lk GROUP BY product_id""")
def shares(spark, d):
    return p.shares(t.ledger(spark, d, "key"), ["product_id"], {
        "purchase": F.col("direction") == 0, "redemption": F.col("direction") == 1, "success": F.col("status") == 1,
        "month_end": tf.is_month_end("date") == 1, "quarter_end": tf.is_quarter_end("date") == 1})


@register("distinct_counts", """SELECT count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_suppkey) AS l_suppkey,
  count(DISTINCT l_orderkey) AS l_orderkey FROM lineitem""")
def distinct_counts(spark, d):
    return p.distinct_counts(t.table(spark, d, "lineitem"), ["l_partkey", "l_suppkey", "l_orderkey"])


@register("amount_quantiles", f"""WITH {L}, g AS (SELECT product_id, quantile_cont(CAST(amount AS DOUBLE), [0.5::DOUBLE, 0.75::DOUBLE, 0.99::DOUBLE]) AS q,
  CAST(max(amount) AS DOUBLE) AS hi, CAST(min(amount) AS DOUBLE) AS lo FROM l GROUP BY product_id)
SELECT product_id, round(q[1], 6) AS median, round(q[2], 6) AS p75, round(q[3], 6) AS p99, lo AS min, hi AS max FROM g""")
def amount_quantiles(spark, d):
    rows = p.quantiles(t.ledger(spark, d), ["product_id"], "amount", [0, 0.5, 0.75, 0.99, 1])
    return rows.select("product_id", *[F.round(at("quantiles", i), 6).alias(n)
                                       for i, n in enumerate(["min", "median", "p75", "p99", "max"])])


@register("quantile_vector", f"""WITH {LK}, g AS (SELECT direction, quantile_cont(CAST(amount AS DOUBLE), {PROBS_SQL}) AS q FROM lk GROUP BY direction)
SELECT direction, {spread_sql('q')} FROM g""")
def quantile_vector(spark, d):
    return spread(p.quantiles(t.ledger(spark, d, "key"), ["direction"], "amount"), ["direction"], "quantiles")


def histogram_sql(source, keys, value, bins, density=False):
    dens = f", round(coalesce(c.n, 0) / (total * (hi - lo) / {bins}), 9) AS density" if density else ""
    ks = ", ".join(keys)
    on = " AND ".join(f"c.{k} = m.{k}" for k in keys)
    return f"""m AS (SELECT {ks}, CASE WHEN min({value}) = max({value}) THEN min({value}) - 0.5 ELSE min({value}) END AS lo,
  CASE WHEN min({value}) = max({value}) THEN max({value}) + 0.5 ELSE max({value}) END AS hi, count({value}) AS total FROM {source} GROUP BY {ks}),
c AS (SELECT {', '.join('s.' + k for k in keys)}, least(CAST(floor(({value} - lo) * {bins} / (hi - lo)) AS INTEGER), {bins - 1}) AS bin, count(*) AS n
  FROM {source} s JOIN m USING ({ks}) GROUP BY ALL)
SELECT {', '.join('m.' + k for k in keys)}, CAST(r.i AS INTEGER) AS bin, round(lo + (hi - lo) / {bins} * r.i, 6) AS lo,
  round(lo + (hi - lo) / {bins} * (r.i + 1), 6) AS hi, coalesce(c.n, 0) AS n{dens}
FROM m CROSS JOIN range({bins}) AS r(i) LEFT JOIN c ON {on} AND c.bin = r.i"""


@register("histogram", f"""WITH {L}, x AS (SELECT product_id, CAST(amount AS DOUBLE) AS v FROM l), {histogram_sql('x', ['product_id'], 'v', 20)}""")
def histogram(spark, d):
    return rounded(p.histogram(t.ledger(spark, d), ["product_id"], "amount"), 6, "lo", "hi")


@register("log_density", f"""WITH {L}, x AS (SELECT product_id, direction, round(ln(1 + CAST(amount AS DOUBLE)), 9) AS v FROM l),
{histogram_sql('x', ['product_id', 'direction'], 'v', 50, True)}""")
def log_density(spark, d):
    rows = t.ledger(spark, d).withColumn("x", v.log_amount("amount"))
    return rounded(rounded(p.histogram(rows, ["product_id", "direction"], "x", 50, density=True), 6, "lo", "hi"), 9, "density")


@register("describe", f"""WITH {LK}, x AS (SELECT direction, CAST(amount AS DOUBLE) AS v, amount FROM lk)
SELECT direction, count(v) AS count, round(CAST(sum(amount) AS DOUBLE) / count(amount), 6) AS mean, round(stddev_samp(v), 6) AS std,
  min(v) AS min, round(quantile_cont(v, 0.25::DOUBLE), 6) AS p25, round(quantile_cont(v, 0.5::DOUBLE), 6) AS p50,
  round(quantile_cont(v, 0.75::DOUBLE), 6) AS p75, max(v) AS max FROM x GROUP BY direction""")
def describe(spark, d):
    return rounded(p.describe(t.ledger(spark, d, "key"), ["direction"], "amount"), 6, "mean", "std", "p25", "p50", "p75")


SCOPES = """sc AS (SELECT product_id, 'all' AS scope, amount FROM {0} UNION ALL
  SELECT product_id, CASE WHEN direction = 0 THEN 'purchase' ELSE 'redemption' END, amount FROM {0})"""


@register("amount_profile", f"""WITH {L}, {SCOPES.format('l')}, g AS (SELECT product_id, scope, count(*) AS n, CAST(sum(amount) AS DOUBLE) / count(*) AS mean,
  stddev_samp(CAST(amount AS DOUBLE)) AS std, quantile_cont(CAST(amount AS DOUBLE), {PROBS_SQL}) AS q,
  quantile_cont(ln(1 + CAST(amount AS DOUBLE)), {PROBS_SQL}) AS lq FROM sc GROUP BY product_id, scope)
SELECT product_id, scope, n, round(mean, 6) AS mean, round(std, 6) AS std, {spread_sql('q')}, {spread_sql('lq', 'log_')} FROM g""")
def amount_profile(spark, d):
    rows = p.amount_profile(t.ledger(spark, d))
    return rows.select(
        "product_id", "scope", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
        *[F.round(at("quantiles", i), 6).alias(n) for i, n in enumerate(PROFILE_NAMES)],
        *[F.round(at("log1p_quantiles", i), 6).alias("log_" + n) for i, n in enumerate(PROFILE_NAMES)])


@register("daily_count_quantiles", f"""WITH {L}, c AS (SELECT product_id, date, count(*) AS n FROM l GROUP BY ALL),
g AS (SELECT product_id, quantile_cont(CAST(n AS DOUBLE), {PROBS_SQL}) AS q FROM c GROUP BY product_id) SELECT product_id, {spread_sql('q')} FROM g""")
def daily_count_quantiles(spark, d):
    return spread(p.daily_count_quantiles(t.ledger(spark, d)), ["product_id"], "quantiles")


@register("day_averages", f"""WITH {L}, c AS (SELECT product_id, date, count(*) AS n FROM l GROUP BY ALL)
SELECT product_id, avg(n) AS avg_txns_per_day, avg(n) FILTER ({is_month_end('date')} = 1) AS avg_txns_per_month_end_day,
  avg(n) FILTER ({is_quarter_end('date')} = 1) AS avg_txns_per_quarter_end_day FROM c GROUP BY product_id""")
def day_averages(spark, d):
    return p.day_averages(t.ledger(spark, d))


@register("month_end_days", f"""WITH {L}, c AS (SELECT product_id, date, count(*) AS n FROM l GROUP BY ALL),
m AS (SELECT DISTINCT date FROM c WHERE {is_month_end('date')} = 1) SELECT product_id, date, n FROM c SEMI JOIN m USING (date)""")
def month_end_days(spark, d):
    counts = p.day_counts(t.ledger(spark, d))
    days = split.distinct_dates(t.ledger(spark, d, "key")).where(tf.is_month_end("date") == 1)
    return joins.matched_days(counts, days, ["date"])


@register("product_profile", f"""WITH {L}, c AS (SELECT product_id, date, count(*) AS n FROM l GROUP BY ALL),
cq AS (SELECT product_id, avg(n) AS avg_txns_per_day, avg(n) FILTER ({is_month_end('date')} = 1) AS avg_txns_per_month_end_day,
  quantile_cont(CAST(n AS DOUBLE), 0.5::DOUBLE) AS daily_p50 FROM c GROUP BY product_id),
x AS (SELECT product_id, CAST(amount AS DOUBLE) AS v, amount, direction, status, txn_ts, date FROM l),
m AS (SELECT product_id, min(v) AS lo, max(v) AS hi FROM x GROUP BY product_id)
SELECT x.product_id, count(*) AS n_records, CAST(floor((max(txn_ts) - min(txn_ts)) / 86400) AS INTEGER) AS days_total,
  count(*) FILTER (isodow(date) = 1) AS mondays, count(*) FILTER (month(date) = 12) AS december, count(*) FILTER (year(date) = 1999) AS y1999,
  avg({is_month_end('date')}) AS month_end_share, avg({is_quarter_end('date')}) AS quarter_end_share,
  avg(CASE WHEN direction = 0 THEN 1 ELSE 0 END) AS purchase_share, avg(CASE WHEN direction = 1 THEN 1 ELSE 0 END) AS redemption_share,
  avg(CASE WHEN status = 1 THEN 1 ELSE 0 END) AS status_share_success, any_value(avg_txns_per_day) AS avg_txns_per_day,
  any_value(avg_txns_per_month_end_day) AS avg_txns_per_month_end_day, any_value(daily_p50) AS daily_p50,
  round(CAST(sum(amount) AS DOUBLE) / count(*), 6) AS mean_all, round(quantile_cont(v, 0.99::DOUBLE), 6) AS p99_all,
  count(*) FILTER (direction = 1) AS n_redemption, round(quantile_cont(CASE WHEN direction = 1 THEN v END, 0.5::DOUBLE), 6) AS p50_redemption,
  count(*) FILTER (least(CAST(floor((v - lo) * 20 / (hi - lo)) AS INTEGER), 19) = 0) AS first_bar
FROM x JOIN cq USING (product_id) JOIN m USING (product_id) GROUP BY x.product_id""")
def product_profile(spark, d):
    rows = p.product_profile(t.ledger(spark, d).withColumn("ts", F.timestamp_seconds("txn_ts")))
    red, every = F.col("amount")["redemption"], F.col("amount")["all"]
    return rows.select(
        "product_id", "n_records", "days_total", F.col("txns_per_dow")["0"].alias("mondays"),
        F.col("txns_per_month")[12].alias("december"), F.col("txns_per_year")[1999].alias("y1999"),
        "month_end_share", "quarter_end_share", "purchase_share", "redemption_share", "status_share_success",
        "avg_txns_per_day", "avg_txns_per_month_end_day", F.col("daily_count_quantiles")["p50"].alias("daily_p50"),
        F.round(every["mean"], 6).alias("mean_all"), F.round(every["quantiles"]["p99"], 6).alias("p99_all"),
        red["n"].alias("n_redemption"), F.round(red["quantiles"]["p50"], 6).alias("p50_redemption"),
        F.col("amount_histogram")[0]["n"].alias("first_bar"))


def shown(x: str, digits: int = 0) -> str:
    return f"printf('%.{digits}f', round({x}, {digits}))"


def direction_line(number: int, name: str, array: str, count: str) -> str:
    return (f"SELECT product_id, {number}, '  - {name}: n=' || {count} || ', p50=' || {shown(array + '[2]')} || ', p99=' || "
            f"{shown(array + '[4]')} FROM g WHERE {count} > 0")


def points(direction: int | None) -> str:
    value = "CAST(amount AS DOUBLE)" if direction is None else f"CASE WHEN direction = {direction} THEN CAST(amount AS DOUBLE) END"
    return f"quantile_cont({value}, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.99::DOUBLE])"


@register("report_lines", f"""WITH {L}, g AS (SELECT product_id, count(*) AS n, min(date) AS lo, max(date) AS hi,
  CAST(floor((max(txn_ts) - min(txn_ts)) / 86400) AS INTEGER) AS days, {', '.join(f"count(*) FILTER (isodow(date) = {i + 1}) AS d{i}" for i in range(7))},
  count(*) FILTER (direction = 0) AS np, count(*) FILTER (direction = 1) AS nr, avg(CASE WHEN direction = 0 THEN 1 ELSE 0 END) AS ps,
  avg(CASE WHEN direction = 1 THEN 1 ELSE 0 END) AS rs, avg(CASE WHEN status = 1 THEN 1 ELSE 0 END) AS ss,
  {points(None)} AS qa, {points(0)} AS qp, {points(1)} AS qr FROM l GROUP BY product_id)
SELECT product_id, 0 AS line_no, '## ' || product_id AS line FROM g UNION ALL
SELECT product_id, 1, '- records: ' || n FROM g UNION ALL
SELECT product_id, 2, '- from ' || lo || ' to ' || hi || ' (' || days || ' days)' FROM g UNION ALL
SELECT product_id, 3, '- purchase ' || {shown('ps * 100', 2)} || '% / redemption ' || {shown('rs * 100', 2)} || '%' FROM g UNION ALL
SELECT product_id, 4, '- success ' || {shown('ss * 100', 2)} || '%' FROM g UNION ALL
SELECT product_id, 5, '- amount: p25=' || {shown('qa[1]')} || ' p50=' || {shown('qa[2]')} || ' p75=' || {shown('qa[3]')} || ' p99=' || {shown('qa[4]')} FROM g UNION ALL
{direction_line(6, 'purchase', 'qp', 'np')} UNION ALL {direction_line(7, 'redemption', 'qr', 'nr')} UNION ALL
SELECT product_id, 8, '- Mon=' || d0 || ', Tue=' || d1 || ', Wed=' || d2 || ', Thu=' || d3 || ', Fri=' || d4 || ', Sat=' || d5 || ', Sun=' || d6 FROM g""")
def report_lines(spark, d):
    return p.report_lines(p.product_profile(t.ledger(spark, d).withColumn("ts", F.timestamp_seconds("txn_ts"))))


@register("cross_table", """WITH c AS (SELECT c_mktsegment AS segment, count(*) FILTER (l_returnflag <> 'R') AS purchase,
  count(*) FILTER (l_returnflag = 'R') AS redemption FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT *, purchase / (purchase + redemption) AS purchase_share, redemption / (purchase + redemption) AS redemption_share FROM c""")
def cross_table(spark, d):
    rows = t.ledger(spark, d, "key", group=True).withColumnRenamed("group_name", "segment")
    return p.cross_tab(rows, "segment", "direction", [0, 1], ["purchase", "redemption"])


@register("month_matrix", f"""WITH {LK} SELECT CAST(month(date) AS INTEGER) AS month, {total(0)} AS purchase, {total(1)} AS redemption FROM lk GROUP BY 1""")
def month_matrix(spark, d):
    return p.month_matrix(t.ledger(spark, d, "key"))


@register("group_summary", f"""WITH {LG} SELECT product_id, group_id, any_value(group_name) AS group_name, count(*) AS n,
  avg(CASE WHEN direction = 1 THEN 1 ELSE 0 END) AS red_share, round(quantile_cont(CAST(amount AS DOUBLE), 0.5::DOUBLE), 6) AS amt_median
FROM lg GROUP BY product_id, group_id""")
def group_summary(spark, d):
    rows = p.group_summary(t.ledger(spark, d, group=True), ["product_id", "group_id"], name="group_name")
    return rounded(rows, 6, "amt_median")


@register("granularity", f"""WITH {LG} SELECT (SELECT count(*) FROM (SELECT DISTINCT product_id, group_id, date FROM lg)) AS n_fine,
  (SELECT count(*) FROM (SELECT DISTINCT product_id, date FROM lg)) AS n_coarse,
  (SELECT count(*) FROM (SELECT DISTINCT product_id, group_id, date FROM lg)) / (SELECT count(*) FROM (SELECT DISTINCT product_id, date FROM lg)) AS ratio""")
def granularity(spark, d):
    return p.granularity(t.ledger(spark, d, group=True))


@register("series_lengths", f"""WITH {LK}, s AS (SELECT product_id, count(*) AS len FROM lk GROUP BY product_id)
SELECT count(*) AS n_series, min(len) AS min_len, quantile_cont(CAST(len AS DOUBLE), 0.5::DOUBLE) AS median_len, avg(len) AS mean_len,
  round(quantile_cont(CAST(len AS DOUBLE), 0.9::DOUBLE), 6) AS p90_len, max(len) AS max_len, avg(CASE WHEN len > 1500 THEN 1 ELSE 0 END) AS long_share FROM s""")
def series_lengths(spark, d):
    return rounded(p.series_lengths(t.ledger(spark, d, "key")), 6, "p90_len")


@register("calibration", f"""WITH {L} SELECT product_id, round(ln(quantile_cont(CAST(amount AS DOUBLE), 0.5::DOUBLE)), 6) AS mu_amount_log,
  round((ln(quantile_cont(CAST(amount AS DOUBLE), 0.99::DOUBLE)) - ln(quantile_cont(CAST(amount AS DOUBLE), 0.5::DOUBLE))) / {p.Z99}::DOUBLE, 6) AS sigma_amount,
  round(count(*) * 30.0::DOUBLE / (date_diff('day', min(date), max(date)) + 1), 6) AS monthly_txn_rate,
  avg(CASE WHEN direction = 1 THEN 1 ELSE 0 END) AS p_redemption_base FROM l GROUP BY product_id""")
def calibration(spark, d):
    return rounded(p.calibrate(t.ledger(spark, d)), 6, "mu_amount_log", "sigma_amount", "monthly_txn_rate")


@register("bin_balance", f"WITH {SERIES_BINS} SELECT amount_bin, count(*) AS n, count(*) / (SELECT count(*) FROM cb) AS share FROM cb GROUP BY amount_bin")
def bin_balance(spark, d):
    return p.bin_balance(corpus.series_bins(corpus_days(spark, d)))


# ---- quality ----------------------------------------------------------------------------------

@register("quality_gates", f"""WITH {L}, {BALANCE}, {bounds_sql('l', 0.8, 0.1, 7)}, s AS (SELECT *, {SPLIT_CASE} AS split FROM b, bounds),
len AS (SELECT count(*) AS n FROM s GROUP BY product_id),
f AS (SELECT product_id, date, {total(0)} AS purchase_amt, {total(1)} AS redemption_amt FROM l WHERE status = 1 GROUP BY product_id, date),
lab AS (SELECT {label_sql()} FROM f WINDOW w AS (PARTITION BY product_id ORDER BY date)),
g AS (SELECT 'fail_rate' AS gate, avg(CASE WHEN status = 0 THEN 1 ELSE 0 END) AS value, 0.01::DOUBLE AS lo, 0.5::DOUBLE AS hi FROM s UNION ALL
 SELECT 'redemption_share', avg(CASE WHEN direction = 1 THEN 1 ELSE 0 END), 0.2::DOUBLE, 0.8::DOUBLE FROM s UNION ALL
 SELECT 'min_balance', CAST(min(aum_after) AS DOUBLE), 0.0::DOUBLE, NULL FROM s UNION ALL
 SELECT 'n_splits', CAST(count(DISTINCT split) AS DOUBLE), NULL, NULL FROM s UNION ALL
 SELECT 'min_len', CAST(min(n) AS DOUBLE), NULL, NULL FROM len UNION ALL
 SELECT 'median_len', quantile_cont(CAST(n AS DOUBLE), 0.5::DOUBLE), NULL, NULL FROM len UNION ALL
 SELECT 'max_len', CAST(max(n) AS DOUBLE), NULL, NULL FROM len UNION ALL
 SELECT 'coverage_label_purchase_1d', count(label_purchase_1d) / count(*), NULL, NULL FROM lab UNION ALL
 SELECT 'coverage_label_purchase_30d', count(label_purchase_30d) / count(*), NULL, NULL FROM lab)
SELECT *, (lo IS NULL OR value >= lo) AND (hi IS NULL OR value <= hi) AS passed FROM g""")
def quality_gates(spark, d):
    rows = split.assign_split(with_balance(spark, d), split.split_bounds(t.ledger(spark, d, "key")))
    daily = series.lead_labels(rollup.daily_flow(t.ledger(spark, d, ok_only=True)), ["product_id"], "date", {"purchase_amt": "label_purchase"}, (1, 7, 30))
    return quality.gates(rows, daily, ["label_purchase_1d", "label_purchase_30d"])


@register("invariants", f"""WITH {L}, g AS (SELECT 'n_rows' AS gate, CAST(count(*) AS DOUBLE) AS value, 10000.0::DOUBLE AS lo, NULL::DOUBLE AS hi FROM l UNION ALL
 SELECT 'n_products', CAST(count(DISTINCT product_id) AS DOUBLE), 2.0::DOUBLE, 2.0::DOUBLE FROM l)
SELECT *, value >= lo AND (hi IS NULL OR value <= hi) AS passed FROM g""")
def invariants(spark, d):
    return quality.invariants(t.ledger(spark, d))


@register("holding_order", f"""WITH r AS (SELECT p_type AS product_id, min(p_size) AS min_holding_days FROM part GROUP BY p_type), {L},
s AS (SELECT product_id, min_holding_days, avg(CASE WHEN direction = 1 THEN 1 ELSE 0 END) AS red_share FROM l JOIN r USING (product_id) GROUP BY ALL)
SELECT *, coalesce(lag(red_share) OVER (ORDER BY min_holding_days DESC, product_id) <= red_share, TRUE) AS passed FROM s""")
def holding_order(spark, d):
    hold = t.table(spark, d, "part").groupBy(F.col("p_type").alias("product_id")).agg(F.min("p_size").alias("min_holding_days"))
    return quality.holding_order(t.ledger(spark, d).join(hold, "product_id"))


@register("monotone_medians", f"""WITH {LG}, m AS (SELECT product_id, group_id, round(quantile_cont(CAST(amount AS DOUBLE), 0.5::DOUBLE), 6) AS amt_median FROM lg GROUP BY ALL)
SELECT *, coalesce(lag(amt_median) OVER (PARTITION BY product_id ORDER BY group_id) <= amt_median, TRUE) AS passed FROM m""")
def monotone_medians(spark, d):
    rows = rounded(p.group_summary(t.ledger(spark, d, group=True), ["product_id", "group_id"]), 6, "amt_median")
    return quality.monotone(rows.select("product_id", "group_id", "amt_median"), "group_id", "amt_median", ["product_id"])


@register("ks_distance", f"""WITH {L}, c AS (SELECT product_id, amount, count(*) FILTER (direction = 0) AS a, count(*) FILTER (direction = 1) AS b FROM l GROUP BY ALL),
k AS (SELECT product_id, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY product_id) AS na, sum(b) OVER (PARTITION BY product_id) AS nb
  FROM c WINDOW w AS (PARTITION BY product_id ORDER BY amount))
SELECT product_id, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b, round(max(abs(ca / na - cb / nb)), 9) AS ks,
  max(abs(ca / na - cb / nb)) < 0.05 AS passed FROM k GROUP BY product_id""")
def ks_distance(spark, d):
    return rounded(quality.ks_distance(t.ledger(spark, d), "direction", "amount", ["product_id"]), 9, "ks")


@register("corpus_health", f"""WITH {SERIES_BINS}, n AS (SELECT count(*) AS n FROM cb GROUP BY amount_bin)
SELECT count(*) AS n_bins, max(n) / sum(n) AS max_share, max(n) / avg(n) AS max_over_mean, max(n) / sum(n) < 0.5 AS passed FROM n""")
def corpus_health(spark, d):
    return quality.corpus_health(corpus.series_bins(corpus_days(spark, d)))
