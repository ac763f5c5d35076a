"""Registered queries: series operators, tokens and the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlytics.functions import tokens as tk
from flowlytics.functions import values as v
from flowlytics.operators import corpus, quantile as q, rollup, series, vocab
from flowlytics.plans.buckets import CORPUS_DAYS, SERIES_BINS, SPLIT_CASE, binned_group_days, bounds_sql, corpus_days
from flowlytics.plans.catalog import (
    E, FACT, L, LG, LK, TIE_COLUMNS, bin_of, fit_edges, log_amount, register, rounded, total,
)
from flowlytics.plans.flows import GROUP_DAILY, group_days
from flowlytics.sources import tables as t
from flowlytics.sources.stage import materialise

ORDER = ["txn_ts", *t.TIE]

# ---- row-level series -------------------------------------------------------------------------


@register("time_gap", f"""WITH {E} SELECT event_id, cust_id,
  CAST(least(greatest(coalesce(txn_ts - lag(txn_ts) OVER (PARTITION BY cust_id ORDER BY txn_ts, event_id), 0), 0), 2592000) AS INTEGER) AS dt_prev_sec FROM e""")
def time_gap(spark, d):
    return series.time_gap(t.event_ledger(spark, d), ["cust_id"], "txn_ts", ["event_id"]).select("event_id", "cust_id", "dt_prev_sec")


@register("customer_gap", f"""WITH {LG} SELECT cust_id, product_id, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
  CAST(least(greatest(coalesce(txn_ts - lag(txn_ts) OVER (PARTITION BY cust_id, product_id ORDER BY txn_ts, {TIE_COLUMNS}), 0), 0), 2592000) AS INTEGER) AS dt_prev_sec FROM lg""")
def customer_gap(spark, d):
    rows = t.ledger(spark, d, customer=True, tie=True).select("cust_id", "product_id", *ORDER)
    return series.time_gap(rows, ["cust_id", "product_id"], "txn_ts", t.TIE).select(
        "cust_id", "product_id", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "dt_prev_sec")


SIGNED = "CASE WHEN direction = 0 THEN amount ELSE -amount END"
SETTLED = "CASE WHEN status = 0 THEN 0 WHEN direction = 0 THEN amount ELSE -amount END"
ROW_KEYS = ["product_id", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
ROW_SQL = ", ".join(ROW_KEYS)


@register("running_balance", f"""WITH {LK} SELECT {ROW_SQL}, CAST(greatest(sum({SIGNED}) OVER
  (PARTITION BY product_id ORDER BY txn_ts, {TIE_COLUMNS} ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS aum_after FROM lk""")
def running_balance(spark, d):
    rows = series.running_balance(t.ledger(spark, d, "key", tie=True), ["product_id"], ORDER, series.signed_amount(), "clip")
    return rows.select(*ROW_KEYS, F.col("aum_after").cast("double").alias("aum_after"))


FLOORED = f"""s AS (SELECT *, sum({SETTLED}) OVER w AS s FROM lk WINDOW w AS (PARTITION BY product_id ORDER BY txn_ts, {TIE_COLUMNS} ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, s - least(0, min(s) OVER w) AS bal FROM s WINDOW w AS (PARTITION BY product_id ORDER BY txn_ts, {TIE_COLUMNS} ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, coalesce(lag(bal) OVER (PARTITION BY product_id ORDER BY txn_ts, {TIE_COLUMNS}), 0) AS before FROM f)"""


@register("floored_balance", f"WITH {LK}, {FLOORED} SELECT {ROW_SQL}, CAST(bal AS DOUBLE) AS aum_after FROM f")
def floored_balance(spark, d):
    rows = series.floored_balance(t.ledger(spark, d, "key", tie=True), ["product_id"], ORDER)
    return rows.select(*ROW_KEYS, F.col("aum_after").cast("double").alias("aum_after"))


@register("over_redemption", f"""WITH {LK}, {FLOORED} SELECT {ROW_SQL}, CAST(before AS DOUBLE) AS balance_before, CAST(bal AS DOUBLE) AS balance_after
FROM o WHERE direction = 1 AND status = 1 AND amount > before""")
def over_redemption(spark, d):
    rows = series.over_redemption(t.ledger(spark, d, "key", tie=True), ["product_id"], ORDER)
    return rows.select(*ROW_KEYS, *[F.col(c).cast("double").alias(c) for c in ("balance_before", "balance_after")])


@register("series_chunks", f"""WITH {L}, r AS (SELECT product_id, amount, (row_number() OVER (PARTITION BY product_id ORDER BY txn_ts, {TIE_COLUMNS}) - 1) // 1500 AS chunk, date FROM l)
SELECT product_id, chunk, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount, min(date) AS first_day, max(date) AS last_day FROM r GROUP BY product_id, chunk""")
def series_chunks(spark, d):
    return series.chunk(t.ledger(spark, d, tie=True), ["product_id"], ORDER).groupBy("product_id", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"),
        F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@register("sliding_chunks", f"""WITH {L}, r AS (SELECT product_id, amount, row_number() OVER (PARTITION BY product_id ORDER BY txn_ts, {TIE_COLUMNS}) - 1 AS i FROM l),
x AS (SELECT product_id, amount, unnest(range(greatest(CAST(floor((i - 1500) / 500) AS BIGINT) + 1, 0), i // 500 + 1)) AS chunk FROM r)
SELECT product_id, chunk, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM x GROUP BY product_id, chunk""")
def sliding_chunks(spark, d):
    return series.chunk(t.ledger(spark, d, tie=True), ["product_id"], ORDER, 1500, 500).groupBy("product_id", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


# ---- day-level series -------------------------------------------------------------------------

BINNED_DAYS = f"""{GROUP_DAILY}, {bounds_sql('gd', 0.7, 0.15, 1)}, sd AS (SELECT gd.*, {SPLIT_CASE} AS split FROM gd, bounds),
ned AS ({fit_edges("(SELECT * FROM sd WHERE split = 'train')", '', 'amount_log1p', 16)}),
bd AS (SELECT sd.*, {bin_of('amount_log1p', 'edges', -1, 1)} AS amount_bin FROM sd, ned)"""
FEATURES_SQL = ["direction", "amount_bin", "product_type", "risk_level", "dow", "dom", "is_month_end", "is_quarter_end", "n_txn", "yield_rate"]
SAMPLE_WINDOW = """WINDOW w AS (PARTITION BY split, product_id, group_id ORDER BY date),
  p AS (PARTITION BY split, product_id, group_id ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
  a AS (PARTITION BY split, product_id, group_id)"""
SAMPLE_LABELS = ", ".join(f"lead({k}, {h - 1}) OVER w AS {k}_h{h}" for k in ("purchase_log1p", "redemption_log1p") for h in (1, 7, 30))
SAMPLE_ROW = "row_number() OVER w - 1 AS t, count(*) OVER a AS len"
LABEL_NAMES = [f"{k}_h{h}" for k in ("purchase_log1p", "redemption_log1p") for h in (1, 7, 30)]


@register("history_windows", f"""WITH {BINNED_DAYS}, s AS (SELECT split, product_id, group_id, date, {SAMPLE_LABELS}, count(*) OVER p AS width,
  first_value(amount_bin) OVER p AS first_bin, last_value(amount_bin) OVER p AS last_bin, last_value(n_txn) OVER p AS last_n,
  sum(dow) OVER p AS dow_sum, {SAMPLE_ROW} FROM bd {SAMPLE_WINDOW})
SELECT split, product_id, group_id, date, {', '.join(LABEL_NAMES)}, CAST(width AS INTEGER) AS width, CAST(first_bin AS INTEGER) AS first_bin,
  CAST(last_bin AS INTEGER) AS last_bin, CAST(last_n AS INTEGER) AS last_n, CAST(dow_sum AS INTEGER) AS dow_sum FROM s WHERE t >= 30 AND t < len - 30""")
def history_windows(spark, d):
    """Samples within each split; the feature array is shown by a few of its entries."""
    rows = series.history_windows(binned_group_days(spark, d), ["split", "product_id", "group_id"], "date", FEATURES_SQL,
                                  ["purchase_log1p", "redemption_log1p"])
    f = F.col("features")
    return rows.select("split", "product_id", "group_id", "date", *LABEL_NAMES, F.size(f).alias("width"),
                       f[0][1].cast("int").alias("first_bin"), f[29][1].cast("int").alias("last_bin"), f[29][8].cast("int").alias("last_n"),
                       F.aggregate(f, F.lit(0), lambda a, x: a + x[4].cast("int")).alias("dow_sum"))


@register("corpus_windows", f"""WITH {SERIES_BINS}, s AS (SELECT product_id, group_id, direction, date, sum(amount_bin) OVER n AS bin_sum,
  last_value(amount_bin) OVER n AS last_bin, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY product_id, group_id, direction) AS len
  FROM cb WINDOW w AS (PARTITION BY product_id, group_id, direction ORDER BY date),
  n AS (PARTITION BY product_id, group_id, direction ORDER BY date ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))
SELECT product_id, group_id, direction, date, CAST(bin_sum AS INTEGER) AS bin_sum, CAST(last_bin AS INTEGER) AS last_bin FROM s WHERE t < len - 30""")
def corpus_windows(spark, d):
    rows = corpus.series_bins(corpus_days(spark, d))
    w = series.corpus_windows(rows, corpus.SERIES, "date", ["direction", "amount_bin", "product_type", "risk_level", "n_txn"])
    f = F.col("features")
    return w.select(*corpus.SERIES, "date", F.aggregate(f, F.lit(0), lambda a, x: a + x[1].cast("int")).alias("bin_sum"),
                    f[29][1].cast("int").alias("last_bin"))


@register("lag1_corr", f"""WITH {SERIES_BINS}, p AS (SELECT product_id, group_id, direction, amount_log1p AS x,
  lag(amount_log1p) OVER (PARTITION BY product_id, group_id, direction ORDER BY date) AS y FROM cb)
SELECT product_id, group_id, direction, count(y) AS n_pairs, round(corr(x, y), 6) AS lag1_corr FROM p GROUP BY product_id, group_id, direction""")
def lag1_corr(spark, d):
    rows = corpus.series_bins(corpus_days(spark, d))
    return rounded(series.lag1_corr(rows, corpus.SERIES, ["date"], "amount_log1p"), 6, "lag1_corr")


@register("dilated_lags", f"""WITH {GROUP_DAILY} SELECT product_id, group_id, date, ({' + '.join(
    f'0.25::DOUBLE * coalesce(lag(amount_log1p, {2 * k}) OVER w, 0) + 0.25::DOUBLE * coalesce(lag(amount_log1p, {k}) OVER w, 0) + 0.5::DOUBLE * amount_log1p'
    for k in (1, 2, 4))}) AS context FROM gd WINDOW w AS (PARTITION BY product_id, group_id ORDER BY date)""")
def dilated_lags(spark, d):
    rows = series.dilated_lags(group_days(spark, d), ["product_id", "group_id"], "date", "amount_log1p")
    return rows.select("product_id", "group_id", "date", "context")


@register("change_sign", f"""WITH {L}, f AS (SELECT product_id, date, {total(0)} AS purchase, {total(1)} AS redemption FROM l WHERE status = 1 GROUP BY ALL)
SELECT product_id, date, CAST(coalesce(sign(purchase - lag(purchase) OVER w), 0) AS INTEGER) AS purchase_sign,
  CAST(coalesce(sign(redemption - lag(redemption) OVER w), 0) AS INTEGER) AS redemption_sign FROM f WINDOW w AS (PARTITION BY product_id ORDER BY date)""")
def change_sign(spark, d):
    rows = series.change_sign(rollup.daily_flow(t.ledger(spark, d, ok_only=True)), ["product_id"], ["date"],
                              {"purchase_sign": "purchase_amt", "redemption_sign": "redemption_amt"})
    return rows.select("product_id", "date", "purchase_sign", "redemption_sign")


# ---- tokens -----------------------------------------------------------------------------------

TYPE_NAME = "(CASE product_type WHEN 0 THEN 'MM' WHEN 1 THEN 'BOND' WHEN 2 THEN 'EQUITY' WHEN 3 THEN 'MIX' WHEN 4 THEN 'FIXEDPLUS' WHEN 5 THEN 'OTHER' ELSE 'UNK' END)"
TOKENS = f"""tr AS (SELECT {FACT}, {TIE_COLUMNS}, CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_partkey % 7 AS INTEGER) AS product_type,
  CAST(l_suppkey % 5 + 1 AS INTEGER) AS risk_level FROM lineitem),
tx AS (SELECT *, {log_amount('amount')} AS amount_log1p FROM tr), ted AS ({fit_edges('tx', 'direction', 'amount_log1p', 16)}),
tk AS (SELECT tx.*, {bin_of('amount_log1p', 'edges')} AS amount_bin FROM tx JOIN ted ON tx.direction = ted.direction),
tok AS (SELECT *, (CASE direction WHEN 0 THEN 'PUR' ELSE 'RED' END) || '_A' || printf('%02d', amount_bin) || '_' || {TYPE_NAME} || '_R' || risk_level AS token FROM tk),
freq AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
ranked AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rank, sum(n) OVER (ORDER BY n DESC, token ROWS UNBOUNDED PRECEDING) AS cum,
  sum(n) OVER () AS total FROM freq)"""


def coded_rows(spark, d):
    """Ledger rows with amount bucket, type (seven codes, one of them unknown to the names) and risk."""
    rows = t.ledger(spark, d, "key", tie=True)
    rows = rows.withColumns({
        "product_type": (F.col("l_partkey") % 7).cast("int"), "risk_level": (F.col("l_suppkey") % 5 + 1).cast("int"),
        "amount_log1p": v.log_amount("amount")})
    edges = q.fit_adaptive_bins(rows, ["direction"], "amount_log1p", 16)
    return q.apply_bins(rows, edges, ["direction"], "amount_log1p", 16, codes=q.DIRECTIONS)


def token_rows(spark, d):
    token = tk.compose_token("direction", tk.bin_label(F.col("amount_bin")), "product_type", "risk_level")
    return coded_rows(spark, d).withColumn("token", token)


@register("token_frequency", f"WITH {TOKENS} SELECT token, n FROM freq")
def token_frequency(spark, d):
    return vocab.token_frequency(token_rows(spark, d))


@register("top_tokens", f"WITH {TOKENS} SELECT token, n FROM freq ORDER BY n DESC, token LIMIT 10")
def top_tokens(spark, d):
    return vocab.top_tokens(token_rows(spark, d), 10)


@register("topk_coverage", f"""WITH {TOKENS} SELECT count(*) AS n_tokens, CAST(max(total) AS BIGINT) AS n_rows,
  CAST(sum(n) FILTER (rank <= 500) AS BIGINT) AS covered, sum(n) FILTER (rank <= 500) / max(total) AS coverage FROM ranked""")
def topk_coverage(spark, d):
    return vocab.topk_coverage(token_rows(spark, d), 500)


@register("min_vocabulary", f"WITH {TOKENS} SELECT CAST(min(rank) AS INTEGER) AS min_k FROM ranked WHERE cum / total >= 0.95::DOUBLE")
def min_vocabulary(spark, d):
    return vocab.min_k(token_rows(spark, d))


@register("encoded_rows", f"""WITH {TOKENS} SELECT CAST(coalesce(rank, 0) AS INTEGER) AS token_id, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount
FROM tok LEFT JOIN (SELECT * FROM ranked WHERE rank <= 500) r ON tok.token = r.token GROUP BY 1""")
def encoded_rows(spark, d):
    """Vocabulary of the 500 most frequent tokens applied to all rows; id 0 is everything else."""
    rows = token_rows(spark, d)
    return vocab.encode(rows, vocab.build_vocab(rows, 500)).groupBy("token_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").cast("double").alias("amount"))


@register("packed_tokens", f"""WITH {TOKENS} SELECT CAST(((direction * 16 + greatest(least(amount_bin, 15), 0)) * 6 + least(product_type, 5)) * 5 + risk_level - 1 AS INTEGER) AS code,
  count(*) AS n FROM tk GROUP BY 1""")
def packed_tokens(spark, d):
    return coded_rows(spark, d).groupBy(tk.pack_token().alias("code")).agg(F.count(F.lit(1)).alias("n"))


CHANNEL = "(CASE cust_id % 5 WHEN 0 THEN 'APP' WHEN 1 THEN 'WEB' WHEN 2 THEN 'BR' WHEN 3 THEN '3RD' ELSE 'UNK' END)"


@register("wide_tokens", f"""WITH {E}, g AS (SELECT *, round(ln(1 + least(greatest(coalesce(txn_ts - lag(txn_ts) OVER (PARTITION BY cust_id ORDER BY txn_ts, event_id), 0), 0), 2592000)), 9) AS gap,
  {log_amount('amount')} AS amount_log1p, CAST(cust_id % 6 AS INTEGER) AS product_type, CAST(cust_id % 5 + 1 AS INTEGER) AS risk_level,
  CAST(CASE WHEN cust_id % 3 = 0 THEN 9 ELSE hour(ts) END AS DOUBLE) AS hour FROM e),
ed AS ({fit_edges('g', 'direction', 'amount_log1p', 16)}), gd AS ({fit_edges('g', '', 'gap', 8)}), hd AS ({fit_edges('g', '', 'hour', 8)}),
b AS (SELECT g.*, {bin_of('amount_log1p', 'ed.edges')} AS ab, {bin_of('gap', 'gd.edges')} AS gb, {bin_of('hour', 'hd.edges')} AS hb
  FROM g JOIN ed ON g.direction = ed.direction CROSS JOIN gd CROSS JOIN hd),
tok AS (SELECT (CASE direction WHEN 0 THEN 'PUR' ELSE 'RED' END) || '_A' || printf('%02d', ab) || '_' || {TYPE_NAME} || '_R' || risk_level
  || '_' || {CHANNEL} || '_D' || (isodow(date) - 1) || '_A' || printf('%02d', hb) || '_A' || printf('%02d', gb) AS token FROM b)
SELECT token, count(*) AS n FROM tok GROUP BY token""")
def wide_tokens(spark, d):
    """Eight-field tokens: amount, hour and gap by fitted quantiles, the channel from its code. Customers of the branch (every third)
    come at nine, so hours are spread unevenly and some edges fall together."""
    rows = series.time_gap(t.event_ledger(spark, d), ["cust_id"], "txn_ts", ["event_id"])
    rows = materialise(rows.withColumns({
        "gap": v.log_amount("dt_prev_sec"), "amount_log1p": v.log_amount("amount"),
        "product_type": (F.col("cust_id") % 6).cast("int"), "risk_level": (F.col("cust_id") % 5 + 1).cast("int"),
        "channel": (F.col("cust_id") % 5).cast("int"), "hour": F.when(F.col("cust_id") % 3 == 0, 9).otherwise(F.hour("ts")).cast("double")}))
    rows = q.apply_bins(rows, q.fit_adaptive_bins(rows, ["direction"], "amount_log1p", 16), ["direction"], "amount_log1p", 16, "ab", codes=q.DIRECTIONS)
    for value, out in (("gap", "gb"), ("hour", "hb")):
        rows = q.apply_bins(rows, q.fit_bins(rows, [], value, 8), [], value, 8, out)
    token = tk.compose_token("direction", tk.bin_label(F.col("ab")), "product_type", "risk_level")
    wide = tk.compose_wide_token(token, F.weekday("date"), tk.bin_label(F.col("hb")), tk.bin_label(F.col("gb")), F.col("channel"))
    return vocab.token_frequency(rows.select(wide.alias("token")))


NEXT = f"""{TOKENS}, np AS (SELECT product_id, direction, amount_bin, product_type, risk_level,
  lead(direction) OVER w AS next_direction, lead(amount_bin) OVER w AS next_amount_bin, lead(product_type) OVER w AS next_product_type,
  lead(risk_level) OVER w AS next_risk_level, lead(1) OVER w AS has_next FROM tk WINDOW w AS (PARTITION BY product_id ORDER BY txn_ts, {TIE_COLUMNS}))"""
FIELDS = {"direction": 2, "amount_bin": 16, "product_type": 7, "risk_level": 6}


def pairs(spark, d):
    return series.next_pairs(coded_rows(spark, d), ["product_id"], ORDER, list(FIELDS))


@register("next_pairs", f"""WITH {NEXT} SELECT direction, amount_bin, risk_level, next_direction, next_amount_bin, next_risk_level, count(*) AS n
FROM np WHERE has_next = 1 GROUP BY ALL""")
def next_pairs(spark, d):
    keys = ["direction", "amount_bin", "risk_level", "next_direction", "next_amount_bin", "next_risk_level"]
    return pairs(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@register("transitions", f"""WITH {NEXT}, c AS (SELECT amount_bin, next_amount_bin, count(*) AS n FROM np WHERE has_next = 1 GROUP BY ALL)
SELECT amount_bin, next_amount_bin, n, n / sum(n) OVER (PARTITION BY amount_bin) AS p FROM c""")
def transitions(spark, d):
    return vocab.transitions(pairs(spark, d), "amount_bin", "next_amount_bin")


def field_loss(f: str, states: int) -> str:
    return (f"SELECT '{f}' AS field, -sum(n * ln((n + 1) / (g + {states}::DOUBLE))) / sum(n) AS loss, {vocab.FIELD_WEIGHTS[f]}::DOUBLE AS weight FROM "
            f"(SELECT n, sum(n) OVER (PARTITION BY {f}) AS g FROM (SELECT {f}, next_{f}, count(*) AS n FROM np WHERE has_next = 1 GROUP BY ALL))")


@register("token_loss", f"""WITH {NEXT}, x AS ({' UNION ALL '.join(field_loss(f, n) for f, n in FIELDS.items())})
SELECT field, round(loss, 6) AS loss, weight FROM x UNION ALL SELECT 'total', round(sum(loss * weight), 6), round(sum(weight), 6) FROM x""")
def token_loss(spark, d):
    return rounded(vocab.cross_entropy(pairs(spark, d), FIELDS), 6, "loss", "weight")


@register("sampled_rows", f"""WITH {LK} SELECT product_id, l_orderkey, l_linenumber, l_suppkey FROM lk
ORDER BY md5('7:' || l_orderkey || ':' || l_linenumber || ':' || l_suppkey || ':' || product_id), l_orderkey, l_linenumber, l_suppkey, product_id LIMIT 100""")
def sampled_rows(spark, d):
    rows = t.ledger(spark, d, "key", tie=True).select("product_id", "l_orderkey", "l_linenumber", "l_suppkey")
    return vocab.sample_rows(rows, ["l_orderkey", "l_linenumber", "l_suppkey", "product_id"], 100, 7)


# ---- corpus -----------------------------------------------------------------------------------

@register("harmonised_corpus", f"""WITH {LG}, {E},
u AS (SELECT product_id, group_id, date, direction, CAST(amount AS DECIMAL(28,4)) AS amount, product_type, CAST(2 AS INTEGER) AS risk_level FROM lg
  UNION ALL SELECT product_id, 0, date, direction, amount, least(CAST(cust_id % 7 AS INTEGER), 5), least(greatest(CAST(cust_id % 7 AS INTEGER), 1), 5) FROM e),
cd AS (SELECT product_id, group_id, date, direction, CAST(sum(amount) AS DOUBLE) AS amount, min(product_type) AS product_type, min(risk_level) AS risk_level FROM u GROUP BY product_id, group_id, date, direction),
cx AS (SELECT *, {log_amount('amount')} AS amount_log1p FROM cd), ced AS ({fit_edges('cx', 'product_id, group_id, direction', 'amount_log1p', 16)})
SELECT product_id, group_id, date, direction, {bin_of('amount_log1p', '(CASE WHEN n >= 16 THEN edges END)', 0)} AS amount_bin, product_type, risk_level
FROM cx LEFT JOIN ced USING (product_id, group_id, direction)""")
def harmonised_corpus(spark, d):
    """The grouped ledger as client corpus, events without a group as market corpus."""
    client = corpus.from_client(t.ledger(spark, d, group=True).withColumnRenamed("direction", "txn_type"), t.table(spark, d, "part").select(
        F.col("p_type").alias("product_id"), t.position("p_type", t.PART_TYPES).alias("product_type"), F.lit(2).alias("risk_level")).distinct())
    market = corpus.from_market(t.event_ledger(spark, d).withColumns({
        "product_type": F.col("cust_id") % 7, "risk_level": F.col("cust_id") % 7}))
    return corpus.harmonise([client, market])
