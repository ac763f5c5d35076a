"""Registered queries: sketches stored per day, combined to periods, beside the exact figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlytics.operators import quantile as q, sketches as sk
from flowlytics.plans.catalog import L, LG, LK, at, register
from flowlytics.plans.sequences import TOKENS, token_rows
from flowlytics.sources import tables as t
from flowlytics.sources.stage import materialise

PROBS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
PROBS_LIST = "[" + ", ".join(f"{p}::DOUBLE" for p in PROBS) + "]"


@register("sketched_quantiles", f"""WITH {L}, g AS (SELECT product_id, year(date) AS year, count(*) AS n, quantile_cont(CAST(amount AS DOUBLE), {PROBS_LIST}) AS q FROM l GROUP BY ALL)
SELECT product_id, CAST(year AS INTEGER) AS year, n, unnest({PROBS_LIST}) AS prob, round(unnest(q), 6) AS exact, TRUE AS close FROM g""")
def sketched_quantiles(spark, d):
    """Yearly quantiles per product from stored daily sketches; ``close``: the exact rank of the sketched value is off by less than 1 %."""
    rows = t.ledger(spark, d).withColumn("year", F.year("date"))
    keys = ["product_id", "year"]
    daily = materialise(sk.quantile_sketches(rows, [*keys, "date"], "amount"))
    yearly = materialise(sk.sketch_quantiles(sk.merged_quantile_sketches(daily, keys), keys, PROBS))
    errors = sk.rank_errors(rows, yearly, keys, "amount", PROBS)
    exact = q.exact_quantiles(rows, keys, "amount", PROBS)
    entries = F.array(*[F.struct(F.lit(p).alias("prob"), F.round(at("quantiles", i), 6).alias("exact")) for i, p in enumerate(PROBS)])
    whole = exact.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    return errors.join(whole, [*keys, "prob"]).select(*keys, "n", "prob", "exact", (F.col("rank_error") < 0.01).alias("close"))


MONTHS = "strftime(date, '%Y-%m')"


@register("sketched_customers", f"""WITH {LG}, m AS (SELECT {MONTHS} AS month, cust_id, bool_or(direction = 0) AS buys, bool_or(direction = 1) AS sells FROM lg WHERE cust_id IS NOT NULL GROUP BY ALL),
nx AS (SELECT a.month, count(*) AS n_again FROM m a JOIN m b ON a.cust_id = b.cust_id AND b.month = strftime(CAST(a.month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') GROUP BY a.month)
SELECT m.month, count(*) AS n_customers, count(*) FILTER (buys AND sells) AS n_both, coalesce(max(n_again), 0) AS n_again, TRUE AS close FROM m LEFT JOIN nx USING (month) GROUP BY m.month""")
def sketched_customers(spark, d):
    """Customers per month, of both directions, and again in the next month: exact, and from theta sketches per day and direction
    (union for the month, intersections for the others); ``close``: all within 5 %, or 3 customers."""
    rows = t.ledger(spark, d, group=True).where("cust_id IS NOT NULL").withColumn("month", F.date_format("date", "yyyy-MM"))
    daily = materialise(sk.distinct_sketches(rows, ["month", "date", "direction"], "cust_id"))
    sides = sk.merged_distinct_sketches(daily, ["month", "direction"]).groupBy("month").agg(
        *[F.max(F.when(F.col("direction") == i, F.col("sketch"))).alias(n) for i, n in enumerate(("buys", "sells"))])
    whole = sk.merged_distinct_sketches(daily, ["month"])
    later = whole.select(F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), -1), "yyyy-MM").alias("month"), F.col("sketch").alias("next"))
    guess = whole.join(sides, "month").join(later, "month", "left").select(
        "month", sk.distinct_estimate("sketch").alias("g_customers"),
        F.coalesce(sk.common_estimate("buys", "sells"), F.lit(0)).alias("g_both"), F.coalesce(sk.common_estimate("sketch", "next"), F.lit(0)).alias("g_again"))
    seen = materialise(rows.groupBy("month", "cust_id").agg(F.bool_or(F.col("direction") == 0).alias("buys"), F.bool_or(F.col("direction") == 1).alias("sells")))
    again = seen.select(F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), -1), "yyyy-MM").alias("month"), "cust_id").join(
        seen, ["month", "cust_id"]).groupBy("month").agg(F.count(F.lit(1)).alias("n_again"))
    exact = seen.groupBy("month").agg(F.count(F.lit(1)).alias("n_customers"), F.count_if(F.col("buys") & F.col("sells")).alias("n_both")).join(
        again, "month", "left").withColumn("n_again", F.coalesce("n_again", F.lit(0)))
    names = ("customers", "both", "again")
    close = [F.abs(F.col(f"n_{n}") - F.col(f"g_{n}")) <= F.greatest(F.col(f"n_{n}") * 0.05, F.lit(3)) for n in names]
    return exact.join(guess, "month").select("month", *[f"n_{n}" for n in names], (close[0] & close[1] & close[2]).alias("close"))


@register("heavy_tokens", f"WITH {TOKENS} SELECT token, n FROM freq ORDER BY n DESC, token LIMIT 10")
def heavy_tokens(spark, d):
    """The most frequent behaviour tokens from item counters, recounted exactly; equals top_tokens."""
    return sk.heavy_hitters(materialise(token_rows(spark, d).select("token")), "token", 10)


@register("heavy_products", f"WITH {LK} SELECT product_id, count(*) AS n FROM lk GROUP BY product_id ORDER BY n DESC, product_id LIMIT 25")
def heavy_products(spark, d):
    """The products with the most transactions, counters kept per day."""
    return sk.heavy_hitters(t.ledger(spark, d, "key").select("product_id", "date"), "product_id", 25, by=["date"])
