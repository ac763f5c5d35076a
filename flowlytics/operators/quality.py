"""Data-quality gates as rows: gate, value, lo, hi, passed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlytics.functions import values as v
from flowlytics.operators.profile import bin_balance, series_lengths
from flowlytics.operators.segments import segmented
from flowlytics.operators.series import shifted

# Accepted range per gate.
LIMITS = {"fail_rate": (0.01, 0.50), "redemption_share": (0.20, 0.80), "min_balance": (0.0, None)}
STRICT_LIMITS = {**LIMITS, "fail_rate": (0.01, 0.10)}


def _gate_rows(one: DataFrame, limits: Mapping[str, tuple]) -> DataFrame:
    """One row of measures to one row per gate; a missing bound does not restrict."""
    names = list(one.columns)
    value = F.col("value")

    def bound(i: int) -> Column:
        picked = F.lit(None).cast("double")
        for n in names:
            limit = limits.get(n, (None, None))[i]
            if limit is not None:
                picked = F.when(F.col("gate") == n, F.lit(float(limit))).otherwise(picked)
        return picked

    rows = one.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "gate", "value")
    rows = rows.select("gate", "value", bound(0).alias("lo"), bound(1).alias("hi"))
    ok = (F.col("lo").isNull() | (value >= F.col("lo"))) & (F.col("hi").isNull() | (value <= F.col("hi")))
    return rows.withColumn("passed", F.coalesce(ok, F.lit(False)))


def gates(ledger: DataFrame, daily: DataFrame | None = None, labels: Sequence[str] = (),
          limits: Mapping[str, tuple] = LIMITS, balance: str | None = "aum_after", **cut) -> DataFrame:
    """Failure rate, redemption share, lowest balance, series lengths, label coverage."""
    facts = [v.share(F.col("status") == 0).alias("fail_rate"),
             v.share(F.col("direction") == 1).alias("redemption_share")]
    if balance:
        facts.append(F.min(balance).cast("double").alias("min_balance"))
    if "split" in ledger.columns:
        facts.append(F.count_distinct("split").alias("n_splits"))
    rows = _gate_rows(ledger.agg(*facts), limits)
    lengths = series_lengths(ledger, **cut).select("min_len", "median_len", "max_len")
    rows = rows.unionByName(_gate_rows(lengths, limits))
    if daily is not None and labels:
        cover = daily.agg(*[(F.count(c) / F.count(F.lit(1))).alias(f"coverage_{c}") for c in labels])
        rows = rows.unionByName(_gate_rows(cover, limits))
    return rows


def bin_rows(edges: DataFrame, bins: int, codes: Sequence[int], by: str = "direction", per_bin: int = 2) -> DataFrame:
    """Whether each code had enough rows for its buckets, ``per_bin`` each; ``edges`` come from fit_bins (codes without rows have none)."""
    counts = edges.agg(*[F.coalesce(F.max(F.when(F.col(by) == c, F.col("n"))), F.lit(0)).alias(f"bin_rows_{c}") for c in codes])
    return _gate_rows(counts, {f"bin_rows_{c}": (per_bin * bins, None) for c in codes})


def invariants(df: DataFrame, min_rows: int = 10_000, n_products: int = 2) -> DataFrame:
    """Enough rows, and exactly the expected number of products."""
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("product_id").alias("n_products"))
    return _gate_rows(one, {"n_rows": (min_rows, None), "n_products": (n_products, n_products)})


def holding_order(df: DataFrame, holding: str = "min_holding_days") -> DataFrame:
    """Redemption share per product ordered by holding period, longest first; a longer period should
    not redeem more than the next shorter one."""
    per = df.groupBy("product_id", holding).agg(v.share(F.col("direction") == 1).alias("red_share"))
    before = shifted(per.withColumn("_h", -F.col(holding)), [], ["_h", "product_id"], {"_before": "red_share"}, -1)
    return before.withColumn("passed", F.coalesce(F.col("_before") <= F.col("red_share"), F.lit(True))).drop("_h", "_before")


def monotone(groups: DataFrame, order: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Flags group rows whose value is below that of the group before it."""
    before = shifted(groups, keys, [order], {"_before": value}, -1)
    return before.withColumn("passed", F.coalesce(F.col("_before") <= F.col(value), F.lit(True))).drop("_before")


def ks_distance(df: DataFrame, sample: str, value: str, keys: Sequence[str] = (), limit: float = 0.05,
                **cut) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per key; ``sample`` is 0 or 1.

    Rows are counted per value first; the running counts then go over segments of the value order.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count_if(F.col(sample) == 0).alias("_a"), F.count_if(F.col(sample) == 1).alias("_b"))
    seg = segmented(counted, keys, ["_v"], **cut)
    upto = seg.window().rowsBetween(W.unboundedPreceding, 0)
    whole = seg.window(ordered=False)
    seg = seg.map(seg.rows.select(
        "*", F.sum("_a").over(upto).alias("_ca"), F.sum("_b").over(upto).alias("_cb"),
        F.sum("_a").over(whole).alias("_na"), F.sum("_b").over(whole).alias("_nb")))
    before = seg.carry_window().rowsBetween(W.unboundedPreceding, -1)
    every = seg.carry_window().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = seg.carry({"_sa": F.sum("_a"), "_sb": F.sum("_b")}, {
        "_oa": F.sum("_sa").over(before), "_ob": F.sum("_sb").over(before),
        "_ta": F.sum("_sa").over(every), "_tb": F.sum("_sb").over(every)}).rows
    zero = F.lit(0)
    n_a, n_b = F.coalesce("_ta", "_na"), F.coalesce("_tb", "_nb")
    gap = F.abs(F.try_divide(F.col("_ca") + F.coalesce("_oa", zero), n_a)
                - F.try_divide(F.col("_cb") + F.coalesce("_ob", zero), n_b))
    out = rows.select(*keys, gap.alias("_g"), n_a.alias("n_a"), n_b.alias("n_b")).groupBy(*keys).agg(
        F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max("_g").alias("ks"))
    return out.withColumn("passed", F.coalesce(F.col("ks") < limit, F.lit(False)))


def corpus_health(corpus: DataFrame, column: str = "amount_bin", limit: float = 0.5) -> DataFrame:
    """Largest bucket share, and whether it stays below the limit."""
    return bin_balance(corpus, column).agg(
        F.count(F.lit(1)).alias("n_bins"), F.max("share").alias("max_share"),
        (F.max("n") / F.avg("n")).alias("max_over_mean"),
    ).withColumn("passed", F.col("max_share") < limit)
