"""Mergeable summaries: stored once per day and combined for any period, without another pass over the rows.

KLL sketches answer quantiles and ranks, theta sketches distinct counts of unions and intersections, item counters the
most frequent values. All are partial aggregates of a fixed size, so a hot key costs a row per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlytics.operators.segments import same_keys
from flowlytics.sources.stage import materialise

KLL_K = 400  # rank error about 0.7 % of the rows
THETA_BITS = 14  # 16,384 hashed values: exact up to there, then a standard error of 0.8 %
COUNTERS = 1024
MOST_COUNTERS = 1 << 16  # Spark takes a million at most; beyond this, counting all values is the cheaper way
ERROR_SHARE = 3.5  # an item counter of m slots is off by at most this share of rows / m (fixed by the sketch)


# ---- quantiles ----------------------------------------------------------------------------------

def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = KLL_K) -> DataFrame:
    """One KLL sketch per key (e.g. product and day): columns keys, sketch, n. Null values are left out."""
    present = df.where(F.col(value).isNotNull())
    return present.groupBy(*keys).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged_quantile_sketches(sketches: DataFrame, keys: Sequence[str], k: int = KLL_K) -> DataFrame:
    """Stored sketches combined to coarser keys."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Keys, n and an array of the quantiles at ``probs``."""
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    return sketches.select(*keys, "n", F.kll_sketch_get_quantile_double("sketch", wanted).alias("quantiles"))


def rank_errors(df: DataFrame, quantiles: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Per key and prob: the sketched quantile and how far its exact rank in ``df`` lies from the prob.

    A value takes all ranks from the share of rows below it to the share of rows up to it.
    """
    each = quantiles.select(*keys, F.col("quantiles").alias("_q"))
    rows = same_keys(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), each, keys, "inner")
    counts = []
    for i in range(len(probs)):
        q = F.get("_q", F.lit(i))
        counts += [F.count_if(F.col("_v") < q).alias(f"_b{i}"), F.count_if(F.col("_v") <= q).alias(f"_u{i}"), F.first(q).alias(f"_q{i}")]
    total = rows.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("n"))
    entries = []
    for i, p in enumerate(probs):
        below, upto = F.col(f"_b{i}") / F.col("n"), F.col(f"_u{i}") / F.col("n")
        error = F.greatest(below - p, F.lit(p) - upto, F.lit(0.0))
        entries.append(F.struct(F.lit(float(p)).alias("prob"), F.col(f"_q{i}").alias("value"), error.alias("rank_error")))
    return total.select(*keys, "n", F.explode(F.array(*entries)).alias("e")).select(*keys, "n", "e.*")


# ---- distinct values ----------------------------------------------------------------------------

def distinct_sketches(df: DataFrame, keys: Sequence[str], value: str, bits: int = THETA_BITS) -> DataFrame:
    """One theta sketch of the values per key: columns keys, sketch."""
    return df.groupBy(*keys).agg(F.theta_sketch_agg(value, F.lit(bits)).alias("sketch"))


def merged_distinct_sketches(sketches: DataFrame, keys: Sequence[str], bits: int = THETA_BITS) -> DataFrame:
    """Union of the sketches of each coarser key."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg("sketch", F.lit(bits)).alias("sketch"))


def distinct_estimate(sketch: str | Column) -> Column:
    return F.theta_sketch_estimate(sketch)


def common_estimate(left: str | Column, right: str | Column) -> Column:
    """Number of values that both sketches hold."""
    return F.theta_sketch_estimate(F.theta_intersection(left, right))


# ---- most frequent values -----------------------------------------------------------------------

def _counter(df: DataFrame, value: str, by: Sequence[str], counters: int) -> DataFrame:
    state = F.expr(f"approx_top_k_accumulate(`{value}`, {counters})").alias("state")
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(state, F.count(F.lit(1)).alias("n"))


def heavy_hitters(df: DataFrame, value: str, k: int, by: Sequence[str] = (), counters: int = COUNTERS) -> DataFrame:
    """The ``k`` most frequent values with their exact counts (value, n), as sorting all counts would give them.

    Item counters are filled per ``by`` (e.g. a day, to be stored) and combined; their candidates are then counted exactly, so
    only candidates pass a shuffle. A value that is no candidate occurs at most 3.5 n / slots times; if the k-th candidate occurs
    more often, the list is proved complete. Otherwise counters grow to the number that would prove it for the k-th candidate
    found, which the true k-th value is not below. Where that takes more than MOST_COUNTERS (fewer than k frequent values, say,
    or many values that are equally frequent), all values are counted. Runs a job for each step; null values are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(value, *[c for c in by if c != value])
    while counters <= MOST_COUNTERS:
        parts = _counter(rows, value, by, counters)
        whole = materialise(parts.agg(F.expr(f"approx_top_k_combine(state, {counters})").alias("state"), F.sum("n").alias("n")))
        found = whole.select(F.explode(F.expr(f"approx_top_k_estimate(state, {counters})")).alias("e")).select(F.col("e.item").alias(value))
        exact = materialise(rows.join(F.broadcast(found), value, "left_semi").groupBy(value).agg(F.count(F.lit(1)).alias("n")))
        total = whole.first()["n"] or 0
        kth = exact.orderBy(F.col("n").desc(), value).limit(k).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).first()
        complete = total == (exact.agg(F.sum("n")).first()[0] or 0)  # every row is one of a candidate
        if complete or (kth["rows"] == k and kth["least"] > ERROR_SHARE * total / _slots(counters)):
            return exact.orderBy(F.col("n").desc(), value).limit(k)
        least = kth["least"] if kth["rows"] == k else 1
        counters *= 4
        while counters <= MOST_COUNTERS and least <= ERROR_SHARE * total / _slots(counters):
            counters *= 4
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), value).limit(k)


def _slots(counters: int) -> int:
    """The sketch keeps a power of two, three quarters full."""
    return 1 << (counters * 4 // 3 - 1).bit_length()
