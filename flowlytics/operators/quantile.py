"""Exact quantiles and quantile buckets without a per-group buffer.

The built-in exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer. Here equal values are counted first (partial aggregation before the
shuffle), the counts are dealt out by ranges of key and value, and the wanted ranks are
picked by running counts. Interpolation is linear between neighbouring ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlytics.operators.segments import same_keys, segmented

# The eleven profile probabilities and their names.
PROFILE_PROBS = [0, 0.01, 0.05, 0.10, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
PROFILE_NAMES = ["p00", "p01", "p05", "p10", "p25", "p50", "p75", "p90", "p95", "p99", "p100"]


# fixed values: codes of the direction (purchase, redemption, unknown)
DIRECTIONS = (-1, 0, 1)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float | str],
    *,
    weight: str | None = None,
    transforms: Mapping[str, str] | None = None,
    counts: tuple[str, str] = ("n", "n_distinct"),
    **cut,
) -> DataFrame:
    """One row per key: an array of quantiles per transform, and the row and distinct counts.

    A probability may be an SQL expression over ``_nd``, the distinct count of the key. ``weight`` is
    a column of row counts for input that is already grouped. ``transforms`` are SQL expressions with
    ``{}`` for the value; they must be non-decreasing, as ranks are found once on the raw value, and
    are applied before interpolating.
    """
    keys = list(keys)
    transforms = transforms or {"quantiles": "CAST({} AS DOUBLE)"}
    n_rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    grouped = (df.where(F.col(value).isNotNull())
               .groupBy(*keys, F.col(value).alias("_v")).agg(n_rows.alias("_c")))
    seg = segmented(grouped, keys, ["_v"], **cut)
    whole = seg.window(ordered=False)
    upto = seg.window()
    seg = seg.map(seg.rows.select(
        "*",
        F.sum("_c").over(upto.rowsBetween(W.unboundedPreceding, 0)).alias("_cum"),
        F.lead("_v").over(upto).alias("_next"),
        F.sum("_c").over(whole).alias("_n"),
        F.count("_c").over(whole).alias("_nd"),
    ))
    over = seg.carry_window()
    every = over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = over.rowsBetween(W.unboundedPreceding, -1)
    rows = seg.carry(
        {"_s": F.sum("_c"), "_d": F.count("_c"), "_first": F.min("_v")},
        {"_off": F.sum("_s").over(before), "_n_all": F.sum("_s").over(every),
         "_nd_all": F.sum("_d").over(every), "_next_seg": F.lead("_first").over(over)},
    ).rows
    rows = rows.select(
        *keys, "_v", "_c",
        (F.col("_cum") + F.coalesce("_off", F.lit(0))).alias("_cum"),
        F.coalesce("_next", "_next_seg", "_v").alias("_next"),
        F.coalesce("_n_all", "_n").alias("_n"),
        F.coalesce("_nd_all", "_nd").alias("_nd"),
    )

    picks = []
    for name, form in transforms.items():
        lower, upper = form.format("_v"), form.format("_next")
        for i, p in enumerate(probs):
            pos = f"(({p if isinstance(p, str) else repr(float(p)) + 'D'}) * (_n - 1))"
            rank = f"floor({pos})"
            picks.append(F.expr(
                f"max(CASE WHEN {rank} >= _cum - _c AND {rank} < _cum THEN "
                f"CASE WHEN {rank} + 1 < _cum OR {pos} = {rank} THEN {lower} "
                f"ELSE {lower} + ({upper} - {lower}) * ({pos} - {rank}) END END)").alias(f"_{name}_{i}"))
    out = rows.groupBy(*keys).agg(*picks, F.max("_n").alias(counts[0]), F.max("_nd").alias(counts[1]))
    return out.select(
        *keys,
        *[F.expr(f"array({', '.join(f'_{name}_{i}' for i in range(len(probs)))})").alias(name)
          for name in transforms],
        *counts,
    )


def quantile_map(quantiles: Column, names: Sequence[str] = PROFILE_NAMES) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), quantiles)


def bounded_quantiles(value: str, probs: Sequence[float], weight: str | None = None) -> Column:
    """Aggregate for groups whose number of distinct values is bounded by their domain
    (days of a calendar, counts per day); wider domains take ``exact_quantiles``."""
    return F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in probs]), F.lit(1) if weight is None else F.col(weight))


def fit_bins(df: DataFrame, by: Sequence[str], value: str, bins: int, *,
             min_rows: int = 0, digits: int | None = 9, **cut) -> DataFrame:
    """Bucket edges per key: quantiles at i/bins, duplicates dropped.

    Columns: keys, edges array<double>, n. A key with fewer than ``min_rows`` rows gets no edges.
    """
    fitted = exact_quantiles(df, by, value, [i / bins for i in range(bins + 1)], **cut)
    edges = F.col("quantiles")
    if digits is not None:
        edges = F.transform(edges, lambda e: F.round(e, digits))
    edges = F.array_distinct(edges)
    if min_rows:
        edges = F.when(F.col("n") >= min_rows, edges).otherwise(F.slice(edges, 1, 0))
    return fitted.select(*by, edges.alias("edges"), "n")


def fit_adaptive_bins(df: DataFrame, by: Sequence[str], value: str, bins: int, **cut) -> DataFrame:
    """As fit_bins, but never asks for more buckets than there are distinct values."""
    k = f"greatest(least(_nd, {bins}), 1)"
    probs = [f"CASE WHEN {i} <= {k} THEN {i} / CAST({k} AS DOUBLE) END" for i in range(bins + 1)]
    fitted = exact_quantiles(df, by, value, probs, **cut)
    edges = F.filter(F.transform("quantiles", lambda e: F.round(e, 9)), lambda e: e.isNotNull())
    return fitted.select(*by, F.array_distinct(edges).alias("edges"), "n")


def bin_of(value: str, edges: str, bins: int, missing: int = -1, offset: int = 0) -> Column:
    """Right-closed bucket number; the lowest edge belongs to the first bucket.

    The edges below the value are counted by one filter. A comparison per edge would make generated methods so long that the
    JVM doesn't compile them and interprets each row.
    """
    below = f"size(filter(slice({edges}, 1, {bins + 1}), edge_ -> edge_ < {value}))"
    outside = (f"{edges} IS NULL OR {value} IS NULL OR size({edges}) < 2 OR {value} < get({edges}, 0) "
               f"OR {value} > get({edges}, size({edges}) - 1)")
    return F.expr(f"CASE WHEN {outside} THEN {missing} ELSE greatest({below} - 1, 0) END + {offset}")


def apply_bins(df: DataFrame, edges: DataFrame, by: Sequence[str], value: str, bins: int,
               out: str = "amount_bin", *, missing: int = -1, offset: int = 0,
               codes: Sequence[int] | None = None) -> DataFrame:
    """Adds the bucket number of ``value``.

    ``codes`` lists the values of the one key, where it is a fixed code such as the direction: the
    edges of these and of null, one row each, are broadcast, and any other value has no bucket.
    Otherwise the join is left to the size check of the optimizer and to AQE.
    """
    table = edges.select(*by, F.col("edges").alias("_edges"))
    if by:
        if codes is not None:
            (key,) = by
            table = F.broadcast(table.where(F.col(key).isin(*codes) | F.col(key).isNull()))
        joined = same_keys(df, table, by, "left")
    else:
        joined = df.withColumn("_edges", table.select("_edges").scalar())
    number = bin_of(value, "_edges", bins, missing, offset)
    return joined.withColumn(out, number).drop("_edges")
