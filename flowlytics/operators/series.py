"""Series operators.

Row-level series (transactions of a product or a customer) can be arbitrarily long, so they run
on ordered segments with carries; ``seg`` takes segments that another operator already made of the
same rows (``df`` then holds their ``_seg``, and so does the result). Day-level series come out of a roll-up and are bounded by the
number of calendar days; they use plain windows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlytics.functions import values as v
from flowlytics.operators.segments import Segmented, segmented


# ---- row-level series -------------------------------------------------------------------------

def shifted(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str],
            step: int = -1, seg: Segmented | None = None, **cut) -> DataFrame:
    """Adds, per output name, the source column of the previous (-1) or next (+1) row of the series."""
    seg = seg.map(df) if seg else segmented(df, keys, order, **cut)
    value = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    point = F.struct(*order)
    w, over = seg.window(), seg.carry_window()
    near, edge, beyond = ((F.lag, F.max_by, F.lag) if step < 0 else (F.lead, F.min_by, F.lead))
    seg = seg.map(seg.rows.withColumn("_x", near(value).over(w)))
    rows = seg.carry({"_e": edge(value, point)}, {"_c": beyond("_e").over(over)}).rows
    return rows.withColumn("_x", F.coalesce("_x", "_c")).select(
        *[F.col(c) for c in df.columns], *[F.col(f"_x.{n}").alias(n) for n in columns])


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "idx",
              seg: Segmented | None = None, **cut) -> DataFrame:
    """Position 0, 1, ... of each row within its series."""
    seg = seg.map(df) if seg else segmented(df, keys, order, **cut)
    seg = seg.map(seg.rows.withColumn("_rn", F.row_number().over(seg.window())))
    before = seg.carry_window().rowsBetween(W.unboundedPreceding, -1)
    rows = seg.carry({"_s": F.count(F.lit(1))}, {"_off": F.sum("_s").over(before)}).rows
    return rows.select(*df.columns, (F.col("_rn") - 1 + F.coalesce("_off", F.lit(0))).cast("bigint").alias(out))


def time_gap(df: DataFrame, keys: Sequence[str], seconds: str, tie: Sequence[str] = (),
             out: str = "dt_prev_sec", limit: int = v.MAX_GAP_SECONDS, **cut) -> DataFrame:
    """Seconds since the previous transaction of the series; 0 for the first, at most ``limit``."""
    rows = shifted(df, keys, [seconds, *tie], {"_prev": seconds}, -1, **cut)
    gap = F.coalesce(F.col(seconds) - F.col("_prev"), F.lit(0))
    return rows.withColumn(out, v.winsorise(gap, 0, limit).cast("int")).drop("_prev")


def signed_amount(amount: str = "amount", direction: str = "direction") -> Column:
    return F.when(F.col(direction) == 0, F.col(amount)).otherwise(-F.col(amount))


def running_balance(df: DataFrame, keys: Sequence[str], order: Sequence[str], change: Column,
                    floor: str | None = None, out: str = "aum_after", prior: str | None = None,
                    seg: Segmented | None = None, **cut) -> DataFrame:
    """Balance after each row.

    floor=None: the plain running sum. 'clip': the running sum, shown as 0 where negative.
    'reflect': the balance itself never goes below 0, later rows build on that; by the closed form
    sum - min(0, lowest sum so far). ``prior`` adds the balance before the row.
    """
    seg = seg.map(df) if seg else segmented(df, keys, order, **cut)
    seg = seg.map(seg.rows.withColumn("_chg", change))
    w = seg.window()
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = seg.rows.withColumn("_s", F.sum("_chg").over(upto))
    if floor == "reflect":
        rows = rows.withColumns({
            "_m": F.min("_s").over(upto),
            "_m0": F.min("_s").over(w.rowsBetween(W.unboundedPreceding, -1)),
        })
    before = seg.carry_window().rowsBetween(W.unboundedPreceding, -1)
    summary, carried = {"_t": F.sum("_chg")}, [{"_off": F.sum("_t").over(before)}]
    if floor == "reflect":
        summary["_low"] = F.min("_s")
        carried.append({"_floor": F.min(F.col("_low") + F.coalesce(F.col("_off"), F.lit(0))).over(before)})
    rows = seg.map(rows).carry(summary, *carried).rows
    off = F.coalesce(F.col("_off"), F.lit(0))
    total = F.col("_s") + off
    previous = total - F.coalesce(F.col("_chg"), F.lit(0))
    zero = F.lit(0)
    if floor == "clip":
        after, ahead = F.greatest(total, zero), F.greatest(previous, zero)
    elif floor == "reflect":
        after = total - F.least(zero, F.col("_m") + off, F.col("_floor"))
        ahead = previous - F.least(zero, F.col("_m0") + off, F.col("_floor"))
    else:
        after, ahead = total, previous
    extra = [ahead.alias(prior)] if prior else []
    kept = [c for c in df.columns if c not in (out, prior)]
    return rows.select(*kept, after.alias(out), *extra)


def settled_change() -> Column:
    """Signed amount of successful rows; failed rows leave the balance alone."""
    return F.when(F.col("status") == 1, signed_amount()).otherwise(F.col("amount") * 0)


def floored_balance(df: DataFrame, keys: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    return running_balance(df, keys, order, settled_change(), "reflect", **kw)


def over_redemption(df: DataFrame, keys: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    """Successful redemptions larger than the balance they met."""
    rows = floored_balance(df, keys, order, out="balance_after", prior="balance_before", **kw)
    return rows.where((F.col("direction") == 1) & (F.col("status") == 1)
                      & (F.col("amount") > F.col("balance_before")))


def chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 1500,
          stride: int | None = None, **cut) -> DataFrame:
    """Adds the chunk number of each row; a stride below ``size`` makes overlapping chunks
    (a row then appears once per chunk that holds it)."""
    rows = row_index(df, keys, order, "_i", **cut)
    step = stride or size
    last = F.floor(F.col("_i") / step)
    if step >= size:
        return rows.withColumn("chunk", last.cast("bigint")).drop("_i")
    first = F.greatest(F.floor((F.col("_i") - size) / step) + 1, F.lit(0))
    return rows.withColumn("chunk", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))).drop("_i")


def packed(chunks: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """One row per chunk with its values in order (a chunk never exceeds its size)."""
    entry = F.struct(*order, F.col(value).alias("_value"))
    return chunks.groupBy(*keys, "chunk").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_value"]).alias(value))


def next_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
               prefix: str = "next_", **cut) -> DataFrame:
    """Each position with the values of the following one; the last position of a series has none."""
    rows = shifted(df.withColumn("_here", F.lit(1)), keys, order,
                   {**{prefix + c: c for c in columns}, "_there": "_here"}, 1, **cut)
    return rows.where("_there = 1").drop("_here", "_there")


def lag1_corr(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, **cut) -> DataFrame:
    """Correlation of a series with itself one step earlier."""
    rows = shifted(df, keys, order, {"_before": value}, -1, **cut)
    return rows.groupBy(*keys).agg(
        F.count("_before").alias("n_pairs"), F.corr(value, "_before").alias("lag1_corr"))


def change_sign(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str],
                **cut) -> DataFrame:
    """Per output name: sign of the change of the source column against the row before, first 0."""
    rows = shifted(df, keys, order, {f"_b_{n}": c for n, c in columns.items()}, -1, **cut)
    signs = {n: F.coalesce(F.signum(F.col(c) - F.col(f"_b_{n}")), F.lit(0.0)).cast("int")
             for n, c in columns.items()}
    return rows.withColumns(signs).drop(*[f"_b_{n}" for n in columns])


# ---- day-level series -------------------------------------------------------------------------

def lagged_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int, out: str) -> DataFrame:
    """Mean of the n rows before this one; 0 until there are n of them."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    full = F.count(value).over(w) == n
    return df.withColumn(out, F.when(full, F.avg(value).over(w)).otherwise(F.lit(0.0)))


def lead_labels(df: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, str],
                horizons: Sequence[int], calendar: bool = False, within: str | None = None) -> DataFrame:
    """Labels ``prefix_{h}d`` = the value h rows ahead (active days).

    calendar=True takes the row exactly h calendar days ahead instead. ``within`` names a column
    (a split) that the label row must share, else the label is null.
    """
    if calendar:
        day = F.unix_date(F.col(order))
        w = W.partitionBy(*keys).orderBy(day)

        def at(c: str, h: int) -> Column:
            return F.max(c).over(w.rangeBetween(h, h))
    else:
        w = W.partitionBy(*keys).orderBy(order)

        def at(c: str, h: int) -> Column:
            return F.lead(c, h).over(w)

    def label(c: str, h: int) -> Column:
        if within is None:
            return at(c, h)
        return F.when(at(within, h) == F.col(within), at(c, h))

    return df.select("*", *[label(c, h).alias(f"{prefix}_{h}d")
                            for c, prefix in columns.items() for h in horizons])


def history_windows(df: DataFrame, keys: Sequence[str], order: str, features: Sequence[str],
                    labels: Sequence[str], hist_len: int = 30, horizons: Sequence[int] = (1, 7, 30),
                    extra: Mapping[str, Column] | None = None, use_last: bool = False) -> DataFrame:
    """One sample per row t: features of the hist_len rows before t, labels at t, t+6, t+29.

    The row itself is never in its window. By default the last row of a series is not used as a
    label; ``use_last`` lifts that. ``extra`` are expressions over the named window ``history``
    given as functions of that window.
    """
    series = W.partitionBy(*keys)
    w = series.orderBy(order)
    past = w.rowsBetween(-hist_len, -1)
    reach = max(horizons) - (1 if use_last else 0)
    numbers = F.array(*[F.col(c).cast("float") for c in features])
    rows = df.select(
        *keys, order,
        F.collect_list(numbers).over(past).alias("features"),
        *[F.lead(c, h - 1).over(w).alias(f"{c}_h{h}") for c in labels for h in horizons],
        *[make(past).alias(n) for n, make in (extra or {}).items()],
        (F.row_number().over(w) - 1).alias("_t"),
        F.count(F.lit(1)).over(series).alias("_len"),
    )
    return rows.where((F.col("_t") >= hist_len) & (F.col("_t") < F.col("_len") - reach)).drop("_t", "_len")


def corpus_windows(df: DataFrame, keys: Sequence[str], order: str, features: Sequence[str],
                   hist_len: int = 30) -> DataFrame:
    """Every run of hist_len rows with at least one row after it, stride 1; absent features are 0."""
    series = W.partitionBy(*keys)
    w = series.orderBy(order)
    numbers = F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) if c in df.columns
                        else F.lit(0.0).cast("float") for c in features])
    rows = df.select(
        *keys, order,
        F.collect_list(numbers).over(w.rowsBetween(0, hist_len - 1)).alias("features"),
        (F.row_number().over(w) - 1).alias("_t"),
        F.count(F.lit(1)).over(series).alias("_len"),
    )
    return rows.where(F.col("_t") < F.col("_len") - hist_len).drop("_t", "_len")


def dilated_lags(df: DataFrame, keys: Sequence[str], order: str, value: str,
                 weights: Sequence[float] = (0.25, 0.25, 0.5), dilations: Sequence[int] = (1, 2, 4),
                 out: str = "context") -> DataFrame:
    """Causal multi-scale smoothing: per dilation d the weighted sum of x[t-2d], x[t-d], x[t]
    (zero before the start), summed over the dilations."""
    w = W.partitionBy(*keys).orderBy(order)
    kernel = len(weights)
    total = None
    for d in dilations:
        for j, weight in enumerate(weights):
            back = d * (kernel - 1 - j)
            x = F.lag(F.col(value).cast("double"), back, 0.0).over(w) if back else F.col(value).cast("double")
            total = x * weight if total is None else total + x * weight
    return df.withColumn(out, total)
