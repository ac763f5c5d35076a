"""Distribution profiles. Only aggregates leave these functions; ``min_count`` hides small groups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlytics.functions import timefeat as tf
from flowlytics.functions import values as v
from flowlytics.operators.quantile import (
    PROFILE_NAMES, PROFILE_PROBS, bounded_quantiles, exact_quantiles, quantile_map,
)
from flowlytics.operators.segments import SEG, Segmented, salted_lookup, same_keys, tasks_for
from flowlytics.sources.stage import materialise


def value_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))


def long_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts of several code columns at once, as (field, value, n): one pass by grouping sets."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    sets = [[F.col(c)] for c in columns]
    which = F.grouping_id(*[F.col(c) for c in columns])
    out = text.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), which.alias("_g"))
    width = len(columns)
    full = (1 << width) - 1
    name = value = None
    for i, c in enumerate(columns):
        mine = F.col("_g") == (full ^ (1 << (width - 1 - i)))
        name = F.when(mine, c) if name is None else name.when(mine, c)
        value = F.when(mine, F.col(c)) if value is None else value.when(mine, F.col(c))
    return out.select(name.alias("field"), value.alias("value"), "n")


def dow_counts(df: DataFrame, date: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """Rows per day of week, all seven days present."""
    wide = df.groupBy(*keys).agg(*[F.count_if(tf.dow(date) == d).alias(str(d)) for d in range(7)])
    return (wide.unpivot(list(keys), [str(d) for d in range(7)], "dow", "n")
            .withColumn("dow", F.col("dow").cast("int")))


def shares(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[v.share(c).alias(n) for n, c in conditions.items()])


def distinct_counts(df: DataFrame, columns: Sequence[str], exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Distinct values per column. Sketches (bounded state) when ``exact`` is off."""
    if exact:
        return df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in columns])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = PROFILE_PROBS,
              exact: bool = True, accuracy: int = 10000, **cut) -> DataFrame:
    """Array of quantiles per key; ``exact=False`` uses the bounded sketch."""
    if exact:
        return exact_quantiles(df, keys, value, probs, **cut).select(*keys, "quantiles")
    points = F.array(*[F.lit(float(p)) for p in probs])
    return df.groupBy(*keys).agg(F.percentile_approx(value, points, accuracy).alias("quantiles"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 20, density: bool = False,
              salts: int = 16) -> DataFrame:
    """Equal-width histogram from min to max, last bin closed, empty bins kept.

    Columns: keys, bin, lo, hi, n (and density). Equal values are counted before anything else, the
    per-key range meets them through a salted join, and a constant input is widened by 0.5 each way.
    """
    keys = list(keys)
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    edge = counted.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                      F.sum("_c").alias("_total"))
    flat = F.col("_lo") == F.col("_hi")
    edge = edge.select(*keys, "_total",
                       F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                       F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    if keys:
        ranged = salted_lookup(counted, edge, keys, "inner", salts)
    else:
        ranged = counted.withColumn("_e", edge.select(F.struct("*")).scalar()).select("*", "_e.*").drop("_e")
    spot = F.least(F.width_bucket(F.col("_v"), F.col("_lo"), F.col("_hi"), F.lit(bins)), F.lit(bins)) - 1
    tally = ranged.groupBy(*keys, spot.cast("int").alias("bin")).agg(F.sum("_c").alias("n"))
    frame = edge.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = same_keys(frame, tally, [*keys, "bin"], "left")
    width = (F.col("_hi") - F.col("_lo")) / bins
    out = [*keys, "bin", (F.col("_lo") + width * F.col("bin")).alias("lo"),
           (F.col("_lo") + width * (F.col("bin") + 1)).alias("hi"),
           F.coalesce("n", F.lit(0)).alias("n")]
    if density:
        out.append((F.coalesce("n", F.lit(0)) / (F.col("_total") * width)).alias("density"))
    return full.select(*out)


def describe(df: DataFrame, keys: Sequence[str], value: str, **cut) -> DataFrame:
    """count, mean, sample std, min, quartiles, max."""
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], **cut)
    base = df.groupBy(*keys).agg(
        F.count(value).alias("count"), v.mean(value).alias("mean"),
        F.stddev_samp(F.col(value).cast("double")).alias("std"),
        F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"))
    if keys:
        both = same_keys(base, q, keys, "left")
    else:
        both = base.withColumn("quantiles", q.select("quantiles").scalar())
    names = ["p25", "p50", "p75"]
    return both.select(*keys, "count", "mean", "std", "min",
                       *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(names)], "max")


BARS = 20
SALTS = 16


def amount_profile(df: DataFrame, product: str = "product_id", value: str = "amount", **cut) -> DataFrame:
    """Count, mean, std, quantiles and log quantiles per product, overall and per direction."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).alias("_salt")
    rows = materialise(df.where(F.col(value).isNotNull()).select(product, "direction", value, salt))
    return amount_facts(rows, product, value, **cut).drop("bars")


def amount_facts(rows: DataFrame, product: str, value: str, segments: int | None = None) -> DataFrame:
    """product, scope (all, purchase, redemption), n, mean, std, quantiles, log1p_quantiles, bars (the histogram, in the scope of all).

    ``rows`` is a staged table with product, direction, the value and ``_salt``. It is dealt out once, by ranges of product and
    value, in shares of a fixed number of rows; equal values are counted and all scopes ranked side by side in these ranges. The
    salt spreads equal values over several ranges. A row is expanded to its scopes last, on its way into the aggregates.
    """
    tasks = segments or tasks_for(rows)
    dealt = rows.where(F.col(value).isNotNull()).select(product, "direction", F.col(value).alias("_v"), "_salt").repartitionByRange(
        tasks, F.col(product).asc_nulls_first(), F.col("_v").asc_nulls_first(), F.col("_salt").asc_nulls_first())
    counted = dealt.groupBy(product, "_v", "_salt").agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(F.col("direction") == 0).alias("_c_0"), F.count_if(F.col("direction") == 1).alias("_c_1"))
    staged = materialise(counted.drop("_salt").withColumn(SEG, F.spark_partition_id()))
    seg, scopes = Segmented(staged, (product,), ("_v",)), {"all": "", "purchase": "_0", "redemption": "_1"}
    x, over = F.col("_v").cast("double"), seg.carry_window()
    every, before = over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), over.rowsBetween(W.unboundedPreceding, -1)
    ends = {"_hi": F.max(x)}
    for s in scopes.values():
        ends |= {f"_n{s}": F.sum(f"_c{s}"), f"_lo{s}": F.min(F.when(F.col(f"_c{s}") > 0, x))}
    totals = {f"_all{c}": (F.max if c == "_hi" else F.min if c.startswith("_lo") else F.sum)(c).over(every) for c in ends}
    seg = seg.carry(ends, totals | {f"_off{s}": F.sum(f"_n{s}").over(before) for s in scopes.values()})
    seg = seg.map(seg.rows.repartitionByRange(tasks, SEG))
    # both frames in one order, so that one pass makes all columns
    upto, whole = (seg.window().rowsBetween(W.unboundedPreceding, end) for end in (0, W.unboundedFollowing))
    ranked = seg.rows.select(
        product, SEG, "_v", x.alias("_x"), *[f"_c{s}" for s in scopes.values()],
        *[(F.sum(f"_c{s}").over(upto) + F.coalesce(f"_off{s}", F.lit(0))).alias(f"_cum{s}") for s in scopes.values()],
        *[F.coalesce(f"_all{c}", e.over(whole)).alias(c) for c, e in ends.items()])

    mine = F.array_compact(F.array(*[F.when(F.col(f"_c{s}") > 0, F.struct(
        F.lit(name).alias("scope"), F.col(f"_c{s}").alias("_count"), F.col(f"_cum{s}").alias("_upto"), F.col(f"_n{s}").alias("n"), F.col(f"_lo{s}").alias("_low")))
        for name, s in scopes.items()]))
    edges = "CASE WHEN _lo = _hi THEN _lo - 0.5D ELSE _lo END, CASE WHEN _lo = _hi THEN _hi + 0.5D ELSE _hi END"
    spot = F.expr(f"least(width_bucket(_x, {edges}, {BARS}), {BARS}) - 1")
    wide = ranked.select(product, SEG, "_v", "_x", "_lo", "_hi", spot.alias("_spot"), F.explode(mine).alias("_s")).select(
        product, SEG, "_v", "_x", "_lo", "_hi", "_s.*", F.when(F.col("_s.scope") == "all", F.col("_spot")).alias("_bar"))
    count, off = F.col("_count"), F.col("_x") - F.col("_low")
    facts = {c: F.max(c) for c in ("n", "_lo", "_hi")}
    for i, p in enumerate(PROFILE_PROBS):
        rank = rank_of(p)
        for name, at in ((f"_at{i}", rank), *([(f"_next{i}", f"{rank} + 1")] if 0 < p < 1 else [])):
            facts[name] = F.expr(f"max(CASE WHEN {at} >= _upto - _count AND {at} < _upto THEN _x END)")
    sums = {"_sum": F.sum(F.col("_v") * count), "_dev": F.sum(off * count), "_sq": F.sum(off * off * count)}
    sums |= {f"_bar{i}": F.sum(F.when(F.col("_bar") == i, count)) for i in range(BARS)}
    # the ranges first, which needs no exchange, then the few products that span several
    parts = wide.groupBy(SEG, product, "scope").agg(*[c.alias(n) for n, c in (facts | sums).items()])
    one = parts.repartition(tasks, product, "scope").groupBy(product, "scope").agg(
        *[F.max(n).alias(n) for n in facts], *[F.sum(n).alias(n) for n in sums])

    # as arrays, since an expression for each point would make methods so long that the JVM doesn't compile them
    ranks = F.arrays_zip(F.array(*[f"_at{i}" for i in range(len(PROFILE_PROBS))]).alias("at"),
                         F.array(*[f"_next{i}" if f"_next{i}" in facts else f"_at{i}" for i in range(len(PROFILE_PROBS))]).alias("next"),
                         F.array(*[F.expr(f"{float(p)!r}D * (n - 1) - {rank_of(p)}") for p in PROFILE_PROBS]).alias("part"))

    def points(form: Callable[[Column], Column]) -> Column:
        def point(r: Column) -> Column:
            low, high = form(r["at"]), form(r["next"])
            return F.when((r["part"] == 0) | (r["at"] == r["next"]), low).otherwise(low + (high - low) * r["part"])

        return F.transform("_ranks", point)

    # squares around the minimum, which is one of the values, lose about n parts in 2^53 at most
    var = F.greatest(F.col("_sq") - F.col("_dev") * F.col("_dev") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1)
    flat = F.col("_lo") == F.col("_hi")
    lo, hi = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")), F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    width = (hi - lo) / BARS
    bars = F.array(*[F.struct((lo + width * i).alias("lo"), (lo + width * (i + 1)).alias("hi"), F.coalesce(f"_bar{i}", F.lit(0)).alias("n"))
                     for i in range(BARS)])
    return one.withColumn("_ranks", ranks).select(
        product, "scope", "n", (F.col("_sum").cast("double") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, F.sqrt(var)).alias("std"),
        points(lambda x: x).alias("quantiles"), points(lambda x: F.log1p(F.greatest(x, F.lit(0.0)))).alias("log1p_quantiles"),
        F.when(F.col("scope") == "all", bars).alias("bars"))


def rank_of(p: float) -> str:
    return f"floor({float(p)!r}D * (n - 1))"


def day_counts(df: DataFrame, keys: Sequence[str] = ("product_id",), date: str = "date") -> DataFrame:
    return df.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("n"))


def daily_count_quantiles(df: DataFrame, keys: Sequence[str] = ("product_id",), date: str = "date",
                          probs: Sequence[float] = PROFILE_PROBS) -> DataFrame:
    """Quantiles of rows per day; a key has at most one value per calendar day."""
    return day_counts(df, keys, date).groupBy(*keys).agg(bounded_quantiles("n", probs).alias("quantiles"))


def day_averages(df: DataFrame, keys: Sequence[str] = ("product_id",), date: str = "date") -> DataFrame:
    """Mean rows per active day: all days, month-end days, quarter-end days."""
    n = F.col("n")
    return day_counts(df, keys, date).groupBy(*keys).agg(
        F.avg(n).alias("avg_txns_per_day"),
        F.avg(F.when(tf.is_month_end(date) == 1, n)).alias("avg_txns_per_month_end_day"),
        F.avg(F.when(tf.is_quarter_end(date) == 1, n)).alias("avg_txns_per_quarter_end_day"))


def product_profile(df: DataFrame, product: str = "product_id", min_count: int = 0, **cut) -> DataFrame:
    """The whole profile for all products at once; one row per product, aggregates only.

    ``df`` has product, ts, date, direction, status, amount. First and last day and the extreme
    quantiles are raw values; ``min_count`` drops products with fewer rows. The rows are read once and staged with these
    columns; all counts are folded from one table by product and day. Rows are dealt out in shares of a fixed size.
    """
    rows = df.select(product, F.date_trunc("second", "ts").alias("ts"), "date", "direction", "status", "amount")
    rows = materialise(rows.withColumn("_salt", F.pmod(F.xxhash64("ts", "direction", "status"), F.lit(SALTS))))
    tasks = tasks_for(rows)
    days = rows.repartition(tasks, product, "date").groupBy(product, "date").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(F.col("direction") == 0).alias("purchases"),
        F.count_if(F.col("direction") == 1).alias("redemptions"), F.count_if(F.col("status") == 1).alias("done"))
    days = days.select(
        product, "n", "first", "last", "purchases", "redemptions", "done", F.year("date").alias("year"), F.month("date").alias("_month"),
        tf.dow("date").alias("_dow"), (tf.is_month_end("date") == 1).alias("_me"), (tf.is_quarter_end("date") == 1).alias("_qe"))

    def where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    # a product has at most one row per calendar day, so its days may meet in one task; days alike are folded first
    alike = days.repartition(tasks, product).groupBy(product, "year", "n").agg(
        F.count(F.lit(1)).alias("_days"), F.min("first").alias("first"), F.max("last").alias("last"),
        *[where(F.col("_dow") == d).alias(f"_dow{d}") for d in range(7)], *[where(F.col("_month") == m).alias(f"_m{m}") for m in range(1, 13)],
        *[x for c in ("_me", "_qe") for x in (where(F.col(c)).alias(c), F.count_if(F.col(c)).alias(f"{c}_days"))],
        *[F.sum(c).alias(c) for c in ("purchases", "redemptions", "done")]).withColumn("_rows", F.col("n") * F.col("_days"))
    records, by_year = F.sum("_rows"), F.collect_list(F.when(F.col("year").isNotNull(), F.struct("year", F.col("_rows").alias("n"))))
    counts = alike.groupBy(product).agg(
        records.alias("n_records"), F.min("first").alias("first_time"), F.max("last").alias("last_time"),
        tf.whole_days(F.unix_timestamp(F.min("first")), F.unix_timestamp(F.max("last"))).alias("days_total"),
        F.create_map(*[x for d in range(7) for x in (F.lit(str(d)), F.sum(f"_dow{d}"))]).alias("txns_per_dow"),
        F.map_filter(F.create_map(*[x for m in range(1, 13) for x in (F.lit(m), F.sum(f"_m{m}"))]), lambda k, n: n > 0).alias("txns_per_month"),
        *[(F.sum(c) / records).alias(s) for c, s in (("_me", "month_end_share"), ("_qe", "quarter_end_share"), ("purchases", "purchase_share"),
                                                     ("redemptions", "redemption_share"), ("done", "status_share_success"))],
        (records / F.sum("_days")).alias("avg_txns_per_day"),
        F.try_divide(F.sum("_me"), F.sum("_me_days")).alias("avg_txns_per_month_end_day"),
        F.try_divide(F.sum("_qe"), F.sum("_qe_days")).alias("avg_txns_per_quarter_end_day"),
        quantile_map(bounded_quantiles("n", PROFILE_PROBS, "_days")).alias("daily_count_quantiles"), by_year.alias("_years"),
    ).where(F.col("n_records") >= min_count)

    def in_year(y: Column) -> Column:
        mine = F.filter("_years", lambda e: e["year"] == y)
        return F.struct(y.alias("year"), F.aggregate(mine, F.lit(0).cast("bigint"), lambda total, e: total + e["n"]).alias("n"))

    years = F.map_from_entries(F.transform(F.array_distinct(F.col("_years.year")), in_year))
    counts = counts.withColumn("txns_per_year", F.when(F.size("_years") > 0, years)).drop("_years")
    amounts = amount_facts(rows, product, "amount", **cut).select(product, F.struct("scope", F.struct(
        "n", "mean", "std", quantile_map(F.col("quantiles")).alias("quantiles"),
        quantile_map(F.col("log1p_quantiles")).alias("log1p_quantiles")).alias("facts")).alias("_scope"), F.col("bars").alias("amount_histogram"))
    # one exchange brings the parts of a product together
    parts = counts.unionByName(amounts, allowMissingColumns=True).repartition(tasks, product).groupBy(product).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in counts.columns if c != product],
        F.collect_list("_scope").alias("_scopes"), F.first("amount_histogram", ignorenulls=True).alias("amount_histogram"))
    scopes = F.when(F.size("_scopes") > 0, F.map_from_entries("_scopes")).alias("amount")
    return parts.where(F.col("n_records").isNotNull()).select(*counts.columns, scopes, "amount_histogram")


def report_lines(profile: DataFrame, product: str = "product_id") -> DataFrame:
    """Human-readable lines per product, in order, from the profile."""
    def amount(scope: str, field: str) -> Column:
        return F.try_element_at("amount", F.lit(scope))[field]

    def q(scope: str, name: str) -> Column:
        return F.coalesce(F.try_element_at(amount(scope, "quantiles"), F.lit(name)), F.lit(0.0))

    def by_direction(scope: str) -> Column:
        text = F.format_string(f"  - {scope}: n=%d, p50=%.0f, p99=%.0f",
                               amount(scope, "n"), q(scope, "p50"), q(scope, "p99"))
        return F.when(amount(scope, "n").isNotNull(), text)

    dow = F.concat_ws(", ", *[
        F.concat(F.lit(f"{name}="), F.try_element_at("txns_per_dow", F.lit(str(i))).cast("string"))
        for i, name in enumerate(["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"])])
    lines = F.array_compact(F.array(
        F.concat(F.lit("## "), F.col(product).cast("string")),
        F.format_string("- records: %d", "n_records"),
        F.format_string("- from %s to %s (%d days)", F.to_date("first_time").cast("string"),
                        F.to_date("last_time").cast("string"), F.col("days_total")),
        F.format_string("- purchase %.2f%% / redemption %.2f%%",
                        F.col("purchase_share") * 100, F.col("redemption_share") * 100),
        F.format_string("- success %.2f%%", F.col("status_share_success") * 100),
        F.format_string("- amount: p25=%.0f p50=%.0f p75=%.0f p99=%.0f",
                        q("all", "p25"), q("all", "p50"), q("all", "p75"), q("all", "p99")),
        by_direction("purchase"),
        by_direction("redemption"),
        F.concat(F.lit("- "), dow),
    ))
    return profile.select(product, F.posexplode(lines).alias("line_no", "line"))


def cross_tab(df: DataFrame, row: str, column: str, values: Sequence, names: Sequence[str]) -> DataFrame:
    """Counts of row x column with the share of each column within its row."""
    tab = df.groupBy(row).agg(*[F.count_if(F.col(column) == x).alias(n) for x, n in zip(values, names)])
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return tab.select("*", *[F.try_divide(F.col(n), total).alias(f"{n}_share") for n in names])


def month_matrix(df: DataFrame, date: str = "date") -> DataFrame:
    """Amount per calendar month and direction."""
    return df.groupBy(F.month(date).alias("month")).agg(
        *[F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))).cast("double"), F.lit(0.0)).alias(n)
          for d, n in ((0, "purchase"), (1, "redemption"))])


def group_summary(df: DataFrame, keys: Sequence[str], value: str = "amount", name: str | None = None, **cut) -> DataFrame:
    """Rows, median amount and redemption share per group."""
    extra = [F.max(name).alias(name)] if name else []
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), v.share(F.col("direction") == 1).alias("red_share"), *extra)
    mid = exact_quantiles(df, keys, value, [0.5], counts=("_n", "_nd"), **cut).select(
        *keys, F.get("quantiles", F.lit(0)).alias("amt_median"))
    return same_keys(base, mid, keys, "left")


def granularity(df: DataFrame, fine: Sequence[str] = ("product_id", "group_id", "date"),
                coarse: Sequence[str] = ("product_id", "date")) -> DataFrame:
    """How many more units the fine key gives than the coarse one: two nested distincts."""
    flag = df.groupBy(*fine).agg(F.lit(1).alias("_u")).groupBy(*coarse).agg(F.count(F.lit(1)).alias("_f"))
    return flag.agg(F.coalesce(F.sum("_f"), F.lit(0)).alias("n_fine"), F.count(F.lit(1)).alias("n_coarse")).withColumn(
        "ratio", F.col("n_fine") / F.greatest(F.col("n_coarse"), F.lit(1)))


def series_lengths(df: DataFrame, keys: Sequence[str] = ("product_id",), chunk: int = 1500, **cut) -> DataFrame:
    """Distribution of rows per series and the share of series longer than one chunk."""
    length = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("len"))
    q = exact_quantiles(length, [], "len", [0.5, 0.9], counts=("_n", "_nd"), **cut)
    base = length.agg(
        F.count(F.lit(1)).alias("n_series"), F.min("len").alias("min_len"), F.avg("len").alias("mean_len"),
        F.max("len").alias("max_len"), v.share(F.col("len") > chunk).alias("long_share"))
    return base.withColumn("_q", q.select("quantiles").scalar()).select(
        "n_series", "min_len", F.get("_q", F.lit(0)).alias("median_len"), "mean_len",
        F.get("_q", F.lit(1)).alias("p90_len"), "max_len", "long_share")


# Fixed value: 99 % point of the standard normal distribution.
Z99 = 2.3263478740408408


def calibrate(df: DataFrame, product: str = "product_id", **cut) -> DataFrame:
    """Log-normal amount parameters, monthly rate and redemption share per product."""
    q = exact_quantiles(df.where("amount > 0"), [product], "amount", [0.5, 0.99], counts=("_n", "_nd"), **cut)
    base = df.groupBy(product).agg(
        F.count(F.lit(1)).alias("n"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("days"),
        v.share(F.col("direction") == 1).alias("p_redemption_base"))
    p50, p99 = F.log(F.get("quantiles", F.lit(0))), F.log(F.get("quantiles", F.lit(1)))
    return same_keys(base, q, [product], "left").select(
        product, p50.alias("mu_amount_log"), ((p99 - p50) / Z99).alias("sigma_amount"),
        (F.col("n") * 30.0 / F.col("days")).alias("monthly_txn_rate"), "p_redemption_base")


def bin_balance(df: DataFrame, column: str = "amount_bin") -> DataFrame:
    """Rows per bucket with their share; a healthy corpus has no dominating bucket."""
    counts = value_counts(df, [], column)
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("_t", total).select(column, "n", (F.col("n") / F.col("_t")).alias("share"))


