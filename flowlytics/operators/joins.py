"""Dimension joins. All are equi joins against one row per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlytics.operators.segments import salted_lookup, sliced, slices_for
from flowlytics.sources.stage import discard, materialise


def join_dims(fact: DataFrame, product: DataFrame, customer: DataFrame, *,
              product_key: str = "product_id", customer_key: str = "cust_id_hash",
              salts: int = 0) -> DataFrame:
    """fact with product and customer attributes (left joins).

    Without hints, a dimension under the broadcast threshold is broadcast and a larger one is
    shuffled, with AQE splitting skewed keys. ``salts`` spreads hot keys in advance.
    """
    out = fact
    for dim, key in ((product, product_key), (customer, customer_key)):
        out = _with_dim(out, dim, key, salts)
    return out


def _with_dim(fact: DataFrame, dim: DataFrame, key: str, salts: int) -> DataFrame:
    return salted_lookup(fact, dim, [key], "left", salts) if salts else fact.join(dim, key, "left")


def join_dims_staged(fact: DataFrame, product: DataFrame, customer: DataFrame, *,
                     product_key: str = "product_id", customer_key: str = "cust_id_hash",
                     salts: int = 0, codec: str | None = None) -> list[DataFrame]:
    """The rows of ``join_dims`` in parts that are to be written one after another (runs a job for each table it stages).

    Rows that have come through one shuffle are staged before they go into another, and go there in slices of a fixed number
    of rows, so that the disk never holds more than that of the shuffled fact.
    """
    parts, before = [fact], None
    for dim, key in ((product, product_key), (customer, customer_key)):
        passed = _shuffles(parts[0])
        if passed and _shuffles(_with_dim(parts[0], dim, key, salts)) > passed + _shuffles(dim):
            table = materialise(parts, codec)
            if before is not None:
                discard(before)
            parts, before = sliced(table, [key], slices_for(table)), table
        parts = [_with_dim(part, dim, key, salts) for part in parts]
    return parts


def _shuffles(df: DataFrame) -> int:
    """Shuffles that the plan of the frame has before anything of it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def repeated_keys(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dimension keys that occur more than once and would fan the fact rows out."""
    return dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raises when a dimension key repeats (runs a job on the dimension)."""
    if not repeated_keys(dim, keys).isEmpty():
        raise ValueError(f"dimension key {list(keys)} is not unique")
    return dim


def miss_facts(markers: Sequence[str]) -> list[Column]:
    """Rows, and rows that found no partner in some dimension, as aggregates."""
    hit = None
    for m in markers:
        term = F.col(m).isNotNull()
        hit = term if hit is None else hit & term
    return [F.count(F.lit(1)).alias("n_rows"), F.count_if(~hit).alias("n_missed")]


def with_ratio(facts: DataFrame, warn_over: float = 0.05) -> DataFrame:
    ratio = F.col("n_missed") / F.nullif("n_rows", F.lit(0))
    return facts.select("n_rows", "n_missed", ratio.alias("miss_ratio"), (ratio > warn_over).alias("warn"))


def miss_rate(joined: DataFrame, markers: Sequence[str], warn_over: float = 0.05) -> DataFrame:
    """Rows that found no partner in some dimension, as count, ratio and warning flag."""
    return with_ratio(joined.agg(*miss_facts(markers)), warn_over)


def with_defaults(df: DataFrame, lookup: DataFrame, key: str, defaults: Mapping[str, object],
                  casts: Mapping[str, str] | None = None) -> DataFrame:
    """Lookup join whose absent attributes take the default."""
    def filled(name: str) -> Column:
        c = F.coalesce(F.col(name), F.lit(defaults[name]))
        return c.cast(casts[name]) if casts and name in casts else c

    joined = df.join(lookup.select(key, *defaults), key, "left")
    return joined.withColumns({name: filled(name) for name in defaults})


def matched_days(counts: DataFrame, days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Day counts restricted to the given days (semi join)."""
    return counts.join(days, list(keys), "leftsemi")
