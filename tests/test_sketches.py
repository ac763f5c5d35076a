"""Sketches against exact figures, merged and whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlytics.operators import sketches as sk

PROBS = [0.05, 0.5, 0.95]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 20_000
    data = [(int(k), int(d), float(v), int(c)) for k, d, v, c in zip(
        rng.choice([0, 0, 0, 1, 2], n), rng.integers(0, 30, n), np.exp(rng.normal(size=n)), rng.zipf(1.6, n) % 5000)]
    data += [(None, 1, 3.0, None), (2, 1, None, 7)]
    return spark.createDataFrame(data, "k int, day int, v double, c int").cache()


def test_merged_daily_sketches_answer_quantiles(rows):
    daily = sk.quantile_sketches(rows, ["k", "day"], "v")
    whole = sk.merged_quantile_sketches(daily, ["k"])
    found = sk.sketch_quantiles(whole, ["k"], PROBS).cache()
    errors = sk.rank_errors(rows, found, ["k"], "v", PROBS).collect()
    assert len(errors) == 4 * len(PROBS) and max(r["rank_error"] for r in errors) < 0.01
    assert {r["k"]: r["n"] for r in found.collect()} == {r["k"]: r["count"] for r in rows.where("v IS NOT NULL").groupBy("k").count().collect()}


def test_rank_error_of_a_wrong_value(spark):
    rows = spark.range(1, 101).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    off = spark.createDataFrame([(1, [30.0])], "k int, quantiles array<double>")
    assert sk.rank_errors(rows, off, ["k"], "v", [0.5]).first()["rank_error"] == pytest.approx(0.2)


def test_unions_and_intersections(rows):
    daily = sk.distinct_sketches(rows, ["k", "day"], "c")
    by_k = {r["k"]: r["n"] for r in sk.merged_distinct_sketches(daily, ["k"]).select("k", sk.distinct_estimate("sketch").alias("n")).collect()}
    exact = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.countDistinct("c").alias("n")).collect()}
    assert by_k == exact  # fewer values than the sketch holds
    sides = sk.merged_distinct_sketches(daily, ["k"]).where("k IN (0, 1)").groupBy().pivot("k", [0, 1]).agg(F.first("sketch"))
    both = rows.where("k = 0").select("c").distinct().join(rows.where("k = 1").select("c").distinct(), "c").count()
    assert sides.select(sk.common_estimate(F.col("0"), F.col("1")).alias("n")).first()["n"] == both


@pytest.mark.parametrize("counters", [8, 64, 1024])
@pytest.mark.parametrize("by", [[], ["day"]])
def test_heavy_hitters_equal_the_full_count(rows, counters, by):
    want = rows.where("c IS NOT NULL").groupBy("c").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "c").limit(5).collect()
    assert sk.heavy_hitters(rows, "c", 5, by, counters).collect() == want


def test_heavy_hitters_without_a_gap(spark, monkeypatch):
    monkeypatch.setattr(sk, "MOST_COUNTERS", 64)
    flat = spark.range(0, 3000).select((F.col("id") % 1000).alias("c"))
    assert [tuple(r) for r in sk.heavy_hitters(flat, "c", 4, counters=16).collect()] == [(0, 3), (1, 3), (2, 3), (3, 3)]
    assert sk.heavy_hitters(flat.limit(0), "c", 4).count() == 0
    assert sk.heavy_hitters(flat.where("c < 3"), "c", 4).count() == 3


def test_counters_stop_where_counting_all_is_cheaper(spark):
    flat = spark.range(0, 400_000).select(F.col("id").alias("c"))  # no value is frequent, however many counters there are
    assert [tuple(r) for r in sk.heavy_hitters(flat, "c", 3, counters=1 << 16).collect()] == [(0, 1), (1, 1), (2, 1)]
    assert sk.MOST_COUNTERS <= 1_000_000
