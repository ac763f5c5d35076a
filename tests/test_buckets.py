"""Quantiles, buckets and segments against numpy and by hand."""

import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flowlytics.operators import quantile as q
from flowlytics.operators.segments import salted_lookup, segmented

SMALL = {"segments": 9}


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    frame = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n)),
        "v": np.round(np.exp(rng.normal(size=n)), 2),
        "id": np.arange(n),
    })
    return frame, spark.createDataFrame(frame).cache()


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_exact_quantiles_equal_numpy(skewed, limits):
    frame, df = skewed
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    got = {r["k"]: r for r in q.exact_quantiles(df, ["k"], "v", probs, **limits).collect()}
    for k, g in frame.groupby("k"):
        assert np.allclose(got[k]["quantiles"], np.quantile(g.v, probs))
        assert (got[k]["n"], got[k]["n_distinct"]) == (len(g), g.v.nunique())
    whole = q.exact_quantiles(df, [], "v", probs, **limits).first()
    assert np.allclose(whole["quantiles"], np.quantile(frame.v, probs))


def test_weighted_input_and_transform(spark, skewed):
    frame, df = skewed
    counted = df.groupBy("v").agg(F.count("*").alias("w"))
    row = q.exact_quantiles(counted, [], "v", [0.3, 0.7], weight="w",
                            transforms={"a": "CAST({} AS DOUBLE)", "b": "log1p({})"}).first()
    assert np.allclose(row["a"], np.quantile(frame.v, [0.3, 0.7]))
    assert np.allclose(row["b"], np.quantile(np.log1p(frame.v), [0.3, 0.7]))


def test_segments_are_ordered_ranges(skewed):
    frame, df = skewed
    seg = segmented(df, ["k"], ["v", "id"], **SMALL)
    parts = seg.rows.groupBy("k", "_seg").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).toPandas()
    for _, g in parts.groupby("k"):
        g = g.sort_values("_seg")
        assert (g.hi.values[:-1] <= g.lo.values[1:]).all()
    assert parts.n.sum() == len(frame)
    hot = parts[parts.k == 0]
    assert len(hot) > 1 and hot.n.max() < 0.6 * hot.n.sum()
    bounds = parts.groupby("_seg").k.agg(["min", "max"]).sort_index()
    assert (bounds["max"].values[:-1] <= bounds["min"].values[1:]).all()


def test_segments_hold_about_the_same_number_of_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    sizes = [r["count"] for r in segmented(df, ["k"], ["id"], segments=16).rows.groupBy("_seg").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2.5 * 20_000 / 16


def test_only_keys_of_several_segments_are_carried(skewed):
    _, df = skewed
    seg = segmented(df, ["k"], ["v", "id"], **SMALL)
    rows = seg.carry({"_s": F.count("*")}, {"_all": F.sum("_s").over(seg.carry_window().rowsBetween(-1000, 1000))}).rows
    got = {r["k"]: (r["parts"], r["total"], r["n"]) for r in rows.groupBy("k").agg(
        F.countDistinct("_seg").alias("parts"), F.max("_all").alias("total"), F.count("*").alias("n")).collect()}
    assert any(parts > 1 for parts, _, _ in got.values())
    assert all(total == (n if parts > 1 else None) for parts, total, n in got.values())


def test_one_plan_for_every_size(skewed):
    _, df = skewed
    plans = []
    for part in (df, df.limit(3)):
        seg = segmented(part, ["k"], ["v", "id"])
        rows = seg.map(seg.rows.withColumn("s", F.sum("v").over(seg.window()))).carry({"_t": F.sum("v")}, {"_o": F.lag("_t").over(seg.carry_window())}).rows
        plans.append([line.strip(" :+-") .split(" ")[0] for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines()])
    assert plans[0] == plans[1] and "array" not in str(rows.dtypes)


def edges_of(spark, values, bins, **kw):
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    edges = q.fit_bins(df, [], "x", bins, **kw)
    rows = q.apply_bins(df, edges, [], "x", bins, "b", missing=-1).select("x", "b").collect()
    return edges.first()["edges"], [r["b"] for r in sorted(rows, key=lambda r: r["x"])]


def test_duplicate_edges(spark):
    assert edges_of(spark, [1, 2, 2, 2, 3, 7], 4) == ([1.0, 2.0, 2.75, 7.0], [0, 0, 0, 0, 2, 2])


def test_constant_series_has_no_bucket(spark):
    assert edges_of(spark, [1, 1, 1], 4) == ([1.0], [-1, -1, -1])


def test_right_closed_lowest_included(spark):
    edges = spark.createDataFrame([([0.0, 1.0, 5.0, 9.0],)], "edges array<double>")
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 1, 2, 5, 9, 10)] + [(None,)], "x double")
    got = [r["b"] for r in q.apply_bins(df, edges, [], "x", 3, "b").collect()]
    assert got == [-1, 0, 0, 1, 1, 2, -1, -1]


def test_few_rows_get_no_edges(spark):
    edges, bins = edges_of(spark, range(15), 16, min_rows=16)
    assert edges == [] and set(bins) == {-1}


def test_adaptive_bins_follow_distinct_values(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 0, 1, 1, 2, 3]], "x double")
    edges = q.fit_adaptive_bins(df, [], "x", 16).first()["edges"]
    want = sorted(set(np.quantile([0, 0, 1, 1, 2, 3], np.arange(5) / 4)))
    assert np.allclose(edges, want)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=3, max_size=60), st.integers(2, 8))
def test_buckets_equal_qcut(spark, values, bins):
    edges, got = edges_of(spark, values, bins)
    assert edges == sorted(edges)
    # edges are rounded to nine digits, so that a quantile is not an ulp away from a value
    want_edges = np.unique(np.round(np.quantile(values, np.arange(bins + 1) / bins), 9))
    if len(want_edges) < 2:
        assert set(got) == {-1}
        return
    want = pd.cut(pd.Series(sorted(values), dtype=float), want_edges, labels=False, include_lowest=True).astype(int).tolist()
    assert got == want


def test_unseen_key_is_missing(spark):
    edges = spark.createDataFrame([(0, [0.0, 1.0, 2.0])], "direction int, edges array<double>")
    df = spark.createDataFrame([(0, 1.5), (1, 1.5), (None, 1.5)], "direction int, x double")
    got = [r["b"] for r in q.apply_bins(df, edges, ["direction"], "x", 2, "b", codes=q.DIRECTIONS).orderBy("direction").collect()]
    assert sorted(got) == [-1, -1, 1]


def test_salted_lookup_is_a_left_join(spark):
    big = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(60)], "k int, x int")
    small = spark.createDataFrame([(0, "a"), (2, "c"), (None, "n")], "k int, s string")
    got = {(r["k"], r["x"]): r["s"] for r in salted_lookup(big, small, ["k"], salts=4).collect()}
    assert len(got) == 60
    assert all(s == {0: "a", 1: None, 2: "c", None: "n"}[k] for (k, _), s in got.items())


def test_bucket_lookup_is_compiled(spark):
    """The JVM interprets methods of more than 8,000 bytes."""
    edges = spark.createDataFrame([(0, [float(i) for i in range(25)]), (1, None)], "direction int, edges array<double>")
    rows = spark.range(40).select((F.col("id") % 2).cast("int").alias("direction"), (F.col("id") / 2 - 1).alias("x"))
    out = q.apply_bins(q.apply_bins(rows, edges, ["direction"], "x", 24, codes=q.DIRECTIONS), edges.where("direction = 0"), [], "x", 24, "other")
    for _ in range(3):
        out = q.apply_bins(out, edges.where("direction = 0"), [], "x", 24, "again")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)) < 8000
    found = {(r["direction"], r["x"]): r["amount_bin"] for r in out.collect()}
    assert found[0, -1.0] == -1 and found[0, 0.0] == 0 and found[0, 1.0] == 0 and found[0, 2.0] == 1 and found[1, 0.5] == -1
