"""Series operators: hand-made cases, and cut form equals plain form."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlytics.operators import cleaning, quality, rollup, segments, series, split
from flowlytics.sources.stage import materialise

SMALL = {"segments": 7}


@pytest.fixture(scope="module")
def ledger(spark):
    """One product holds half of the rows."""
    rng = np.random.default_rng(11)
    n = 900
    frame = pd.DataFrame({
        "product_id": np.where(rng.random(n) < 0.5, "A", rng.choice(list("BCDEFGH"), n)),
        "txn_ts": rng.integers(0, 40 * 86400, n),
        "id": np.arange(n),
        "direction": rng.integers(0, 2, n),
        "status": (rng.random(n) > 0.1).astype(int),
        "amount": rng.integers(1, 10_000, n),
    })
    frame["date"] = pd.to_datetime(frame.txn_ts, unit="s").dt.date
    return frame, spark.createDataFrame(frame).cache()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("make", [
    lambda df, **c: series.time_gap(df, ["product_id"], "txn_ts", ["id"], **c),
    lambda df, **c: series.running_balance(df, ["product_id"], ["txn_ts", "id"], series.signed_amount(), None, prior="was", **c),
    lambda df, **c: series.running_balance(df, ["product_id"], ["txn_ts", "id"], series.signed_amount(), "clip", **c),
    lambda df, **c: series.floored_balance(df, ["product_id"], ["txn_ts", "id"], prior="was", **c),
    lambda df, **c: series.over_redemption(df, ["product_id"], ["txn_ts", "id"], **c),
    lambda df, **c: series.row_index(df, ["product_id"], ["txn_ts", "id"], **c),
    lambda df, **c: series.chunk(df, ["product_id"], ["txn_ts", "id"], 7, **c),
    lambda df, **c: series.chunk(df, ["product_id"], ["txn_ts", "id"], 7, 3, **c),
    lambda df, **c: series.next_pairs(df, ["product_id"], ["txn_ts", "id"], ["amount", "direction"], **c),
    lambda df, **c: series.change_sign(df, ["product_id"], ["txn_ts", "id"], {"s": "amount"}, **c),
    lambda df, **c: series.change_sign(df, [], ["txn_ts", "id"], {"s": "amount"}, **c),
    lambda df, **c: cleaning.dense_row_id(df, ["txn_ts", "id"], **c),
    lambda df, **c: split.sample_split(df, ["txn_ts", "id"], **c),
    lambda df, **c: quality.ks_distance(df, "direction", "amount", ["product_id"], **c),
    lambda df, **c: quality.ks_distance(df, "direction", "amount", **c),
    lambda df, **c: series.lag1_corr(df, ["product_id"], ["txn_ts", "id"], "amount", **c).withColumn("lag1_corr", F.round("lag1_corr", 9)),
])
def test_cut_form_equals_plain_form(ledger, make):
    _, df = ledger
    assert rows_of(make(df, **SMALL)) == rows_of(make(df))


def test_floored_balance_equals_the_loop(ledger):
    frame, df = ledger
    got = {r["id"]: r["aum_after"] for r in series.floored_balance(df, ["product_id"], ["txn_ts", "id"], **SMALL).collect()}
    for _, g in frame.sort_values(["txn_ts", "id"]).groupby("product_id"):
        held = 0
        for r in g.itertuples():
            if r.status == 1:
                held = held + r.amount if r.direction == 0 else max(0, held - r.amount)
            assert got[r.id] == held


def test_gap_by_hand(spark):
    df = spark.createDataFrame([("a", 100), ("a", 160), ("a", 160 + 40 * 86400)], "k string, ts bigint")
    assert [r["dt_prev_sec"] for r in series.time_gap(df, ["k"], "ts").orderBy("ts").collect()] == [0, 60, 2592000]


def test_clip_and_reflect(spark):
    df = spark.createDataFrame([(1, 10), (2, -15), (3, 5)], "t int, x int")
    def balance(floor):
        return [r["b"] for r in series.running_balance(df, [], ["t"], F.col("x"), floor, "b").orderBy("t").collect()]
    assert (balance(None), balance("clip"), balance("reflect")) == ([10, -5, 0], [10, 0, 0], [10, 0, 5])


def days(spark, n, start="2024-01-01", product="a"):
    return spark.sql(f"SELECT '{product}' AS product_id, 0 AS group_id, date_add(DATE '{start}', CAST(id AS INT)) AS date, CAST(id AS DOUBLE) AS x FROM range({n})")


def test_lagged_mean_needs_a_full_week(spark):
    got = [r["m"] for r in series.lagged_mean(days(spark, 12), ["product_id"], "date", "x", 7, "m").orderBy("date").collect()]
    assert got == [0] * 7 + [3, 4, 5, 6, 7]


def test_row_and_calendar_labels(spark):
    df = days(spark, 9).where("x IN (0, 1, 8)")
    near = series.lead_labels(df, ["product_id"], "date", {"x": "y"}, [1]).orderBy("date")
    assert [r["y_1d"] for r in near.collect()] == [1.0, 8.0, None]
    exact = series.lead_labels(df, ["product_id"], "date", {"x": "y"}, [1], calendar=True).orderBy("date")
    assert [r["y_1d"] for r in exact.collect()] == [1.0, None, None]


def test_labels_stay_within_their_split(spark):
    df = days(spark, 4).withColumn("split", F.when(F.col("x") < 2, "train").otherwise("test"))
    rows = series.lead_labels(df, ["product_id"], "date", {"x": "y"}, [1], within="split").orderBy("date").collect()
    assert [r["y_1d"] for r in rows] == [1.0, None, 3.0, None]


@pytest.mark.parametrize("n, use_last, samples", [(60, False, 0), (61, False, 1), (61, True, 2), (70, False, 10)])
def test_window_count(spark, n, use_last, samples):
    df = series.history_windows(days(spark, n), ["product_id", "group_id"], "date", ["x"], ["x"], use_last=use_last)
    rows = df.orderBy("date").collect()
    assert len(rows) == samples
    for i, r in enumerate(rows):
        t = 30 + i
        assert [f[0] for f in r["features"]] == list(range(t - 30, t))
        assert (r["x_h1"], r["x_h7"], r["x_h30"]) == (t, t + 6, t + 29)


def test_corpus_windows(spark):
    rows = series.corpus_windows(days(spark, 33), ["product_id"], "date", ["x", "absent"]).orderBy("date").collect()
    assert len(rows) == 3
    assert rows[2]["features"][0] == [2.0, 0.0] and rows[2]["features"][29] == [31.0, 0.0]


def test_chunks_pack_in_order(spark):
    chunks = series.chunk(days(spark, 10), ["product_id"], ["date"], 4)
    got = {r["chunk"]: r["x"] for r in series.packed(chunks, ["product_id"], ["date"], "x").collect()}
    assert got == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9]}


def test_dilated_lags_are_causal(spark):
    df = days(spark, 12)
    base = [r["context"] for r in series.dilated_lags(df, ["product_id"], "date", "x").orderBy("date").collect()]
    changed = df.withColumn("x", F.when(F.col("x") > 6, 1000.0).otherwise(F.col("x")))
    moved = [r["context"] for r in series.dilated_lags(changed, ["product_id"], "date", "x").orderBy("date").collect()]
    assert base[:7] == moved[:7] and base[7] != moved[7]
    assert base[0] == 0 and base[1] == pytest.approx(1.5)


def test_split_by_hand(spark):
    df = days(spark, 100)
    bounds = split.split_bounds(df)
    b = bounds.first()
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i - 1)
    assert (b["train_end"], b["val_start"], b["val_end"], b["test_start"]) == (day(80), day(87), day(90), day(91))
    parts = {r["split"]: (r["lo"], r["hi"], r["n"]) for r in split.assign_split(df, bounds).groupBy("split").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("*").alias("n")).collect()}
    assert parts == {"train": (day(1), day(80), 80), "gap": (day(81), day(86), 6), "val": (day(87), day(90), 4), "test": (day(91), day(100), 10)}


def test_empty_train_raises(spark):
    df = days(spark, 1)
    with pytest.raises(ValueError):
        split.require_nonempty(split.assign_split(df, split.split_bounds(df)))


def test_daily_context_by_hand(spark):
    rows = [("a", d, 10 * d, s, 0, float(d), 1.0 * d) for d in range(1, 13) for s in ((1, 0) if d % 2 else (1,))]
    df = spark.createDataFrame(rows, "product_id string, d int, txn_ts int, status int, direction int, amount double, aum_after double")
    df = df.withColumn("date", F.date_add(F.lit("2024-03-20").cast("date"), F.col("d")))
    out = rollup.daily_context(df, ["txn_ts"]).orderBy("date").collect()
    assert len(out) == 12 and out[0]["purchase_amt"] == 1.0 and out[0]["redemption_amt"] == 0.0
    assert [r["fail_rate_7d"] for r in out[:7]] == [0.0] * 7
    assert out[7]["fail_rate_7d"] == pytest.approx(4 * 0.5 / 7) and out[8]["fail_rate_7d"] == pytest.approx(3 * 0.5 / 7)
    assert out[10]["is_quarter_end"] == 1 and out[9]["is_quarter_end"] == 0
    assert out[0]["label_purchase_7d"] == 8.0 and out[0]["label_purchase_30d"] is None


def test_end_of_day_tie_takes_the_larger_key(spark):
    df = spark.createDataFrame([("a", 5, 1, 10.0), ("a", 5, 2, 20.0), ("a", 9, 0, None)], "k string, ts int, tie int, b double")
    assert df.groupBy("k").agg(rollup.end_of_day("b", ["ts", "tie"]).alias("b")).first()["b"] == 20.0


def test_flow_balance_property(ledger):
    _, df = ledger
    day = rollup.daily_flow(df)
    assert day.where("abs(purchase_amt - redemption_amt - net_amt) > 1e-9").count() == 0
    total = day.agg(F.sum("purchase_amt")).first()[0]
    assert total == df.where("status = 1 AND direction = 0").agg(F.sum("amount")).first()[0]
    assert rollup.daily_flow(df, ok_only=False).agg(F.sum("purchase_amt")).first()[0] > total


def test_only_keys_of_several_segments_are_summarised(spark, monkeypatch):
    """A balance without reflection needs no running sum for its summary, and no window over all rows."""
    staged = []
    monkeypatch.setattr(segments, "materialise", lambda df: staged.append(df) or materialise(df))
    rows = spark.range(600).select((F.col("id") % 50).alias("k"), "id", F.lit(1).alias("amount"), F.lit(0).alias("direction"))
    out = series.running_balance(rows, ["k"], ["id"], series.signed_amount(), segments=7)
    assert {(r["k"], r["id"]): r["aum_after"] for r in out.collect()} == {(i % 50, i): i // 50 + 1 for i in range(600)}
    ledger, spanning, summary = staged
    assert spanning.count() <= 6
    assert summary._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
