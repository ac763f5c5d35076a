"""The end-to-end jobs on small ledgers."""

import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlytics.operators import joins, segments
from flowlytics.plans import jobs
from flowlytics.sources import readers, stage


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    n = 1500
    fact = pd.DataFrame({
        "txn_id": [f"t{i:05d}" for i in range(n)], "cust_id_hash": rng.choice([f"c{i}" for i in range(20)], n),
        "product_id": rng.choice(["p0", "p1", "p2"], n, p=[0.6, 0.3, 0.1]),
        "txn_ts": 1704067200 + rng.integers(0, 200 * 86400, n), "txn_type": rng.integers(0, 2, n),
        "txn_status": (rng.random(n) > 0.05).astype(int), "amount": np.round(rng.gamma(2, 500, n), 2),
        "aum_after": rng.normal(1000, 900, n)})
    fact.loc[:4, "amount"] = 0.0
    product = pd.DataFrame({"product_id": ["p0", "p1", "p2"], "product_type": [0, 1, 2], "product_type_name": ["a", "b", "c"],
                            "risk_level": [1, 2, 3], "min_purchase": [1.0, 100.0, 10000.0]})
    customer = pd.DataFrame({"cust_id_hash": [f"c{i}" for i in range(20)], "cust_type": [i % 3 for i in range(20)]})
    return fact, [spark.createDataFrame(x) for x in (fact, product, customer)]


def test_training_tables(spark, tables, tmp_path):
    fact, frames = tables
    out = jobs.training_tables(*frames, segments=5)
    txns = out.txns.toPandas()
    assert len(txns) == len(fact) - 5 and sorted(txns["__row_id__"]) == list(range(len(txns)))
    assert "product_type_name" not in txns and (txns.aum_after >= 0).all()
    assert tuple(out.dropped.first()) == (len(fact) - 5, 5) and tuple(out.join_misses.first()) == (len(fact), 0, 0.0, False)

    b = out.bounds.first()
    assert txns[txns.split == "train"].date.max() <= b["train_end"] < b["val_start"] <= txns[txns.split == "val"].date.min()
    train = txns[txns.split == "train"]
    for d in (0, 1):
        values = np.round(np.log1p(train[train.direction == d].amount), 9)
        edges = np.unique(np.round(np.quantile(values, np.arange(17) / 16), 9))
        mine = txns[txns.direction == d]
        want = pd.cut(np.round(np.log1p(mine.amount), 9), edges, labels=False, include_lowest=True).fillna(-1).astype(int)
        assert (want == mine.amount_bin).mean() > 0.999
    assert set(txns.min_purchase_bin) <= {0, 1, 2, 3} and txns.dt_bin.between(-1, 7).all()

    ok = txns[(txns.status == 1) & (txns.direction == 0)].groupby(["product_id", "date"]).amount.sum()
    daily = out.daily.toPandas().set_index(["product_id", "date"])
    assert daily.purchase_amt[daily.purchase_amt > 0].sum() == pytest.approx(ok.sum())
    assert {r["gate"] for r in out.gates.collect()} >= {"fail_rate", "redemption_share", "min_balance", "n_splits", "min_len"}

    out.write(str(tmp_path / "out"))
    assert readers.read_parquet(spark, str(tmp_path / "out" / "txns")).count() == len(txns)
    assert readers.read_state(spark, str(tmp_path / "out" / "bucket_state")).count() == 3


def test_masked_labels_are_fewer(tables):
    _, frames = tables
    plain = jobs.training_tables(*frames).daily
    masked = jobs.training_tables(*frames, mask_labels=True).daily
    label = F.count("label_purchase_30d")
    assert masked.agg(label).first()[0] < plain.agg(label).first()[0]
    assert set(masked.columns) == set(plain.columns)


def test_forecast_evaluation(spark):
    rng = np.random.default_rng(9)
    rows = [(p, g, pd.Timestamp("2022-01-01") + pd.Timedelta(days=i), k, float(np.round(rng.gamma(2, 100), 2)), 0.02)
            for p in "ab" for g in (0, 1) for i in range(480) for k in (0, 1)]
    ledger = spark.createDataFrame(pd.DataFrame(rows, columns=["product_id", "group_id", "ts", "direction", "amount", "yield_rate"]))
    ledger = ledger.withColumn("date", F.to_date("ts"))
    out = jobs.forecast_evaluation(ledger, seeds=(1, 2), noise=0.02, trees=False)
    assert out.predictions.count() == 2 * 4 * 12 * 6
    assert out.scores.count() == 2 * 6 and out.products.count() == 2
    wape = out.summary.where("metric = 'wape' AND kind = 'purchase_log1p' AND horizon = 1").first()
    assert wape["n_seeds"] == 2 and 0 < wape["mean"] < 0.5 and len(wape["values"]) == 2


def test_token_corpus_and_profile(spark, tmp_path):
    (tmp_path / "a.csv").write_text("fund_code,time,trade_type,status,amount\n" + "".join(
        f"F{i % 2},2024010{1 + i % 9}120000,{'buy' if i % 3 else 'sell'},ok,{i}\n" for i in range(40)))
    profile, lines = jobs.privacy_profile(spark, [str(tmp_path / "a.csv")])
    assert {r["product_id"]: r["n_records"] for r in profile.collect()} == {"F0": 20, "F1": 20}
    assert lines.count() == 18
    market = spark.createDataFrame([("x", f"2024-01-{i + 1:02d}", 0, float(i), 6, 9) for i in range(20)],
                                   "product_id string, date string, direction int, amount double, product_type int, risk_level int")
    rows = jobs.token_corpus(market=market).collect()
    assert len(rows) == 20 and {r["amount_bin"] for r in rows} == set(range(16)) and {r["product_type"] for r in rows} == {5}
    with pytest.raises(ValueError):
        jobs.token_corpus()


def test_a_second_run_gives_the_same_files(spark, tables, tmp_path):
    _, frames = tables
    out = jobs.training_tables(*frames)
    for _ in range(2):
        out.write(str(tmp_path))
    assert readers.read_parquet(spark, str(tmp_path / "txns")).count() == out.txns.count()
    assert spark.read.json(str(tmp_path / "gates")).count() == out.gates.count()
    readers.write_split(out.txns.where("split = 'val'").limit(3), str(tmp_path / "txns"))
    left = {r["split"]: r["count"] for r in readers.read_parquet(spark, str(tmp_path / "txns")).groupBy("split").count().collect()}
    assert left["val"] == 3 and left["train"] == out.txns.where("split = 'train'").count()


def test_small_directions_are_flagged(spark):
    from flowlytics.operators import quality, quantile

    rows = spark.createDataFrame([(0, float(i)) for i in range(40)] + [(1, 1.0)] * 31, "direction int, x double")
    got = quality.bin_rows(quantile.fit_bins(rows, ["direction"], "x", 16), 16, (0, 1, -1)).collect()
    assert [(r["gate"], r["value"], r["passed"]) for r in got] == [("bin_rows_0", 40.0, True), ("bin_rows_1", 31.0, False), ("bin_rows_-1", 0.0, False)]


def test_bucketed_tables_are_read_without_an_exchange(spark, tmp_path):
    from flowlytics.operators import series

    days = spark.range(400).select((F.col("id") % 7).cast("string").alias("product_id"), F.col("id").cast("int").alias("date"), F.rand(1).alias("x"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = readers.write_bucketed(days, "days_by_product", str(tmp_path / "days"), ["product_id"], ["date"], 4)
        labels = series.lead_labels(stored, ["product_id"], "date", {"x": "label"}, (1, 7))
        joined = labels.join(stored.groupBy("product_id").agg(F.sum("x").alias("total")), "product_id")
        assert joined.count() == 400
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.sql("DROP TABLE IF EXISTS days_by_product")


def staged_folders(spark):
    return {p.name: p for p in Path(stage.shared_folder(spark).removeprefix("file:")).glob("stage-*")}


def shuffle_files(spark):
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
    return {f for f in names.split(",") if "/shuffle_" in f}


def test_the_training_job_leaves_one_copy_of_the_ledger(spark, tables):
    fact, frames = tables
    before, kept = staged_folders(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large dimensions
    try:
        out = jobs.training_tables(*frames)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    left = [p for name, p in staged_folders(spark).items() if name not in before]
    ledgers = [p for p in left if "txn_id" in spark.read.parquet(str(p)).columns]
    days = [p for p in left if {"purchase_amt", "date"} <= set(spark.read.parquet(str(p)).columns)]
    assert len(ledgers) == 1 and len(days) == 1
    assert out.txns.count() == len(fact) - 5 and out.gates.count() == 12


@pytest.mark.parametrize("rows", [10 ** 8, 150])
def test_training_tables_with_null_and_repeated_rows(spark, tables, monkeypatch, rows):
    monkeypatch.setattr(segments, "ROWS_OF_A_SHUFFLE", rows)  # one shuffle of all rows, or one for each of several slices
    fact, (_, product, customer) = tables
    odd = pd.concat([fact.iloc[5:400], fact.iloc[5:105]])  # rows that come twice
    odd["cust_id_hash"] = [None if i % 7 == 0 else c for i, c in enumerate(odd.cust_id_hash)]
    schema = "txn_id string, cust_id_hash string, product_id string, txn_ts long, txn_type long, txn_status long, amount double, aum_after double"
    out = jobs.training_tables(spark.createDataFrame(list(odd.itertuples(index=False, name=None)), schema), product, customer, segments=3)
    txns = out.txns.toPandas().sort_values("__row_id__")
    order = ["cust_id_hash", "product_id", "txn_ts", "txn_id"]
    assert list(txns["__row_id__"]) == list(range(len(odd)))
    assert tuple(out.join_misses.first())[:2] == (len(odd), int(odd.cust_id_hash.isna().sum())) and tuple(out.dropped.first()) == (len(odd), 0)
    ok = odd[odd.txn_status == 1]
    assert out.daily.agg(F.sum("purchase_amt") + F.sum("redemption_amt")).first()[0] == pytest.approx(ok.amount.sum())
    assert out.daily.count() == len(ok.assign(day=ok.txn_ts // 86400)[["product_id", "day"]].drop_duplicates())
    want = odd.sort_values(order, na_position="first")
    assert txns[order].fillna("").values.tolist() == want[order].fillna("").values.tolist()
    gap = want.groupby(["cust_id_hash", "product_id"], dropna=False).txn_ts.diff().fillna(0).clip(0, 2592000).astype(int)
    assert list(txns.dt_prev_sec) == list(gap)
    assert list(txns.columns)[-7:] == ["dt_prev_sec", "amount_log1p", "split", "min_purchase_bin", "amount_bin", "dt_bin", "__row_id__"]


def test_slices_may_be_empty(spark, tables, monkeypatch):
    fact, (_, product, customer) = tables
    monkeypatch.setattr(segments, "ROWS_OF_A_SHUFFLE", 400)
    rows = fact.iloc[5:].drop(columns="cust_id_hash").assign(product_id="p1")
    frame = spark.createDataFrame(rows).withColumn("cust_id_hash", F.lit(None).cast("string")).repartition(2, "txn_ts")
    out = jobs.training_tables(frame, product, customer)
    assert tuple(out.join_misses.first())[:2] == (len(rows), len(rows)) and tuple(out.dropped.first()) == (len(rows), 0)
    assert sorted(r["__row_id__"] for r in out.txns.select("__row_id__").collect()) == list(range(len(rows)))


def test_shuffle_files_go_with_the_write(spark):
    before = shuffle_files(spark)
    rows = stage.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:  # they are removed beside the next steps
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert rows.count() == 7 and spark.conf.get(stage.CLEANUP) == "false"


def test_tables_on_the_way_are_deleted(spark):
    before, kept = staged_folders(spark), []

    def inner():
        first = stage.materialise(spark.range(10))
        kept.append(stage.settled(lambda: stage.materialise(first.where("id > 2")).where("id > 5")))
        return kept[0].unionByName(first)

    rows = stage.settled(inner, "zstd")
    assert len(set(staged_folders(spark)) - set(before)) == 1 and rows.count() == 14
    stage.discard(rows)
    assert set(staged_folders(spark)) == set(before)


def test_shuffles_of_the_fact_are_staged_between(spark, tables, monkeypatch):
    _, (fact, product, customer) = tables
    small = [F.broadcast(product), F.broadcast(customer)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = joins.join_dims(fact, product, customer)
        for dims, shuffles, rows in (([product, customer], 2, 10 ** 6), ([product, customer], 2, 400), (small, 0, 400)):
            monkeypatch.setattr(segments, "ROWS_OF_A_SHUFFLE", rows)
            parts = joins.join_dims_staged(fact, *dims)
            assert len(parts) == (4 if shuffles and rows == 400 else 1)
            assert all(joins._shuffles(part) == shuffles for part in parts)  # fact and dimension, of one join
            staged = stage.materialise(parts)
            assert staged.columns == plain.columns and staged.exceptAll(plain).isEmpty() and plain.exceptAll(staged).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_windows_over_dealt_out_keys_need_no_other_exchange(spark):
    rows = segments.dealt_out(spark.range(100).select((F.col("id") % 9).alias("k"), "id"), ["k"], 4)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "hashpartitioning" not in plan
    per = rows.groupBy("k").agg(F.count_distinct(segments.SEG).alias("s"), F.max("n").alias("n")).collect()
    assert all(r["s"] == 1 and r["n"] in (11, 12) for r in per)
    assert [r[segments.SEG] for r in rows.orderBy("k").collect()] == sorted(r[segments.SEG] for r in rows.collect())
