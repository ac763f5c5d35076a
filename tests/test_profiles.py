"""Cleaning, profiles, quality, vocabulary, mapping, forecast scores and files."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlytics.operators import cleaning, corpus, forecast as fc, joins, mapping, profile as p, quality, rollup, segments, vocab
from flowlytics.operators import quantile as q
from flowlytics.operators.quantile import PROFILE_NAMES, PROFILE_PROBS
from flowlytics.functions import tokens
from flowlytics.sources import readers, tables


def test_detection_prefers_order_then_substring():
    found = cleaning.detect_columns(["序号", "产品代码", "交易时间", "业务类型", "确认金额", "date"])
    assert found == {"product": "产品代码", "time": "交易时间", "type": "业务类型", "status": None, "amount": "确认金额"}
    assert cleaning.detect_column(["my_amount_x", "TXN_AMOUNT"], ["amount", "txn_amount"]) == "my_amount_x"
    assert cleaning.detect_columns(["product_id", "txn_time", "txn_type", "amount", "status"])["product"] == "product_id"


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError):
        cleaning.canonical_ledger(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(ValueError):
        cleaning.require_columns(spark.range(1), ["amount"])


@pytest.mark.parametrize("values, want", [
    (["20240131235959", "20240201000000"], ["2024-01-31 23:59:59", "2024-02-01 00:00:00"]),
    (["1291193100", "1291193101"], ["2010-12-01 08:45:00", "2010-12-01 08:45:01"]),
    (["2024-01-31 10:00:00", "bad"], ["2024-01-31 10:00:00", None]),
    (["20240131235959", "20249931235959", "20240131235958"], ["2024-01-31 23:59:59", None, "2024-01-31 23:59:58"]),
])
def test_time_formats(spark, values, want):
    df = cleaning.parse_time(spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, s string"), "s")
    assert [r["t"] for r in df.select("i", F.col("ts").cast("string").alias("t")).orderBy("i").collect()] == want


def test_success_words_or_numbers(spark):
    words = spark.createDataFrame([("成功",), ("failed",), ("1",), (None,)], "s string")
    assert [r["status"] for r in cleaning.normalise_success(words, "s").collect()] == [1, 0, 1, 0]
    numbers = spark.createDataFrame([(1.0,), (0.0,), (None,)], "s double")
    assert [r["status"] for r in cleaning.normalise_success(numbers, "s").collect()] == [1, 0, 0]


def test_join_miss_rate_and_unique_keys(spark):
    fact = spark.createDataFrame([(f"p{i}", "c1") for i in range(10)], "product_id string, cust_id_hash string")
    product = spark.createDataFrame([(f"p{i}", i) for i in range(9)], "product_id string, product_type int")
    customer = spark.createDataFrame([("c1", 0)], "cust_id_hash string, cust_type int")
    for salts in (0, 4):
        row = joins.miss_rate(joins.join_dims(fact, product, customer, salts=salts), ["product_type", "cust_type"]).first()
        assert (row["n_rows"], row["n_missed"], row["miss_ratio"], row["warn"]) == (10, 1, 0.1, True)
    with pytest.raises(ValueError):
        joins.require_unique(product.union(product), ["product_id"])
    assert joins.require_unique(product, ["product_id"]) is product


def test_histogram_edges(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    rows = p.histogram(df, [], "x", 2).orderBy("bin").collect()
    assert [(r["lo"], r["hi"], r["n"]) for r in rows] == [(2.5, 3.0, 0), (3.0, 3.5, 2)]
    values = np.random.default_rng(5).gamma(2.0, size=500)
    frame = spark.createDataFrame([("k", float(x)) for x in values], "k string, x double")
    counts, edges = np.histogram(values, bins=20)
    rows = p.histogram(frame, ["k"], "x", 20, density=True).orderBy("bin").collect()
    assert [r["n"] for r in rows] == counts.tolist()
    assert np.allclose([r["lo"] for r in rows], edges[:-1])
    assert np.allclose([r["density"] for r in rows], np.histogram(values, bins=20, density=True)[0])


def profile_input(spark):
    rng = np.random.default_rng(2)
    n = 400
    frame = pd.DataFrame({
        "product_id": rng.choice(["a", "b"], n, p=[0.8, 0.2]),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 100 * 86400, n), unit="s"),
        "direction": rng.integers(0, 2, n), "status": rng.integers(0, 2, n), "amount": np.round(rng.gamma(2, 1000, n), 2)})
    return frame, spark.createDataFrame(frame).withColumn("date", F.to_date("ts"))


def test_product_profile(spark):
    frame, df = profile_input(spark)
    for row in p.product_profile(df).collect():
        g = frame[frame.product_id == row["product_id"]]
        assert row["n_records"] == len(g)
        assert row["days_total"] == (g.ts.max() - g.ts.min()).days
        assert row["txns_per_dow"] == {str(i): int((g.ts.dt.dayofweek == i).sum()) for i in range(7)}
        assert row["txns_per_month"] == g.ts.dt.month.value_counts().to_dict()
        assert row["txns_per_year"] == {2024: len(g)}
        assert row["purchase_share"] == pytest.approx((g.direction == 0).mean())
        everything = row["amount"]["all"]
        assert everything["std"] == pytest.approx(g.amount.std())
        assert everything["quantiles"]["p99"] == pytest.approx(np.quantile(g.amount, 0.99))
        red = g[g.direction == 1].amount
        assert row["amount"]["redemption"]["log1p_quantiles"]["p25"] == pytest.approx(np.quantile(np.log1p(red), 0.25))
        assert [b["n"] for b in row["amount_histogram"]] == np.histogram(g.amount, bins=20)[0].tolist()
        by_day = g.groupby(g.ts.dt.date).size()
        assert row["daily_count_quantiles"]["p90"] == pytest.approx(np.quantile(by_day, 0.9))
    assert p.product_profile(df, min_count=200).count() == 1
    lines = [r["line"] for r in p.report_lines(p.product_profile(df)).where("product_id = 'a'").orderBy("line_no").collect()]
    assert lines[0] == "## a" and lines[1].startswith("- records: ") and len(lines) == 9


def shape_input(spark):
    """Products of all shapes: many rows, one row, one value, no amounts, no key, other directions, days without a date."""
    rng = np.random.default_rng(7)
    rows = [("big", int(i), float(x)) for i, x in enumerate(np.round(rng.gamma(2, 100, 3000), 1))]
    rows += [("one", 5, 7.5), *[("flat", i, 3.25) for i in range(40)], *[("none", i, None) for i in range(4)], *[(None, i, float(i % 7)) for i in range(30)]]
    df = spark.createDataFrame(rows, "product_id string, i int, amount double")
    return rows, df.withColumn("direction", F.when(F.col("i") % 11 != 10, F.col("i") % 4 - 1)).withColumn("status", F.col("i") % 2).withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i") * 40_000)).withColumn("date", F.when(F.col("i") % 13 != 0, F.to_date("ts")))


def test_profile_in_many_ranges_equals_numpy(spark):
    rows, df = shape_input(spark)
    direction = {i: None if i % 11 == 10 else i % 4 - 1 for _, i, _ in rows}
    frames = [p.product_profile(df, segments=s).select("product_id", "n_records", "txns_per_year", "amount", "amount_histogram").collect() for s in (1, 9)]
    for found in frames:
        assert len(found) == 5
        for r in found:
            mine = [(i, x) for k, i, x in rows if k == r["product_id"]]
            assert r["n_records"] == len(mine) and sum(r["txns_per_year"].values()) == sum(i % 13 != 0 for i, _ in mine)
            if r["product_id"] == "none":
                assert r["amount"] is None and r["amount_histogram"] is None
                continue
            values = {"all": [x for _, x in mine], **{n: [x for i, x in mine if direction[i] == d] for n, d in (("purchase", 0), ("redemption", 1))}}
            assert set(r["amount"]) == {n for n, x in values.items() if x}
            assert [b["n"] for b in r["amount_histogram"]] == np.histogram(values["all"], bins=20)[0].tolist()
            for name, facts in r["amount"].asDict().items() if hasattr(r["amount"], "asDict") else r["amount"].items():
                x = np.array(values[name])
                assert facts["n"] == len(x) and facts["mean"] == pytest.approx(x.mean())
                assert facts["std"] is None if len(x) == 1 else facts["std"] == pytest.approx(x.std(ddof=1), abs=1e-9)
                for i, (q, prob) in enumerate(zip(PROFILE_NAMES, PROFILE_PROBS)):
                    assert facts["quantiles"][q] == pytest.approx(np.quantile(x, prob))
                    assert facts["log1p_quantiles"][q] == pytest.approx(np.quantile(np.log1p(x), prob))


def test_profile_tasks_hold_a_fixed_share_of_the_rows(spark, monkeypatch):
    """A task's share must not grow with the table, nor shrink the count of tasks because the rows compress well."""
    _, df = shape_input(spark)
    monkeypatch.setattr(segments, "ROWS_OF_A_TASK", 100)
    seen = []
    real = p.materialise
    monkeypatch.setattr(p, "materialise", lambda x: (seen.append(real(x)), seen[-1])[1])
    p.product_profile(df).collect()
    (dealt,) = [x for x in seen if segments.SEG in x.columns]
    shares = [r["count"] for r in dealt.groupBy(segments.SEG).count().collect()]
    assert len(shares) >= 20 and max(shares) <= 400


def test_fourteen_digits_are_read_as_the_format_reads_them(spark):
    texts = ["20240229235959", "20230229000000", "20241301000000", "20240131240000", "20240131236000", "20240131235960", "10000101000000", "99991231235959",
             "20240400000000", "20240101000000.0", "19700101000000"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    plain = F.try_to_timestamp(F.trim("t").try_cast("double").try_cast("bigint").cast("string"), F.lit("yyyyMMddHHmmss"))
    rows = cleaning.parse_time(df, "t").select("ts", plain.alias("want"), F.col("ts").eqNullSafe(plain).alias("same")).collect()
    assert all(r["same"] for r in rows) and sum(r["ts"] is None for r in rows) == 6


def test_profile_has_no_row_level_column(spark):
    _, df = profile_input(spark)
    assert not {"cust_id", "ts", "amount_raw"} & set(p.product_profile(df).columns)


def test_describe_equals_pandas(spark):
    frame, df = profile_input(spark)
    row = p.describe(df, [], "amount").first().asDict()
    want = frame.amount.describe()
    assert np.allclose([row[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")], want.values)


def test_ks_equals_definition(spark):
    frame, df = profile_input(spark)
    a, b = (np.sort(frame[frame.direction == d].amount) for d in (0, 1))
    grid = np.sort(frame.amount)
    want = np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)).max()
    for cut in ({}, {"segments": 6}):
        assert quality.ks_distance(df, "direction", "amount", **cut).first()["ks"] == pytest.approx(want)


def test_gates(spark):
    df = spark.createDataFrame([("a", 1, 0, 5.0)] * 9 + [("a", 0, 1, 5.0)], "product_id string, status int, direction int, aum_after double")
    rows = {r["gate"]: r for r in quality.gates(df).collect()}
    assert rows["fail_rate"]["passed"] and not rows["redemption_share"]["passed"] and rows["min_balance"]["passed"]
    strict = {r["gate"]: r["passed"] for r in quality.gates(df.withColumn("status", F.lit(0)), limits=quality.STRICT_LIMITS).collect()}
    assert not strict["fail_rate"]
    bad = {r["gate"]: r["passed"] for r in quality.gates(df.withColumn("aum_after", F.lit(-1.0))).collect()}
    assert not bad["min_balance"]


def test_coverage(spark):
    df = spark.createDataFrame([(t,) for t, n in (("x", 90), ("y", 6), ("z", 4)) for _ in range(n)], "token string")
    assert vocab.min_k(df).first()["min_k"] == 2
    assert vocab.topk_coverage(df, 1).first()["coverage"] == pytest.approx(0.9)
    coded = vocab.encode(df, vocab.build_vocab(df, 2)).groupBy("token_id").count().collect()
    assert {r["token_id"]: r["count"] for r in coded} == {1: 90, 2: 6, 0: 4}


def test_transition_rows_sum_to_one(spark):
    pairs = spark.createDataFrame([(a, (a * b) % 4) for a in range(4) for b in range(9)], "s int, t int")
    sums = vocab.transitions(pairs, "s", "t").groupBy("s").agg(F.sum("p").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in sums)
    loss = vocab.cross_entropy(pairs.withColumnsRenamed({"s": "f", "t": "next_f"}), {"f": 4}, {"f": 0.5}, smoothing=0.0)
    got = {r["field"]: r["loss"] for r in loss.collect()}
    counts = pairs.toPandas().groupby(["s", "t"]).size()
    want = -(counts * np.log(counts / counts.groupby("s").transform("sum"))).sum() / counts.sum()
    assert got["f"] == pytest.approx(want) and got["total"] == pytest.approx(want / 2)


def test_top_n_filters_before_it_picks(spark):
    rows = [("x", None), ("y", -1.0)] + [(f"bad{i}", 100.0 + i) for i in range(40)] + [(f"{i:06d}", float(i)) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "code string, v double")
    got = [r["code"] for r in vocab.top_n(df, "v", ["code"], 20, F.col("code").rlike(r"^\d{6}$")).collect()]
    assert got == [f"{i:06d}" for i in range(40, 20, -1)]


def test_codes_stay_distinct_with_seven_digits(spark):
    ids = spark.createDataFrame([(i,) for i in (7, 1_000_007, 1_000_008, 123_456)], "cust_id long")
    assert [r["code"] for r in ids.select(tables.code_of("cust_id")).collect()] == ["000007", "1000007", "1000008", "123456"]


def test_bin_labels_stay_distinct_beyond_a_hundred(spark):
    labels = [r["l"] for r in spark.range(128).select(tokens.bin_label(F.col("id")).alias("l")).collect()]
    assert len(set(labels)) == 128 and labels[5] == "A05" and labels[100] == "A100"


def test_merge_keeps_rows_without_group(spark):
    client = spark.createDataFrame([("a", 2, 1700000000, 0, 5.0)], "product_id string, group_id int, txn_ts bigint, txn_type int, amount double")
    market = spark.createDataFrame([("510300", "2024-01-01", 1, "7.5", 9, 0)], "product_id string, date string, direction int, amount string, product_type int, risk_level int")
    rows = {r["product_id"]: r for r in corpus.harmonise([corpus.from_client(client), corpus.from_market(market)]).collect()}
    assert rows["a"]["group_id"] == 2 and (rows["a"]["product_type"], rows["a"]["risk_level"]) == (1, 2)
    m = rows["510300"]
    assert (m["group_id"], m["product_type"], m["risk_level"], m["amount_bin"]) == (0, 5, 1, 0)
    with pytest.raises(ValueError):
        corpus.from_market(market.drop("risk_level"))


def test_orders_mapping(spark):
    rows = [("536365", "2010-12-01 08:26:00", "85123A", 6, 2.5, 17850), ("C536379", "2010-12-01 09:41:00", "85123A", -8, 2.0, 14527),
            ("536370", "2010-12-01 08:45:00", "22728", 0, 3.0, 12583), ("536371", None, "22728", 1, 3.0, 12583),
            ("536372", "2010-12-01 08:45:00", "22728", 24, -3.0, 12583), ("536373", "2010-12-31 23:45:00", "22728", 24, 3.75, None)]
    df = spark.createDataFrame(rows, "InvoiceNo string, d string, StockCode string, Quantity int, UnitPrice double, CustomerID bigint")
    df = df.withColumn("InvoiceDate", F.col("d").cast("timestamp")).drop("d")
    got = mapping.from_orders(df).orderBy("ts").collect()
    assert len(got) == 2
    first, second = got
    assert (first["direction"], first["status"], first["amount"], first["dt_prev_sec"], first["aum_after"]) == (0, 1, 15.0, 0, 15.0)
    assert (second["direction"], second["status"], second["amount"], second["dt_prev_sec"], second["aum_after"]) == (1, 0, 16.0, 4500, 0.0)
    assert first["ts"] == 1291191960 and [r["__row_id__"] for r in got] == [0, 1] and first["amount_bin"] == 0
    assert got[0].asDict().keys() == set([*mapping.WIDE_COLUMNS, "__row_id__"])


def test_quotes_mapping(spark):
    prices = spark.createDataFrame([("510300", "2024-03-29", 10.0, 11.0, 100.0), ("510300", "2024-03-31", 11.0, 10.0, 300.0),
                                    ("518880", "2024-03-29", 0.0, 4.0, 50.0), ("518880", "2024-03-30", 4.0, 4.0, 0.0)],
                                   "code string, date string, open double, close double, amount double")
    quotes = spark.createDataFrame([("510300", "沪深300ETF", 5.0), ("999999", "x", 1.0)], "code string, name string, main_net double")
    got = {(r["product_id"], r["dom"]): r for r in mapping.from_quotes(prices, quotes).collect()}
    a, b, c = got[("510300", 29)], got[("510300", 31)], got[("518880", 29)]
    assert len(got) == 3
    assert (a["direction"], a["product_type"], a["risk_level"], a["cust_type"], a["hour_bin"]) == (0, 2, 4, 1, 5)
    assert (b["direction"], b["dt_prev_sec"], b["aum_after"], b["is_quarter_end"]) == (1, 2 * 86400, 0.0, 1)
    assert (c["yield_rate"], c["product_type"], c["cust_type"]) == (None, 2, 0)


def scored(spark, truth, pred):
    rows = [("p", 0, i, "purchase_log1p", 1, float(a), float(b)) for i, (a, b) in enumerate(zip(truth, pred))]
    return spark.createDataFrame(rows, "product_id string, group_id int, date int, kind string, horizon int, truth double, pred double")


def test_scores_by_hand(spark):
    row = fc.metrics(scored(spark, [1, 2, 3], [1, 3, 2])).first()
    assert (row["mae"], row["rmse"], row["wape"], row["dir_acc"]) == (
        pytest.approx(2 / 3), pytest.approx(math.sqrt(2 / 3)), pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert fc.metrics(scored(spark, [1], [1])).first()["dir_acc"] == 0.0


def test_huber(spark):
    assert fc.huber_loss(scored(spark, [0, 0], [0.5, 2])).first()["huber"] == pytest.approx((0.125 + 1.5) / 2)


def summary_of(spark, a, b):
    rows = [("A", s, v) for s, v in enumerate(a)] + [("B", s, v) for s, v in enumerate(b)]
    df = spark.createDataFrame(rows, "method string, seed int, value double").withColumns(
        {"kind": F.lit("purchase_log1p"), "horizon": F.lit(1), "metric": F.lit("wape")})
    return fc.seed_summary(df)


def test_seed_summary_and_comparison(spark):
    s = summary_of(spark, [1.0, 3.0], [5.0, 7.0])
    row = s.where("method = 'A'").first()
    assert (row["mean"], row["std"], row["values"]) == (2.0, 1.0, [1.0, 3.0])
    assert fc.significant(s, "A", "B").first()["significant"]
    assert not fc.significant(summary_of(spark, [0.0, 2.0], [1.0, 3.0]), "A", "B").first()["significant"]
    assert fc.relative_diff(s, "A", "B").first()["diff_pct"] == pytest.approx(-400 / 6)
    assert fc.converged(s, "A", "B").first()["converged"] and not fc.converged(s, "B", "A").first()["converged"]
    assert fc.converged(s, "C", "B").first()["converged"] is None


def test_early_stop_margin_is_a_recursion(spark):
    losses = [1.0, 1.0 - 6e-6, 1.0 - 1.2e-5, 0.9, 0.95, 0.95, 0.95, 0.1]
    history = [(i + 1, 0.0, x) for i, x in enumerate(losses)]
    df = spark.createDataFrame([("m", 1, history)], "method string, seed int, history array<struct<epoch int, train_loss double, val_loss double>>")
    row = fc.early_stop(df, patience=3).first()
    assert (row["best_loss"], row["best_epoch"], row["stop_epoch"], row["n_epochs"]) == (0.9, 4, 7, 8)
    assert fc.early_stop(df, patience=15).first()["stop_epoch"] is None


def test_curve_band_allows_ragged_runs(spark):
    schema = "method string, seed int, history array<struct<epoch int, train_loss double, val_loss double>>"
    df = spark.createDataFrame([("m", 1, [(1, 1.0, 2.0), (2, 1.0, 4.0)]), ("m", 2, [(1, 3.0, 4.0)])], schema)
    rows = fc.curve_band(df).orderBy("epoch").collect()
    assert [(r["n_runs"], r["val_loss_mean"], r["val_loss_std"]) for r in rows] == [(2, 3.0, 1.0), (1, 4.0, 0.0)]


def test_naive_forecast_defaults_and_noise(spark):
    train = spark.createDataFrame([("a", 0, 10.0, 0.0), ("a", 0, 20.0, 0.0)], "product_id string, group_id int, purchase double, redemption double")
    samples = spark.createDataFrame([("a", 0), ("b", 0)], "product_id string, group_id int")
    got = {r["product_id"]: r for r in fc.naive_forecast(train, samples).collect()}
    assert got["a"]["pred_purchase_log1p"] == pytest.approx(math.log1p(15)) and got["b"]["pred_purchase_log1p"] == 0.0
    one, two = ([r["pred_purchase_log1p"] for r in fc.naive_forecast(train, samples, seed=s, noise=0.02).orderBy("product_id").collect()] for s in (1, 1))
    other = fc.naive_forecast(train, samples, seed=2, noise=0.02).orderBy("product_id").first()["pred_purchase_log1p"]
    assert one == two and one[0] != other and abs(one[0] / math.log1p(15) - 1) < 0.2


def test_long_and_wide_are_inverse(spark):
    rows = [("p", 0, "2024-01-01", k, h, float(h), float(-h)) for k in fc.KINDS for h in fc.HORIZONS]
    long = spark.createDataFrame(rows, "product_id string, group_id int, date string, kind string, horizon int, truth double, pred double")
    assert sorted(map(tuple, fc.to_long(fc.to_wide(long)).collect())) == sorted(rows)


def test_files_round_trip(spark, tmp_path):
    meta = {"A1": {"product_type_name": "固收", "product_type_id": 1, "risk_level": 2, "min_holding_days": 180},
            "B2": {"product_type_id": 3, "risk_level": 4}}
    (tmp_path / "meta.json").write_text(json.dumps(meta, indent=2, ensure_ascii=False), encoding="utf-8")
    got = {r["product_id"]: r for r in readers.read_meta(spark, str(tmp_path / "meta.json")).collect()}
    assert got["A1"]["product_type"] == 1 and got["A1"]["min_holding_days"] == 180 and got["B2"]["risk_level"] == 4

    (tmp_path / "a.csv").write_text("产品代码,交易时间,业务类型,确认金额\nP,20240101000000,申购,10\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("产品代码,交易时间,业务类型,确认金额,备注\nQ,20240102000000,赎回,x,hi\n", encoding="utf-8")
    raw = readers.read_raw_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    rows = {r["product_id"]: r for r in cleaning.canonical_ledger(raw).collect()}
    assert (rows["P"]["__src_file__"], rows["P"]["direction"], rows["P"]["status"], rows["P"]["amount"]) == ("a.csv", 0, 1, 10.0)
    assert rows["Q"]["amount"] is None and rows["Q"]["direction"] == 1

    df = spark.createDataFrame([(i, "train" if i < 8 else "val", 0, float(i)) for i in range(10)], "i int, split string, direction int, x double")
    readers.write_split(df, str(tmp_path / "split"))
    back = readers.read_parquet(spark, str(tmp_path / "split")).where("split = 'val'")
    assert back.count() == 2 and (tmp_path / "split" / "split=val").is_dir()

    edges = q.fit_bins(df, ["direction"], "x", 4)
    readers.write_json(readers.edge_state(edges, "amount", 4, "direction"), str(tmp_path / "state"))
    stored = readers.edges_for(readers.read_state(spark, str(tmp_path / "state")), "amount", "direction")
    assert stored.first()["edges"] == edges.first()["edges"]

    runs = spark.createDataFrame([("m", 1, 0.5, 1.0, [(1, 0.1, 0.2)], {"purchase|1": (1.0, 2.0, 3.0, 4.0)})], readers.RUN_SCHEMA)
    readers.write_json(runs, str(tmp_path / "runs"))
    assert readers.read_runs(spark, str(tmp_path / "runs")).collect() == runs.collect()

    readers.write_sample(df, str(tmp_path / "sample"), ["i", "x"], ["i"], 3)
    text = next((tmp_path / "sample").glob("part-*.csv")).read_text()
    assert text.splitlines() == ["i,x", "0,0.0", "1,1.0", "2,2.0"]

    lines = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one")], "product_id string, line_no int, line string")
    readers.write_report(lines, str(tmp_path / "report"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "report").glob("part-*"))) == "one\ntwo\n"


def test_group_daily_defaults(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 0, 10.0), ("a", "2024-01-01", 1, 30.0)], "product_id string, d string, direction int, amount double")
    row = rollup.group_daily(df.withColumn("date", F.to_date("d"))).first()
    assert (row["group_id"], row["net"], row["n_txn"], row["yield_rate"], row["direction"], row["product_type"], row["risk_level"]) == (0, -20.0, 2, 0.02, 1, 1, 2)


def test_trees_learn_what_the_features_determine(spark):
    rows = [("p", 0, i, 0, 3, 1, 2, i % 7, i % 28, 0, 0, 5, 0.02, float(i % 5), float(i % 3)) for i in range(400)]
    daily = spark.createDataFrame(rows, "product_id string, group_id int, date int, direction int, amount_bin int, product_type int, risk_level int, dow int, dom int, "
                                        "is_month_end int, is_quarter_end int, n_txn int, yield_rate double, purchase_log1p double, redemption_log1p double")
    feats = fc.window_features(daily).withColumn("planted_h0", F.when(F.col("dow_last") >= 5, 4.0).otherwise(1.0)).withColumn("none_h0", F.lit(None).cast("double"))
    out = fc.fit_trees(feats, feats, [(fc.KINDS[0], 1), ("planted", 0), ("none", 0)], rounds=6, depth=2, rate=0.5)
    assert out.groupBy("kind").count().count() == 2 and out.count() == 2 * feats.count()
    assert out.where("kind = 'planted'").agg(F.max(F.abs(F.col("truth") - F.col("pred")))).first()[0] < 0.3


def test_files_of_one_folder_are_read_by_their_own_headers(spark, tmp_path):
    for name, text in (("a.csv", "a,b,c\n1,2,3\n4,5\n"), ("b.csv", "c,a\n30,10\n31,x,9\n"), ("c.csv", "\ufeffa,b,c\n\"7,5\",8,n/a\n"), ("d.csv", "a\n")):
        (tmp_path / name).write_text(text)
    read = readers.read_raw_files(spark, [str(tmp_path)])
    assert {(r["a"], r["b"], r["c"], r["__src_file__"]) for r in read.collect()} == {
        ("1", "2", "3", "a.csv"), ("4", "5", None, "a.csv"), ("10", None, "30", "b.csv"), ("x", None, "31", "b.csv"), ("7,5", "8", "n/a", "c.csv")}
    bad = readers.quarantined(spark, [str(tmp_path)], ["a", "c"])
    assert {tuple(r) for r in bad.collect()} == {("a.csv", "columns", "4,5"), ("b.csv", "columns", "31,x,9"), ("c.csv", "number a", "7,5"), ("c.csv", "number c", "n/a")}


def test_a_code_with_two_quotes_is_an_error(spark):
    from flowlytics.operators import mapping

    prices = spark.createDataFrame([("1", "2024-01-01", "1", "2", "5")], "code string, date string, open string, close string, amount string")
    quotes = spark.createDataFrame([("1", "n", "3"), ("1", "m", "3")], "code string, name string, main_net string")
    with pytest.raises(ValueError):
        mapping.from_quotes(prices, quotes)


def test_headers_without_sorting_lines(spark, tmp_path):
    """Only the number of the first line is aggregated; a text in the buffer would sort all lines of a task."""
    for name, lines in (("a.csv", "x,y\n1,2\n3,4\n"), ("b.csv", "y,x\n"), ("c.csv", "x,y\n5,6\n")):
        (tmp_path / name).write_text(lines)
    found = readers.header_inventory(spark, [str(tmp_path)])
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["file"].rsplit("/", 1)[1]: r["header"] for r in found.collect()} == {"a.csv": "x,y", "b.csv": "y,x", "c.csv": "x,y"}
