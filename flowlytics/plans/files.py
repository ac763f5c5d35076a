"""Queries that go through files: data of the given tables is written to the shared folder by the sinks and read back by the
readers. Also the branches of the cleaning step that the other ledgers don't reach."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowlytics.functions import values as v
from flowlytics.operators import cleaning, profile as p, quantile as q, rollup, series, split
from flowlytics.plans import flows, jobs  # noqa: F401  (flows registers lead_labels)
from flowlytics.plans.buckets import LOGGED, logged
from flowlytics.plans.catalog import L, LK, ORACLE, TIE_COLUMNS, bin_of, fit_edges, register, rounded
from flowlytics.plans.forecasts import EPOCHS, runs
from flowlytics.sources import readers, tables as t
from flowlytics.sources.stage import shared_folder


def fresh(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@register("raw_files", """SELECT CAST(l_partkey AS VARCHAR) AS product_id, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS n_status,
  CAST(count(DISTINCT l_linestatus) AS BIGINT) AS n_headers FROM lineitem GROUP BY l_partkey""")
def raw_files(spark, d):
    """CSV exports with unequal columns, read together; open lines come without the status column."""
    raw, root = t.raw_ledger(spark, d), fresh(spark)
    done, open_ = raw.where("__src_file__ = 'F'").drop("__src_file__"), raw.where("__src_file__ = 'O'").drop("__src_file__", "交易状态")
    for name, part in (("done", done), ("open", open_)):
        part.write.option("header", True).csv(f"{root}/{name}")
    read = readers.read_raw_files(spark, [f"{root}/done", f"{root}/open"])
    return read.where(F.col("__src_file__").endswith(".csv")).groupBy(F.col("产品代码").alias("product_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count("交易状态").alias("n_status"), F.count_distinct(F.col("交易状态").isNull()).alias("n_headers"))


def mixed_folder(spark, d) -> str:
    """One folder of CSV exports with three headers, some lines with a field too few, some texts in the place of amounts."""
    rows, root = t.table(spark, d, "lineitem"), f"{fresh(spark)}/mixed"
    amount = F.when(F.col("l_discount") == 0, "n/a").otherwise(F.col("l_quantity").cast("string"))
    named = rows.select(F.col("l_partkey").cast("string").alias("产品代码"), amount.alias("确认金额"), F.col("l_linestatus").alias("交易状态"), "l_linestatus", "l_tax", "l_returnflag")
    parts = (named.where("l_linestatus = 'F'").select("产品代码", "确认金额", "交易状态"),
             named.where("l_linestatus = 'O' AND l_returnflag <> 'A' AND l_tax > 0").select("确认金额", "产品代码"))
    for part in parts:
        part.write.mode("append").option("header", True).csv(root)
    short = named.where("l_linestatus = 'O' AND (l_returnflag = 'A' OR l_tax = 0)")
    line = F.when(F.col("l_tax") == 0, F.col("产品代码")).otherwise(F.concat_ws(",", "产品代码", F.lit("x"), "确认金额")).alias("产品代码,渠道,确认金额")
    short.select(line).write.mode("append").option("header", True).option("quote", "\u0000").option("sep", "\t").csv(root)
    return root


@register("mixed_files", """SELECT CAST(l_partkey AS VARCHAR) AS product_id, count(*) AS n,
  CAST(sum(CASE WHEN l_discount <> 0 AND NOT (l_linestatus = 'O' AND l_tax = 0) THEN CAST(l_quantity AS DOUBLE) END) AS DOUBLE) AS quantity,
  count(*) FILTER (l_linestatus = 'F') AS n_status FROM lineitem GROUP BY l_partkey""")
def mixed_files(spark, d):
    """A folder whose files differ in columns and their order, each read by its own header."""
    read = readers.read_raw_files(spark, [mixed_folder(spark, d)])
    return read.groupBy(F.col("产品代码").alias("product_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v.to_number("确认金额")).alias("quantity"), F.count("交易状态").alias("n_status"))


@register("quarantined_rows", """SELECT reason, count(*) AS n, count(DISTINCT record) AS n_records FROM (
  SELECT 'columns' AS reason, CAST(l_partkey AS VARCHAR) AS record FROM lineitem WHERE l_linestatus = 'O' AND l_tax = 0
  UNION ALL SELECT 'number 确认金额', 'n/a' FROM lineitem WHERE l_discount = 0 AND NOT (l_linestatus = 'O' AND l_tax = 0)) GROUP BY reason""")
def quarantined_rows(spark, d):
    """What doesn't fit, with its reason: lines with a field too few, and texts that are no amounts."""
    bad = readers.quarantined(spark, [mixed_folder(spark, d)], ["确认金额"])
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record").alias("n_records"))


@register("run_logs", f"WITH {EPOCHS} SELECT method, CAST(seed AS BIGINT) AS seed, CAST(count(*) AS INTEGER) AS n_epochs, min(val_loss) AS best_val_loss FROM en GROUP BY method, seed")
def run_logs(spark, d):
    path = fresh(spark)
    readers.write_json(runs(spark, d), path)
    return readers.read_runs(spark, path).select("method", "seed", F.size("history").alias("n_epochs"), "best_val_loss")


@register("split_files", f"WITH {LK} SELECT direction, status, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM lk GROUP BY direction, status")
def split_files(spark, d):
    """A folder per part, read back with the part from the path."""
    path = fresh(spark)
    readers.write_split(t.ledger(spark, d, "key").select("direction", "status", "amount"), path, by="direction")
    return readers.read_parquet(spark, path).groupBy("direction", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


@register("replaced_split", f"WITH {LK} SELECT direction, count(*) AS n, CAST(sum(amount) * max(CASE direction WHEN 1 THEN 2 ELSE 1 END) AS DOUBLE) AS amount FROM lk GROUP BY direction")
def replaced_split(spark, d):
    """All splits written twice, then one of them anew: nothing doubles, and the other one stays."""
    path, rows = fresh(spark), t.ledger(spark, d, "key").select("direction", "status", "amount")
    for _ in range(2):
        readers.write_split(rows, path, by="direction")
    readers.write_split(rows.where("direction = 1").withColumn("amount", (F.col("amount") * 2).cast(rows.schema["amount"].dataType)), path, by="direction")
    return readers.read_parquet(spark, path).groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


@register("bucketed_days", ORACLE["lead_labels"])
def bucketed_days(spark, d):
    """Labels from a daily table that is stored by product and sorted by day; the window needs no exchange."""
    daily = rollup.daily_flow(t.ledger(spark, d, ok_only=True))
    stored = readers.write_bucketed(daily, f"daily_{uuid.uuid4().hex}", fresh(spark), ["product_id"], ["date"], 16)
    rows = series.lead_labels(stored, ["product_id"], "date", {"purchase_amt": "label_purchase", "redemption_amt": "label_redemption"}, (1, 7, 30))
    return rows.drop("purchase_amt", "redemption_amt", "net_amt")


@register("run_metrics", f"""WITH {EPOCHS}, b AS (SELECT method, CAST(seed AS BIGINT) AS seed, min(val_loss) AS best, CAST(count(*) AS DOUBLE) AS epochs FROM en GROUP BY method, seed)
SELECT method, seed, 'purchase' AS series, 'MAE' AS metric, best AS value FROM b UNION ALL SELECT method, seed, 'purchase', 'pinball@' || seed, epochs FROM b""")
def run_metrics(spark, d):
    """Metrics of run logs, one of them under a name that no schema knows."""
    path = fresh(spark)
    own = F.create_map(F.lit("MAE"), F.col("best_val_loss"), F.concat(F.lit("pinball@"), F.col("seed").cast("string")), F.size("history").cast("double"))
    readers.write_json(runs(spark, d).withColumn("metrics", F.create_map(F.lit("purchase"), own)), path)
    return readers.read_run_metrics(spark, path)


@register("state_file", f"""WITH {LK}, {LOGGED}, ed AS ({fit_edges('x', 'direction', 'amount_log1p', 16)})
SELECT x.direction, {bin_of('amount_log1p', 'edges')} AS amount_bin, count(*) AS n FROM x LEFT JOIN ed ON x.direction = ed.direction GROUP BY ALL""")
def state_file(spark, d):
    """Bucket edges through a JSON file, applied as at inference."""
    rows, path = logged(t.ledger(spark, d, "key")), fresh(spark)
    readers.write_json(readers.edge_state(q.fit_bins(rows, ["direction"], "amount_log1p", 16), "amount", 16, "direction"), path)
    edges = readers.edges_for(readers.read_state(spark, path), "amount", "direction")
    return q.apply_bins(rows, edges, ["direction"], "amount_log1p", 16, codes=q.DIRECTIONS).groupBy("direction", "amount_bin").agg(F.count(F.lit(1)).alias("n"))


@register("statistics_file", f"""WITH {L} SELECT product_id, count(*) AS n_records, avg(CASE WHEN direction = 0 THEN 1 ELSE 0 END) AS purchase_share
FROM l GROUP BY product_id""")
def statistics_file(spark, d):
    """The profile as JSON lines, nested fields included, read back."""
    ledger, path = t.ledger(spark, d).withColumn("ts", F.timestamp_seconds("txn_ts")), fresh(spark)
    readers.write_json(p.product_profile(ledger), path)
    return spark.read.json(path).select("product_id", "n_records", "purchase_share")


@register("suppressed_profile", f"""WITH {LK} SELECT product_id, count(*) AS n_records FROM lk GROUP BY product_id HAVING count(*) >= 33""")
def suppressed_profile(spark, d):
    """Small groups are hidden: products with fewer rows than the limit don't appear."""
    ledger = t.ledger(spark, d, "key").withColumn("ts", F.timestamp_seconds("txn_ts"))
    return p.product_profile(ledger, min_count=33).select("product_id", "n_records")


@register("sample_file", f"WITH {LK} SELECT product_id, CAST(date AS DATE) AS date, direction FROM lk ORDER BY txn_ts, {TIE_COLUMNS} LIMIT 50")
def sample_file(spark, d):
    """The first rows as one CSV file with a header."""
    path = fresh(spark)
    readers.write_sample(t.ledger(spark, d, "key", tie=True), path, ["product_id", "date", "direction", "txn_ts", *t.TIE], ["txn_ts", *t.TIE])
    return spark.read.option("header", True).csv(path).select("product_id", F.col("date").cast("date"), F.col("direction").cast("int"))


@register("training_gates", f"""WITH {LK}, w AS (SELECT * FROM lk WHERE amount > 0)
SELECT 'fail_rate' AS gate, round(avg(CASE WHEN status = 1 THEN 0 ELSE 1 END), 9) AS value FROM w
UNION ALL SELECT 'redemption_share', round(avg(CASE WHEN direction = 1 THEN 1 ELSE 0 END), 9) FROM w""")
def training_gates(spark, d):
    """The training job from ledger to gates, on customers and parts as dimensions."""
    rows = t.ledger(spark, d, "key", customer=True, tie=True)
    fact = rows.select(F.concat_ws("-", *t.TIE).alias("txn_id"), F.col("cust_id").cast("string").alias("cust_id_hash"), "product_id", "txn_ts",
                       F.col("direction").alias("txn_type"), F.col("status").alias("txn_status"), "amount", F.lit(0.0).alias("aum_after"))
    customer = t.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cust_id_hash"), t.position("c_mktsegment", t.SEGMENTS).alias("cust_type"))
    gates = jobs.training_tables(fact, t.dim_product(spark, d), customer).gates
    return rounded(gates.where(F.col("gate").isin("fail_rate", "redemption_share")).select("gate", "value"), 9, "value")


@register("privacy_report", """SELECT CAST(l_partkey AS VARCHAR) AS product_id, count(*) AS n_records FROM lineitem GROUP BY l_partkey HAVING count(*) >= 33""")
def privacy_report(spark, d):
    """The privacy job from raw files to the profile."""
    root = fresh(spark)
    t.raw_ledger(spark, d).drop("__src_file__").write.option("header", True).csv(root)
    profile, _ = jobs.privacy_profile(spark, [root], min_count=33)
    return profile.select("product_id", "n_records")


@register("time_formats", """SELECT CAST(make_timestamp((CAST(epoch(l_shipdate) AS BIGINT) + 1000000000) * 1000000) AS DATE) AS date, count(*) AS n_unix, count(*) AS n_iso,
  count(*) FILTER (l_linestatus = 'O') AS n_ok, count(*) FILTER (l_tax <> 0) AS n_number FROM lineitem GROUP BY 1""")
def time_formats(spark, d):
    """Epoch seconds (moved on, into the range that is read as such) and ISO text as times; status words, and numbers where no row has a word."""
    rows = t.table(spark, d, "lineitem").select(
        (F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + 1_000_000_000).cast("string").alias("unix"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("iso"),
        F.when(F.col("l_linestatus") == "O", "成功").otherwise("x").alias("word"), F.when(F.col("l_tax") == 0, "0").otherwise("1").alias("number"))
    for col in ("unix", "iso"):
        rows = cleaning.parse_time(rows, col, f"{col}_ts")
    for col in ("word", "number"):
        rows = cleaning.normalise_success(rows, col, f"{col}_ok")
    return rows.groupBy(F.to_date("unix_ts").alias("date")).agg(
        F.count("unix_ts").alias("n_unix"), F.count_if(F.unix_timestamp("iso_ts") + 1_000_000_000 == F.unix_timestamp("unix_ts")).alias("n_iso"),
        F.sum("word_ok").alias("n_ok"), F.sum("number_ok").alias("n_number"))


# a word of each rule, in their order, and one of none
FUND_WORDS = ["货币", "信用", "红利", "平衡", "沪深300", "半导体", "原油", "纳指", "远见"]
FUND_SQL = "\n".join(f"  WHEN {i} THEN {{{{'type': {kind}, 'risk': {risk}}}}}" for i, (kind, risk) in enumerate(
    [(0, 1), (1, 2), (4, 4), (3, 4), (2, 4), (2, 5), (5, 5), (6, 5), (2, 4)])).replace("{{", "{").replace("}}", "}")


@register("fund_rules", f"""WITH c AS (SELECT c_custkey % 9 AS word, CASE c_custkey % 9
{FUND_SQL} END AS rule FROM customer)
SELECT CAST(word AS INTEGER) AS word, CAST(rule.type AS INTEGER) AS type, CAST(rule.risk AS INTEGER) AS risk,
  CASE rule.type {" ".join(f"WHEN {i} THEN '{n}'" for i, n in v.TYPE_NAMES.items())} ELSE 'UNK' END AS type_name, count(*) AS n FROM c GROUP BY ALL""")
def fund_rules(spark, d):
    """Fund names classified by all eight rules and the fallback; the names hold the customers' segments."""
    word = (F.col("c_custkey") % 9).cast("int")
    name = F.concat_ws(" ", F.lit("基金"), F.element_at(F.array(*map(F.lit, FUND_WORDS)), word + 1), "c_mktsegment")
    rule = v.classify(F.col("name"), v.FUND_NAME_RULES)
    named = t.table(spark, d, "customer").select(word.alias("word"), name.alias("name")).select("word", rule["type"].alias("type"), rule["risk"].alias("risk"))
    return named.groupBy("word", "type", "risk", v.label_of("type", v.TYPE_NAMES).alias("type_name")).agg(F.count(F.lit(1)).alias("n"))
