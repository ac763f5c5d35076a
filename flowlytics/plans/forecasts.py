"""Registered queries: forecast baselines, their scores and the comparison of methods.

Two forecasters are compared: the train mean of each series, and the mean of each sample's own
history window (one of the window features). The customer group plays the part of the seed. Window
means are rounded: two equal means must compare as equal for the sign of change.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlytics.operators import cleaning, forecast as fc, series
from flowlytics.plans.buckets import binned_group_days
from flowlytics.plans.catalog import LG, at, register, rounded
from flowlytics.plans.sequences import BINNED_DAYS, LABEL_NAMES, SAMPLE_LABELS, SAMPLE_ROW, SAMPLE_WINDOW
from flowlytics.sources import tables as t
from flowlytics.sources.stage import materialise

SAMPLES = f"""{BINNED_DAYS}, sm AS (SELECT * FROM (SELECT split, product_id, group_id, date, {SAMPLE_LABELS},
  round(avg(purchase_log1p) OVER p, 10) AS mean_purchase, round(avg(redemption_log1p) OVER p, 10) AS mean_redemption, {SAMPLE_ROW} FROM bd {SAMPLE_WINDOW})
  WHERE t >= 30 AND t < len - 30 AND split = 'test'),
nm AS (SELECT product_id, group_id, ln(1 + avg(purchase)) AS pp, ln(1 + avg(redemption)) AS pr FROM bd WHERE split = 'train' GROUP BY ALL),
sp AS (SELECT sm.*, coalesce(pp, 0) AS pp, coalesce(pr, 0) AS pr FROM sm LEFT JOIN nm USING (product_id, group_id))"""


def long_sql(method: str, pur: str, red: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{method}' AS method, product_id, group_id, date, '{k}' AS kind, {h} AS horizon, {k}_h{h} AS truth, "
        f"{pur if k.startswith('purchase') else red} AS pred FROM sp" for k in fc.KINDS for h in fc.HORIZONS)


NAIVE = f"{SAMPLES}, nl AS ({long_sql('naive', 'pp', 'pr')})"
BOTH = f"{SAMPLES}, nl AS ({long_sql('naive', 'pp', 'pr')} UNION ALL {long_sql('window mean', 'mean_purchase', 'mean_redemption')})"


def score_sql(by: str, partition: str, source: str = "nl") -> str:
    return f"""sg AS (SELECT *, coalesce(sign(pred - lag(pred) OVER w), 0) AS spd, coalesce(sign(truth - lag(truth) OVER w), 0) AS st
  FROM {source} WINDOW w AS (PARTITION BY {partition} ORDER BY product_id, group_id, date)),
sc AS (SELECT {by}, count(*) AS n, avg(abs(pred - truth)) AS mae, sqrt(avg((pred - truth) * (pred - truth))) AS rmse,
  sum(abs(pred - truth)) / greatest(sum(abs(truth)), 1e-6::DOUBLE) AS wape,
  CASE WHEN count(*) > 1 THEN avg(CASE WHEN spd = st THEN 1 ELSE 0 END) ELSE 0 END AS dir_acc FROM sg GROUP BY {by})"""


def parts(spark, d):
    """Train days and test samples. Samples also carry the mean of each label over their window."""
    days = binned_group_days(spark, d)
    extra = {f"hist_{k}": (lambda w, k=k: F.round(F.avg(k).over(w), 10)) for k in fc.KINDS}
    samples = series.history_windows(days, ["split", *fc.SERIES], "date", fc.FEATURES, fc.KINDS, extra=extra)
    return days.where("split = 'train'"), samples.where("split = 'test'").drop("split", "features")


def both_methods(spark, d):
    train, samples = parts(spark, d)
    named = fc.naive_forecast(train, samples)
    long = fc.labels_long(named, [*[f"pred_{k}" for k in fc.KINDS], *[f"hist_{k}" for k in fc.KINDS]])
    first = F.col("kind") == fc.KINDS[0]
    options = F.array(
        F.struct(F.lit("naive").alias("method"),
                 F.when(first, F.col(f"pred_{fc.KINDS[0]}")).otherwise(F.col(f"pred_{fc.KINDS[1]}")).alias("pred")),
        F.struct(F.lit("window mean").alias("method"),
                 F.when(first, F.col(f"hist_{fc.KINDS[0]}")).otherwise(F.col(f"hist_{fc.KINDS[1]}")).alias("pred")))
    return long.select(*fc.POINT, "kind", "horizon", "truth", F.explode(options).alias("_o")).select(
        "_o.method", *fc.POINT, "kind", "horizon", "truth", "_o.pred")


@register("naive_forecast", f"WITH {NAIVE} SELECT product_id, group_id, date, kind, horizon, round(truth, 6) AS truth, round(pred, 6) AS pred FROM nl")
def naive_forecast(spark, d):
    return rounded(fc.naive_long(*parts(spark, d)), 6, "truth", "pred")


WF = ["n_txn", "amount_bin", "yield_rate"]


@register("window_features", f"""WITH {BINNED_DAYS}, s AS (SELECT product_id, group_id, date, split, {', '.join(
    f'avg({c}) OVER p AS {c}_mean, stddev_pop({c}) OVER p AS {c}_std, last_value({c}) OVER p AS {c}_last' for c in WF)}, {SAMPLE_ROW}
  FROM bd {SAMPLE_WINDOW})
SELECT split, product_id, group_id, date, {', '.join(f'round({c}_mean, 6) AS {c}_mean, round({c}_std, 6) AS {c}_std, round(CAST({c}_last AS DOUBLE), 6) AS {c}_last' for c in WF)},
  CAST(group_id % 8 = 0 AS INTEGER) AS group_0, CAST(group_id % 8 = 3 AS INTEGER) AS group_3 FROM s WHERE t >= 30 AND t < len - 30""")
def window_features(spark, d):
    days = binned_group_days(spark, d)
    names = [f"{c}_{s}" for c in WF for s in ("mean", "std", "last")]
    out = None
    for part in ("train", "val", "test"):
        rows = fc.window_features(days.where(F.col("split") == part)).select(
            F.lit(part).alias("split"), *fc.POINT, *names, "group_0", "group_3")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, 6, *names)


@register("tree_forecast", f"""WITH {NAIVE} SELECT kind, horizon, count(*) AS n, round(avg(truth), 6) AS truth_mean, round(avg(abs(truth - pred)), 6) AS naive_mae, TRUE AS good FROM nl GROUP BY kind, horizon
UNION ALL SELECT 'planted', 0, count(*), NULL, NULL, TRUE FROM nl WHERE kind = '{fc.KINDS[0]}' AND horizon = 1""")
def tree_forecast(spark, d):
    """Boosted trees on window features, all targets, and one planted target that the features determine (weekend and day of month of
    the last day). ``good``: the squared error stays below 1.05 times that of the train mean, for the planted target below a tenth of it,
    which a trainer that doesn't fit misses. The planted target has its row even where the test days are too few for a sample."""
    train, samples = parts(spark, d)
    days = materialise(binned_group_days(spark, d))
    planted = F.when(F.col("dow_last") >= 5, 4.0).otherwise(0.0) + F.col("dom_last") / 10
    fit_on, test = (materialise(fc.window_features(days.where(F.col("split") == s)).withColumn("planted_h0", planted)) for s in ("train", "test"))
    targets = [(k, h) for k in fc.KINDS for h in fc.HORIZONS] + [("planted", 0)]
    means = fit_on.agg(*[F.avg(f"{k}_h{h}").alias(f"{k}_h{h}") for k, h in targets]).first()
    mean = F.element_at(F.create_map(*[x for c in means.asDict() for x in (F.lit(c), F.lit(means[c]))]), F.concat("kind", F.lit("_h"), "horizon"))
    trees = fc.fit_trees(fit_on, test, targets, rounds=12, depth=4, rate=0.3, seed=7, parallel=4)
    fitted = trees.groupBy("kind", "horizon").agg(
        F.count("truth").alias("n"), F.round(F.avg(F.when(F.col("kind") != "planted", F.col("truth"))), 6).alias("truth_mean"),
        F.avg(F.pow(F.col("truth") - F.col("pred"), 2)).alias("error"), F.avg(F.pow(F.col("truth") - mean, 2)).alias("of_mean"))
    unseen = test.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("planted").alias("kind"), F.lit(0).alias("horizon"), "n")
    fitted = fitted.unionByName(unseen, allowMissingColumns=True)
    naive = fc.naive_long(train, samples).groupBy("kind", "horizon").agg(F.round(F.avg(F.abs(F.col("truth") - F.col("pred"))), 6).alias("naive_mae"))
    share = F.when(F.col("kind") == "planted", 0.1).otherwise(1.05)
    return fitted.join(naive, ["kind", "horizon"], "left").select("kind", "horizon", "n", "truth_mean", "naive_mae", F.coalesce(F.col("error") <= share * F.col("of_mean"), F.col("n") == 0).alias("good"))


@register("forecast_scores", f"""WITH {NAIVE}, {score_sql('kind, horizon', 'kind, horizon')}
SELECT kind, horizon, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(wape, 6) AS wape, round(dir_acc, 6) AS dir_acc FROM sc""")
def forecast_scores(spark, d):
    return rounded(fc.metrics(materialise(fc.naive_long(*parts(spark, d)))), 6, *fc.METRICS)


@register("money_scores", f"""WITH {NAIVE}, ml AS (SELECT product_id, group_id, date, kind, horizon, exp(truth) - 1 AS truth, exp(pred) - 1 AS pred FROM nl),
{score_sql('kind, horizon', 'kind, horizon, product_id, group_id', 'ml')} SELECT kind, horizon, n, round(wape, 6) AS wape, round(dir_acc, 6) AS dir_acc FROM sc""")
def money_scores(spark, d):
    """WAPE in money and direction per series, the stricter variant."""
    scored = fc.metrics(materialise(fc.naive_long(*parts(spark, d))), log_space=False, per_series=True)
    return rounded(scored, 6, "wape", "dir_acc").select("kind", "horizon", "n", "wape", "dir_acc")


SUMMARY = f"""{BOTH}, {score_sql('method, group_id, kind, horizon', 'method, group_id, kind, horizon')},
ml AS (UNPIVOT (SELECT method, group_id, kind, horizon, mae, rmse, wape, dir_acc FROM sc) ON mae, rmse, wape, dir_acc INTO NAME metric VALUE v),
su AS (SELECT method, kind, horizon, metric, avg(v) AS mean, stddev_pop(v) AS std, count(v) AS n_seeds, arg_min(v, group_id) AS first_value,
  arg_max(v, group_id) AS last_value FROM ml GROUP BY method, kind, horizon, metric)"""


def summary(spark, d):
    scored = fc.metrics(materialise(both_methods(spark, d)), ["method", "group_id", "kind", "horizon"])
    runs = fc.metrics_long(scored.drop("n"), ["method", "group_id", "kind", "horizon"])
    return fc.seed_summary(runs, "group_id")


@register("seed_summary", f"""WITH {SUMMARY} SELECT method, kind, horizon, metric, round(mean, 6) AS mean, round(std, 6) AS std, n_seeds,
  round(first_value, 6) AS first_value, round(last_value, 6) AS last_value FROM su""")
def seed_summary(spark, d):
    rows = summary(spark, d)
    return rounded(rows.select("*", at("values", 0).alias("first_value"), F.element_at("values", -1).alias("last_value")).drop("values"),
                   6, "mean", "std", "first_value", "last_value")


@register("significance", f"""WITH {SUMMARY} SELECT a.kind, a.horizon, a.metric, round(a.mean, 6) AS mean_a, round(a.std, 6) AS std_a, round(b.mean, 6) AS mean_b,
  round(b.std, 6) AS std_b, a.mean + a.std < b.mean - b.std AS significant FROM su a JOIN su b USING (kind, horizon, metric) WHERE a.method = 'window mean' AND b.method = 'naive'""")
def significance(spark, d):
    return rounded(fc.significant(summary(spark, d), "window mean", "naive"), 6, "mean_a", "std_a", "mean_b", "std_b")


@register("relative_difference", f"""WITH {SUMMARY} SELECT a.kind, a.horizon, a.metric, round(a.mean, 6) AS mean_a, round(b.mean, 6) AS mean_b,
  round(a.mean - b.mean, 6) AS delta, round((a.mean - b.mean) / b.mean * 100, 4) AS diff_pct FROM su a JOIN su b USING (kind, horizon, metric)
  WHERE a.method = 'window mean' AND b.method = 'naive'""")
def relative_difference(spark, d):
    rows = fc.relative_diff(summary(spark, d), "window mean", "naive")
    return rounded(rounded(rows, 6, "mean_a", "mean_b", "delta"), 4, "diff_pct")


@register("converged", f"""WITH {SUMMARY}, c AS (SELECT max(mean) FILTER (method = 'window mean') AS m, max(mean) FILTER (method = 'naive') AS n FROM su
  WHERE kind = 'purchase_log1p' AND horizon = 1 AND metric = 'wape') SELECT round(m, 6) AS model_wape, round(n, 6) AS naive_wape, m <= n * 1.5 AS converged FROM c""")
def converged(spark, d):
    return rounded(fc.converged(summary(spark, d), "window mean", "naive"), 6, "model_wape", "naive_wape")


@register("wape_table", f"""WITH {SUMMARY}, c AS (SELECT method, kind, {', '.join(
    f"max(mean) FILTER (horizon = {h}) AS mean_h{h}, max(std) FILTER (horizon = {h}) AS std_h{h}" for h in fc.HORIZONS)}, max(mean + std) AS top
  FROM su WHERE metric = 'wape' GROUP BY method, kind)
SELECT method, kind, {', '.join(f'round(mean_h{h}, 6) AS mean_h{h}, round(std_h{h}, 6) AS std_h{h}' for h in fc.HORIZONS)}, round(max(top) OVER (PARTITION BY kind), 6) AS bound FROM c""")
def wape_table(spark, d):
    rows = fc.wape_table(summary(spark, d))
    return rounded(rows, 6, "bound", *[f"{c}_h{h}" for h in fc.HORIZONS for c in ("mean", "std")])


@register("huber_loss", f"""WITH {NAIVE} SELECT kind, horizon, round(avg(CASE WHEN abs(pred - truth) <= 1 THEN 0.5::DOUBLE * (pred - truth) * (pred - truth)
  ELSE abs(pred - truth) - 0.5::DOUBLE END), 6) AS huber FROM nl GROUP BY kind, horizon""")
def huber_loss(spark, d):
    return rounded(fc.huber_loss(fc.naive_long(*parts(spark, d))), 6, "huber")


@register("prediction_table", f"""WITH {NAIVE} SELECT product_id, group_id, date, {', '.join(
    f"round(max({c}) FILTER (kind = '{k}' AND horizon = {h}), 6) AS {c}_{fc.SHORT[k]}_log1p_h{h}" for k in fc.KINDS for h in fc.HORIZONS for c in ('truth', 'pred'))}
FROM nl GROUP BY product_id, group_id, date""")
def prediction_table(spark, d):
    wide = fc.to_wide(fc.naive_long(*parts(spark, d)))
    return rounded(wide, 6, *[c for c in wide.columns if c.startswith(("truth_", "pred_"))])


@register("aligned_predictions", f"""WITH {NAIVE} SELECT product_id, group_id, date, kind, horizon, round(truth, 6) AS truth, round(pred, 6) AS pred FROM nl""")
def aligned_predictions(spark, d):
    """Wide predictions back to long form, matched with the truth by key."""
    long = fc.naive_long(*parts(spark, d))
    pred = fc.to_long(fc.to_wide(long)).drop("truth")
    return rounded(fc.align(pred, long.drop("pred")), 6, "truth", "pred")


@register("product_index", """SELECT CAST(l_partkey AS VARCHAR) AS product_id, row_number() OVER (ORDER BY CAST(l_partkey AS VARCHAR)) - 1 AS idx
FROM (SELECT DISTINCT l_partkey FROM lineitem)""")
def product_index(spark, d):
    return fc.product_index(t.ledger(spark, d, "key"))


# ---- run logs ---------------------------------------------------------------------------------

EPOCHS = f"""{LG}, ep AS (SELECT product_id AS method, group_id AS seed, CAST((year(date) - 1995) * 12 + month(date) AS INTEGER) AS epoch,
  CAST(sum(yield_rate) FILTER (direction = 0) AS DOUBLE) / count(*) FILTER (direction = 0) AS train_loss,
  CAST(sum(yield_rate) FILTER (direction = 1) AS DOUBLE) / count(*) FILTER (direction = 1) AS val_loss FROM lg GROUP BY 1, 2, 3),
en AS (SELECT * EXCLUDE (epoch), CAST(row_number() OVER (PARTITION BY method, seed ORDER BY epoch) AS INTEGER) AS epoch FROM ep WHERE val_loss IS NOT NULL)"""


def runs(spark, d):
    """A run per product type and group: one epoch per month, losses are mean yields by direction."""
    rows = t.ledger(spark, d, group=True)

    def loss(direction):
        hit = F.col("direction") == direction
        return F.sum(F.when(hit, F.col("yield_rate"))).cast("double") / F.nullif(F.count_if(hit), F.lit(0))

    month = ((F.year("date") - 1995) * 12 + F.month("date")).alias("month")
    monthly = rows.groupBy(F.col("product_id").alias("method"), F.col("group_id").alias("seed"), month).agg(
        loss(0).alias("train_loss"), loss(1).alias("val_loss")).where("val_loss IS NOT NULL")
    numbered = series.row_index(monthly, ["method", "seed"], ["month"], "epoch").withColumn("epoch", (F.col("epoch") + 1).cast("int"))
    return numbered.groupBy("method", "seed").agg(
        F.array_sort(F.collect_list(F.struct("epoch", "train_loss", "val_loss"))).alias("history"),
        F.min("val_loss").alias("best_val_loss"))


@register("curve_band", f"""WITH {EPOCHS} SELECT method, epoch, count(*) AS n_runs, round(avg(train_loss), 9) AS train_loss_mean, round(stddev_pop(train_loss), 9) AS train_loss_std,
  round(avg(val_loss), 9) AS val_loss_mean, round(stddev_pop(val_loss), 9) AS val_loss_std FROM en GROUP BY method, epoch""")
def curve_band(spark, d):
    return rounded(fc.curve_band(runs(spark, d)), 9, "train_loss_mean", "train_loss_std", "val_loss_mean", "val_loss_std")


@register("early_stop", f"""WITH RECURSIVE {EPOCHS}, n AS (SELECT method, seed, count(*) AS n_epochs, min(val_loss) AS best_val_loss FROM en GROUP BY ALL),
r AS (SELECT method, seed, 0 AS epoch, 'infinity'::DOUBLE AS best, 0 AS best_epoch, 0 AS stale, 0 AS stop FROM n
  UNION ALL SELECT r.method, r.seed, en.epoch, CASE WHEN val_loss < best - 1e-5::DOUBLE THEN val_loss ELSE best END,
    CASE WHEN val_loss < best - 1e-5::DOUBLE THEN en.epoch ELSE best_epoch END, CASE WHEN val_loss < best - 1e-5::DOUBLE THEN 0 ELSE stale + 1 END,
    CASE WHEN val_loss < best - 1e-5::DOUBLE THEN 0 WHEN stale + 1 >= 15 THEN en.epoch ELSE 0 END
  FROM r JOIN en ON en.method = r.method AND en.seed = r.seed AND en.epoch = r.epoch + 1 WHERE r.stop = 0)
SELECT r.method, r.seed, CAST(n_epochs AS INTEGER) AS n_epochs, best_val_loss, arg_max(best, epoch) AS best_loss, arg_max(best_epoch, epoch) AS best_epoch,
  nullif(max(stop), 0) AS stop_epoch FROM r JOIN n ON n.method = r.method AND n.seed = r.seed GROUP BY r.method, r.seed, n_epochs, best_val_loss""")
def early_stop(spark, d):
    return fc.early_stop(runs(spark, d))


@register("best_run", f"""WITH {EPOCHS}, n AS (SELECT method, seed, min(val_loss) AS best_val_loss FROM en GROUP BY ALL)
SELECT method, arg_min(seed, (best_val_loss, seed)) AS best_seed, min(best_val_loss) AS best_val_loss FROM n GROUP BY method""")
def best_run(spark, d):
    return fc.best_run(runs(spark, d))
