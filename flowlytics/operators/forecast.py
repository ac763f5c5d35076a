"""Forecast baselines and their evaluation.

Predictions are kept in long form: product_id, group_id, date, kind, horizon, truth, pred.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlytics.functions import values as v
from flowlytics.operators.series import change_sign, history_windows
from flowlytics.sources.stage import materialise, shared_folder

KINDS = ("purchase_log1p", "redemption_log1p")
HORIZONS = (1, 7, 30)
SERIES = ["product_id", "group_id"]
POINT = [*SERIES, "date"]
# The ten features of a history window.
FEATURES = ["direction", "amount_bin", "product_type", "risk_level", "dow", "dom",
            "is_month_end", "is_quarter_end", "n_txn", "yield_rate"]


def naive_means(train: DataFrame) -> DataFrame:
    """log1p of the mean purchase and redemption per series."""
    return train.groupBy(*SERIES).agg(
        v.log_amount(F.avg("purchase"), None).alias(KINDS[0]),
        v.log_amount(F.avg("redemption"), None).alias(KINDS[1]))


def jitter(seed: int, scale: float, keys: Sequence[str]) -> Column:
    """Reproducible multiplicative noise from the keys: 1 + scale * N(0, 1)."""
    def uniform(tag: str) -> Column:
        h = F.pmod(F.xxhash64(F.lit(f"{tag}:{seed}"), *keys), F.lit(1 << 30))
        return (h + 0.5) / float(1 << 30)

    normal = F.sqrt(-2 * F.log(uniform("r"))) * F.cos(2 * F.pi() * uniform("a"))
    return 1 + F.lit(scale) * normal


def naive_forecast(train: DataFrame, samples: DataFrame, seed: int = 0, noise: float = 0.0) -> DataFrame:
    """samples with pred_{kind}: the series mean on train, 0 for an unseen series, same for all horizons."""
    means = naive_means(train)
    if noise:
        means = means.withColumns({k: F.col(k) * jitter(seed, noise, [*SERIES, F.lit(k)]) for k in KINDS})
    named = means.withColumnsRenamed({k: f"pred_{k}" for k in KINDS})
    return samples.join(named, SERIES, "left").na.fill(0.0, [f"pred_{k}" for k in KINDS])


def labels_long(samples: DataFrame, extra: Sequence[str] = (), horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """One row per sample, kind and horizon; label columns are {kind}_h{h}."""
    entries = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(h).alias("horizon"), F.col(f"{k}_h{h}").alias("truth"))
        for k in KINDS for h in horizons])
    return samples.select(*POINT, *extra, F.explode(entries).alias("_e")).select(*POINT, *extra, "_e.*")


def naive_long(train: DataFrame, samples: DataFrame, **kw) -> DataFrame:
    preds = [f"pred_{k}" for k in KINDS]
    long = labels_long(naive_forecast(train, samples, **kw), preds)
    pred = F.when(F.col("kind") == KINDS[0], F.col(preds[0])).otherwise(F.col(preds[1]))
    return long.withColumn("pred", pred).drop(*preds)


def align(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = (*POINT, "kind", "horizon")) -> DataFrame:
    """Predictions with their truth by key."""
    return truth.join(pred, list(keys), "inner")


def window_features(daily: DataFrame, features: Sequence[str] = FEATURES, hist_len: int = 30,
                    horizons: Sequence[int] = HORIZONS, groups: int = 8) -> DataFrame:
    """Per sample: mean, population std and last value of each feature over its history, one-hot group
    and the labels. Window aggregates only; no array of the history is built."""
    extra = {}
    for c in features:
        extra[f"{c}_mean"] = lambda w, c=c: F.avg(F.col(c).cast("double")).over(w)
        extra[f"{c}_std"] = lambda w, c=c: F.stddev_pop(F.col(c).cast("double")).over(w)
        extra[f"{c}_last"] = lambda w, c=c: F.last(F.col(c).cast("double")).over(w)
    rows = history_windows(daily, SERIES, "date", features, KINDS, hist_len, horizons, extra).drop("features")
    return rows.select("*", *[(F.pmod(F.col("group_id"), F.lit(groups)) == g).cast("int").alias(f"group_{g}")
                              for g in range(groups)])


def feature_names(features: Sequence[str] = FEATURES, groups: int = 8) -> list[str]:
    return [f"{c}_{s}" for s in ("mean", "std", "last") for c in features] + [f"group_{g}" for g in range(groups)]


def fit_trees(train: DataFrame, test: DataFrame, targets: Sequence[tuple[str, int]] | None = None, *,
              rounds: int = 200, depth: int = 6, rate: float = 0.05, seed: int = 0, parallel: int = 3) -> DataFrame:
    """Gradient-boosted trees per target on window features, fitted by Spark on all labelled rows; all test rows are scored.

    The fits of ``parallel`` targets run side by side. Lineage is cut every ten rounds in the checkpoint folder; the session's
    own is used where it names one. A target without any labelled row is left out.
    """
    targets = list(targets or [(k, h) for k in KINDS for h in HORIZONS])
    names, labels = feature_names(), [f"{k}_h{h}" for k, h in targets]
    spark = train.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/trees")
    row = VectorAssembler(inputCols=names, outputCol="x")

    def assembled(df: DataFrame) -> DataFrame:
        whole = df.select(*POINT, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names], *[F.col(c).cast("double") for c in labels])
        return row.transform(whole).select(*POINT, "x", *labels)

    learn = materialise(assembled(train).drop(*POINT))
    known = learn.agg(*[F.count(c).alias(c) for c in labels]).first()

    def fit(label: str) -> GBTRegressionModel:
        trees = GBTRegressor(featuresCol="x", labelCol=label, predictionCol=f"p_{label}", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed,
                             maxBins=64, minInstancesPerNode=20, checkpointInterval=10)
        return trees.fit(learn.where(F.col(label).isNotNull()).select("x", label))

    fitted = [label for label in labels if known[label]]
    with ThreadPool(parallel) as pool:
        models = pool.map(inheritable_thread_target(spark)(fit), fitted)
    scored = assembled(test)
    for model in models:
        scored = model.transform(scored)
    entries = [F.struct(F.lit(k).alias("kind"), F.lit(h).alias("horizon"), F.col(label).alias("truth"), F.col(f"p_{label}").alias("pred"))
               for (k, h), label in zip(targets, labels) if label in fitted]
    return scored.select(*POINT, F.explode(F.array(*entries)).alias("e")).select(*POINT, "e.*")


def metrics(pred: DataFrame, by: Sequence[str] = ("kind", "horizon"), order: Sequence[str] = tuple(POINT),
            log_space: bool = True, per_series: bool = False, **cut) -> DataFrame:
    """MAE, RMSE, WAPE and DirAcc per group.

    log_space=False scores money (expm1) instead. DirAcc compares the signs of change along
    ``order``; per_series restarts at each series.
    """
    by = list(by)
    x = {c: F.col(c) if log_space else F.expm1(c) for c in ("truth", "pred")}
    rows = pred.withColumns({f"_{c}": e for c, e in x.items()})
    keys = [*by, *[s for s in SERIES if s not in by]] if per_series else by
    rest = [c for c in order if c not in keys]
    signs = change_sign(rows, keys, rest, {"_sp": "_pred", "_st": "_truth"}, **cut)
    err = F.col("_pred") - F.col("_truth")
    n = F.count(F.lit(1))
    return signs.groupBy(*by).agg(
        n.alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.sum(F.abs(err)) / F.greatest(F.sum(F.abs("_truth")), F.lit(1e-6))).alias("wape"),
        F.when(n > 1, v.share(F.col("_sp") == F.col("_st"))).otherwise(F.lit(0.0)).alias("dir_acc"))


METRICS = ("mae", "rmse", "wape", "dir_acc")


def metrics_long(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.unpivot(list(keys), list(METRICS), "metric", "value")


def seed_summary(runs: DataFrame, seed: str = "seed",
                 by: Sequence[str] = ("method", "kind", "horizon", "metric"), value: str = "value") -> DataFrame:
    """Mean, population std and the list of values over seeds (a handful per group)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(seed, value))), lambda e: e[value])
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                 F.count(value).alias("n_seeds"), listed.alias("values"))


def huber(residual: Column | str, delta: float = 1.0) -> Column:
    r = F.abs(residual)
    return F.when(r <= delta, 0.5 * r * r).otherwise(delta * (r - 0.5 * delta))


def huber_loss(pred: DataFrame, by: Sequence[str] = ("kind", "horizon")) -> DataFrame:
    """Mean Huber loss per target."""
    return pred.groupBy(*by).agg(F.avg(huber(F.col("pred") - F.col("truth"))).alias("huber"))


def mean_huber(pred: DataFrame) -> DataFrame:
    return huber_loss(pred).agg(F.avg("huber").alias("loss"))


def curve_band(runs: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Mean and population std of the losses per epoch over runs; runs may differ in length."""
    points = runs.select(*by, F.explode("history").alias("h"))
    return points.groupBy(*by, F.col("h.epoch").alias("epoch")).agg(
        F.count(F.lit(1)).alias("n_runs"),
        *[f(F.col(f"h.{c}")).alias(f"{c}_{n}") for c in ("train_loss", "val_loss")
          for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def early_stop(runs: DataFrame, patience: int = 15, margin: float = 1e-5) -> DataFrame:
    """Best loss, its epoch and the stopping epoch per run, from the stored history array.

    A loss counts as better only by more than the margin, so the rule is a true recursion over the
    epochs; it folds the array of one run (an epoch list, already one value of one row).
    """
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("best_epoch"),
                     F.lit(0).alias("stale"), F.lit(0).alias("stop"))

    def step(acc: Column, h: Column) -> Column:
        done = acc["stop"] > 0
        better = h["val_loss"] < acc["best"] - margin
        stale = F.when(better, 0).otherwise(acc["stale"] + 1)
        moved = F.struct(
            F.when(better, h["val_loss"]).otherwise(acc["best"]).alias("best"),
            F.when(better, h["epoch"]).otherwise(acc["best_epoch"]).alias("best_epoch"),
            stale.alias("stale"),
            F.when(stale >= patience, h["epoch"]).otherwise(F.lit(0)).alias("stop"))
        return F.when(done, acc).otherwise(moved)

    ordered = F.array_sort("history", lambda a, b: a["epoch"] - b["epoch"])
    end = F.aggregate(ordered, start, step)
    keys = [c for c in runs.columns if c not in ("history", "metrics")]
    return runs.select(*keys, F.size("history").alias("n_epochs"), end.alias("_e")).select(
        *keys, "n_epochs", F.col("_e.best").alias("best_loss"), F.col("_e.best_epoch").alias("best_epoch"),
        F.when(F.col("_e.stop") > 0, F.col("_e.stop")).alias("stop_epoch"))


def best_run(runs: DataFrame, by: Sequence[str] = ("method",), loss: str = "best_val_loss", seed: str = "seed") -> DataFrame:
    """Seed with the smallest validation loss; the smaller seed on a tie."""
    return runs.groupBy(*by).agg(F.min_by(seed, F.struct(loss, seed)).alias("best_seed"), F.min(loss).alias(loss))


def _versus(summary: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """Both methods side by side per key, in one aggregation instead of a self join."""
    def of(m: str, c: str) -> Column:
        return F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{c}_{'a' if m == a else 'b'}")

    return summary.where(F.col("method").isin(a, b)).groupBy(*keys).agg(
        of(a, "mean"), of(a, "std"), of(b, "mean"), of(b, "std"))


TARGET = ("kind", "horizon", "metric")


def significant(summary: DataFrame, a: str, b: str, keys: Sequence[str] = TARGET) -> DataFrame:
    """A beats B beyond the bands: mean + std of A below mean - std of B."""
    return _versus(summary, a, b, keys).withColumn(
        "significant", F.col("mean_a") + F.col("std_a") < F.col("mean_b") - F.col("std_b"))


def relative_diff(summary: DataFrame, a: str, b: str, keys: Sequence[str] = TARGET) -> DataFrame:
    """A minus B, absolute and in percent of B."""
    return _versus(summary, a, b, keys).select(
        *keys, "mean_a", "mean_b", (F.col("mean_a") - F.col("mean_b")).alias("delta"),
        (F.try_divide(F.col("mean_a") - F.col("mean_b"), F.col("mean_b")) * 100).alias("diff_pct"))


def converged(summary: DataFrame, model: str, naive: str, factor: float = 1.5, kind: str = KINDS[0],
              horizon: int = 1) -> DataFrame:
    """Whether the model's WAPE stays within factor x naive on one target; null if either is absent."""
    one = summary.where((F.col("kind") == kind) & (F.col("horizon") == horizon) & (F.col("metric") == "wape"))
    return one.agg(
        F.max(F.when(F.col("method") == model, F.col("mean"))).alias("model_wape"),
        F.max(F.when(F.col("method") == naive, F.col("mean"))).alias("naive_wape"),
    ).withColumn("converged", F.col("model_wape") <= F.col("naive_wape") * factor)


def wape_table(summary: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """method x kind with mean and std per horizon, and the highest mean + std of the kind."""
    wape = summary.where(F.col("metric") == "wape")
    cells = [F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{c}_h{h}") for h in horizons for c in ("mean", "std")]
    table = wape.groupBy("method", "kind").agg(*cells, F.max(F.col("mean") + F.col("std")).alias("_top"))
    return table.withColumn("bound", F.max("_top").over(W.partitionBy("kind"))).drop("_top")


SHORT = {KINDS[0]: "pur", KINDS[1]: "red"}


def to_wide(long: DataFrame, keys: Sequence[str] = POINT, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """truth_/pred_{pur,red}_log1p_h{h} columns per sample."""
    def cell(c: str, k: str, h: int) -> Column:
        hit = (F.col("kind") == k) & (F.col("horizon") == h)
        return F.max(F.when(hit, F.col(c))).alias(f"{c}_{SHORT[k]}_log1p_h{h}")

    return long.groupBy(*keys).agg(*[cell(c, k, h) for k in KINDS for h in horizons for c in ("truth", "pred")])


def to_long(wide: DataFrame, keys: Sequence[str] = POINT, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(h).alias("horizon"),
                 F.col(f"truth_{SHORT[k]}_log1p_h{h}").alias("truth"),
                 F.col(f"pred_{SHORT[k]}_log1p_h{h}").alias("pred")) for k in KINDS for h in horizons])
    return wide.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")


def product_index(df: DataFrame, key: str = "product_id", **cut) -> DataFrame:
    """Dense index 0.. of the distinct keys in sorted order."""
    from flowlytics.operators.cleaning import dense_row_id

    return dense_row_id(df.select(key).distinct(), [key], "idx", **cut)
