"""The end-to-end jobs: training tables, token corpus, forecast evaluation, privacy profile."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowlytics.functions import timefeat as tf
from flowlytics.functions import values as v
from flowlytics.operators import (
    cleaning, corpus, forecast as fc, joins, profile as p, quality, quantile as q, rollup, series, split,
)
from flowlytics.operators.segments import SEG, Segmented, dealt_out, segmented, sliced, slices_for
from flowlytics.sources import readers
from flowlytics.sources.stage import discard, materialise, settled

HORIZONS = (1, 7, 30)
AMOUNT_BINS, GAP_BINS, MIN_PURCHASE_BINS = 16, 8, 4
# whole ledgers are staged in a form that takes less disk than the session's
CODEC = "zstd"


@dataclass
class TrainingTables:
    txns: DataFrame
    daily: DataFrame
    bounds: DataFrame
    state: DataFrame
    gates: DataFrame
    join_misses: DataFrame
    dropped: DataFrame

    def write(self, path: str) -> None:
        """Writes all tables; a second run puts its own in their place."""
        readers.write_split(self.txns, f"{path}/txns")
        readers.write_split(self.daily, f"{path}/daily")
        readers.write_json(self.state, f"{path}/bucket_state", "overwrite")
        readers.write_json(self.gates, f"{path}/gates", "overwrite")


def training_tables(fact: DataFrame, product: DataFrame, customer: DataFrame, *, tie: Sequence[str] = ("txn_id",),
                    train: float = 0.8, val: float = 0.1, gap_days: int = 7,
                    mask_labels: bool = False, **cut) -> TrainingTables:
    """Ledger with its dimensions to split, bucketed rows and labelled days.

    ``fact`` has txn_id, cust_id_hash, product_id, txn_ts, txn_type, txn_status, amount, aum_after.
    Buckets are fitted on the train rows only. The cleaned and joined ledger is staged once, and misses and dropped rows are
    counted by that write as it passes them. Row number and gap come from one range partitioning of it; every later step reads
    its rows. The disk holds one shuffle of the ledger at a time, or of a slice of it where it is long, the table that it
    comes from and the one that it goes to: earlier tables are deleted. Calendar features and logs are made after the shuffles. ``mask_labels`` drops labels that reach
    into another split.
    """
    tie, pair = list(tie), ["cust_id_hash", "product_id"]
    seen: list[Observation] = []

    def cleaned() -> Iterator[DataFrame]:
        for joined in joins.join_dims_staged(fact, joins.require_unique(product, ["product_id"]),
                                             joins.require_unique(customer, ["cust_id_hash"]), codec=CODEC):
            named = cleaning.canonicalise(cleaning.drop_columns(joined), {"txn_type": "direction", "txn_status": "status"})
            seen.append(Observation())
            named = named.observe(seen[-1], *joins.miss_facts(["product_type", "cust_type"]), *cleaning.dropped_facts())
            yield cleaning.clean_basic(named).drop("date")

    clean = settled(lambda: list(cleaned()), CODEC)
    spark, slices = clean.sparkSession, slices_for(clean)
    facts = {name: sum(part.get[name] for part in seen) for name in seen[0].get}
    misses = joins.with_ratio(spark.createDataFrame([(facts["n_rows"], facts["n_missed"])], "n_rows long, n_missed long"))
    dropped = spark.createDataFrame([(facts["kept"], facts["dropped"])], "kept long, dropped long")
    seg = segmented(clean, pair, ["txn_ts", *tie], codec=CODEC, slices=slices, **cut)
    discard(clean)

    def numbered() -> list[DataFrame]:
        whole = seg.whole(seg.rows)
        rows = cleaning.dense_row_id(seg.rows, whole.order, seg=whole)
        rows = series.time_gap(rows, pair, "txn_ts", tie, seg=seg)
        return seg.map(tf.time_features(rows)).parts()

    timed = settled(numbered, CODEC)
    discard(seg.rows)
    own = [c for c in timed.columns if c not in (SEG, "__row_id__", "dt_prev_sec")]
    rows = timed.select(*own, "dt_prev_sec", "__row_id__").withColumns(
        {"amount_log1p": v.log_amount("amount"), "_gap": v.log_amount("dt_prev_sec")})

    bounds = split.split_bounds(rows, train, val, gap_days)
    rows = split.require_nonempty(split.assign_split(rows, bounds))
    if "min_purchase" in rows.columns:
        rows = rows.withColumn("_floor", v.log_amount("min_purchase"))
        floor_edges = settled(lambda: q.fit_bins(rows, [], "_floor", MIN_PURCHASE_BINS, **cut))
        binned = q.apply_bins(rows, floor_edges, [], "_floor", MIN_PURCHASE_BINS, "min_purchase_bin", missing=0).drop("_floor")
    else:
        binned = rows.withColumn("min_purchase_bin", F.lit(0))
    fit_on = rows.where("split = 'train'")
    amount_edges = settled(lambda: q.fit_bins(fit_on, ["direction"], "amount_log1p", AMOUNT_BINS, **cut))

    def edges() -> DataFrame:
        gap_edges = q.fit_bins(fit_on, [], "_gap", GAP_BINS, **cut)
        return readers.edge_state(amount_edges, "amount", AMOUNT_BINS, "direction").unionByName(
            readers.edge_state(gap_edges, "gap", GAP_BINS))

    state = settled(edges)
    binned = q.apply_bins(binned, readers.edges_for(state, "amount", "direction"), ["direction"], "amount_log1p",
                          AMOUNT_BINS, codes=q.DIRECTIONS)
    rows = q.apply_bins(binned, readers.edges_for(state, "gap"), [], "_gap", GAP_BINS, "dt_bin").drop("_gap")
    txns = rows.select(*[c for c in rows.columns if c != "__row_id__"], "__row_id__")

    labels = [f"label_{k}_{h}d" for k in ("purchase", "redemption") for h in HORIZONS]

    def labelled() -> DataFrame:
        # whole products are dealt out, so that the windows over a product and the segments need one shuffle of the days
        days = rollup.daily_context(
            rows, ["txn_ts", *tie], horizons=HORIZONS, keep=[SEG],
            between=lambda day: dealt_out(materialise(sliced(day, ["product_id"], slices), CODEC), ["product_id"], **cut))
        days = split.assign_split(days, bounds)
        if mask_labels:
            days = series.lead_labels(days.drop(*labels), ["product_id"], "date",
                                      {"purchase_amt": "label_purchase", "redemption_amt": "label_redemption"},
                                      HORIZONS, within="split")
        return days

    daily = settled(labelled, CODEC)
    order = ["product_id", "date"]
    daily = cleaning.dense_row_id(daily, order, seg=Segmented(daily, (), tuple(order))).drop(SEG)
    gates = quality.gates(rows, daily, labels[:3], **cut).unionByName(quality.bin_rows(amount_edges, AMOUNT_BINS, (0, 1)))
    return TrainingTables(txns, daily, bounds, state, gates, misses, dropped)


def token_corpus(client: DataFrame | None = None, meta: DataFrame | None = None, market: DataFrame | None = None,
                 **cut) -> DataFrame:
    """Client and market ledgers to one token corpus."""
    frames = []
    if client is not None:
        frames.append(corpus.from_client(client, meta))
    if market is not None:
        frames.append(corpus.from_market(market))
    return corpus.harmonise(frames, **cut)


@dataclass
class Evaluation:
    daily: DataFrame
    predictions: DataFrame
    scores: DataFrame
    summary: DataFrame
    products: DataFrame


def forecast_evaluation(ledger: DataFrame, meta: DataFrame | None = None, seeds: Sequence[int] = (0,), *,
                        trees: bool = True, noise: float = 0.0, rounds: int = 200, depth: int = 6,
                        rate: float = 0.05, hist_len: int = 30, **cut) -> Evaluation:
    """Group days, a 70/15/15 date split, the baselines per seed, and their scores over seeds.

    ``ledger`` has product_id, group_id, date, direction, amount, yield_rate. Windows stay within
    their split.
    """
    days = split.date_split(materialise(rollup.group_daily(ledger, meta)))
    edges = q.fit_bins(days.where("split = 'train'"), [], "amount_log1p", AMOUNT_BINS, **cut)
    days = q.apply_bins(days, edges, [], "amount_log1p", AMOUNT_BINS, missing=-1, offset=1)
    train_days = split.require_nonempty(days).where("split = 'train'")
    train, test = (materialise(fc.window_features(days.where(F.col("split") == s), hist_len=hist_len))
                   for s in ("train", "test"))
    frames = []
    for seed in seeds:
        named = [("naive", fc.naive_long(train_days, test, seed=seed, noise=noise))]
        if trees:
            named.append(("trees", fc.fit_trees(train, test, rounds=rounds, depth=depth, rate=rate, seed=seed)))
        frames += [df.select(F.lit(m).alias("method"), F.lit(seed).alias("seed"), *fc.POINT, "kind", "horizon",
                             "truth", "pred") for m, df in named]
    predictions = materialise(corpus.union_all(frames))
    scores = fc.metrics(predictions, ["method", "seed", "kind", "horizon"], **cut)
    summary = fc.seed_summary(fc.metrics_long(scores.drop("n"), ["method", "seed", "kind", "horizon"]))
    return Evaluation(days, predictions, scores, summary, fc.product_index(test))


def privacy_profile(spark: SparkSession, paths: Sequence[str], fmt: str = "csv",
                    overrides: Mapping[str, str] | None = None, min_count: int = 0, **cut) -> tuple[DataFrame, DataFrame]:
    """Raw files to the per-product profile and its report lines; only aggregates are returned."""
    raw = readers.read_raw_files(spark, paths, fmt)
    roles = {role: c for role, c in cleaning.detect_columns(raw.columns, overrides).items() if c}
    cleaning.canonical_ledger(raw, roles)  # names what is missing before anything runs
    # the files are parsed once; formats are decided and values read from the staged text
    text = materialise(raw.select(*[F.col("`" + c.replace("`", "``") + "`") for c in dict.fromkeys(roles.values())]))
    profile = materialise(p.product_profile(cleaning.canonical_ledger(text, roles), min_count=min_count, **cut))
    return profile, p.report_lines(profile)
