"""Token statistics: frequency, coverage, vocabulary, next-token counts.

Rows are counted down to distinct tokens first; ranks and running counts go over segments of the
frequency order, so a free-text token column is no single task either.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlytics.operators.segments import segmented

# Weight of each token field in the next-token loss.
FIELD_WEIGHTS = {"direction": 1.0, "amount_bin": 0.3, "product_type": 0.1, "risk_level": 0.1}


def token_frequency(df: DataFrame, token: str = "token") -> DataFrame:
    return df.groupBy(token).agg(F.count(F.lit(1)).alias("n"))


def ranked_tokens(df: DataFrame, token: str = "token", **cut) -> DataFrame:
    """Frequency with rank (count down, then token), running and total count."""
    freq = token_frequency(df, token)
    seg = segmented(freq.withColumn("_o", -F.col("n")), [], ["_o", token], **cut)
    upto, whole = seg.window().rowsBetween(W.unboundedPreceding, 0), seg.window(ordered=False)
    seg = seg.map(seg.rows.withColumns({"_r": F.row_number().over(seg.window()), "_c": F.sum("n").over(upto), "_t": F.sum("n").over(whole)}))
    before = seg.carry_window().rowsBetween(W.unboundedPreceding, -1)
    every = seg.carry_window().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = seg.carry({"_rows": F.count(F.lit(1)), "_sum": F.sum("n")}, {
        "_br": F.sum("_rows").over(before), "_bc": F.sum("_sum").over(before), "_all": F.sum("_sum").over(every)}).rows
    zero = F.lit(0)
    return rows.select(token, "n", (F.col("_r") + F.coalesce("_br", zero)).cast("int").alias("rank"),
                       (F.col("_c") + F.coalesce("_bc", zero)).alias("cum"), F.coalesce("_all", "_t").alias("total"))


def top_tokens(df: DataFrame, k: int, token: str = "token") -> DataFrame:
    return token_frequency(df, token).orderBy(F.col("n").desc(), token).limit(k)


def topk_coverage(df: DataFrame, k: int, token: str = "token") -> DataFrame:
    """Distinct tokens, rows covered by the k most frequent, and their share."""
    return ranked_tokens(df, token).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.max("total").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("n"))), F.lit(0)).alias("covered"),
    ).withColumn("coverage", F.col("covered") / F.col("n_rows"))


def min_k(df: DataFrame, target: float = 0.95, token: str = "token") -> DataFrame:
    """Smallest number of most frequent tokens that reaches the target share."""
    reached = F.col("cum") / F.col("total") >= target
    return ranked_tokens(df, token).agg(F.min(F.when(reached, F.col("rank"))).alias("min_k"))


def build_vocab(df: DataFrame, k: int, token: str = "token") -> DataFrame:
    """token_id by frequency, 1..k; id 0 stands for anything else."""
    return ranked_tokens(df, token).where(F.col("rank") <= k).select(token, F.col("rank").alias("token_id"), "n")


def encode(df: DataFrame, vocab: DataFrame, token: str = "token", unknown: int = 0) -> DataFrame:
    """Adds token_id; the optimizer broadcasts the vocabulary where its size allows."""
    return df.join(vocab.select(token, "token_id"), token, "left").withColumn(
        "token_id", F.coalesce("token_id", F.lit(unknown)))


def transitions(pairs: DataFrame, current: str, following: str, smoothing: float = 0.0,
                states: int | None = None) -> DataFrame:
    """P(next | current) by counting, with additive smoothing over ``states`` codes."""
    counts = pairs.groupBy(current, following).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(current))
    size = states or 0
    return counts.withColumn("p", (F.col("n") + smoothing) / (total + smoothing * size))


def cross_entropy(pairs: DataFrame, fields: Mapping[str, int], weights: Mapping[str, float] = FIELD_WEIGHTS,
                  smoothing: float = 1.0, prefix: str = "next_") -> DataFrame:
    """Loss of the counting model per field and the weighted total (field 'total').

    The pairs are counted once over all fields; each field's table is a regrouping of that.
    """
    names = list(fields)
    joint = pairs.groupBy(*names, *[prefix + f for f in names]).agg(F.count(F.lit(1)).alias("n"))
    parts = None
    for f, states in fields.items():
        cell = joint.groupBy(F.col(f).alias("_c"), F.col(prefix + f).alias("_d")).agg(F.sum("n").alias("n"))
        given = F.sum("n").over(W.partitionBy("_c"))
        p = (F.col("n") + smoothing) / (given + smoothing * states)
        loss = cell.select("n", p.alias("p")).agg(
            (-F.sum(F.col("n") * F.log("p")) / F.sum("n")).alias("loss")
        ).select(F.lit(f).alias("field"), "loss", F.lit(float(weights[f])).alias("weight"))
        parts = loss if parts is None else parts.unionByName(loss)
    total = parts.agg(F.sum(F.col("loss") * F.col("weight")).alias("loss"), F.sum("weight").alias("weight")).select(
        F.lit("total").alias("field"), "loss", "weight")
    return parts.unionByName(total)


def top_n(df: DataFrame, value: str, tie: Sequence[str], n: int, valid: Column | None = None) -> DataFrame:
    """The n largest positive values among the valid rows; fewer only where there are fewer."""
    rows = df.where(F.col(value) > 0)
    return (rows if valid is None else rows.where(valid)).orderBy(F.col(value).desc(), *tie).limit(n)


def sample_rows(df: DataFrame, key: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """k rows that depend only on the seed and the row keys."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    return df.orderBy(draw, *key).limit(k)
