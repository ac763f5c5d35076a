"""Cross-site boilerplate removal by the spread of lines over sites.

A HyperLogLog sketch of the sites of each line is built in every task and merged by aggregation. Lines whose estimate lies
well above or below the least number of sites are decided by it; those near the limit get an exact distinct count. Lines on
that many sites or more are removed wherever they stand. Everything is made of built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlytics.sources.stage import materialise

MIN_SITES = 5
SKETCH_BITS = 10
NEAR = 0.25  # share of the limit on either side that counts as near; the sketch's error is about 3 %
LINE = ["h1", "h2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _exploded(docs: DataFrame) -> DataFrame:
    """Lines with words: doc_id, copy (hash of the text), site, pos, and the line's key (96 bits of hashes, ends trimmed)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"), "site", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    trimmed = F.btrim("line", F.lit(" \t\r"))
    return rows.withColumn("line", trimmed).filter("line <> ''").select("doc_id", "copy", "site", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def widespread_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys of the lines on at least ``min_sites`` distinct sites. ``docs``: doc_id, text, site."""
    lines = _exploded(docs)
    spread = lines.groupBy(*LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"))
    margin = max(1.0, NEAR * min_sites)
    candidates = materialise(spread.filter(F.col("sites") >= min_sites - margin))
    near = candidates.filter(F.col("sites") <= min_sites + margin).select(*LINE)
    counted = (lines.join(near, LINE, "left_semi").select(*LINE, "site").distinct()
               .groupBy(*LINE).agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites).select(*LINE))
    return candidates.filter(F.col("sites") > min_sites + margin).select(*LINE).unionAll(counted)


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text (without the widespread lines).

    Lines are cut at line feeds and compared without blanks, tabs and returns at their ends; empty lines always stay, and
    what stays is unchanged. A null text is empty and comes back empty; a null site is a site of its own. Repeated rows are
    cleaned each. An empty table gives no row. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("site"))
    wide = materialise(widespread_lines(rows, min_sites))
    gone = (_exploded(rows).join(wide, LINE, "left_semi").groupBy(F.col("doc_id").alias("of"), F.col("copy").alias("of_copy"))
            .agg(F.array_sort(F.collect_set("pos")).alias("gone")))
    # a byte per line up to the last removed one: 1 where the line goes
    runs = F.transform("gone", lambda g, i: F.concat(F.expr("repeat('0', 0)"), F.rpad(F.lit(""), g - F.when(i > 0, F.get("gone", i - 1) + 1).otherwise(0), "0"), F.lit("1")))
    masked = gone.select("of", "of_copy", F.size("gone").alias("n_removed"), F.array_join(runs, "").cast("binary").alias("mask"))
    every = rows.select("doc_id", "text", F.xxhash64("text").alias("copy"))
    joined = every.join(masked, every["doc_id"].eqNullSafe(masked["of"]) & (every["copy"] == masked["of_copy"]), "left")
    lines = _lines(F.col("text"))
    stays = F.filter(lines, lambda _, i: F.substring("mask", i + 1, 1) != F.lit(b"1"))
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                         F.when(F.col("mask").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("text"))
