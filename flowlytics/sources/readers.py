"""Reading and writing ledgers, metadata, bucket state, run logs and statistics."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowlytics.functions import values as v

CORRUPT = "__corrupt_record__"

META_SCHEMA = (
    "map<string, struct<product_type_name string, product_type_id int, risk_level int, min_holding_days int, "
    "is_t0 int, annualized_yield double, benchmark string, mu_amount_log double, sigma_amount double, "
    "monthly_txn_rate int, p_redemption_base double>>"
)
RUN_SCHEMA = (
    "method string, seed bigint, best_val_loss double, elapsed_sec double, "
    "history array<struct<epoch int, train_loss double, val_loss double>>, "
    "metrics map<string, struct<MAE double, RMSE double, WAPE double, DirAcc double>>"
)
EDGE_SCHEMA = "feature string, key string, bins int, edges array<double>"


def read_parquet(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*([path] if isinstance(path, str) else path))


def header_inventory(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, header: the first line of every CSV file below the paths, from the first block of each file."""
    lines = spark.read.text(list(paths), recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("id"))
    lines = lines.where("start = 0")
    # the number of the first line is a buffer of fixed size; taking the text along would sort all lines of a task
    first = lines.groupBy("file").agg(F.min("id").alias("id"))
    return lines.join(F.broadcast(first.select("id")), "id", "left_semi").select("file", F.col("value").alias("header"))


def _by_header(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their column names; the list of files is the driver's, as that of any scan."""
    alike: dict[tuple[str, ...], list[str]] = {}
    for row in header_inventory(spark, paths).orderBy("file").toLocalIterator():
        alike.setdefault(tuple(next(csv.reader([row["header"].lstrip("\ufeff")]), [])), []).append(row["file"])
    return alike


def read_raw_files(spark: SparkSession, paths: Sequence[str], fmt: str = "csv") -> DataFrame:
    """Raw files that may differ in columns and their order, each row with its file name.

    CSV files are read by the names in their own header, also where files of one folder differ. Files with the same header are
    read in one scan, so the plan has a branch per header and not per file. Rows whose number of fields differs from the
    header's stay, with nulls for what is missing; ``quarantined`` lists them.
    """
    if fmt == "csv":
        return _union(_scan(spark, header, files) for header, files in _by_header(spark, paths).items())
    alike: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        alike.setdefault(tuple(spark.read.format(fmt).load(path).columns), []).append(path)
    return _union(spark.read.format(fmt).load(same).select("*", F.col("_metadata.file_name").alias("__src_file__")) for same in alike.values())


def _scan(spark: SparkSession, header: Sequence[str], files: list[str], corrupt: str | None = None) -> DataFrame:
    """Files of one header as text columns. ``corrupt`` adds the lines that don't fit it; then no column is pruned, as only whole lines show that."""
    fields = StructType([StructField(c, StringType()) for c in [*header, *([corrupt] if corrupt else [])]])
    reader = spark.read.schema(fields).option("header", True).option("mode", "PERMISSIVE")
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt).option("columnPruning", False)
    return reader.csv(files).select("*", F.col("_metadata.file_name").alias("__src_file__"))


def _union(frames: Iterable[DataFrame]) -> DataFrame | None:
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def quarantined(spark: SparkSession, paths: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """Rows of CSV files that don't fit: __src_file__, reason, record.

    ``columns``: more or fewer fields than the file's header has (record is the line); ``number <column>``: a text in one of
    the columns ``numbers`` that is no number (record is the text). A row has one entry per reason.
    """
    def bad(header: Sequence[str], files: list[str]) -> DataFrame:
        rows = _scan(spark, header, files, CORRUPT)
        entries = [F.when(F.col(CORRUPT).isNotNull(), F.struct(F.lit("columns").alias("reason"), F.col(CORRUPT).alias("record")))]
        for c in numbers:
            if c in header:
                wrong = F.col(CORRUPT).isNull() & (F.trim(c) != "") & v.to_number(c).isNull()
                entries.append(F.when(wrong, F.struct(F.lit(f"number {c}").alias("reason"), F.col(c).alias("record"))))
        return rows.select("__src_file__", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("__src_file__", "e.*")

    return _union(bad(header, files) for header, files in _by_header(spark, paths).items())


def parse_meta(text: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects keyed by product id to one row per product."""
    parsed = F.from_json(F.col(column), META_SCHEMA)
    rows = text.select(F.explode(parsed).alias("product_id", "_m"))
    return rows.select("product_id", "_m.*").withColumnRenamed("product_type_id", "product_type")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return parse_meta(spark.read.text(path, wholetext=True))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path)


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """method, seed, series, metric, value of run logs; metric names are taken as they come, no schema lists them."""
    log = spark.read.text(path).select(F.try_parse_json("value").alias("log")).where("log IS NOT NULL")
    metrics = F.try_variant_get("log", "$.metrics", "map<string, map<string, double>>")
    rows = log.select(F.try_variant_get("log", "$.method", "string").alias("method"), F.try_variant_get("log", "$.seed", "bigint").alias("seed"), metrics.alias("m"))
    each = rows.select("method", "seed", F.explode("m").alias("series", "m"))
    return each.select("method", "seed", "series", F.explode("m").alias("metric", "value"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; nested statistics keep their structure."""
    df.write.mode(mode).json(path)


def write_split(df: DataFrame, path: str, by: str = "split", mode: str = "replace") -> None:
    """One directory per split; the split value lives in the path, not in the files.

    A split can hold most of the rows, so rows are not gathered by split: each task appends to the few splits it meets.
    ``replace`` puts the splits of ``df`` in the place of those of the same value and leaves the others alone, so that a second
    run gives the same content and one split can be written anew; other modes are those of Spark's writer.
    """
    writer = df.write.partitionBy(by)
    if mode == "replace":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, by: Sequence[str], order: Sequence[str], buckets: int = 64) -> DataFrame:
    """A catalog table dealt out by a hash of ``by`` and sorted within; joins and windows on ``by`` read it without an exchange.

    Rows are dealt out before the write, so each bucket is one file. The table replaces one of the same name.
    """
    by, order = list(by), list(order)
    dealt = df.repartition(buckets, *by)
    dealt.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by, *order).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def edge_state(edges: DataFrame, feature: str, bins: int, key: str | None = None) -> DataFrame:
    """Fitted edges in the stored layout: feature, key, bins, edges."""
    name = F.col(key).cast("string") if key else F.lit("")
    return edges.select(F.lit(feature).alias("feature"), name.alias("key"), F.lit(bins).alias("bins"), "edges")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGE_SCHEMA).json(path)


def edges_for(state: DataFrame, feature: str, key: str | None = None, key_type: str = "int") -> DataFrame:
    """Stored edges of one feature, ready for apply_bins."""
    rows = state.where(F.col("feature") == feature)
    return rows.select(*([F.col("key").cast(key_type).alias(key)] if key else []), "edges")


def write_sample(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], n: int = 50,
                 mode: str = "errorifexists") -> None:
    """First n rows as one CSV file with a header."""
    df.select(*columns).orderBy(*order).limit(n).coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_report(lines: DataFrame, path: str, order: Sequence[str] = ("product_id", "line_no"),
                 mode: str = "errorifexists") -> None:
    """Report lines as sorted text files, range-partitioned so that file order is line order."""
    lines.orderBy(*order).select("line").write.mode(mode).text(path)
