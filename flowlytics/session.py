"""Session helpers shared by the bench, the tests and the registered queries."""

from __future__ import annotations

import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, tempfile.TemporaryDirectory] = {}

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BATCH_BYTES = 4_000_000


def ship_library(spark: SparkSession) -> SparkSession:
    """Gives the executors' Python workers this package, once for each application, and its rows in small batches."""
    if spark.sparkContext.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        folder = tempfile.TemporaryDirectory(prefix="flowlytics-")  # the driver serves the archive from it
        tree = shutil.copytree(package, f"{folder.name}/tree/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder.name}/{package.name}", "zip", Path(tree).parent))
        _shipped[spark.sparkContext.applicationId] = folder
    return bound_batches(spark)


def bound_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches by bytes: Spark's 10,000 whole texts are held in the JVM, off its heap, and in the worker, for every task.

    A smaller bound that the session has stays. Rows are never cut, so a longer one is a batch of its own.
    """
    if _bytes(spark.conf.get(BATCH_BYTES)) > MOST_BATCH_BYTES:
        spark.conf.set(BATCH_BYTES, str(MOST_BATCH_BYTES))
    return spark


def _bytes(size: str) -> int:
    """Bytes of a setting such as 64MB or 67108864."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def local_session(cpus: str = "8", app: str = "flowlytics", memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def pin_utc(spark: SparkSession) -> SparkSession:
    """Ledger times carry no zone, so epoch arithmetic is done in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
