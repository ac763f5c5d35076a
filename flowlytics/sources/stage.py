"""Intermediate tables that several later steps read.

A roll-up that feeds split bounds, bucket edges and windows would otherwise be computed once per
reader. It is written once as parquet to the shared folder the session names in
``spark.checkpoint.dir``, so that a lost executor costs a re-read and not the lineage. All tables
of a session lie in one folder of its own there, which the file system deletes when the session's
JVM ends.

A long job would fill the disk with tables and shuffle files that nothing reads any more. The shuffle files of a table's own
write go as soon as it is written, ``discard`` deletes a table that has had its last reader, and ``settled`` the tables that
were staged on the way to another one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: dict[str, str] = {}
_own: list[tempfile.TemporaryDirectory] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_on_the_way: ContextVar[list[str] | None] = ContextVar("tables staged within settled", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session below ``spark.checkpoint.dir``.

    Where the setting is missing, a session in one process (tests, a laptop) gets a temporary
    folder; on a cluster, whose machines don't share one, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    key = f"{spark.sparkContext.applicationId} {named}"
    if key not in _folders:
        if not named:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _own.append(tempfile.TemporaryDirectory(prefix="flowlytics-"))
            named = _own[-1].name
        _folders[key] = f"{named.rstrip('/')}/flowlytics-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(_folders[key])
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _folders[key]


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go with the end of the write, not when the driver happens to collect its garbage."""
    kept = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, kept)


def materialise(df: DataFrame | Sequence[DataFrame], codec: str | None = None) -> DataFrame:
    """Writes the frame once and returns the reader of it (runs a job). ``codec`` is one of Parquet's, by default the session's.

    Several frames of one schema are written one after another to one table, so the disk holds the shuffle files of one.
    """
    parts = [df] if isinstance(df, DataFrame) else list(df)
    spark = parts[0].sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    for part in parts:
        with _shuffles_removed(spark):
            part.write.mode("append").options(**({"compression": codec} if codec else {})).parquet(path)
    staged = spark.read.schema(parts[0].schema).parquet(path)
    _paths[staged] = path
    if (tables := _on_the_way.get()) is not None:
        tables.append(path)
    return staged


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(staged: DataFrame) -> None:
    """Deletes the files of a frame that ``materialise`` returned, once no frame that is still to be run reads them."""
    _delete(staged.sparkSession, [_paths.pop(staged)])


def settled(make: Callable[[], DataFrame | Sequence[DataFrame]], codec: str | None = None) -> DataFrame:
    """The staged result of ``make``, as ``materialise`` writes it; the tables that it staged on the way are deleted (runs its jobs)."""
    outer = _on_the_way.get()
    token = _on_the_way.set([])
    try:
        staged = materialise(make(), codec)
        path = _paths[staged]
        _delete(staged.sparkSession, [p for p in _on_the_way.get() if p != path])
    finally:
        _on_the_way.reset(token)
    if outer is not None:
        outer.append(path)
    return staged
