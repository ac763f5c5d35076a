"""Ordered segments, so that no window runs over one unbounded group.

A window ``partitionBy(keys).orderBy(order)`` puts a whole key in one task. With a third of a ledger under one product that
task never ends. ``segmented`` deals the rows out by ranges of (keys, order) instead and stages them; the number of a range is
a row's segment, so segments have about the same size whatever the keys are, and rise with the order within each key. A window
then runs per (keys, segment), and what a range needs from the ranges before it (a last value, a running sum, a minimum) comes
from a summary with one row per segment of a key that spans several.

There is one plan for every size. Segments are as many as ``spark.sql.shuffle.partitions`` and the adaptive coalescing make
them, so these settings bound a task. The summary has at most two rows per segment more than there are segments; it is a table in the
shared folder and is joined without a hint.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlytics.sources.stage import materialise

SEG = "_seg"
ROWS_OF_A_TASK = 400_000
ROWS_OF_A_SHUFFLE = 150_000_000
SEGMENTS_OF_A_SLICE = 1 << 20


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str],
              how: str = "left", prefix: str = "_r_") -> DataFrame:
    """Equi-join in which null keys match each other; the right copy of the keys is dropped."""
    renamed = right.withColumnsRenamed({k: prefix + k for k in keys})
    condition = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[prefix + k])
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[prefix + k for k in keys])


def salted_lookup(big: DataFrame, small: DataFrame, keys: Sequence[str],
                  how: str = "left", salts: int = 16) -> DataFrame:
    """Join with a side that has one row per key but no proven size.

    Each row of ``small`` is repeated per salt and each row of ``big`` takes one salt
    from its own content, so a key with a third of all rows spreads over ``salts`` tasks.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return same_keys(salted, copies, [*keys, "_salt"], how).drop("_salt")


def tasks_for(staged: DataFrame) -> int:
    """Tasks that take the rows of a staged table in shares of a fixed size, whatever the session's shuffle partitions are
    and however well the rows compress (runs a count). Small tables get a task for each core at most."""
    n, cores = staged.count(), staged.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // ROWS_OF_A_TASK), min(cores, -(-n // 10_000)))


def slices_for(staged: DataFrame) -> int:
    """Slices of a staged table of which each goes through a shuffle by itself, so that the disk holds a shuffle of a fixed
    number of rows, however many there are (runs a count)."""
    return max(1, -(-staged.count() // ROWS_OF_A_SHUFFLE))


def sliced(df: DataFrame, keys: Sequence[str], slices: int) -> list[DataFrame]:
    """The rows in slices by a hash of the keys; rows of equal keys share one."""
    number = F.pmod(F.xxhash64(*keys), F.lit(slices))
    return [df.where(number == i) for i in range(slices)] if slices > 1 else [df]


def _ranges(df: DataFrame, key: str, slices: int) -> list[DataFrame]:
    """The rows in slices of rising values of the key, nulls in the first. The values at which a slice ends come from some
    thousand rows; they move rows between slices and nothing else."""
    some = df.select(key).where(F.col(key).isNotNull()).sample(min(1.0, 20_000 / max(df.count(), 1)), seed=1).sort(key).collect()
    ends = [some[len(some) * i // slices][0] for i in range(1, slices)] if some else []
    number = sum((F.when(F.col(key) > F.lit(end), 1).otherwise(0) for end in ends), F.lit(0))
    return [df.where(number == i) for i in range(slices)]


@dataclass(frozen=True)
class Segmented:
    """Staged rows with ``_seg`` (rising with keys and order)."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    slices: int = 1

    def map(self, rows: DataFrame) -> Segmented:
        """The same segments with other columns beside."""
        return Segmented(rows, self.keys, self.order, self.slices)

    def whole(self, rows: DataFrame) -> Segmented:
        """The same segments as parts of one series of all keys, in the order of keys and order."""
        return Segmented(rows, (), (*self.keys, *self.order), self.slices)

    def parts(self) -> list[DataFrame]:
        """The rows by the slices in which they were dealt out; the files of other slices are skipped by their statistics."""
        first = [i * SEGMENTS_OF_A_SLICE for i in range(self.slices + 1)]
        return [self.rows.where((F.col(SEG) >= lo) & (F.col(SEG) < hi)) for lo, hi in zip(first, first[1:])]

    def window(self, ordered: bool = True):
        w = Window.partitionBy(SEG, *self.keys)  # in this order rows sorted by a window over whole segments need no other sort
        return w.orderBy(*self.order) if ordered else w

    def carry_window(self):
        """Over the summary rows of one key, in segment order."""
        return Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(SEG)

    def carry(self, summary: dict[str, Column], *carried: dict[str, Column]) -> Segmented:
        """Brings columns over from earlier or later segments of the same key.

        ``summary`` are aggregates per (keys, segment); ``carried`` are window expressions over ``carry_window()``, later
        groups building on earlier ones. In a key of one segment the carried columns are null, so only rows of the keys that
        span several are summarised; between two neighbouring segments there is at most one such key.
        """
        names = [n for group in carried for n in group]
        rows = self.rows
        if self.keys:
            ends = rows.groupBy(*self.keys).agg(F.min(SEG).alias("_lo"), F.max(SEG).alias("_hi"))
            rows = same_keys(rows, materialise(ends.where("_lo < _hi").select(*self.keys)), self.keys, "left_semi")
        table = rows.groupBy(*self.keys, SEG).agg(*[c.alias(n) for n, c in summary.items()])
        for group in carried:
            table = table.withColumns(group)
        table = materialise(table.select(*self.keys, SEG, *names))
        return self.map(same_keys(self.rows, table, [*self.keys, SEG], "left"))


def dealt_out(df: DataFrame, columns: Sequence[str], segments: int | None = None) -> DataFrame:
    """Rows dealt out by ranges of the columns, not staged yet, with the number of their range. Where the columns are keys, a
    window over them needs no other exchange, and each key lies in one range whole."""
    ranged = df.repartitionByRange(*([segments] if segments else []), *[F.col(c).asc_nulls_first() for c in columns])
    return ranged.withColumn(SEG, F.spark_partition_id())


def segmented(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, segments: int | None = None,
              codec: str | None = None, slices: int = 1) -> Segmented:
    """Rows dealt out by ranges of (keys, order) and staged with their segment (runs jobs for the ranges and the table).

    ``order`` should identify a row within its key; rows that are equal in keys and order stay together. ``segments`` sets the
    number of ranges; by default the session does. ``codec`` is that of ``materialise``. ``slices`` of the first column are dealt
    out one after another, each into segments of its own.
    """
    columns = [*keys, *order]
    if slices > 1:
        parts = [dealt_out(part, columns, segments).withColumn(SEG, F.col(SEG) + i * SEGMENTS_OF_A_SLICE)
                 for i, part in enumerate(_ranges(df, columns[0], slices))]
    else:
        parts = dealt_out(df, columns, segments)
    staged = materialise(parts, codec) if codec else materialise(parts)
    return Segmented(staged, tuple(keys), tuple(order), slices)
