"""Exact deduplication with counting quotient filters.

Every partition builds a counting quotient filter of the 64-bit fingerprints of its texts. A filter is held by blocks of the
quotient space; the blocks of all partitions merge without loss by their sorted remainders. A fingerprint with count one is
a text that occurs once, so its row is done. Rows with a higher count go on to byte verification: they are grouped by the
normalised text itself, with partial groups before the shuffle, so a text that holds a third of all rows is one row for each
task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlytics.llm.texts import fresh_name, small
from flowlytics.sources.stage import materialise

SPACE = "[\\x20\\x09-\\x0D]+"
BLOCK_ROWS = 50_000
LOCAL_BITS = 16
LEAST_BLOCK_BITS = 9
FILTER_ROWS = 4_000_000


class QuotientFilter:
    """Counting quotient filter: remainders sorted within their quotient, each with a count.

    The remainder keeps all bits that the quotient leaves, so no two fingerprints are confused and a merge loses nothing.
    """

    def __init__(self, bits: int, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.quotients, self.remainders, self.counts = bits, quotients, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, bits: int) -> QuotientFilter:
        values, counts = np.unique(fingerprints, return_counts=True)
        rest = np.uint64(64 - bits)
        return cls(bits, values >> rest, values & ((np.uint64(1) << rest) - np.uint64(1)), counts.astype(np.uint64))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Sorts the remainders of all filters within their quotients and adds the counts of equal ones."""
        q, r, n = (np.concatenate([getattr(f, x) for f in filters]) for x in ("quotients", "remainders", "counts"))
        order = np.lexsort((r, q))
        q, r, n = q[order], r[order], n[order]
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])
        return cls(filters[0].bits, q[first], r[first], np.add.reduceat(n, np.flatnonzero(first)) if len(n) else n)

    def fingerprints(self) -> np.ndarray:
        return (self.quotients << np.uint64(64 - self.bits)) | self.remainders

    def blocks(self, block_bits: int) -> Iterator[tuple[int, QuotientFilter]]:
        """The parts of the filter by the leading bits of the quotient."""
        block = self.quotients >> np.uint64(self.bits - block_bits)
        for start, end in zip(*_runs(block)):
            yield int(block[start]), QuotientFilter(self.bits, self.quotients[start:end], self.remainders[start:end], self.counts[start:end])

    def pack(self, block_bits: int) -> bytes:
        """Quotient within the block, remainder in as many bytes as it needs, and counts only where above one."""
        width = (64 - self.bits + 7) // 8
        local = (self.quotients & np.uint64((1 << (self.bits - block_bits)) - 1)).astype("<u2")
        rest = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        many = np.flatnonzero(self.counts > 1)
        return b"".join((struct.pack("<II", len(local), len(many)), local.tobytes(), rest.tobytes(), many.astype("<u4").tobytes(),
                         self.counts[many].astype("<u8").tobytes()))

    @classmethod
    def unpack(cls, raw: bytes, block: int, bits: int, block_bits: int) -> QuotientFilter:
        n, m = struct.unpack_from("<II", raw)
        width, at = (64 - bits + 7) // 8, 8
        local = np.frombuffer(raw, "<u2", n, at).astype(np.uint64)
        at += 2 * n
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.ones(n, np.uint64)
        counts[np.frombuffer(raw, "<u4", m, at)] = np.frombuffer(raw, "<u8", m, at + 4 * m)
        return cls(bits, local | np.uint64(block << (bits - block_bits)), rest.view("<u8").reshape(-1).astype(np.uint64), counts)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_values):
        return np.empty(0, int), np.empty(0, int)
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return starts, np.append(starts[1:], len(sorted_values))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def block_bits(fingerprints: int) -> int:
    """Leading bits by which filters are cut, so that a block holds about BLOCK_ROWS fingerprints at any size."""
    return max(LEAST_BLOCK_BITS, int(np.ceil(np.log2(max(1, fingerprints) / BLOCK_ROWS))))


def packed_filter(fingerprints: list[np.ndarray], leading: int, least: int = 1) -> pa.RecordBatch:
    """The filter of one task's fingerprints (those that it has ``least`` times), a row per block."""
    whole = QuotientFilter.of(np.concatenate(fingerprints), leading + LOCAL_BITS)
    if least > 1:
        many = whole.counts >= least
        whole = QuotientFilter(whole.bits, whole.quotients[many], whole.remainders[many], whole.counts[many])
    parts = list(whole.blocks(leading))
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([f.pack(leading) for _, f in parts], pa.binary())],
                                      names=["block", "filter"])


def repeated_in(filters: DataFrame, leading: int, least: int = 2) -> DataFrame:
    """Fingerprints (``fp``) with their counts (``n``) of at least ``least``, from the tasks' filters (block, filter)."""
    bits = leading + LOCAL_BITS

    def merge(group: pa.Table) -> pa.Table:
        filters = [QuotientFilter.unpack(raw, b, bits, leading) for b, raw in zip(group["block"].to_pylist(), group["filter"].to_pylist())]
        whole = QuotientFilter.merged(filters)
        many = whole.counts >= least
        return pa.table({"fp": whole.fingerprints()[many].view(np.int64), "n": whole.counts[many].astype(np.int64)})

    return filters.groupBy("block").applyInArrow(merge, "fp long, n long")


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """Fingerprints (column ``fp``) that occur more than once, by filters built per partition and merged per block."""
    leading = block_bits(rows)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += len(held[-1])
            if size >= FILTER_ROWS:
                yield packed_filter(held, leading)
                held, size = [], 0
        if held:
            yield packed_filter(held, leading)

    filters = fingerprints.select("fp").mapInArrow(build, "block int, filter binary")
    return repeated_in(filters, leading).select("fp")


def duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as empty, and empty texts
    are equal to each other. The row with the smallest doc_id stays. Rows that repeat one doc_id with one text are all
    counted and share the flag of that doc_id; a null doc_id never stays where a group has another. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    norm = normalised(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"))
    digests = materialise(rows.select("doc_id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")))
    repeated = materialise(repeated_fingerprints(digests, digests.count()))
    verified = (rows.withColumn("fp", F.xxhash64("norm")).join(repeated, "fp", "left_semi")
                .groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                .filter("group_size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"))
    groups = materialise(verified)
    joined = digests.join(groups, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, without those of which an equal text with a smaller doc_id stays.

    A row goes by its doc_id together with its text, so other texts under the same doc_id, or without one, stay. Of rows that
    repeat both, one stays. Names of other columns are free.
    """
    sha = fresh_name(docs.columns, "sha")
    found = materialise(duplicate_groups(docs, text, doc_id).select("doc_id", "kept", F.unhex("text_sha256").alias("sha")))
    marked = found.groupBy("doc_id", "sha").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1 OR NOT kept")
    marked = small(materialise(marked.select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"), "kept")), 64)
    rows = docs.withColumn(sha, F.unhex(F.sha2(normalised(F.col(text)), 256)))
    same = rows[doc_id].eqNullSafe(marked["__id"]) & (rows[sha] == marked["__sha"])
    out = rows.join(marked, same, "left_anti")
    again = marked.filter("kept")
    if not again.isEmpty():
        repeats = rows.join(again, rows[doc_id].eqNullSafe(again["__id"]) & (rows[sha] == again["__sha"]), "left_semi")
        out = out.unionAll(repeats.dropDuplicates([doc_id, sha]))
    return out.drop(sha)
