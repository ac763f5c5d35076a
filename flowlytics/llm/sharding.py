"""Minimax contiguous sharding of atomic groups.

Equal texts form an atomic group; groups are ordered by a hash of the text. The smallest capacity for which a greedy sweep
needs no more than the given number of shards is found by binary search, and the groups are cut there: no cut into that many
contiguous shards has a smaller largest shard.

The sweep never walks over all groups. Their order is a 60-bit space, and the driver holds sums of cells of it: first a
fixed number of equal cells. A sweep that may stop only at cell borders needs at least the true capacity, one that may run
to the end of the cell it reaches at most that. While the two differ, the cells in which a cut can lie are split further,
by one aggregation each round; a cell of one group can't be split. The cells held are a few thousand, whatever the size of
the table.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlytics.sources.stage import materialise

SPACE_BITS = 60
FIRST_BITS = 12
MORE_BITS = 6
OVERHEAD = 8
SLOT_PIECES = 1024
PIECE_ROWS = 50_000


@dataclass(frozen=True)
class Cell:
    """Groups whose order lies in [low, high): their bytes, and whether they are one group."""

    low: int
    high: int
    size: int
    single: bool


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed overhead for each row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def group_order(text: Column) -> Column:
    """Place of a text's group in the order; equal texts have one place, and null is with the empty text."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - SPACE_BITS)


def _cells(rows: DataFrame, bits: int, ranges: list[tuple[int, int]] | None = None) -> list[Cell]:
    """Sums of the cells of 2 ** (SPACE_BITS - bits) places, within the given ranges; cells without rows are left out."""
    shift = SPACE_BITS - bits
    if ranges is not None:
        within = F.lit(False)
        for low, high in ranges:
            within = within | F.col("place").between(low, high - 1)
        rows = rows.filter(within)
    found = rows.groupBy(F.shiftright("place", shift).alias("cell")).agg(F.sum("size").alias("size"), F.min("place").alias("a"), F.max("place").alias("b"))
    return sorted((Cell(r["cell"] << shift, (r["cell"] + 1) << shift, r["size"], r["a"] == r["b"]) for r in found.collect()), key=lambda c: c.low)


def sweep(sizes: list[int], sums: list[int], capacity: int, shards: int, beyond: list[bool]) -> tuple[bool, list[int]]:
    """Greedy sweep over cells: whether ``shards`` shards of the capacity hold all, and the cell where each shard ends.

    ``beyond[i]``: a shard that reaches into cell i may take all of it (the optimistic sweep over a cell that can be split).
    """
    at, cuts = 0, []
    for _ in range(shards):
        if at == len(sizes):
            break
        start = sums[at]
        end = bisect_right(sums, start + capacity) - 1
        if end < len(sizes) and beyond[end]:
            end += 1
        if end == at:
            return False, cuts
        cuts.append(end)
        at = end
    return at == len(sizes), cuts


def _search(cells: list[Cell], shards: int, optimistic: bool) -> tuple[int, list[int]]:
    """The smallest feasible capacity by binary search, and its cuts."""
    sizes = [c.size for c in cells]
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    beyond = [optimistic and not c.single for c in cells]
    low, high = max([-(-sums[-1] // shards), *(c.size for c in cells if c.single)]), sums[-1]
    while low < high:
        mid = (low + high) // 2
        if sweep(sizes, sums, mid, shards, beyond)[0]:
            high = mid
        else:
            low = mid + 1
    return low, sweep(sizes, sums, low, shards, beyond)[1]


def minimax_cuts(rows: DataFrame, shards: int, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the first place of each shard after the first. ``rows``: place, size."""
    cells, bits = _cells(rows, first_bits), first_bits
    while True:
        if not cells:
            return 0, []
        least, _ = _search(cells, shards, True)
        most, cuts = _search(cells, shards, False)
        windows = [] if least == most else _reached(cells, shards, least, most)
        if not windows:
            return most, [cells[c].low for c in cuts[:-1]]
        bits = min(bits + more_bits, SPACE_BITS)
        finer = _cells(rows, bits, [(cells[a].low, cells[b].high) for a, b in windows])
        kept = [c for i, c in enumerate(cells) if not any(a <= i <= b for a, b in windows)]
        cells = sorted(kept + finer, key=lambda c: c.low)


def _reached(cells: list[Cell], shards: int, least: int, most: int) -> list[tuple[int, int]]:
    """Runs of cells (first, last) in which a cut can lie for a capacity from ``least`` to ``most``, one for each shard at most.

    The k-th cut lies between where the strict sweep at the least capacity and the loose one at the most can put it. Runs
    without a cell that can be split are left out, and runs that touch are joined.
    """
    sizes = [c.size for c in cells]
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    low = high = 0
    found: list[tuple[int, int]] = []
    for _ in range(shards):
        low = max(bisect_right(sums, sums[low] + least) - 1, low)
        high = bisect_right(sums, sums[high] + most) - 1
        last = min(high, len(cells) - 1)
        if any(not c.single for c in cells[low:last + 1]):
            if found and low <= found[-1][1] + 1:
                found[-1] = (found[-1][0], max(last, found[-1][1]))
            else:
                found.append((low, last))
        high = min(high + (high < len(cells) and not cells[high].single), len(cells))
    return found


def sharded(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Shards are numbered from 0 in the order of the groups and as near in size as atomic groups allow; equal texts share a
    shard, a null text is with the empty ones. Slots are gapless from 0 within a shard, in no order of meaning; repeated
    rows get a slot each. With fewer groups than shards the last shards are empty; an empty table gives no row. Other
    columns are ignored.
    """
    rows = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
                       .select("doc_id", text_size(F.col("t")).alias("size"), F.crc32(F.coalesce("t", F.lit("")).cast("binary")).alias("text_crc32"),
                               group_order(F.col("t")).alias("place")))
    _, cuts = minimax_cuts(rows.select("place", "size"), shards)
    shard = F.lit(0)
    for i, c in enumerate(cuts):
        shard = F.when(F.col("place") >= c, i + 1).otherwise(shard)
    # slots: each shard is dealt over pieces by a hash of the row, so a shard that is one hot group is no single task
    pieces = max(SLOT_PIECES, rows.count() // PIECE_ROWS)
    dealt = rows.withColumns({"shard": shard.cast("int"), "piece": F.pmod(F.xxhash64("doc_id", "place", F.lit(1)), F.lit(pieces)).cast("int")})
    counts = dealt.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("shard", "piece").orderBy("doc_id", "place", "size", "text_crc32")))
    return numbered.join(offsets, ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
