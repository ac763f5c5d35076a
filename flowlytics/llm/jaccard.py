"""Exact Jaccard join of word-shingle sets as a metric-space join.

The Jaccard distance is a metric, and a link is a distance of at most EPSILON = 1 - threshold.

1. Equal sets collapse to one representative (the smallest doc_id), which carries the class.
2. Regions: in one common order of all shingles, frequent ones last, two linked sets share a shingle among the first
   n - ceil(threshold n) + 1 of each. So the sets that share such a shingle form a region, and each link lies in one. Sizes
   and the places of the shared shingle bound the similarity of a pair from above. The order's frequencies are counted over
   all documents by counting quotient filters.
3. Pivots connect: in each region that holds several classes, members meet a few pivots that have been altered least, as far
   as the bounds let them link. Classes grow by these links, so a group of near copies is one class after as many comparisons as it has members.
4. Regions with more than REGION_ROWS members outside of their largest class become Voronoi regions: all members' distances
   to drawn pivots are computed, each member goes to its nearest pivot p and, as d(x, q) <= d(x, p) + 2 EPSILON is all that a
   link across allows, to the pivots q of that window as well. That is repeated while regions shrink.
5. Within the regions, members outside of the largest class meet the members of other classes: those pairs are compared
   exactly of which at least one is at home, for which the bounds hold, whose distances to the pivot differ by no more
   than EPSILON, and whose signatures (parities of shingles by cells of their hash) differ in no more bits than linked sets may.

No link between different classes is lost and no group is gathered: pivots, minima and classes are aggregates with partial
groups, distances are computed per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlytics.llm import exact, texts
from flowlytics.llm.components import components
from flowlytics.sources.stage import materialise

WORDS = 5
PERCENT = 75
FREQUENT = 16
MOST_RANKED = 500_000
SAMPLE_BITS = 62
TASK_TOKENS = 500_000
PIVOTS = (1, 4)
REGION_ROWS = 512
REGION_PIVOTS = 4
SHRINKS = 0.75
LONG = (1 << 16) - 1
NEAR = 64
SIGNATURE_BITS = 1024
HOT = 20_000  # frequency above which a token's members don't meet in one block


_TABLE = texts.translation({0x20, *range(0x09, 0x0E)})


def shingle_sets(raws: list[bytes], k: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, hashed and sorted; a text of fewer words is one shingle, one without words none."""
    words = texts.Words(raws, _TABLE)
    rolled = texts.rolling(words.hashes, k)
    for start, end in words.bounds():
        if end - start >= k:
            h = np.sort(rolled[start:end - k + 1])
            keep = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            yield h[keep]
        else:
            yield texts.rolling(words.hashes[start:end], end - start) if end > start else np.empty(0, texts.U64)


class Ranks:
    """Frequency of the most frequent shingles; any other has rank 0. Bounded by MOST_RANKED for each of two halves."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]
        self.mask = np.zeros(1 << 22, bool)
        self.mask[(tokens & texts.U64((1 << 22) - 1)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        ranks = np.zeros(len(hashes), np.int64)
        at = np.flatnonzero(self.mask[(hashes & texts.U64((1 << 22) - 1)).astype(np.int64)])
        if len(at):
            which = np.searchsorted(self.tokens, hashes[at])
            which[which == len(self.tokens)] = 0
            found = self.tokens[which] == hashes[at]
            ranks[at[found]] = self.counts[which[found]]
        return ranks


def prefix(shingles: np.ndarray, ranks: Ranks, percent: int = PERCENT) -> np.ndarray:
    """The first shingles in the common order (rank, hash), as many as a linked set can't miss all of."""
    n = len(shingles)
    size = n - -(-percent * n // 100) + 1 if n else 0
    r = ranks.of(shingles)
    if r.any():
        shingles = shingles[np.argsort(r, kind="stable")]
    return shingles[:size]


def has_partner(sizes: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """For each member of a region, whether sizes and places let it link to some other one.

    In the order of sizes, the partners that a member allows are a range; one of them has to allow it in turn, which the
    greatest reach in the range tells (a table of maxima over powers of two, so the work is about linear).
    """
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    reach = ((100 + percent) * (1 + rest[order]) - percent * n) // percent  # no partner is larger
    at = np.arange(len(n))
    low = np.searchsorted(n, -(-percent * n // 100))
    high = np.searchsorted(n, np.minimum(reach, 100 * n // percent), "right")
    tables = [reach]
    while 2 << (len(tables) - 1) <= len(n):
        step = 1 << (len(tables) - 1)
        tables.append(np.maximum(tables[-1][:-step], tables[-1][step:]))

    def reached(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = np.zeros(len(n), bool)
        length = end - start
        for k, table in enumerate(tables):
            some = np.flatnonzero((length >= 1 << k) & (length < 2 << k))
            found[some] = np.maximum(table[start[some]], table[end[some] - (1 << k)]) >= n[some]
        return found

    out = np.zeros(len(n), bool)
    out[order] = reached(low, np.minimum(high, at)) | reached(np.maximum(low, at + 1), high)
    return out


def _digests(docs: DataFrame, leading: int) -> DataFrame:
    """A row per document (doc_id, n, set_key) and, in the same pass, the tasks' filters of a quarter of all shingles."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, raws in texts.slices(batches, "text"):
            n, keys = [], []
            for s in shingle_sets(raws):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                held.append(s[:np.searchsorted(s, texts.U64(1 << SAMPLE_BITS))])
                size += len(held[-1])
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *none],
                                             names=["doc_id", "n", "set_key", "block", "filter"])
            if size >= TASK_TOKENS:
                yield blocks(held)
                held, size = [], 0
        if held:
            yield blocks(held)

    def blocks(held: list[np.ndarray]) -> pa.RecordBatch:
        f = exact.packed_filter(held, leading)
        k = f.num_rows
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), f.column(0), f.column(1)],
                                          names=["doc_id", "n", "set_key", "block", "filter"])

    return docs.mapInArrow(digest, "doc_id long, n long, set_key binary, block int, filter binary")


def _remaining_filters(docs: DataFrame, ranks: Ranks, leading: int) -> DataFrame:
    """Filters of the other three quarters of the shingles, of documents that hold a frequent one.

    A task passes on what repeats within it. That is a lower bound of the frequency, good enough for an order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, raws in texts.slices(batches, "text"):
            for s in shingle_sets(raws):
                cut = np.searchsorted(s, texts.U64(1 << SAMPLE_BITS))
                if ranks.of(s[:cut]).any():
                    held.append(s[cut:])
                    size += len(held[-1])
            if size >= TASK_TOKENS:
                yield exact.packed_filter(held, leading, 2)
                held, size = [], 0
        if held:
            yield exact.packed_filter(held, leading, 2)

    return docs.select("text").mapInArrow(count, "block int, filter binary")


def _ranked(filters: DataFrame, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles with their counts, at most MOST_RANKED of them: an order, not a selection of work."""
    top = exact.repeated_in(filters, leading, FREQUENT).orderBy(F.desc("n"), "fp").limit(MOST_RANKED).toArrow()
    return top["fp"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)


def _members(docs: DataFrame, ranks: Ranks, leading: int, percent: int) -> DataFrame:
    """(region, rep, n, rest) of prefix shingles that at least two documents share: the set's size and how many of its shingles
    at most come after this one (both null for sets of LONG or more). Shingles with the same members are one region.

    Each task packs its rows by blocks of the token space; a block is grouped where all its rows meet, and members without a
    possible partner go. Members of hot tokens are dealt out by a hash instead and go through as they are, so no block grows
    with one token.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, raws in texts.slices(batches, "text"):
            for rep, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(raws)):
                p = prefix(s, ranks, percent)
                n = len(p)
                held.append((p, np.full(n, rep, np.int64), np.full(n, min(len(s), LONG), np.uint16), (np.arange(n) * 256 // max(n, 1)).astype(np.uint8)))
                size += n
            if size >= TASK_TOKENS:
                yield pack(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield pack(*map(np.concatenate, zip(*held)))

    def pack(tokens: np.ndarray, reps: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        frequent = ranks.of(tokens) > HOT
        block = np.where(frequent, texts.mix(tokens ^ reps.view(np.uint64)), tokens) >> texts.U64(64 - leading)
        order = np.lexsort((frequent, block))
        tokens, reps, sizes, places, frequent, block = (x[order] for x in (tokens, reps, sizes, places, frequent, block))
        blocks, rows = [], []
        for start, end in zip(*exact._runs(block)):
            own = slice(start, end)
            base = int(reps[own].min())
            wide = int(reps[own].max()) - base >= 1 << 32
            rows.append(b"".join((np.array([base, int(wide), int(frequent[own].sum()), end - start], "<i8").tobytes(), tokens[own].astype("<u8").tobytes(),
                                  (reps[own] - base).astype("<u8" if wide else "<u4").tobytes(), sizes[own].astype("<u2").tobytes(), places[own].tobytes())))
            blocks.append(int(block[start]))
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(rows, pa.binary())], names=["block", "rows"])

    def group(block: pa.Table) -> pa.Table:
        parts = []
        for raw in block["rows"].to_pylist():
            base, wide, frequent, n = np.frombuffer(raw, "<i8", 4).tolist()
            at = 32 + (16 if wide else 12) * n
            parts.append((np.frombuffer(raw, "<u8", n, 32), np.frombuffer(raw, "<u8" if wide else "<u4", n, 32 + 8 * n).astype(np.int64) + base,
                          np.frombuffer(raw, "<u2", n, at).astype(np.int64), np.frombuffer(raw, np.uint8, n, at + 2 * n).astype(np.int64), np.arange(n) >= n - frequent))
        tokens, reps, sizes, places, passed = map(np.concatenate, zip(*parts))
        order = np.lexsort((places, sizes, reps, tokens))
        tokens, reps, sizes, places, passed = (x[order] for x in (tokens, reps, sizes, places, passed))
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (reps[1:] != reps[:-1]) | (sizes[1:] != sizes[:-1])
        tokens, reps, sizes, places, passed = (x[fresh] for x in (tokens, reps, sizes, places, passed))
        first = np.ones(len(tokens), bool)
        first[1:] = tokens[1:] != tokens[:-1]
        number = np.cumsum(first) - 1
        of_first = reps[first][number]
        kept = passed | (np.bincount(number, reps != of_first, minlength=first.sum()) > 0)[number]
        tokens, reps, sizes, places = (x[kept] for x in (tokens, reps, sizes, places))
        length = sizes - -(-percent * sizes // 100) + 1  # of the prefix
        rest = sizes - 1 - -(-places * length // 256)
        known = sizes < LONG
        met = passed[kept]
        near = np.flatnonzero(tokens[:-1] == tokens[1:])
        for lag in range(1, NEAR + 1):  # a member without a partner that sizes and places allow can go
            near = near[near + lag < len(tokens)]
            near = near[tokens[near] == tokens[near + lag]]
            if not len(near):
                break
            other = near + lag
            if lag == NEAR:
                for token in np.unique(tokens[near]):
                    own = slice(np.searchsorted(tokens, token), np.searchsorted(tokens, token, "right"))
                    met[own] |= True if not known[own].all() else has_partner(sizes[own], rest[own], percent)
                break
            low, high = np.minimum(sizes[near], sizes[other]), np.maximum(sizes[near], sizes[other])
            fits = (100 * low >= percent * high) & ((100 + percent) * (1 + np.minimum(rest[near], rest[other])) >= percent * (low + high))
            fits = (fits | ~known[near] | ~known[other]) & (reps[near] != reps[other])
            met[near[fits]] = met[other[fits]] = True
        tokens, reps, sizes, rest, known, passed = (x[met] for x in (tokens, reps, sizes, rest, known, passed[kept]))
        starts, ends = exact._runs(tokens)  # shingles with the same members are one region
        names = np.add.reduceat(texts.mix(reps.view(np.uint64)), starts) if len(starts) else np.empty(0, np.uint64)
        region = np.where(passed, tokens, np.repeat(texts.mix(names), ends - starts))
        order = np.lexsort((-rest, sizes, reps, region))
        region, reps, sizes, rest, known = (x[order] for x in (region, reps, sizes, rest, known))
        once = np.ones(len(region), bool)
        once[1:] = (region[1:] != region[:-1]) | (reps[1:] != reps[:-1]) | (sizes[1:] != sizes[:-1])
        region, reps, sizes, rest, known = (x[once] for x in (region, reps, sizes, rest, known))
        return pa.table({"region": region.view(np.int64), "rep": reps, "n": pa.array(sizes, mask=~known), "rest": pa.array(rest, mask=~known)})

    found = docs.mapInArrow(emit, "block int, rows binary").groupBy("block").applyInArrow(group, "region long, rep long, n long, rest long")
    return found.groupBy("region", "rep", "n").agg(F.max("rest").alias("rest"))


def _small(table: DataFrame) -> DataFrame:
    """``texts.small`` for a table of long columns."""
    return texts.small(table, 16 * len(table.columns))


class Distances:
    """Distances of pairs (a, b), each computed once; the sets of the documents asked for are staged as they come up."""

    def __init__(self, docs: DataFrame, percent: int):
        self.docs, self.percent = docs, percent
        self.sets = self.known = None

    def _fetch(self, reps: DataFrame) -> None:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, raws in texts.slices(batches, "text"):
                found = [s.view(np.int64) for s in shingle_sets(raws)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], names=["rep", "shingles"])

        if self.sets is not None:
            reps = reps.join(self.sets, "rep", "left_anti")
        reps = materialise(reps)
        if not reps.isEmpty():
            new = materialise(self.docs.join(_small(reps), self.docs["doc_id"] == reps["rep"], "left_semi").select("doc_id", "text").mapInArrow(cut, "rep long, shingles array<long>"))
            self.sets = new if self.sets is None else self.sets.unionAll(new)

    def of(self, pairs: DataFrame) -> DataFrame:
        """a, b, d, linked of the pairs (a > b; staged). Where a doc_id has several sets, the nearest ones count."""
        if self.known is not None:
            pairs = pairs.join(self.known, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        if self.known is not None and pairs.isEmpty():
            return self.known.limit(0)
        self._fetch(pairs.select(F.col("a").alias("rep")).unionAll(pairs.select("b")).distinct())
        if self.sets is None:
            both = pairs.selectExpr("a", "b", "array(0L) as sa", "array(0L) as sb")
        else:
            sa, sb = (self.sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
            both = pairs.join(sa, "a").join(sb, "b")
        both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
        whole = F.size("sa") + F.size("sb") - F.col("common")
        found = both.select("a", "b", (1 - F.col("common") / whole).alias("d"), (100 * F.col("common") >= self.percent * whole).alias("linked"))
        found = materialise(found.groupBy("a", "b").agg(F.min("d").alias("d"), F.bool_or("linked").alias("linked")))
        self.known = found if self.known is None else self.known.unionAll(found)
        return found


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their class as ``label``. ``labels``: rep, root."""
    if labels is None:
        return members.withColumn("label", F.col("rep"))
    return members.join(labels, "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root")


def _drawn(now: DataFrame, number: int, salt: int, central: bool = False) -> DataFrame:
    """(region, pivot, plabel, pn, prest) of regions with several classes: of the members by cells of a hash, the least by another hash.

    ``central`` takes the one with the fewest shingles before the shared one: those are rarer, so it has been altered least.
    """
    before = F.coalesce(F.col("n") - F.col("rest"), F.lit(LONG)) if central else F.lit(0)
    picked = F.min(F.struct(before.alias("before"), F.xxhash64("rep", F.lit(salt)).alias("o"), "rep", "label", "n", "rest")).alias("p")
    cells = now.groupBy("region", F.pmod(F.xxhash64("rep", F.lit(-salt)), F.lit(number)).alias("cell")).agg(picked, F.min("label").alias("low"), F.max("label").alias("high"))
    region = Window.partitionBy("region")
    mixed = cells.withColumns({"low": F.min("low").over(region), "high": F.max("high").over(region)}).filter("low <> high")
    return materialise(mixed.select("region", F.col("p.rep").alias("pivot"), F.col("p.label").alias("plabel"), F.col("p.n").alias("pn"), F.col("p.rest").alias("prest")))


def _mixed(now: DataFrame) -> DataFrame:
    """(region, major, others) of regions with several classes: the largest class and the number of members outside of it."""
    counted = now.groupBy("region", "label").agg(F.count(F.lit(1)).alias("m"))
    whole = counted.groupBy("region").agg(F.max(F.struct("m", "label")).alias("most"), F.sum("m").alias("size")).filter("most.m < size")
    return materialise(whole.select("region", F.col("most.label").alias("major"), (F.col("size") - F.col("most.m")).alias("others")))


def _may_link(n: str, rest: str, other_n: str, other_rest: str, percent: int) -> Column:
    """Whether sizes and places let a pair link; both bounds are exact."""
    low, high = F.least(n, other_n), F.greatest(n, other_n)
    sizes = 100 * low >= percent * high
    places = (100 + percent) * (1 + F.least(rest, other_rest)) >= percent * (F.col(n) + F.col(other_n))
    return F.col(n).isNull() | F.col(other_n).isNull() | (sizes & places)


def _signatures(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, signature) of the documents asked for: the parity of the number of shingles in each of SIGNATURE_BITS cells.

    A shingle that only one of two sets holds changes one bit at most, so the bits in which signatures differ are a lower
    bound of the sets' symmetric difference. Null where a doc_id has several sets.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in texts.slices(batches, "text"):
            cells = ((s >> texts.U64(32)) % texts.U64(SIGNATURE_BITS) for s in shingle_sets(raws))
            bits = (np.packbits(np.bincount(c.astype(np.int64), minlength=SIGNATURE_BITS) & 1) for c in cells)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b.view(np.int64) for b in bits], pa.list_(pa.int64()))], names=["rep", "signature"])

    found = docs.join(_small(reps), docs["doc_id"] == reps["rep"], "left_semi").select("doc_id", "text").mapInArrow(sign, "rep long, signature array<long>")
    low, high = F.min("signature"), F.max("signature")
    return materialise(found.groupBy("rep").agg(F.when(low == high, low).alias("signature")))


def _bits_may_link(n: str, signature: str, other_n: str, other_signature: str, percent: int) -> Column:
    """Whether the signatures let a pair link: sets that do differ in at most (100 - percent) / (100 + percent) of both sizes."""
    differ = F.expr(f"aggregate(zip_with({signature}, {other_signature}, (p, q) -> bit_count(p ^ q)), 0, (s, b) -> s + b)")
    return F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col(n) + F.col(other_n)), F.lit(True))


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs (a > b) of two columns."""
    return rows.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()


def _voronoi(now: DataFrame, connect: Callable[[DataFrame], None], distances: Distances, percent: int, salt: int) -> DataFrame:
    """Members by (region, pivot): at home with the nearest pivot, a copy with each pivot of the window. ``parent`` is the region before."""
    window = 2 * (1 - percent / 100) + 1e-9
    pivots = _drawn(now, REGION_PIVOTS, salt)
    meets = materialise(now.join(pivots.select("region", "pivot"), "region").select("region", "rep", "n", "rest", "pivot"))
    connect(_pairs(meets.filter("rep <> pivot"), "rep", "pivot"))
    seen = (meets.withColumns({"a": F.greatest("rep", "pivot"), "b": F.least("rep", "pivot")}).join(distances.known.select("a", "b", "d"), ["a", "b"], "left")
            .withColumn("d", F.when(F.col("rep") == F.col("pivot"), 0.0).otherwise(F.col("d"))))
    seen = materialise(seen.select("region", "rep", "n", "rest", "pivot", "d"))
    nearest = seen.groupBy(F.col("region").alias("r"), F.col("rep").alias("x")).agg(F.min(F.struct("d", "pivot")).alias("near"))
    near = seen.join(nearest, (F.col("region") == F.col("r")) & (F.col("rep") == F.col("x"))).filter(F.col("d") <= F.col("near.d") + window)
    return materialise(near.select(F.xxhash64("region", "pivot").alias("region"), "rep", "n", "rest", "d", (F.col("pivot") == F.col("near.pivot")).alias("home"), F.col("region").alias("parent")))


def _linked_classes(members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(rep, root) of the representatives that link to another one. ``members``: region, rep, n, rest."""
    distances, links, labels = Distances(docs, percent), None, None

    def connect(pairs: DataFrame) -> None:
        nonlocal links, labels
        found = distances.of(pairs).filter("linked").select("a", "b")
        if not found.isEmpty():
            links = found if links is None else links.unionAll(found)
            labels = _small(materialise(components(links).withColumnRenamed("node", "rep")))

    for number in PIVOTS:
        pivots = _drawn(_labelled(members, labels), number, number, central=True)
        close = (F.col("label") != F.col("plabel")) & _may_link("n", "rest", "pn", "prest", percent)
        connect(_pairs(_labelled(members, labels).join(_small(pivots), "region").filter(close), "rep", "pivot"))

    parts = []  # members by regions that are compared directly
    part, salt = members.withColumns({"d": F.lit(0.0), "home": F.lit(True)}), 100
    while True:
        regions = _mixed(_labelled(part, labels))
        wide = materialise(regions.filter(F.col("others") > REGION_ROWS).select("region"))
        if wide.isEmpty():
            parts.append((part, regions))
            break
        parts.append((part, regions.join(wide, "region", "left_anti")))
        now = materialise(_labelled(part, labels).join(wide, "region", "left_semi"))
        cells = _voronoi(now, connect, distances, percent, salt)
        before = now.groupBy(F.col("region").alias("parent")).agg(F.count(F.lit(1)).alias("before"))
        sizes = cells.groupBy("region", "parent").agg(F.count(F.lit(1)).alias("size")).join(before, "parent")
        stuck = materialise(sizes.filter(F.col("size") > F.lit(SHRINKS) * F.col("before")).select("region"))  # no pivot separates them
        whole = cells.join(stuck, "region", "left_semi").drop("parent")
        parts.append((whole, _mixed(_labelled(whole, labels))))
        part, salt = materialise(cells.join(stuck, "region", "left_anti").drop("parent")), salt + 1
    for part, regions in parts:
        now = materialise(_labelled(part, labels).join(_small(regions.select("region", "major")), "region"))
        if now.isEmpty():
            continue
        now = now.join(_signatures(docs, materialise(now.select("rep").distinct())), "rep", "left")
        few = materialise(now.filter("label <> major").select("region", *(F.col(c).alias(f"x_{c}") for c in ("rep", "n", "rest", "d", "home", "label", "signature"))))
        meet = ((F.col("x_label") != F.col("label")) & ((F.col("label") == F.col("major")) | (F.col("x_rep") < F.col("rep"))) & (F.col("home") | F.col("x_home"))
                & (F.abs(F.col("d") - F.col("x_d")) <= 1 - percent / 100 + 1e-9) & _may_link("n", "rest", "x_n", "x_rest", percent)
                & _bits_may_link("n", "signature", "x_n", "x_signature", percent))
        connect(_pairs(now.join(few, "region").filter(meet), "rep", "x_rep"))
    if labels is None:
        labels = members.select("rep", F.col("rep").alias("root")).limit(0)
    return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct shingles of five words.
    Documents link when 100 * intersection >= percent * union; component_id is the smallest doc_id reachable, the own one
    included. Null, empty and blank texts have no shingles and link to nothing. doc_id is an integer and the node: rows
    that repeat a doc_id share its links (each row has its own n_shingles); rows with a null doc_id take no part and have
    a null component_id. An empty table gives an empty result. Other columns are ignored. Shingles are compared by 64-bit
    hashes.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    leading = exact.block_bits(128 * rows.count())
    passed = materialise(_digests(rows, leading))
    digests = passed.filter("n IS NOT NULL").select("doc_id", "n", "set_key")
    classes = materialise(digests.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")))
    copied = classes.filter("rep <> last").select("set_key", "rep")
    again = digests.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    copies = digests.filter("n > 0 AND doc_id IS NOT NULL").join(copied, "set_key").filter("doc_id <> rep").select("doc_id")
    firsts = rows.filter("doc_id IS NOT NULL").join(_small(materialise(copies.join(again, "doc_id", "left_anti"))), "doc_id", "left_anti")
    quarter = _ranked(passed.filter("block IS NOT NULL").select("block", "filter"), leading)
    ranks = Ranks(*quarter)
    if len(quarter[0]):
        more = _ranked(_remaining_filters(firsts, ranks, leading), leading)
        ranks = Ranks(*(np.concatenate(x) for x in zip(quarter, more)))
    members = materialise(_members(firsts, ranks, leading, percent))
    roots = materialise(_linked_classes(members, firsts, percent))
    of_set = copied.join(roots, "rep", "left").select("set_key", F.coalesce("root", "rep").alias("root"))
    by_doc = roots.select(F.col("rep").alias("doc_id"), F.col("root").alias("own"))
    found = digests.join(of_set, "set_key", "left").join(by_doc, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "own", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest doc_id of each component (rows without doc_id all stay)."""
    dropped = _small(materialise(near_duplicates(docs, doc_id, text, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("__dropped")).distinct()))
    return docs.join(dropped, docs[doc_id] == dropped["__dropped"], "left_anti")
