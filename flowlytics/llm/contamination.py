"""Benchmark decontamination as a prefix-filtered set join.

A window (13 consecutive item words, or a shorter item as a whole) is contained in a document only if each of its shingles
is. So the shingles of a window are ordered by their document frequency in the corpus, and the rarest one, the necessary
prefix of a full containment, is joined with the shingles of the documents. Its place in the window gives the only start
at which the window can lie there; bounds on place and length drop starts outside the document, and the words of the
item-sized stretch are then compared one by one.

The windows are an index on the tasks' side. It is cut into parts of at most ``PART_WINDOWS`` windows, each fetched and sent
alone, so its size is bounded however large the benchmark is; the parts' hits are united per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlytics.llm import texts
from flowlytics.sources.stage import materialise

WINDOW = 13
SHINGLE = 4
PART_WINDOWS = 50_000

# words are digits, letters and everything beyond ASCII; the rest separates
_TABLE = texts.translation({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per window: item_id (string), window (its words, joined by blanks), shingles (hash of each shingle)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in texts.slices(batches, "text"):
            ids, wins, hashes = [], [], []
            for item, raw in zip(batch.column("item_id").to_pylist(), raws):
                found = texts.Words([raw], _TABLE)
                words = found.clean.split()
                size = min(window, len(words))
                if not size:
                    continue
                h = texts.rolling(found.hashes, min(SHINGLE, size)).view(np.int64)
                per = size - min(SHINGLE, size) + 1
                for i in range(len(words) - size + 1):
                    ids.append(item)
                    wins.append(b" ".join(words[i:i + size]))
                    hashes.append(h[i:i + per].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                                             names=["item_id", "window", "shingles"])

    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias("text"))
    return items.mapInArrow(cut, "item_id string, window binary, shingles array<long>")


def shingle_frequencies(docs: DataFrame, wanted: np.ndarray, sizes: list[int]) -> DataFrame:
    """Documents (column ``text``) that hold each wanted shingle; ``wanted`` is sorted. Counted per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(wanted), np.int64)
        for _, raws in texts.slices(batches, "text"):
            words = texts.Words(raws, _TABLE)
            for k in sizes:
                at, which = _matches(texts.rolling(words.hashes, k), wanted)
                doc = np.searchsorted(words.ends, at, side="right")
                inside = at + k <= words.ends[np.minimum(doc, len(raws) - 1)]
                seen += np.bincount(np.unique(np.stack((doc[inside], which[inside])), axis=1)[1], minlength=len(wanted))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(seen[some])], names=["shingle", "n"])

    return docs.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _matches(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes that are wanted, and which ones they are."""
    if not len(hashes) or not len(wanted):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = _FILTER_MASK & hashes.astype(np.uint32)
    table = np.zeros(int(_FILTER_MASK) + 1, bool)
    table[_FILTER_MASK & wanted.astype(np.uint32)] = True
    at = np.flatnonzero(table[low])
    which = np.searchsorted(wanted, hashes[at])
    which[which == len(wanted)] = 0
    found = wanted[which] == hashes[at]
    return at[found], which[found]


_FILTER_MASK = np.uint32((1 << 20) - 1)


class WindowIndex:
    """Windows by the hash of their rarest shingle."""

    def __init__(self, items: list[str], windows: list[bytes], shingles: list[list[int]], frequency: dict[int, int]):
        rows = []
        for item, win, hashes in zip(items, windows, shingles):
            words = win.split(b" ")
            k = len(words) - len(hashes) + 1
            off = min(range(len(hashes)), key=lambda i: (frequency.get(hashes[i], 0), hashes[i]))
            if frequency.get(hashes[off], 0):  # a shingle that no document has: the window occurs nowhere
                rows.append((hashes[off], k, off, words, item))
        rows.sort(key=lambda r: (r[1], r[0] & (2**64 - 1)))
        self.by_size: dict[int, tuple[np.ndarray, list[list]]] = {}
        for h, k, off, words, item in rows:
            keys, found = self.by_size.setdefault(k, ([], []))
            if not keys or keys[-1] != h:
                keys.append(h)
                found.append([])
            found[-1].append((off, words, item))
        self.by_size = {k: (np.array(keys, np.int64).view(np.uint64), found) for k, (keys, found) in self.by_size.items()}

    def hits(self, words: texts.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Flags of hit words, and the items found in each text."""
        hit, items = np.zeros(len(words.hashes), bool), {}
        for k, (keys, windows) in self.by_size.items():
            at, which = _matches(texts.rolling(words.hashes, k), keys)
            docs = np.searchsorted(words.ends, at, side="right")
            for place, w, doc in zip(at.tolist(), which.tolist(), docs.tolist()):
                first, last = (int(words.ends[doc - 1]) if doc else 0), int(words.ends[doc])
                for off, win, item in windows[w]:
                    start = place - off
                    end = start + len(win)
                    if start >= first and end <= last and words.clean[words.starts[start]:words.stops[end - 1]].split() == win:
                        hit[start:end] = True
                        items.setdefault(doc, set()).add(item)
        return hit, items


_FOUND = "doc_id {id}, n_words long, n_hit long, hits binary, items array<string>, copy long"


def _search(docs: DataFrame, index: WindowIndex, keep_hits: bool) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in texts.slices(batches, "text"):
            words = texts.Words(raws, _TABLE)
            ends = words.ends
            hit, items = index.hits(words)
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            total = np.concatenate(([0], np.cumsum(hit)))
            n_hit = total[ends] - total[starts]
            packed = [np.packbits(hit[s:e]).tobytes() if keep_hits and n else None for s, e, n in zip(starts, ends, n_hit)]
            found = [sorted(items.get(i, ())) for i in range(len(raws))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ends - starts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(packed, pa.binary()),
                 pa.array(found, pa.list_(pa.string())), batch.column("copy")],
                names=["doc_id", "n_words", "n_hit", "hits", "items", "copy"])

    return docs.mapInArrow(find, _FOUND.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _united(parts: list[DataFrame]) -> DataFrame:
    """Unites the hits of several index parts per row; a row's hits have as many bits as it has words."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    schema = every.drop("copy").schema

    def unite(group: pa.Table) -> pa.Table:
        n = group["n_words"][0].as_py()
        hit = np.zeros((n + 7) // 8, np.uint8)
        for raw in group["hits"].to_pylist():
            if raw is not None:
                hit |= np.frombuffer(raw, np.uint8)
        items = sorted({x for xs in group["items"].to_pylist() for x in xs})
        one = group.slice(0, 1).drop_columns(["copy", "n_hit", "hits", "items"])
        return one.append_column("n_hit", pa.array([int(np.unpackbits(hit).sum())], pa.int64())).append_column(
            "hits", pa.array([None], pa.binary())).append_column("items", pa.array([items], pa.list_(pa.string()))).select([f.name for f in schema])

    return every.groupBy("copy").applyInArrow(unite, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, hit_share: int = 20, part_windows: int = PART_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated.

    A document is contaminated when it has a hit word and at least one in ``hit_share`` of its words is hit. Null and
    empty texts have no words and no hits; items without words have no window; items that repeat count once per id.
    Repeated rows are judged each. An empty benchmark hits nothing. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = materialise(item_windows(benchmark, item_id, item_text, window).withColumn("part", F.pmod(F.xxhash64("window", "item_id"), F.lit(2**31))))
    n_parts = max(1, -(-found.count() // part_windows))
    if n_parts > 1:
        rows = materialise(rows.withColumn("copy", F.monotonically_increasing_id()))
    else:
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
    results = []
    for part in range(n_parts):
        local = found.filter(F.pmod("part", F.lit(n_parts)) == part).select("item_id", "window", "shingles").toArrow()
        shingles = local["shingles"].to_pylist()
        sizes = sorted({len(w.split(b" ")) - len(h) + 1 for w, h in zip(local["window"].to_pylist(), shingles)})
        wanted = np.unique(np.array([x for hs in shingles for x in hs], np.int64)).view(np.uint64)
        wanted.sort()
        counted = shingle_frequencies(rows.select("text"), wanted, sizes).toArrow() if len(wanted) else None
        frequency = dict(zip(counted["shingle"].to_pylist(), counted["n"].to_pylist())) if counted else {}
        results.append(_search(rows, WindowIndex(local["item_id"].to_pylist(), local["window"].to_pylist(), shingles, frequency), n_parts > 1))
    per_doc = results[0] if n_parts == 1 else _united(results)
    return per_doc.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                          F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
                          ((F.col("n_hit") > 0) & (hit_share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is not contaminated.

    A row goes by its doc_id together with its text, so clean texts under the same doc_id, or without one, stay.
    """
    sha, row = (texts.fresh_name(docs.columns, name) for name in ("sha", "row"))
    rows = docs.withColumn(sha, F.unhex(F.sha2(F.col(text).cast("string"), 256)))
    judged = contamination(rows.withColumn(row, F.struct(F.col(doc_id).alias("id"), F.col(sha).alias("sha"))), benchmark, row, text, **options)
    bad = materialise(judged.filter("contaminated").select(F.col("doc_id.id").alias("__bad"), F.col("doc_id.sha").alias("__bad_sha")).distinct())
    return rows.join(bad, rows[doc_id].eqNullSafe(bad["__bad"]) & (rows[sha] == bad["__bad_sha"]), "left_anti").drop(sha)
