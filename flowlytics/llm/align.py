"""Alignment of two tokenizers over the same bytes by pointer jumping.

The tokens of both sides are intervals of one byte sequence. Each token points to the one that reaches farthest to the right
among those that overlap it, itself included; of two that end together it is the one of side B. Successors are doubled for
all tokens of a task's slice at once until nothing changes: then each token points to the last token of its connected
component, which labels the group. Groups are thus the stretches between offsets where both sides end.

Counts of linked id pairs are corpus-wide, so documents are staged in chunks of about CHUNK_LINKS links: distinct id pairs
of the chunk, and a short number per link. The distinct pairs are summed over all chunks, each chunk gets the sums of its own
pairs back by a join, and the numbers per link then give the figures of each document without a second run of the tokenizers.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlytics.llm import bpe, texts
from flowlytics.sources.stage import materialise

CHUNK_LINKS = 500_000
SLICE_BYTES = 300_000
SPACE_PIECE = "▁"
NEXT, SIDE, GROUP, LAST = range(4)
SEPARATORS = (b",", b"|", b";", b"")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from U+0100 on."""
    shown = {b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


# how byte-level vocabularies of this kind split a text before merging (fixed value)
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """Side A: a byte-level vocabulary of the tokenizers library, given as its JSON file.

    Characters that every Unicode version classes alike take the merges of ``bpe``, which remembers pieces; other texts go
    through the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        special = {t.content for t in self.library.get_added_tokens_decoder().values() if t.special}
        letters = byte_alphabet()
        self.bytes_of = {i: bytes(map(letters.__getitem__, t)) for t, i in vocabulary.items() if t not in special}
        self.fast = bpe.Encoder({b: i for i, b in self.bytes_of.items()}, BYTE_LEVEL_PATTERN)

    def encode(self, raw: bytes) -> np.ndarray:
        if np.frombuffer(raw, np.uint8).max(initial=0) < bpe.OLD_LETTERS_END:
            return np.frombuffer(self.fast.packed(raw), "<u4")
        return np.array(self.library.encode(raw.decode(), add_special_tokens=False).ids, np.uint32)


class Piece:
    """Side B: a sentencepiece model; a piece is its UTF-8 with U+2581 as space, a byte piece its byte."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes_of = {i: bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace(SPACE_PIECE, " ").encode() for i, n in enumerate(names)}


class Sides:
    """Both tokenizers of a worker, and the decimal strings of ids with the separator that follows them."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Piece(b_path)
        top = max(max(self.a.bytes_of), max(self.b.bytes_of)) + 1
        self.lengths = [np.array([len(side.bytes_of.get(i, b"")) for i in range(top)], np.int64) for side in (self.a, self.b)]
        self.starts = [np.cumsum(n) - n for n in self.lengths]
        self.flat = [np.frombuffer(b"".join(side.bytes_of.get(i, b"") for i in range(top)), np.uint8) for side in (self.a, self.b)]
        width = len(str(top)) + 1
        self.top, self.shown = top, np.zeros((len(SEPARATORS) * top, width), np.uint8)
        for k, mark in enumerate(SEPARATORS):
            rows = b"".join((str(i).encode() + mark).ljust(width, b"\0") for i in range(top))
            self.shown[k * top:(k + 1) * top] = np.frombuffer(rows, np.uint8).reshape(top, width)

    def tokens(self, raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of each text; none where a side's bytes are not those of the text."""
        none = np.empty(0, np.uint32), np.empty(0, np.uint32)
        of_b = self.b.library.encode([raw.decode() for raw in raws], num_threads=1)
        out = [(self.a.encode(b" " + raw), np.array(b, np.uint32)) if raw else none for raw, b in zip(raws, of_b)]
        given = np.array([len(raw) + 1 if raw else 0 for raw in raws], np.int64)
        whole = np.ones(len(raws), bool)
        for k in (0, 1):
            ids = np.concatenate([o[k] for o in out])
            spelled = np.concatenate([[0], np.cumsum(self.lengths[k][ids])])[np.cumsum([len(o[k]) for o in out])]
            whole &= np.diff(spelled, prepend=0) == given
        out = [o if w else none for o, w in zip(out, whole)]
        meant = np.frombuffer(b"".join(b" " + raw for raw, w in zip(raws, whole) if w and raw), np.uint8)
        wrong = np.zeros(len(meant), bool)
        for k in (0, 1):
            wrong |= self._spelled(k, np.concatenate([o[k] for o in out])) != meant
        if wrong.any():
            ends = np.cumsum(np.where(whole, given, 0))
            sums = np.concatenate([[0], np.cumsum(wrong)])[ends]
            out = [none if bad else o for o, bad in zip(out, np.diff(sums, prepend=0) > 0)]
        return out

    def _spelled(self, k: int, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens of side ``k``, one after the other."""
        lengths = self.lengths[k][ids]
        ends = np.cumsum(lengths)
        return self.flat[k][np.arange(lengths.sum()) + np.repeat(self.starts[k][ids] - ends + lengths, lengths)]


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_path, b_path)


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The last token (B's number) of each token's component, A's tokens first. Ends are rising byte offsets of both sides."""
    n = len(a_ends)
    to_b = np.searchsorted(b_ends, a_ends)
    to_a = np.searchsorted(a_ends, b_ends)
    farther = a_ends[to_a] > b_ends if len(b_ends) else np.empty(0, bool)
    step = np.concatenate([n + to_b, np.where(farther, to_a, n + np.arange(len(b_ends)))])
    while True:
        doubled = step[step]
        if np.array_equal(doubled, step):
            return step - n
        step = doubled


class Aligned:
    """Groups and links of a slice of texts, whose tokens lie one after the other."""

    def __init__(self, own: Sides, raws: list[bytes]):
        pairs = own.tokens(raws)
        self.n_a, self.n_b = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
        a, b = (np.concatenate([p[k] for p in pairs]).astype(np.int64) for k in (0, 1))
        a_ends, b_ends = np.cumsum(own.lengths[0][a]), np.cumsum(own.lengths[1][b])
        last = terminals(a_ends, b_ends)
        is_last = last[len(a):] == np.arange(len(b))
        number = np.cumsum(is_last) - 1
        self.group_a, self.group_b = number[last[:len(a)]], number[last[len(a):]]
        self.to_a, self.to_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        through = np.concatenate([[0], np.cumsum(is_last)])[self.to_b]
        self.n_groups = np.diff(through, prepend=0)
        ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
        self.links = (a[np.searchsorted(a_ends, ends)].astype(np.uint64) << np.uint64(32)) | b[np.searchsorted(b_ends, ends)].astype(np.uint64)
        self.n_links = self.n_a + self.n_b - self.n_groups  # a link for each stretch between ends of either side
        self._digest(own, a, b, is_last)

    def _digest(self, own: Sides, a: np.ndarray, b: np.ndarray, is_last: np.ndarray) -> None:
        """The groups as text, tokens in the order (group, side, place), hashed for each document."""
        groups = int(self.n_groups.sum())
        a_through = np.cumsum(np.bincount(self.group_a, minlength=groups))
        b_before = np.cumsum(np.bincount(self.group_b, minlength=groups)) - np.bincount(self.group_b, minlength=groups)
        mark_a = np.full(len(a), NEXT)
        mark_a[a_through - 1] = SIDE
        mark_b = np.where(is_last, GROUP, NEXT)
        mark_b[self.to_b[self.n_b > 0] - 1] = LAST
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + b_before[self.group_a]] = mark_a * own.top + a
        code[np.arange(len(b)) + a_through[self.group_b]] = mark_b * own.top + b
        shown = own.shown[code]
        used = shown != 0
        text = shown[used].tobytes()
        ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[self.to_a + self.to_b]
        self.shas, start = [], 0
        for end in ends.tolist():
            self.shas.append(sha256(text[start:end]).hexdigest() if end > start else "")
            start = end


def _chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per chunk: its documents' figures as lists, distinct id pairs with their times, and the number of each link's pair."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = sides(a_path, b_path), [], 0
        for batch, raws in texts.slices(batches, "text", SLICE_BYTES):
            found = Aligned(own, raws)
            held.append((batch.column("doc_id").to_pylist(), found.n_a, found.n_b, found.n_groups, found.n_links, found.shas, found.links))
            size += len(found.links) + batch.num_rows
            if size >= CHUNK_LINKS:
                yield chunk(held)
                held, size = [], 0
        if held:
            yield chunk(held)

    def chunk(held: list[tuple]) -> pa.RecordBatch:
        ids, n_a, n_b, n_groups, n_links, shas, links = zip(*held)
        pairs, place, times = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
        kind = "<u2" if len(pairs) <= 1 << 16 else "<u4"
        numbers = [np.concatenate(x) for x in (n_a, n_b, n_groups, n_links)]
        columns = [[i for part in ids for i in part], *numbers, [s for part in shas for s in part], pairs.view(np.int64), times]
        kinds = [pa.int64()] * 5 + [pa.string()] + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([c], pa.list_(k)) for c, k in zip(columns, kinds)), pa.array([place.astype(kind).tobytes()], pa.binary())],
                                          names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "pairs", "times", "links"])

    lists = ", ".join(f"{c} array<long>" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links"))
    return docs.mapInArrow(build, f"chunk string, {lists}, sha array<string>, pairs array<long>, times array<long>, links binary")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair (A id in the upper, B id in the lower 32 bits), n, best: whether no pair of that B id has more links."""
    each = chunks.select(F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    counts = materialise(each.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each chunk, with the figures of their links from the counts of the chunk's pairs."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids, n_a, n_b, n_groups, n_links, shas, answers = (batch.column(c)[r].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "answers"))
            pairs, n, best = (answers.field(k).to_numpy(zero_copy_only=False) for k in ("pair", "n", "best"))
            order = np.argsort(pairs.astype(np.int64).view(np.uint64))
            raw = batch.column("links")[r].as_buffer()
            sizes = n_links.to_numpy()
            links = np.frombuffer(raw, "<u2" if len(raw) == 2 * sizes.sum() else "<u4")
            sums = [np.concatenate([[0], np.cumsum(v[order].astype(np.int64)[links])]) for v in (best, n)]
            ends = np.cumsum(sizes)
            n_best, count_sum = (pa.array(s[ends] - s[ends - sizes], pa.int64()) for s in sums)
            yield pa.RecordBatch.from_arrays([ids, n_a, n_b, n_groups, n_links, n_best, count_sum, shas],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def alignment(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Side A encodes a space and the text, side B the text. Links are the pairs of an A and a B token that share a byte; n_best
    counts those whose id pair has as many links in all documents as any pair of its B id, count_sum adds up their pairs'
    links. Groups are written as ``a1,a2|b1;a3|b2`` and hashed. Null and empty texts, and texts whose bytes a side does not
    give back, have no tokens: zeros and an empty hash. Rows stand for themselves, so repeated texts count again; null and
    repeated doc_ids stay. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chunks = materialise(_chunks(rows, a_path, b_path))
    asked = chunks.select("chunk", F.explode("pairs").alias("pair")).join(pair_counts(chunks), "pair")
    answers = asked.groupBy("chunk").agg(F.collect_list(F.struct("pair", "n", "best")).alias("answers"))
    known = chunks.drop("pairs", "times").join(answers, "chunk", "left").withColumn("answers", F.coalesce("answers", F.expr("cast(array() as array<struct<pair: bigint, n: bigint, best: boolean>>)")))
    return known.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "links", "answers").mapInArrow(
        _figures, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
