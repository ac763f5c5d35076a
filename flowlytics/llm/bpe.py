"""Byte-level BPE in linear time: longest matches, backtracking, and pairwise compatibility of neighbours.

The bytes of a piece, read as Latin-1, go once through an Aho-Corasick automaton of all tokens, which gives the longest token
at each place. The encoder takes it; where it can't stand beside the token before it, the next shorter prefix is tried, and
where none is left, the last token is taken back and its end closed for good. Each place is closed at most once, so the work
grows with the piece's length.

Two tokens may be neighbours if merging their joined bytes by rank ends in just these two. That is decided by undoing their
merges along the seam in falling order of rank: if the two parts at the seam merge before the merge just undone, they are no
neighbours. Answers are remembered. A sequence of pairwise compatible tokens is the only one that the merges can give.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlytics.llm import texts

REMEMBERED_PAIRS = 150_000
REMEMBERED_PIECES = 80_000
LONGEST_REMEMBERED = 64
PIECES_AT_ONCE = 100_000
OLD_LETTERS_END, OLD_LETTERS_BELOW = 0xD5, 0x540  # bytes of texts, and characters, that every Unicode version classes alike lie below


class Merges:
    """The tables of a vocabulary of ranks: halves of each token, shorter prefixes, the automaton.

    Every single byte has to be a token and every merge has to join tokens of lower rank, as training makes them; a token that
    the merges never reach is found only where it is a whole piece. Other vocabularies give a ValueError.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds every single byte")
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.ids = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.reached: dict[int, str] = {}
        self.length, self.shorter, self.halves = {}, {}, {}
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in sorted(self.ids.items(), key=lambda x: (len(x[0]) > 1, x[1])):
            self._add(text, i)
        for i, text in self.reached.items():
            self.shorter[i] = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if self.ids.get(text[:n]) in self.reached), None)
        self.automaton.make_automaton()

    def _add(self, text: str, i: int) -> None:
        if len(text) > 1:
            for n in range(1, len(text)):
                a, b = self.ids.get(text[:n]), self.ids.get(text[n:])
                if a in self.reached and b in self.reached and self._stand(a, b):
                    self.halves[i] = a, b
                    self.merged[a, b] = i
                    break
            else:
                if self._merges_to(text):
                    raise ValueError(f"token {i} is merged from a token of higher rank")
                return
        self.reached[i] = text
        self.length[i] = len(text)
        self.automaton.add_word(text, (len(text) - 1, i))

    def _merges_to(self, text: str) -> bool:
        """Whether plain merging of the single bytes ends in the whole text (asked only of tokens that have no halves)."""
        parts = list(text)
        while len(parts) > 1:
            found = min(((self.ids[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ids), default=None)
            if found is None:
                return False
            parts[found[1]:found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
        return True

    def compatible(self, left: int, right: int) -> bool:
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) >= REMEMBERED_PAIRS:
                self.known.clear()
            found = self.known[left, right] = self._stand(left, right)
        return found

    def _stand(self, left: int, right: int) -> bool:
        """Undoes merges beside the seam, the latest first; of equal ranks the left one was made first."""
        undone = None  # ranks below it would have been merged across the seam before
        while True:
            across = self.merged.get((left, right))
            if across is not None and (undone is None or across < undone):
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                undone, left = left, a[1]
            else:
                undone, right = right + 1, b[0]

    def encode(self, piece: str) -> list[int]:
        """Tokens of one piece, given as Latin-1 text of its bytes."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter, known = len(piece), self.length, self.shorter, self.known
        longest = [0] * n
        for end, (back, i) in self.automaton.iter(piece):
            longest[end - back] = i  # ends rise, so the longest comes last
        closed: set[int] = set()  # ends that lead nowhere
        out: list[int] = []
        at, before, token = 0, None, longest[0] if n else None
        while at < n:
            end = at + length[token]
            if end not in closed and (before is None or known.get((before, token)) or self.compatible(before, token)):
                out.append(token)
                at, before = end, token
                token = longest[at] if at < n else None
                continue
            token = shorter[token]
            if token is None:
                closed.add(at)
                token = out.pop()
                before = out[-1] if out else None
                at -= length[token]
        return out


class Pieces(dict):
    """Packed ids of each piece of text met so far; long pieces are not kept. When it is full, the older half goes."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = array("I", self.merges.encode(piece.encode().decode("latin-1")))
            if sys.byteorder == "big":
                ids.byteswap()
            packed = ids.tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


@lru_cache(maxsize=1)
def _classes() -> tuple[str, str]:
    """Letters and numbers as the tokenizer's library classes them, as ranges; Unicode versions differ."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    out = []
    for kind in (r"\p{L}", r"\p{N}"):
        single = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        points = np.array([ord(c) for c in bytes(single.encode_ordinary(every)).decode()])
        first = np.flatnonzero(np.diff(points, prepend=-2) > 1)
        last = np.append(first[1:], len(points)) - 1
        out.append("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[first].tolist(), points[last].tolist())) + "]")
    return out[0], out[1]


def plain_pattern(pattern: str, end: int) -> str:
    """The pattern for texts of characters below ``end``, with its classes spelled out as ranges, for the standard library."""

    def spelled(kind: str, inside: bool) -> str:
        points = np.array([c for c in range(end) if regex.fullmatch(kind.lower() if kind == r"\S" else kind, chr(c))])
        first = np.flatnonzero(np.diff(points, prepend=-2) > 1)
        last = np.append(first[1:], len(points)) - 1
        out = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(points[first].tolist(), points[last].tolist()))
        return out if inside else f"[^{out}]" if kind == r"\S" else f"[{out}]"

    parts = regex.split(r"(\\p\{[LN]\}|\\[sS]|\\.|[\[\]])", pattern)
    inside, out = False, []
    for part in parts:
        if part in ("[", "]"):
            inside = part == "["
        out.append(spelled(part, inside) if part in (r"\p{L}", r"\p{N}", r"\s") or (part == r"\S" and not inside) else part)
    return "".join(out)


class Encoder:
    """Ids of whole texts: pieces by the pattern, tokens by the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges = Merges(ranks)
        self.pieces = Pieces(self.merges)
        self.pattern = pattern
        try:  # the standard library is faster, where the pattern has no classes that it lacks
            self.split = re.compile(plain_pattern(pattern, OLD_LETTERS_BELOW))
        except re.error:
            self.split = regex.compile(pattern)
        self.exact = None

    def packed(self, raw: bytes) -> bytes:
        """Little-endian 32-bit ids of a text given in UTF-8."""
        split, text = self.split, raw.decode()
        if not text.isascii() and np.frombuffer(raw, np.uint8).max() >= OLD_LETTERS_END:
            if self.exact is None:
                letters, numbers = _classes()
                self.exact = regex.compile(self.pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers), regex.V1)
            split = self.exact
        if len(text) <= 8 * PIECES_AT_ONCE:
            return b"".join(map(self.pieces.__getitem__, split.findall(text)))
        found, out = split.finditer(text), []
        while some := [self.pieces[m.group()] for m in islice(found, PIECES_AT_ONCE)]:
            out.append(b"".join(some))
        return b"".join(out)


def ranks_of(path: str) -> dict[bytes, int]:
    """Reads a rank file: a line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a worker, built once."""
    return Encoder(ranks_of(path), pattern)


@lru_cache(maxsize=2)
def _bytes_of(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in ranks_of(path).items()}


def encoded(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit ids).

    Each match of ``pattern`` is encoded separately; special tokens in a text are plain text. A null text is empty, an empty
    one has no tokens. Rows stand for themselves: null and repeated doc_ids stay as they are, and an empty table gives an
    empty result. Other columns are ignored, whatever their names. ``ranks_path`` is a file that every machine has.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for batch, raws in texts.slices(batches, "text"):
            ids = [own.packed(raw) for raw in raws]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                                             names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decoded(tokens: DataFrame, ranks_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ``tokens``: doc_id, n_tokens, ids, decoded (the bytes). Null ids are empty; an id that the vocabulary lacks is an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _bytes_of(ranks_path)
        for batch, packed in texts.slices(batches, "ids"):
            out = [b"".join(map(own.__getitem__, np.frombuffer(p, "<u4").tolist())) for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(out, pa.binary())],
                                             names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = tokens.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(decode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")
