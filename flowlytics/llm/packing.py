"""Cost-balanced packing of tokenised documents into training sequences.

The cost of a piece of n tokens is linear (matrix products) plus quadratic (attention). Documents are tokenised and packed
in the task that reads them, in blocks of about ``BLOCK_TOKENS`` tokens, so no token crosses the network and a task holds
one block. In a block, a document's full sequences are cut off first; what is left is taken in descending length and goes
to the sequence of the lowest cost that still has room for it whole. Where no sequence has, the piece is cut: the cheapest
sequence with any room takes what fits. So every sequence of a block but the emptiest ones is filled to the last token.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlytics.llm import texts

CAPACITY = 4096
END_ID = 2
BLOCK_TOKENS = 1 << 21
# attention cost of a pair of tokens against the linear cost of one token (about 1 / (6 x model width))
QUADRATIC = 1 / 12_288
CACHED = 150_000

# fixed value: the tokenizer file's own pattern, letters first, for characters of which \w tells letters from the rest
_SPLIT = re.compile(r"[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\w\s]|_)+").findall
_SPLIT_ASCII = re.compile(r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9]+").findall
_SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space for str.split(), but not for the pattern


class WordTokens:
    """Token ids (packed 32-bit) of whole texts by a word-level BPE file that drops white space.

    White space never joins a token, so the ids of a text are those of the parts that the pattern makes of it. Parts are
    remembered, in two generations of bounded size, and the library's model merges each new one. A word with characters that
    Python and the library class differently goes through the library. Texts with characters for which lower case depends on
    the place, with control characters that only Python takes for white space, or with special tokens, go through it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.parts: dict[str, bytes] = _Generations(self._part)
        self.known: dict[str, bool] = _Generations(self._known)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _part(self, part: str) -> bytes:
        pieces = self.merge(part.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters))
        return array("I", [p.id for p in pieces]).tobytes()

    def _known(self, letter: str) -> bool:
        """Whether Python and the library, whose Unicode tables differ in age, take the character for the same class."""
        if letter.isascii():
            return True
        if letter.isalnum() and not letter.isalpha():  # a number for the library, like a letter in _SPLIT
            return False
        probe = f"a{letter}{letter}b"
        return self._joined(unicodedata.normalize("NFC", probe)) == self._whole(probe)

    def _joined(self, text: str) -> bytes:
        low = text.lower()
        return b"".join(map(self.parts.__getitem__, _SPLIT_ASCII(low) if low.isascii() else _SPLIT(low)))

    def __call__(self, text: str) -> bytes:
        plain = text.isascii()
        if not plain:
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text or "İ" in text:
                return self._whole(text)
        if "<|" in text or any([c in text for c in _SEPARATORS]):
            return self._whole(text)
        if plain or all(map(self.known.__getitem__, set(text))):
            return self._joined(text)
        return b"".join([self._joined(w) if all(map(self.known.__getitem__, set(w))) else self._whole(w) for w in text.split()])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Generations(dict):
    """A cache of two generations: a full young one becomes the old one, and what is used again moves back."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One tokenizer for each Python worker."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def cost(length: int, quadratic: float = QUADRATIC) -> float:
    return length + quadratic * length * length


def pack_lengths(lengths: list[int], capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Packs documents of the given token counts: (document, start in it, length, sequence, offset in the sequence)."""
    placed, rest, sequences = [], [], 0
    for doc, n in enumerate(lengths):
        for s in range(0, n - n % capacity, capacity):
            placed.append((doc, s, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rest.append((n % capacity, doc, n - n % capacity))
    rest.sort(key=lambda r: (-r[0], r[1]))
    k = -(-sum(r[0] for r in rest) // capacity)
    if not k:
        return placed
    costs, room, used = np.zeros(k), np.full(k, capacity), [0] * k
    for n, doc, start in rest:
        while n:
            fits = np.where(room >= n, costs, np.inf)
            at = int(fits.argmin())
            if fits[at] == np.inf:  # no sequence has room for the whole piece: the cheapest with any takes a part
                at = int(np.where(room > 0, costs, np.inf).argmin())
            size = min(n, int(room[at]))
            placed.append((doc, start, size, sequences + at, used[at]))
            used[at] += size
            room[at] -= size
            costs[at] += cost(size, quadratic)
            start, n = start + size, n - size
    return placed


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
           block_tokens: int = BLOCK_TOKENS, quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, sequence_cost (and ids).

    A document's ids are its text's tokens and ``end_id``; a null or empty text is ``end_id`` alone. Every id lies in one
    piece. Repeated rows are packed each. ``sequence_id`` names partition and sequence, unique but not gapless; offsets
    are gapless from 0. Padding of a sequence is capacity minus sequence_tokens. An empty table gives no piece.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        base = TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4").tobytes()
        ids: list = []
        held: list[bytes] = []
        size = 0
        for batch, raws in texts.slices(batches, "text"):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), raws):
                ids.append(doc)
                held.append(tokens(raw.decode("utf-8", "replace")) + end)
                size += len(held[-1]) // 4
                if size >= block_tokens:
                    out, base = block(ids, held, base)
                    yield out
                    ids, held, size = [], [], 0
        if held:
            yield block(ids, held, base)[0]

    def block(ids: list, held: list[bytes], base: int) -> tuple[pa.RecordBatch, int]:
        rows = pack_lengths([len(x) // 4 for x in held], capacity, quadratic)
        doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*rows))
        pieces = [held[d][4 * s:4 * (s + n)] for d, s, n, _, _ in rows]
        filled = np.bincount(seq, weights=length)
        costs = np.bincount(seq, weights=length + quadratic * length.astype(float) ** 2)
        totals = np.array([len(x) // 4 for x in held], np.int64)
        columns = [pa.array([ids[d] for d in doc.tolist()], id_type), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                   pa.array(totals[doc]), pa.array(base + seq), pa.array(offset), pa.array(filled[seq].astype(np.int64)), pa.array(costs[seq])]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_cost"]
        if with_ids:
            columns.append(pa.array(pieces, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names), base + len(filled)

    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    return rows.mapInArrow(pack, f"doc_id {kind.simpleString()}, {_PIECES}" + (", ids binary" if with_ids else ""))
