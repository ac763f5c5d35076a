"""Byte-level BPE, alignment of two tokenizers and repair of conversations against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from flowlytics.llm import align, bpe

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD_TEXTS = [None, "", " ", "\n\n  x", "a" * 5000, "ab" * 3000, "\x1c \x85\xa0 x", "<|endoftext|> hi", "don't I'LL they've", "՘\U00032000 中文 ก 12²Ⅷ", "x\r\n\ty  z   "]


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})


def plain_merges(piece, ranks):
    """Merges the pair of least rank, the leftmost of equal ones, until none is left."""
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_texts_are_encoded_as_by_the_library(name):
    path, draw = public_tokenizers.path(name), random.Random(name)
    own, other = bpe.encoder(path, public_tokenizers.PATTERN), library(path)
    tokens = list(bpe.ranks_of(path))
    cases = [t or "" for t in ODD_TEXTS]
    for token in draw.sample(tokens, 800):
        text = token.decode(errors="ignore")
        cases += [text * 3, f"x{text}y"]
    for _ in range(800):
        kind = draw.choice(["aab \n", None])
        points = [draw.choice([draw.randrange(32, 127), draw.randrange(0x80, 0xD800), draw.randrange(0xE000, 0x110000)]) for _ in range(30)]
        cases.append("".join(draw.choice(kind) for _ in range(60)) if kind else "".join(map(chr, points)))
    for text in cases:
        ids = other.encode_ordinary(text)
        assert own.packed(text.encode()) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_merges_of_a_small_vocabulary():
    ranks = {bytes([b]): b for b in range(256)}
    for i, token in enumerate([b"ab", b"bc", b"aa", b"aaa", b"abc", b"abab", b"cab", b"zzqq"]):
        ranks[token] = 256 + i
    merges = bpe.Merges(ranks)
    draw = random.Random(3)
    for _ in range(3000):
        piece = bytes(draw.choice(b"abcz") for _ in range(draw.randrange(1, 14)))
        want = [ranks[piece]] if piece in ranks else plain_merges(piece, ranks)
        assert merges.encode(piece.decode("latin-1")) == want
    assert merges.encode("zzqq") == [ranks[b"zzqq"]] and len(merges.encode("zzqqz")) == 5  # no merge reaches it
    with pytest.raises(ValueError):
        bpe.Merges({b"a": 0})
    with pytest.raises(ValueError):
        bpe.Merges({bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 290})


def test_time_grows_with_the_length():
    own = bpe.encoder(MULTI, public_tokenizers.PATTERN)
    raw = ("ab" * 200_000 + "a" * 200_000).encode()
    assert len(own.packed(raw)) // 4 == len(library(MULTI).encode_ordinary(raw.decode()))


def test_round_trip_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 50)
    rows = [(i, t, 7) for i, t in enumerate(ODD_TEXTS)] + [(1, "again", 1), (1, "again", 1), (None, "none", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    tokens = bpe.decoded(bpe.encoded(docs, MULTI, public_tokenizers.PATTERN), MULTI)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in tokens.collect())
    other = library(MULTI)
    want = []
    for i, t, _ in rows:
        ids = other.encode_ordinary(t or "")
        want.append((i is None, i or 0, len(ids), b"".join(x.to_bytes(4, "little") for x in ids), (t or "").encode()))
    assert got == sorted(want)
    assert bpe.encoded(docs.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0


def test_registered_bpe_equals_the_library(spark):
    from flowlytics.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    other = library(MULTI)
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = other.encode_ordinary(r.text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.add((r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = QUERIES["op11_byte_bpe"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in got.collect()} == want


def plain_alignment(rows):
    """Groups by walking both sides, links by comparing all ranges, counts over all rows."""
    a_side, b_side = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_side.encode_special_tokens = True
    letters = align.byte_alphabet()
    docs = []
    for _, text in rows:
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if not text or any(b"".join(x) != (" " + text).encode() for x in (a_bytes, b_bytes)):
            a, b, a_bytes, b_bytes = [], [], [], []
        ranges = []
        for ids, parts in ((a, a_bytes), (b, b_bytes)):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            ranges.append([(i, e - len(p), e) for i, p, e in zip(ids, parts, ends)])
        common = sorted({r[2] for r in ranges[0]} & {r[2] for r in ranges[1]})
        groups, start = [], 0
        for end in common:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in ranges))
            start = end
        links, k = [], 0
        for i, s, e in ranges[0]:
            while k < len(b) and ranges[1][k][2] <= s:
                k += 1
            m = k
            while m < len(b) and ranges[1][m][1] < e:
                links.append((i, b[m]))
                m += 1
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    counts = Counter(x for d in docs for x in d[3])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    return [(i, n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha)
            for (i, _), (n_a, n_b, n_groups, links, sha) in zip(rows, docs)]


def by_value(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_components_by_pointer_jumping():
    draw = random.Random(5)
    for _ in range(300):
        total = draw.randrange(1, 40)
        a, b = (np.array(sorted(draw.sample(range(1, total), draw.randrange(0, total)) + [total])) for _ in range(2))
        last = align.terminals(a, b)
        common = sorted(set(a.tolist()) & set(b.tolist()))
        want = [next(c for c in common if c >= e) for e in a.tolist() + b.tolist()]
        assert b[last].tolist() == want
    assert len(align.terminals(np.empty(0, np.int64), np.empty(0, np.int64))) == 0


def test_alignment_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(align, "CHUNK_LINKS", 300)
    texts_ = ODD_TEXTS + ["\u2581x y", "<0x41> <unk> <s>", "e\u0301 \ufb01 \u00bd", "tab\there", "a\u2028b"]
    rows = [(i, t) for i, t in enumerate(texts_)] + [(1, "again and again"), (1, "again and again"), (None, "nobody's own")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, links int, chunk string")
    got = align.alignment(docs, A_PATH, B_PATH)
    assert by_value(got.collect()) == by_value(plain_alignment(rows))
    assert align.alignment(docs.limit(0), A_PATH, B_PATH).count() == 0


def test_registered_alignment_equals_the_plain_one(spark):
    from flowlytics.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_token_alignment"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert by_value(got.collect()) == by_value(plain_alignment(rows))
