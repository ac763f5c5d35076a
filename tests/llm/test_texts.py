"""Packing, exact dedup, Jaccard join and decontamination against plain versions."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from flowlytics import session
from flowlytics.llm import components, contamination, exact, jaccard, packing
from flowlytics.llm import texts as operator_texts

SF_DIR = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d e"), (7, "A  B\tC d e"), (8, "a b c d e"), (9, "x " * 30_000),
       (10, "ΑΣ Σ İI don't we'll 12x3 <|endoftext|> éé ﬁ"), (11, "\x00\x0b\x0c"), (12, "…—!!! ???")]


def texts(spark, rows):
    """The rows with more columns, whose names clash with those of the operators."""
    full = [(i, t, "n", 1.0, 0, "f") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, norm string, fp double, block int, filter string").repartition(3)


def near_copies(seed=5, bases=12, copies=14):
    """Clusters of texts edited at several rates, some sharing passages, in which links chain."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    passage = [word() for _ in range(60)]
    rows = []
    for b in range(bases):
        base = [word() for _ in range(rng.choice([8, 40, 120]))]
        for c in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(w) // 20])):
                at = rng.randrange(len(w))
                w[at:at + rng.choice([0, 1])] = [word()]
            base = w if rng.random() < 0.3 else base
            if b % 3 == 0:
                w = w + passage[:rng.choice([30, 60])]
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


def test_exact_groups(spark, documents):
    for rows in (ODD, documents, ODD + ODD[3:5], []):
        got = [tuple(r) for r in exact.duplicate_groups(texts(spark, rows)).collect()]
        assert set(got) == brute.exact(rows) and len(got) == len(rows)


def test_exact_keeps_one_of_each(spark):
    kept = exact.keep_first(texts(spark, ODD + [(None, "one"), (None, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 9, 10, 11, 12]
    assert kept.columns == ["doc_id", "text", "norm", "fp", "block", "filter"]


def test_exact_keeps_other_texts_of_a_doc_id(spark):
    rows = [(1, "one"), (None, "one"), (None, "alone"), (3, "one"), (3, "other"), (4, "other")]
    kept = exact.keep_first(texts(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == [(1, "one"), (3, "other"), (None, "alone")]


def test_exact_keeps_one_row_of_repeated_ones(spark):
    rows = [(1, "one"), (1, "one"), (None, "two  x"), (None, "two x"), (None, "three"), (5, "one"), (6, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, __sha int, SHA int")
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns and exact.keep_first(docs.limit(0)).count() == 0
    got = sorted(((r.doc_id, " ".join((r.text or "").split())) for r in kept.collect()), key=str)
    assert got == [(1, "one"), (6, ""), (None, "three"), (None, "two x")]


def test_clean_rows_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6), (None, None, 5, 6)], "doc_id long, text string, __sha int, row int")
    items = spark.createDataFrame([(1, "other words here")], "item_id long, text string")
    kept = contamination.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_quotient_filters_merge_without_loss():
    import numpy as np

    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 2**64, 500, dtype=np.uint64) % np.uint64(97) * np.uint64(10**17 + 7) for _ in range(5)]
    filters = [exact.QuotientFilter.of(p, 25) for p in parts]
    blocks = {}
    for f in filters:
        for b, x in f.blocks(9):
            blocks.setdefault(b, []).append(exact.QuotientFilter.unpack(x.pack(9), b, 25, 9))
    merged = [exact.QuotientFilter.merged(x) for x in blocks.values()]
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    got = {int(v): int(c) for m in merged for v, c in zip(m.fingerprints(), m.counts)}
    assert got == dict(zip(map(int, values), map(int, counts)))


@pytest.mark.parametrize("rows", [ODD, near_copies(), near_copies(8, 3, 60), []], ids=["odd", "chains", "large", "empty"])
def test_jaccard_components(spark, rows):
    got = jaccard.near_duplicates(texts(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard(rows) and len(got) == len(rows)


def test_jaccard_on_documents(spark, documents):
    got = jaccard.near_duplicates(texts(spark, documents)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard(documents)


def test_jaccard_without_ranks(spark, monkeypatch):
    """The order of shingles is free: results don't depend on what counts as frequent."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "HOT", 2)
    rows = near_copies(13)
    got = jaccard.near_duplicates(texts(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard(rows)


@pytest.mark.parametrize("local", [1_000_000, 40, 0])
def test_components_in_any_number_of_steps(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    draw = random.Random(2)
    edges = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    alone = {x for a, b in edges if a == b for x in (a,)} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.root for r in got} == {x: r for x, r in root.items() if x not in alone} and len(got) == len(root) - len(alone)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_members_without_a_possible_partner():
    import numpy as np

    draw = random.Random(9)
    for _ in range(300):
        sizes = np.array([draw.randrange(1, 60) for _ in range(draw.randrange(1, 40))])
        rest = np.array([draw.randrange(max(0, 3 * n // 4 - 1), n) for n in sizes])
        want = [any(i != j and 100 * min(m, n) >= 75 * max(m, n) and 175 * (1 + min(p, q)) >= 75 * (m + n) for j, (n, q) in enumerate(zip(sizes, rest)))
                for i, (m, p) in enumerate(zip(sizes, rest))]
        assert jaccard.has_partner(sizes, rest, 75).tolist() == want


@pytest.mark.parametrize("others, pivots", [(512, (1, 4)), (4, (1,)), (2, ())])
def test_jaccard_in_voronoi_regions(spark, monkeypatch, others, pivots):
    """A hot group around the threshold: most of its sets share their rarest shingles, and only some link."""
    monkeypatch.setattr(jaccard, "REGION_ROWS", others)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    draw = random.Random(4)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(160):
        words = list(base)
        for _ in range(draw.randrange(0, 4)):
            words[draw.randrange(60)] = f"x{draw.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(draw.choice(base) for _ in range(40))) for i in range(160, 200)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(i, n, c) for i, (n, c) in brute.jaccard(rows).items()}


def test_jaccard_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "other words stand in here now"), (2, "a b c d e f"), (2, "a b c d e f"), (9, "other words stand in here now")]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.near_duplicates(texts(spark, rows)).collect()), key=str)
    assert got == [(2, 2), (2, 2), (3, 2), (3, 2), (9, 2), (None, None)]
    kept = jaccard.keep_one(texts(spark, rows)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [2, 2, None]


def test_contamination(spark, documents):
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    extra = [("s", "Rare, SHORT words"), ("n", None), ("e", "..."), ("t", benchmark[0][1]), ("x", "x " * 20)]
    docs = documents + [(10_000 + i, t) for i, t in ODD] + [(20_000, f"a {benchmark[1][1]} rare short; words"), (20_001, "rare short"), (20_002, benchmark[0][1].upper())]
    for items in (benchmark + extra, []):
        items = [(str(i), t) for i, t in items]
        bench = spark.createDataFrame(items, "item_id string, text string")
        want = brute.contamination(docs, items)
        for part_windows in (10**6, 700):
            got = contamination.contamination(texts(spark, docs), bench, part_windows=part_windows).drop("items").collect()
            assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(docs)
        kept = contamination.remove_contaminated(texts(spark, docs), bench)
        assert {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if not v[4]}


def test_decontamination_keeps_other_texts_of_a_doc_id(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, item), (None, "clean"), (None, None), (3, f"a {item}"), (3, "clean too"), (4, item.upper())]
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    for part_windows in (10**6, 3):
        kept = contamination.remove_contaminated(texts(spark, rows), bench, part_windows=part_windows)
        assert kept.columns == ["doc_id", "text", "norm", "fp", "block", "filter"]
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(3, "clean too"), (None, "clean"), (None, None)]


def token_ids(rows):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}


def check_packing(rows, got, capacity):
    ids, pieces, sequences = token_ids(rows), {}, {}
    for r in got:
        assert r.ids_crc32 == brute.crc_of_ids(ids[r.doc_id][r.start:r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for found, total in [(p, len(ids[i])) for i, p in pieces.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == total if total is not None else at <= capacity
    return sum(len(x) for x in ids.values()) / (len(sequences) * capacity)


def test_packing(spark, documents):
    assert check_packing(ODD, packing.packed(texts(spark, ODD), VOCABULARY).collect(), 4096) > 0.5
    got = packing.packed(texts(spark, documents).coalesce(1), VOCABULARY).collect()
    assert check_packing(documents, got, 4096) > 0.95
    small = packing.packed(texts(spark, documents).coalesce(1), VOCABULARY, capacity=64, block_tokens=20_000).collect()
    assert check_packing(documents, small, 64) > 0.99
    assert packing.packed(texts(spark, []), VOCABULARY).count() == 0


def test_packing_keeps_separator_characters(spark):
    rows = [(i, f"a{c}b {c} c") for i, c in enumerate("\x1c\x1d\x1e\x1f\x85\u2028\u200b")]
    assert check_packing(rows, packing.packed(texts(spark, rows), VOCABULARY).collect(), 4096) > 0
    tokens = packing.word_tokens(VOCABULARY)
    odd = [f"a{chr(c)}b" for c in range(0x3000) if chr(c) not in "ΣİI"]
    assert [t for t in odd if tokens(t) != tokens._whole(t)] == []


def test_packing_balances_cost():
    rng = random.Random(2)
    lengths = [rng.randint(1, 3000) for _ in range(400)]
    placed = packing.pack_lengths(lengths)
    total = {}
    for _, _, n, seq, _ in placed:
        total[seq] = total.get(seq, 0) + packing.cost(n)
    by_cost = sorted(total.values())
    assert by_cost[-2] / by_cost[1] < 1.25 and len(placed) < 2 * len(lengths)


def test_packed_ids(spark):
    rows = ODD[:8]
    got = packing.packed(texts(spark, rows), VOCABULARY, capacity=4, with_ids=True).collect()
    ids = token_ids(rows)
    for r in got:
        assert r.ids == b"".join(i.to_bytes(4, "little") for i in ids[r.doc_id][r.start:r.start + r.length])


def test_packing_splits_whole_texts_like_the_library(monkeypatch):
    rng = random.Random(7)
    pool = [*"abZ'_.,#09 \n\t  é́ÄßЖ字½²Ⅷ٣Kſ€", "'s", "'LL", "'re", "\x00", "﻿", "word", "naïve"]
    tokens = packing.WordTokens(VOCABULARY)
    merged = []
    monkeypatch.setattr(tokens, "merge", lambda part, merge=tokens.merge: merged.append(part) or merge(part))
    for _ in range(2000):
        text = "".join(rng.choices(pool, k=rng.randint(1, 12)))
        assert tokens(text) == tokens._whole(text), ascii(text)
    merged.clear()
    marks = [".", ",", "###", "!", "?", "$$$"]
    for text in ("word".join(m * 2 for m in marks), " ".join(f"zebra{m}" for m in marks), " ".join(f"Zebra{m}" for m in marks)):
        assert tokens(text) == tokens._whole(text)
    assert len(merged) == len(set(merged)) and not hasattr(tokens, "words")  # parts are remembered, not words with their marks


def test_jaccard_does_not_compare_all_unlinked_variants(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for doc in range(1, 161):  # each changes some words of the same text; the more it does, the fewer of the others it links to
        words = list(base)
        for at in rng.sample(range(150), rng.choice([2, 3, 4, 9, 10, 11])):
            words[at] = f"d{doc}x{at}"
        rows.append((doc, " ".join(words)))
    compared = []
    pairs = jaccard._pairs

    def counted(rows, x, y):
        if y == "x_rep":
            compared.append(rows.count())
        return pairs(rows, x, y)

    monkeypatch.setattr(jaccard, "_pairs", counted)
    got = jaccard.near_duplicates(texts(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard(rows)
    assert sum(compared) < 10 * len(rows), compared


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_signatures_bound_the_similarity(spark, percent):
    rng = random.Random(percent)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for doc in range(40):
        words = base[:rng.randint(30, 300)]
        for at in rng.sample(range(len(words)), rng.randint(0, 8)):
            words[at] = f"x{rng.randint(0, 50)}"
        rows.append((doc, " ".join(words)))
    rows += [(40, "one two three four five six"), (40, "other words of the same doc_id here")]
    docs = texts(spark, rows)
    signed = jaccard._signatures(docs, spark.createDataFrame([(d,) for d in range(41)], "rep long")).collect()
    signature = {r.rep: r.signature for r in signed}
    assert signature.pop(40) is None and None not in signature.values()
    sets = dict(zip((d for d, _ in rows), (set(s.tolist()) for s in jaccard.shingle_sets([t.encode() for _, t in rows]))))
    table = spark.createDataFrame([(a, b, len(sets[a]), signature[a], len(sets[b]), signature[b]) for a in range(40) for b in range(a)],
                                  "a long, b long, n long, s array<long>, m long, r array<long>")
    fits = {(x.a, x.b) for x in table.filter(jaccard._bits_may_link("n", "s", "m", "r", percent)).collect()}
    linked = {(a, b) for a in range(40) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert linked and linked <= fits and len(fits) < 40 * 39 // 2


def test_batches_are_bounded_by_bytes(spark):
    kept = spark.conf.get(session.BATCH_BYTES)
    try:
        spark.conf.unset(session.BATCH_BYTES)
        session.ship_library(spark)
        rows = spark.range(0, 120, 1, 1).select("id", F.expr("repeat('word ', 20000)").alias("text")).unionAll(spark.range(1).selectExpr("id", "repeat('x', 6000000)"))
        sizes = rows.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]}) for b in batches), "rows long, size long").collect()
        assert sum(r.rows for r in sizes) == 121
        assert all(r["size"] <= session.MOST_BATCH_BYTES + 200_000 for r in sizes if r["size"] < 6_000_000) and max(r["size"] for r in sizes) < 11_000_000
        spark.conf.set(session.BATCH_BYTES, "1m")
        assert session.ship_library(spark).conf.get(session.BATCH_BYTES) == "1m"  # a smaller bound stays
    finally:
        spark.conf.set(session.BATCH_BYTES, kept)


def test_free_memory_is_given_back_after_the_last_text(monkeypatch):
    called = []
    monkeypatch.setattr(operator_texts, "release", lambda: called.append(True))
    batches = [pa.RecordBatch.from_pydict({"text": ["a b", None]})]
    assert [raws for _, raws in operator_texts.slices(iter(batches), "text")] == [[b"a b", b""]] and called == [True]
