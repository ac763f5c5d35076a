"""Repair of conversations against a plain search over all repairs in order of (cost, audit)."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from flowlytics.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(faults):
    """Cheapest path by Dijkstra over (rows consumed, written roles' state), ties by the audit so far."""
    done, heap = set(), [(0, "", 0, "")]
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(faults) and last in ("", "a"):
            return cost, audit
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if i < len(faults):
            initial, fault = faults[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if fault not in ("b", "d"):
                extra = fault == "t"
                if initial and initial in legal:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initial))
                for x in "ua":
                    if x in legal:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, x))
        for x in "ua":
            if x in legal:
                heapq.heappush(heap, (cost + 2, audit + "I", i, x))


def plain(rows):
    """rows after damage -> the contract's row of each conversation."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r[1:])
    out = set()
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            solid = [c for c in text if c not in " \t\n\x0b\x0c\r"]
            faults.append((role[:1], "b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t"))
            seen.add((role, text))
        turns = {r[0] for r in own if r[0] is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
        cost, audit = plain_repair(faults)
        written, given, last = [], iter(own), ""
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(given)
            if letter != "D":
                role = role if letter == "K" else "assistant" if last == "u" else "user"
                written.append(f"{role}:{text}")
                last = role[:1]
        counts = [sum(f == kind for _, f in faults) for kind in "bdt"]
        out.add((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(written).encode()).hexdigest()))
    return out


def drawn(seed, conversations, longest):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        for _ in range(draw.randrange(0, longest)):
            rows.append((conv, draw.choice([None, *range(longest)]), draw.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]),
                         draw.choice([None, "", " \t\n", "Yes.", "No!", "and", "Why? \n", " ", "　.", "x" * 2000 + "."])))
    return rows


def test_search_equals_plain_search():
    draw = random.Random(1)
    for _ in range(4000):
        faults = [(draw.choice("suaat "), draw.choice(["", "", "b", "d", "t"])) for _ in range(draw.randrange(0, 9))]
        assert repair.cheapest(faults, repair.START, repair.FINISH) == plain_repair(faults)


def test_search_of_a_long_conversation():
    faults = [("u", "t"), ("u", ""), ("s", "")] * 3000
    cost, audit = repair.cheapest(faults, repair.START, repair.FINISH)
    assert (cost, audit) == plain_repair(faults)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_conversations_over_any_number_of_ranges(spark, partitions):
    rows = drawn(partitions, 25, 12) + [(99, t, ["user", "assistant"][t % 7 % 2], f"Turn {t % 60}" + ".?"[t % 2] * (t % 5 > 0)) for t in range(400)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        given = spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, audit string")
        got = repair.digests(repair.repaired(given))
        want = plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
        assert {tuple(r) for r in got.select(COLUMNS).collect()} == want
        assert got.count() == len(want)
        assert repair.digests(repair.repaired(given.limit(0))).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_damage(spark):
    rows = drawn(8, 60, 10)
    got = repair.damaged(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, plain_damage(rows)))


def test_registered_repair_equals_the_plain_one(spark):
    from flowlytics.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(plain_damage(rows))
    missing = {r[0] for r in rows} - {r[0] for r in want}
    want |= {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in missing}
    got = QUERIES["op13_conversation_repair"](spark, sf_dir)
    assert got.columns == COLUMNS
    assert {tuple(r) for r in got.collect()} == want and got.filter(F.col("cost") > 0).count()
