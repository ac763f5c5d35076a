"""Cheapest repair of conversations by depth-first branch and bound.

A conversation's rows in order of their turns are kept, given another role, deleted, or rows are inserted, so that the roles
form ``(s?(ua)+)?`` at the least cost; of equal costs the audit (the edits' initials) that comes first in ASCII order is taken.
A node of the search is (rows consumed, role state). An explicit stack holds the open prefixes; a prefix is given up where its
cost and the suffix's lower bound exceed the incumbent's cost, or where the dominance table of its node holds one at least as
good. Children are tried in ASCII order, so of two prefixes at a node the later one has the later audit, and a complete repair
that meets the bound proves itself least. Two prefixes of one node and cost have the same rows, so neither begins the other.

No conversation has to fit into a task: rows are dealt out by ranges of (conversation, turn). A conversation inside a range is
repaired there. Those at a range's ends, the long ones among them, are repaired by runs, one for each range: a run gives the
best repair from each role state to each other one, and the runs of a conversation are joined in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlytics.sources.stage import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
SPOKEN = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
FINISH = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}  # inserts after the last row
NEVER = 1 << 60
SOLID = re.compile(r"[^\x20\x09-\x0D]")
BLANKS = " \t\n\x0b\x0c\r"

Fault = tuple[str, str]  # initial of the role; b(lank), d(uplicate), t(runcated) or nothing


def suffix_bounds(faults: list[Fault], finish: dict[int, tuple[int, str]]) -> list[list[int]]:
    """For each number of rows consumed and each role state: no repair of the rest costs less."""
    bounds = [[finish.get(q, (NEVER, ""))[0] for q in STATES]]
    for initial, fault in reversed(faults):
        after, here = bounds[-1], []
        for q in STATES:
            least = after[q] + DELETE
            if fault not in ("b", "d"):
                extra = TRUNCATED if fault == "t" else 0
                least = min(least, after[NEXT[q]] + REROLE + extra)
                if (initial, q) in KEPT:
                    least = min(least, after[KEPT[initial, q]] + KEEP + extra)
            here.append(least)
        for _ in range(2):  # inserts move between user and assistant, so two of them reach every state
            here = [min(here[q], here[NEXT[q]] + INSERT) for q in STATES]
        bounds.append(here)
    return bounds[::-1]


def cheapest(faults: list[Fault], start: int, finish: dict[int, tuple[int, str]]) -> tuple[int, str] | None:
    """(cost, audit) of the best repair from role state ``start`` that ends after the last row in a state of ``finish``."""
    n, bounds = len(faults), suffix_bounds(faults, finish)
    if bounds[0][start] >= NEVER:
        return None
    incumbent: tuple[int, str | None] = bounds[0][start], None  # a cost that is reached; its audit is still open
    best: dict[tuple[int, int], int] = {}
    path: list[str] = []
    stack = [(0, "", 0, start, 0)]
    while stack:
        depth, letter, i, q, cost = stack.pop()
        del path[max(0, depth - 1):]
        if letter:
            path.append(letter)
        total = cost + bounds[i][q]
        if total > incumbent[0] or (total == incumbent[0] and incumbent[1] is not None) or best.get((i, q), NEVER) <= cost:
            continue
        best[i, q] = cost
        if i == n:
            if q in finish:
                incumbent = cost + finish[q][0], "".join(path) + finish[q][1]
            continue
        initial, fault = faults[i]
        extra = TRUNCATED if fault == "t" else 0
        if fault not in ("b", "d"):  # pushed in falling order of the letters
            stack.append((depth + 1, "R", i + 1, NEXT[q], cost + REROLE + extra))
            if (initial, q) in KEPT:
                stack.append((depth + 1, "K", i + 1, KEPT[initial, q], cost + KEEP + extra))
        stack.append((depth + 1, "I", i, NEXT[q], cost + INSERT))
        stack.append((depth + 1, "D", i + 1, q, cost + DELETE))
    return incumbent[0], incumbent[1]


def fault_of(text: str, repeated: bool) -> str:
    if not SOLID.search(text):
        return "b"
    if repeated:
        return "d"
    return "" if text.rstrip(BLANKS)[-1] in ".!?" else "t"


def lines(rows: list[tuple[str, str]], audit: str, state: int) -> tuple[list[str], int]:
    """``role:text`` of the rows after the edits of ``audit``, and the role state that they leave."""
    out, given = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(given)
        if letter == "D":
            continue
        state = KEPT[role[:1], state] if letter == "K" else NEXT[state]
        out.append(f"{role if letter == 'K' else SPOKEN[state]}:{text}")
    return out, state


class Tally:
    """Counts of a run of rows in order; runs of one conversation add up."""

    def __init__(self):
        self.count = {"b": 0, "d": 0, "t": 0}
        self.illegal = self.distinct = 0
        self.initials: list[str] = []  # of the first and the last row
        self.turns: list[int] = []  # the smallest and the largest

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if fault:
            self.count[fault] += 1
        if self.initials and self.initials[-1] + initial not in LEGAL:
            self.illegal += 1
        self.initials = [*self.initials[:1], initial]
        if turn is not None and (not self.turns or turn != self.turns[-1]):
            self.distinct += 1
            self.turns = [*self.turns[:1], turn]

    def join(self, later: Tally) -> None:
        self.illegal += later.illegal + (self.initials[-1] + later.initials[0] not in LEGAL if self.initials and later.initials else 0)
        self.distinct += later.distinct - (bool(self.turns and later.turns) and self.turns[-1] == later.turns[0])
        for fault in self.count:
            self.count[fault] += later.count[fault]
        self.initials, self.turns = ([*mine, *others][:1] + [*mine, *others][-1:] for mine, others in ((self.initials, later.initials), (self.turns, later.turns)))

    def values(self) -> tuple[int, ...]:
        gaps = self.turns[-1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return gaps, self.count["b"], self.count["d"], self.count["t"], self.illegal


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PIECES = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, piece int, pieces int, text string"
ROWS = "turn long, role string, run int, at long"


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults set by crc32 of ``conv_id:turn`` modulo 20: 0 lost, 1 emptied, 2 without ``.!?``, 3 twice, 4 from the user.

    Nulls are one space, in the hashed key as well as in role and text; conv_id and turn keep theirs in the rows.
    """
    key = F.concat(F.coalesce(F.col(conv_id).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    given = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("kind"))
    hurt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return (given.filter("kind <> 0").withColumns({"text": hurt, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
            .withColumn("copy", copies).select("conv_id", "turn", "role", "text"))


def _within_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs the conversations inside a range; hands on the rows of its first and last one."""
    run, first = TaskContext.get().partitionId(), True
    held, out = [], []

    def closed() -> dict:
        seen, tally, faults = set(), Tally(), []
        for turn, role, text in held:
            key = sha256(f"{len(role)}:{role}{text}".encode(errors="surrogatepass")).digest()
            fault = fault_of(text, key in seen)
            seen.add(key)
            faults.append((role[:1], fault))
            tally.add(turn, role[:1], fault)
        cost, audit = cheapest(faults, START, FINISH)
        text = "\n".join(lines([r[1:] for r in held], audit, START)[0])
        return dict(zip(COUNTS, (*tally.values(), cost))) | {"conv_id": conv, "audit": audit, "piece": 0, "pieces": 1, "text": text}

    def handed() -> Iterator[dict]:
        for at, (turn, role, text) in enumerate(held):
            yield {"conv_id": conv, "turn": turn, "role": role, "text": text, "run": run, "at": at}

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=WITHIN_SCHEMA)

    conv, size = None, 0
    for batch in batches:
        for c, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if held and c != conv:
                out.extend(handed() if first else [closed()])
                first, held = False, []
                if size >= 2_000_000:
                    yield packed(out)
                    out, size = [], 0
            conv = c
            held.append((turn, role, text))
            size += len(text) + 200
    out.extend(handed())
    if out:
        yield packed(out)


WITHIN_SCHEMA = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("piece", pa.int32()), ("pieces", pa.int32()), ("text", pa.string()),
                           ("turn", pa.int64()), ("role", pa.string()), ("run", pa.int32()), ("at", pa.int64())])
RUN = "conv_id long, run int, ways array<struct<start: int, stop: int, cost: long, audit: string>>, counts array<long>, initials array<string>, turns array<long>"


def _run(rows: pa.Table) -> pa.Table:
    """The best repairs of a run from each role state to each other, and its counts."""
    rows = rows.sort_by("at")
    tally, faults = Tally(), []
    for turn, role, text, repeated in zip(*(rows[c].to_pylist() for c in ("turn", "role", "text", "repeated"))):
        fault = fault_of(text, repeated)
        faults.append((role[:1], fault))
        tally.add(turn, role[:1], fault)
    found = {(q, end): cheapest(faults, q, {end: (0, "")}) for q in STATES for end in STATES}
    ways = [{"start": q, "stop": end, "cost": way[0], "audit": way[1]} for (q, end), way in found.items() if way]
    counts = [tally.distinct, tally.illegal, *tally.count.values()]
    return pa.table({"conv_id": rows["conv_id"][:1], "run": rows["run"][:1], "ways": [ways], "counts": [counts], "initials": [tally.initials], "turns": [tally.turns]},
                    schema=pa.schema([("conv_id", pa.int64()), ("run", pa.int32()),
                                      ("ways", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
                                      ("counts", pa.list_(pa.int64())), ("initials", pa.list_(pa.string())), ("turns", pa.list_(pa.int64()))]))


PATH = "conv_id long, run int, piece int, pieces int, state int, part string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"


def _joined(runs: pa.Table) -> pa.Table:
    """The best repair of a conversation from its runs in order: a row per run with its part of the audit."""
    whole, ahead = Tally(), {START: (0, "", [])}
    ordered = runs.sort_by("run").to_pylist()
    for run in ordered:
        tally = Tally()
        tally.distinct, tally.illegal = run["counts"][:2]
        tally.count = dict(zip(tally.count, run["counts"][2:]))
        tally.initials, tally.turns = run["initials"], run["turns"]
        whole.join(tally)
        reached = {}
        for way in run["ways"]:
            if way["start"] in ahead:
                cost, audit, parts = ahead[way["start"]]
                new = cost + way["cost"], audit + way["audit"], [*parts, (way["start"], way["audit"])]
                if way["stop"] not in reached or new[:2] < reached[way["stop"]][:2]:
                    reached[way["stop"]] = new
        ahead = reached
    cost, audit, parts = min((ahead[q][0] + FINISH[q][0], ahead[q][1] + FINISH[q][1], [*ahead[q][2][:-1], (ahead[q][2][-1][0], ahead[q][2][-1][1] + FINISH[q][1])]) for q in ahead)
    figures = dict(zip(COUNTS, (*whole.values(), cost)))
    rows = [{"conv_id": run["conv_id"], "run": run["run"], "piece": k, "pieces": len(parts), "state": state, "part": part, "audit": audit if k == 0 else None} | figures
            for k, (run, (state, part)) in enumerate(zip(ordered, parts))]
    kinds = {"conv_id": pa.int64(), "run": pa.int32(), "piece": pa.int32(), "pieces": pa.int32(), "state": pa.int32(), "part": pa.string(), **dict.fromkeys(COUNTS, pa.int64()), "audit": pa.string()}
    return pa.Table.from_pylist(rows, schema=pa.schema(list(kinds.items())))


def _written(rows: pa.Table, path: pa.Table) -> pa.Table:
    """The text of a run after its part of the repair."""
    rows, way = rows.sort_by("at"), path.to_pylist()[0]
    text = "\n".join(lines(list(zip(rows["role"].to_pylist(), rows["text"].to_pylist())), way["part"], way["state"])[0])
    kept = path.select(["conv_id", *COUNTS, "audit", "piece", "pieces"])
    return kept.append_column("text", pa.array([text], pa.string()))


def _of_runs(rows: DataFrame) -> DataFrame:
    """Pieces of the conversations at the ends of ranges. ``rows``: conv_id, turn, role, text, run, at."""
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    keyed = rows.withColumn("said", said)
    place = F.struct("run", "at")
    firsts = keyed.groupBy("conv_id", "said").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
    known = keyed.join(firsts, keyed["conv_id"].eqNullSafe(firsts["c"]) & (keyed["said"] == firsts["s"]), "left")
    known = materialise(known.select("conv_id", "turn", "role", "text", "run", "at", F.coalesce(place > F.col("first"), F.lit(False)).alias("repeated")))
    runs = materialise(known.groupBy("conv_id", "run").applyInArrow(_run, RUN))
    paths = runs.groupBy("conv_id").applyInArrow(_joined, PATH)
    return known.groupBy("conv_id", "run").cogroup(paths.groupBy("conv_id", "run")).applyInArrow(_written, PIECES)


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Pieces of the repaired conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, piece, pieces, text.

    ``text`` holds the piece's ``role:text`` lines, joined by newlines; a conversation is one piece unless it spans several
    ranges of rows (then ``audit`` is on piece 0, and pieces without any line are empty texts). Rows go by turn, nulls first,
    rows of one turn by role and text. A row's first fault counts: blank (white space only), duplicate (role and text seen
    earlier in the conversation), truncated (the last character that isn't white space is not one of ``.!?``). Null roles and
    texts are one space; a null conv_id is a conversation of its own. An empty table gives no pieces. Other columns are
    ignored, whatever their names.
    """
    given = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    spread = given.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order).drop("row")
    found = materialise(spread.mapInArrow(_within_ranges, f"{PIECES}, {ROWS}"))
    columns = [part.split()[0] for part in PIECES.split(", ")]
    inside = found.filter("run IS NULL").select(columns)
    return inside.unionAll(_of_runs(found.filter("run IS NOT NULL").select("conv_id", "turn", "role", "text", "run", "at")).select(columns))


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired``: its figures and repaired_sha256.

    A hash can't be merged, so the pieces of a conversation that has several stream through one task, one after the other.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, row, some = None, None, False
        for batch in batches:
            for record in batch.to_pylist():
                if record["piece"] == 0:
                    state, row, some = sha256(), record, False
                if record["text"]:
                    state.update((b"\n" if some else b"") + record["text"].encode())
                    some = True
                if record["piece"] == record["pieces"] - 1:
                    figures = {c: row[c] for c in ("conv_id", *COUNTS, "audit")} | {"repaired_sha256": state.hexdigest()}
                    yield pa.RecordBatch.from_pylist([figures], schema=DIGEST_SCHEMA)

    one = pieces.filter("pieces = 1").select("conv_id", *COUNTS, "audit", F.sha2("text", 256).alias("repaired_sha256"))
    more = pieces.filter("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return one.unionAll(more.mapInArrow(hashed, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"))


DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
