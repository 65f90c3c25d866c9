"""Conversations brought to the order (system? (user assistant)+)? by the cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.llm._shared import apart, arrow_map, stored

#: Costs of edits; an undeleted truncated row adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a segment at most, and characters of role and text that put rows of one turn in order, before their hash.
SEGMENT, TIE = 512, 64
#: Grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What each state takes next, and where that leads.
NEXT, AFTER = (b"user", b"user", b"assistant", b"user"), (2, 2, 3, 2)
#: A row's kind: the class of its role's initial (s, u, a, other) + 4 * its fault (none, truncated, to be deleted).
OPEN, TRUNC, GONE = 0, 4, 8
_SPACE = r"\x20\x09-\x0D"
_SEGMENTS = "conv string, at long, kinds binary, blank array<boolean>, keys array<string>, first long, last long, turns long, roles array<binary>, texts array<binary>"
FACTS = "blank long, duplicate long, truncated long, illegal long, gaps long, cost long"


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32(`conv:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes its [.!?] away,
    3 repeats it, 4 makes it the user's. Nulls read as one space in roles, texts and the hash."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(known(conv_col), F.lit(":"), known(turn_col)).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(known(text_col), "[.!?]", "")).otherwise(known(text_col))
    out = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(case == 4, "user").otherwise(known(role_col)).alias("role"), text.alias("text"), F.array_repeat(F.lit(0), F.when(case == 0, 0).when(case == 3, 2).otherwise(1)).alias("times"))
    return out.withColumn("times", F.explode("times")).drop("times")


def key(conv: Column) -> Column:
    """A conversation's key; rows without an id are one conversation."""
    return F.coalesce(conv.cast("string"), F.lit(" "))


def segments(rows: DataFrame) -> DataFrame:
    """Runs of at most SEGMENT rows of a conversation in the order of turn (nulls first), then of role and text by their first TIE characters and
    hashes; `at` grows with the order.

    Rows are ranged over all of these, so a conversation of any size, and any number of equal rows, is spread over many tasks.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    initial = F.substring(role, 1, 1)
    blank = ~F.rlike(text, F.lit(f"[^{_SPACE}]"))
    ends = F.rlike(text, F.lit(rf"[.!?][{_SPACE}]*\z"))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.when(blank, GONE).when(ends, OPEN).otherwise(TRUNC)
    same = F.when(~blank, F.md5(F.concat(role, F.lit("\0"), text).cast("binary")))  # blank rows go in any case
    each = rows.select(key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), role.cast("binary").alias("role"), text.cast("binary").alias("text"), kind.cast("int").alias("kind"), blank.alias("blank"), same.alias("key"), F.substring(role, 1, TIE).alias("r"), F.substring(text, 1, TIE).alias("t"), F.xxhash64(role, text).alias("h"), F.monotonically_increasing_id().alias("n"))
    order = ["conv", "turn", "r", "t", "h", "n"]
    sorted_ = each.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in (b for b in batches if b.num_rows):
            conv, n = batch.column("conv"), batch.num_rows
            change = np.flatnonzero(np.asarray(pc.not_equal(conv.slice(1), conv.slice(0, n - 1)))) + 1 if n > 1 else []
            edges = np.unique(np.concatenate([[0], change, np.arange(0, n, SEGMENT), [n]]).astype(np.int32))
            offsets = pa.array(edges, pa.int32())
            listed = lambda name: pa.ListArray.from_arrays(offsets, batch.column(name))  # noqa: B023, E731
            kinds = np.asarray(batch.column("kind"), np.uint8)
            facts = []
            for a, b in zip(edges, edges[1:], strict=False):
                turns = np.asarray(batch.column("turn").slice(a, b - a).drop_null(), np.int64)  # sorted
                facts.append((int(turns[0]), int(turns[-1]), 1 + int(np.count_nonzero(np.diff(turns)))) if len(turns) else (None, None, 0))
            columns = [conv.take(pa.array(edges[:-1])), pa.array(at + edges[:-1].astype(np.int64)), pa.array([kinds[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()), listed("blank"), listed("key"), *(pa.array([f[i] for f in facts], pa.int64()) for i in range(3)), listed("role"), listed("text")]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "at", "kinds", "blank", "keys", "first", "last", "turns", "roles", "texts"])
            at += n

    return arrow_map(sorted_.select("conv", "turn", "role", "text", "kind", "blank", "key"), run, _SEGMENTS)


def duplicates(segs: DataFrame) -> DataFrame:
    """(at, again): places in each segment whose role and text came earlier in the conversation."""
    each = segs.select("conv", "at", F.posexplode("keys").alias("place", "key")).filter("key is not null")
    first = each.groupBy("conv", "key").agg(F.min(F.struct("at", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = each.join(apart(first), ["conv", "key"]).filter(F.struct("at", "place") > F.col("first"))
    return later.groupBy("at").agg(F.collect_list("place").alias("again"))


@lru_cache(None)
def back(after: tuple, kind: int | None) -> tuple[tuple, int]:
    """Cost to go from each state before a row, by that after it (before the end: kind None), less its least, and that."""
    if kind is None:
        base = [0, np.inf, np.inf, 0]
    else:
        base = []
        for state in range(4):
            to = _kept(state, kind & 3)
            extra = TRUNCATED if kind & TRUNC else 0
            ways = [DELETE + after[state]]
            if not kind & GONE:
                ways += [REROLE + extra + after[AFTER[state]]] + ([extra + after[to]] if to is not None else [])
            base.append(min(ways))
    for _ in range(3):  # inserted rows come one after the other
        base = [min(x, INSERT + base[AFTER[state]]) for state, x in enumerate(base)]
    least = min(base)
    return tuple(x - least for x in base), int(least)


def _kept(state: int, role: int) -> int | None:
    """The state after a kept row of a role class, if the grammar takes it."""
    return {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}.get((state, role))


@lru_cache(None)
def forth(after: tuple, kind: int | None, state: int) -> tuple[str, int]:
    """Edits up to and with a row, and the state then: of the transitions on which no cost is lost, the first by ASCII at each step."""
    now, low = back(after, kind)
    now = [x + low for x in now]
    edits = ""
    while True:
        if kind is None and now[state] == 0:
            return edits, state
        if kind is not None and DELETE + after[state] == now[state]:
            return edits + "D", state
        if INSERT + now[AFTER[state]] == now[state]:
            edits, state = edits + "I", AFTER[state]
            continue
        to, extra = _kept(state, kind & 3), TRUNCATED if kind & TRUNC else 0
        if to is not None and extra + after[to] == now[state]:
            return edits + "K", to
        return edits + "R", AFTER[state]


def planned(kinds: bytes) -> tuple[int, list[str]]:
    """The least cost, and the edits before and at each row, then those after the last one: costs to go from the end to the start, then
    a walk along them. Costs to go differ by a few amounts only, so that each step is looked up."""
    ahead, low = back((), None)
    costs, total = [ahead], low
    for kind in reversed(kinds):
        ahead, low = back(ahead, kind)
        costs.append(ahead)
        total += low
    cost, state, out = total + int(costs[-1][0]), 0, []
    costs.pop()
    for kind in kinds:
        edits, state = forth(costs.pop(), kind, state)
        out.append(edits)
    out.append(forth((), None, state)[0])
    return cost, out


def rebuilt(roles: list[bytes], texts: list[bytes], kinds: bytes, edits: str, state: int) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of a segment's repaired rows, from the state at its start."""
    row = 0
    for e in edits:
        if e in "IR":
            yield NEXT[state], b"" if e == "I" else texts[row]
            state = AFTER[state]
        elif e == "K":
            yield roles[row], texts[row]
            state = _kept(state, kinds[row] & 3)
        row += e != "I"


def _state_after(kinds: bytes, edits: str, state: int) -> int:
    row = 0
    for e in edits:
        state = AFTER[state] if e in "IR" else _kept(state, kinds[row] & 3) if e == "K" else state
        row += e != "I"
    return state


def plans(segs: DataFrame) -> DataFrame:
    """(conv, at, kinds, edits, state, facts) of every segment; facts of its conversation at the first one, else null.

    One byte for each row of a conversation meets in one task, no more than the result's own `audit` takes; texts do not.
    """
    light = segs.select("conv", "at", "kinds", "blank", "first", "last", "turns").join(duplicates(segs), "at", "left")
    whole = light.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "kinds", "blank", "first", "last", "turns", "again"))).alias("parts"))

    def run(batches):
        for batch in batches:
            out = []
            for conv, parts in zip(batch.column("conv").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                codes, blank, again = [], 0, 0
                first = last = None
                turns = 0
                for p in parts:
                    kinds = np.frombuffer(p["kinds"], np.uint8).copy()
                    blank += sum(p["blank"])
                    if p["again"]:
                        kinds[p["again"]] = kinds[p["again"]] & 3 | GONE
                        again += len(p["again"])
                    codes.append(kinds)
                    if p["turns"]:
                        first = p["first"] if first is None else first
                        turns += p["turns"] - (last == p["first"])
                        last = p["last"]
                every = np.concatenate(codes)
                pair = (every[:-1] & 3) * 4 + (every[1:] & 3)
                illegal = int(np.count_nonzero(~np.isin(pair, (1, 6, 9))))  # su, ua, au
                cost, edits = planned(every.tobytes())
                facts = {"blank": blank, "duplicate": again, "truncated": int(np.count_nonzero(every & TRUNC)), "illegal": illegal, "gaps": 0 if first is None else last - first + 1 - turns, "cost": cost}
                a, state = 0, 0
                for i, (p, kinds) in enumerate(zip(parts, codes, strict=True)):
                    own = "".join(edits[a : a + len(kinds)]) + (edits[-1] if i == len(parts) - 1 else "")
                    out.append({"conv": conv, "at": p["at"], "kinds": kinds.tobytes(), "edits": own, "state": state, "facts": None if i else facts})
                    state, a = _state_after(kinds.tobytes(), own, state), a + len(kinds)
            yield from pa.Table.from_pylist(out, _plan_type()).to_batches() if out else []

    return arrow_map(whole, run, f"conv string, at long, kinds binary, edits string, state int, facts struct<{FACTS.replace(' long', ': long')}>")


def _plan_type() -> pa.Schema:
    facts = pa.struct([(f.split()[0], pa.int64()) for f in FACTS.split(", ")])
    return pa.schema([("conv", pa.string()), ("at", pa.int64()), ("kinds", pa.binary()), ("edits", pa.string()), ("state", pa.int32()), ("facts", facts)])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The segments of rows (conv_id, turn, role, text), stored, and the plan of each: what turns() and report() read.

    Each row's first fault counts: blank (no character but white space), duplicate (role and text seen earlier in the conversation),
    truncated (its last such character is none of .!?). Blank and duplicate rows are deleted. Nulls count as one space, rows without an id
    as one conversation; rows that tie in turn, role and text are equal. Other columns are not read.
    """
    segs = stored(segments(rows.select("conv_id", "turn", "role", "text")), "segments")
    return segs, stored(plans(segs), "repairs")


def turns(segs: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv, at, number, role, text): the repaired conversations, in the order of at and number."""

    def run(batches):
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                pairs = list(rebuilt(row["roles"], row["texts"], row["kinds"], row["edits"], row["state"]))
                n = len(pairs)
                yield pa.RecordBatch.from_arrays([pa.array([row["conv"]] * n, pa.string()), pa.array([row["at"]] * n, pa.int64()), pa.array(range(n), pa.int32()), *(pa.array([p[i] for p in pairs], pa.binary()).cast(pa.string()) for i in (0, 1))], ["conv", "at", "number", "role", "text"])

    return arrow_map(segs.select("at", "roles", "texts").join(plan.select("conv", "at", "kinds", "edits", "state"), "at"), run, "conv string, at long, number int, role string, text string")


def report(segs: DataFrame, plan: DataFrame) -> DataFrame:
    """conv, its facts, audit (edits in order), and repaired_sha256 of its `role:text` lines.

    A hash runs over its text in order, so each conversation's segments, of up to SEGMENT rows each, pass through one task in order of `at`, one
    after the other; the task holds one segment and the audit.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    one = plan.withColumn("roles", nothing("array<binary>")).withColumn("texts", nothing("array<binary>")).withColumn("tag", F.lit(0))
    two = segs.select("conv", "at", nothing("binary").alias("kinds"), nothing("string").alias("edits"), nothing("int").alias("state"), nothing(plan.schema["facts"].dataType).alias("facts"), "roles", "texts", F.lit(1).alias("tag"))
    streamed = one.unionByName(two).repartition("conv").sortWithinPartitions("conv", "at", "tag")

    def run(batches):
        conv = facts = step = sha = None
        audit: list[str] = []
        begun = False

        def done() -> dict:
            return {"conv": conv, **facts, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        for batch in batches:
            out = []
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["tag"] == 0:
                    if row["conv"] != conv:
                        if conv is not None:
                            out.append(done())
                        conv, sha, audit, begun = row["conv"], hashlib.sha256(), [], False
                    facts = row["facts"] or facts
                    step = row
                    audit.append(row["edits"])
                else:
                    for role, text in rebuilt(row["roles"], row["texts"], step["kinds"], step["edits"], step["state"]):
                        sha.update((b"\n" if begun else b"") + role + b":")
                        sha.update(text)
                        begun = True
            yield from pa.Table.from_pylist(out, _report_type()).to_batches() if out else []
        if conv is not None:
            yield from pa.Table.from_pylist([done()], _report_type()).to_batches()

    return arrow_map(streamed, run, f"conv string, {FACTS}, audit string, repaired_sha256 string")


def _report_type() -> pa.Schema:
    return pa.schema([("conv", pa.string()), *((f.split()[0], pa.int64()) for f in FACTS.split(", ")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def audited(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """report() of `rows` with the conv_id of every row of `conversations`; zeros, an empty audit and the hash of nothing where none of its rows are left."""
    found = stored(report(*repair(rows)), "report")
    every = conversations.groupBy(key(F.col("conv_id")).alias("conv")).agg(F.max("conv_id").alias("conv_id"))
    counts = [F.coalesce(f.split()[0], F.lit(0).cast("long")).alias(f.split()[0]) for f in FACTS.split(", ")]
    return every.join(found, "conv", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
