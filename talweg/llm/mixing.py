"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talweg.llm._shared import free, stored

#: Lanes at most: the largest sources have one each, all others share the last, within which they
#: have lanes again.
LANES = 256
#: Windows end here at last, where a weight is so small that its block has practically no deadline.
NEVER = 1 << 62
#: Documents of a block.
BLOCK = 16


def shares(weights: list[float]) -> list[Fraction]:
    """The weights' exact shares of their sum."""
    exact = [Fraction(w) for w in weights]
    total = sum(exact)
    return [w / total for w in exact]


def window(share: Fraction, block: int) -> tuple[int, int]:
    """Release and deadline of a lane's block: floor(block / share) and ceil((block + 1) / share)."""
    return block * share.denominator // share.numerator, -(-(block + 1) * share.denominator // share.numerator)


def pattern(share: list[Fraction], left: list[int]) -> list[list[int]]:
    """The slots of each lane by earliest deadline first, until a lane has no blocks left.

    Lane i's block j may run from its release and before its deadline. Shares add up to one,
    so every slot is taken and every deadline met: no lane is ever a whole block off its target.
    """
    out: list[list[int]] = [[] for _ in share]
    waiting = [(0, i) for i in range(len(share))]
    ready: list[tuple[int, int]] = []
    slot = 0
    while share:
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (window(share[i], len(out[i]))[1], i))
        _, i = heapq.heappop(ready)
        out[i].append(slot)
        slot += 1
        if len(out[i]) == left[i]:
            break
        heapq.heappush(waiting, (window(share[i], len(out[i]))[0], i))
    return out


def phases(blocks: list[int], weights: list[float]) -> list[dict]:
    """Rows (lane, first, last, start, share, slots): in a phase, lane's blocks first to last - 1 run in slots
    start + slots[block - first].

    A phase ends when a lane has no blocks left; the others go on with their weights in proportion.
    """
    done, start, out = [0] * len(blocks), 0, []
    while active := [i for i, n in enumerate(blocks) if done[i] < n]:
        share = shares([weights[i] for i in active])
        slots = pattern(share, [blocks[i] - done[i] for i in active])
        for i, p, s in zip(active, share, slots, strict=True):
            if s:
                out.append({"lane": i, "first": done[i], "last": done[i] + len(s), "start": start, "share": p, "slots": s})
            done[i] += len(s)
        start += sum(map(len, slots))
    return out


#: Blocks in a row of the plan, rows of it in one literal, and blocks of a plan that is broadcast.
CHUNK, LITERAL, BROADCAST = 1024, 64, 1 << 18


def nested(blocks: list[int], weights: list[float], most: int) -> tuple[list[dict], list[list[int]]]:
    """phases() of at most `most` lanes, and for each source of a shared last lane the lane's blocks that are its own.

    The last lane's weight is the sum of its sources' weights; within it they are scheduled likewise, in lanes of their own and
    again a shared one.
    """
    edges = list(range(0, max(1, len(blocks) - most), most - 1)) + [max(0, -(-(len(blocks) - most) // (most - 1))) * (most - 1)]
    own: list[list[int]] = []
    plan: list[dict] = []
    for a in sorted(set(edges), reverse=True):
        rest = a + most - 1 if a + most < len(blocks) else len(blocks)
        inner = own
        sizes, wanted = blocks[a:rest], weights[a:rest]
        if rest < len(blocks):
            sizes, wanted = [*sizes, sum(blocks[rest:])], [*wanted, math.fsum(weights[rest:])]
        plan = phases(sizes, wanted)
        if a:
            slots: list[list[int]] = [[] for _ in sizes]
            for p in plan:
                slots[p["lane"]] += [p["start"] + s for s in p["slots"]]
            last = slots.pop() if inner else []
            own = slots + [[last[k] for k in x] for x in inner]
    return plan, own


def placed(plan: list[dict]) -> list[dict]:
    """Rows of phases() with the slot, release and deadline of each block, at most CHUNK blocks to a row."""
    out = []
    for p in plan:
        for k in range(0, len(p["slots"]), CHUNK):
            some = p["slots"][k : k + CHUNK]
            windows = [[min(NEVER, p["start"] + x) for x in window(p["share"], r)] for r in range(k, k + len(some))]
            out.append({"lane": p["lane"], "first": p["first"] + k, "slots": [p["start"] + s for s in some], "releases": [a for a, _ in windows], "deadlines": [b for _, b in windows]})
    return out


def _table(spark, rows: list[dict], kind: str) -> DataFrame:
    """A table of the driver's rows; in the shared folder if they are more than one literal's."""
    parts = [rows[k : k + LITERAL] for k in range(0, len(rows), LITERAL)] or [[]]
    frames = [spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(x)), f"array<struct<{kind}>>"))) for x in parts]
    return frames[0] if len(frames) == 1 else stored(reduce(DataFrame.unionByName, frames), "mix-plan")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.7, block: int = BLOCK, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> tuple[DataFrame, int]:
    """All columns of docs, and `mix_` (with more underscores if docs has such a column): lane, block, at, release, deadline, slot, position; and the number of slots.

    Every row appears once, in blocks of one source; slots order the blocks, position = slot * block + place in the block. Within
    a source, documents come in the order of a seeded hash of id and all columns; rows that are equal in all can stand for each other. weights: a target for each source (0 or missing: the smallest
    given); without any, row counts to the power `temperature`. The largest sources have a lane each, null being a source;
    beyond LANES - 1 the rest share one, weighted by their sum, and are mixed to their weights within it. In each phase, the blocks that a lane has had by any slot differ from its target by
    less than one. Rows are counted and numbered in buckets of a source's hash, never in one task per source. Counts of
    sources and their plan, a slot for each block, pass through the driver. An empty table gives no rows and 0 slots.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    sources = sorted(sizes.collect(), key=lambda r: (-r["n"], r["source"] is not None, r["source"] or ""))
    total = sum(r["n"] for r in sources)
    if weights:
        given = [weights.get(r["source"]) or 0 for r in sources]
        least = min((x for x in given if x > 0), default=1.0)
        target = [x if x > 0 else least for x in given]
    else:
        target = [r["n"] ** temperature for r in sources]
    plan, own = nested([math.ceil(r["n"] / block) for r in sources], target, LANES)
    last = len(sources) - len(own)  # of several sources, which share this lane
    slots = sum(p["last"] - p["first"] for p in plan)
    # buckets of about 512 rows, of more where there are very many
    rows = max(512, math.isqrt(total))
    lanes = [{"member": i, "lane": min(i, last), "name": r["source"], "own": True, "buckets": math.ceil(r["n"] / rows)} for i, r in enumerate(sources)]
    lanes_ = _table(spark, lanes, "member int, lane int, name string, own boolean, buckets int")
    lane = F.broadcast(lanes_) if len(sources) <= LANES else lanes_
    # the whole row orders what has the same id, so that a task that runs again deals rows alike
    key = F.xxhash64(F.col(id_col), _content(docs), F.lit(seed)).alias("key")
    named = docs.select(F.struct("*").alias("row"), key, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"))
    dealt = named.join(lane, F.col("source").eqNullSafe(F.col("name")))
    dealt = dealt.select("row", "key", "id", "source", "member", "lane", F.pmod("key", "buckets").alias("bucket"))
    groups = docs.select(key, F.col(source_col).cast("string").alias("source")).join(lane, F.col("source").eqNullSafe(F.col("name")))
    groups = groups.groupBy("member", F.pmod("key", "buckets").alias("bucket")).agg(F.count("*").alias("n"))
    before = groups.select("member", "bucket", (F.sum("n").over(W.partitionBy("member").orderBy("bucket")) - F.col("n")).alias("before"))
    number = F.row_number().over(W.partitionBy("member", "bucket").orderBy("key", "id", "source")) - 1
    placed_ = dealt.withColumn("number", number).join(before, ["member", "bucket"]).withColumn("number", F.col("number") + F.col("before"))
    placed_ = placed_.withColumn("block", F.floor(F.col("number") / block))
    if own:
        inner = [{"of": last + i, "first": k, "places": x[k : k + CHUNK]} for i, x in enumerate(own) for k in range(0, len(x), CHUNK)]
        places = _table(spark, inner, "of int, first long, places array<long>").select("of", "first", F.posexplode("places").alias("k", "place"))
        places = places.select("of", (F.col("first") + F.col("k")).alias("own_block"), "place")
        places = F.broadcast(places) if slots <= BROADCAST else places
        placed_ = placed_.join(places, (F.col("member") == F.col("of")) & (F.col("block") == F.col("own_block")), "left").withColumn("block", F.coalesce("place", "block"))
    steps = _table(spark, placed(plan), "lane int, first long, slots array<long>, releases array<long>, deadlines array<long>")
    steps = steps.select(F.col("lane").alias("in_lane"), "first", F.posexplode(F.arrays_zip("slots", "releases", "deadlines")).alias("k", "one"))
    steps = steps.select("in_lane", (F.col("first") + F.col("k")).alias("in_block"), F.col("one.slots").alias("slot"), F.col("one.releases").alias("release"), F.col("one.deadlines").alias("deadline"))
    steps = F.broadcast(steps) if slots <= BROADCAST else steps
    placed_ = placed_.join(steps, (F.col("lane") == F.col("in_lane")) & (F.col("block") == F.col("in_block")))
    at = F.col("number") % block
    mixed = F.struct(
        "lane",
        "block",
        at.alias("at"),
        "release",
        "deadline",
        "slot",
        (F.col("slot") * block + at).alias("position"),
    )
    return placed_.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), mixed.alias(free("mix_", docs))), slots


def _content(docs: DataFrame) -> Column:
    """A hash of all columns; maps, which have no order, as JSON."""
    return F.xxhash64(*(F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields))


def in_order(mixed: DataFrame, slots: int, block: int = BLOCK) -> DataFrame:
    """The rows of mix(), whose last column is the operator's, in the order of their positions: parts of equal ranges of slots, one after the other, each sorted."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = mixed.columns[-1]
    place: Column = F.floor(F.col(f"{own}.slot") * parts / max(1, slots)).cast("int")
    return mixed.repartitionById(parts, place).sortWithinPartitions(f"{own}.position").drop(own)


def written_place() -> Column:
    """Of a table of files, a long for each row that grows in the order in which the rows were written: the number of the part, of
    its file and of the row in it. Files are read again by size, so the order of rows as read says nothing."""
    name = F.col("_metadata.file_name")
    part, file = (F.coalesce(F.regexp_extract(name, x, 1).try_cast("long"), F.lit(0).cast("long")) for x in ("^part-([0-9]+)", "-c([0-9]+)[.]"))
    return F.shiftleft(part, 43) + F.shiftleft(file, 33) + F.col("_metadata.row_index")
