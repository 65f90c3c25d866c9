import hashlib
import heapq
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talweg.llm import ball_kmeans, queries, turn_repair, vp_trees

KIND = "vec_id long, embedding array<double>"


def by_50():
    return F.col("vec_id") % 50 == 0



# ---- vantage-point trees


def cosines(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    wide = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, wide - len(v)))) for i, v in ok]
    out = {}
    for q, v in ok:
        if q % 50 == 0:
            near = [(-round(float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), 12), i) for i, w in ok if i != q]
            out[q, tuple(v)] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def check_nearest(got, want):
    """Same neighbours, or, where scores differ by rounding alone, same scores."""
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wanted = {}
    for (q, _), near in want.items():
        wanted.setdefault(q, []).extend((n + 1, *x) for n, x in enumerate(near))
    assert {q: sorted((r, i) for r, i, _ in x) for q, x in found.items()} == {q: sorted((r, i) for r, i, _ in x) for q, x in wanted.items() if x}
    for q, x in found.items():
        assert sorted(s for _, _, s in x) == pytest.approx(sorted(s for _, _, s in wanted[q]), abs=1e-11)


def test_factor_one_is_exact_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vp_trees, "SHARD", 150)
    monkeypatch.setattr(vp_trees, "LEAF", 8)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 500)]
    rows += [(2000 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(120)]
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 4), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (1200, [0.0] * 6), (1250, [3.0, -2.5]), (None, [1.0] * 6), (1300, []), (1350, [1e300, -1e300, 0.0, 0.0, 0.0, 0.0]), (1400, [1e-300] * 6)]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("score", "rank", "ids", "group", "v")}).repartition(3)
    scaled = [(i, v if v is None or not any(v) or None in v or abs(v[0]) < 1e10 and abs(v[0]) > 1e-10 or v[0] != v[0] or v[0] == float('inf') else (np.array(v) / (abs(v[0]) if abs(v[0]) > 1e100 or abs(v[0]) < 1e-100 else 1)).tolist()) for i, v in rows]
    check_nearest(vp_trees.nearest(df, by_50(), factor=1.0), cosines(scaled, 5))


def test_blocks_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vp_trees, "SHARD", 100)
    monkeypatch.setattr(vp_trees, "QUERIES", 2)
    monkeypatch.setattr(vp_trees, "BROADCAST", 0)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(350)]
    check_nearest(vp_trees.nearest(spark.createDataFrame(rows, KIND), by_50(), factor=1.0), cosines(rows, 5))


def test_fewer_vectors_than_wanted(spark):
    assert vp_trees.nearest(spark.createDataFrame([], KIND), by_50()).count() == 0
    assert vp_trees.nearest(spark.createDataFrame([(50, [1.0])], KIND), by_50()).count() == 0
    got = vp_trees.nearest(spark.createDataFrame([(50, [1.0]), (1, [-1.0]), (2, [2.0])], KIND), by_50()).collect()
    assert [tuple(r) for r in got] == [(50, 1, 2, 1.0), (50, 2, 1, -1.0)]


def test_recall_of_the_fitted_factor(spark):
    """Groups of vectors, and vectors without any order: 0.9 at least with the factor that each tree chooses."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 24))
    for x in (centres[rng.integers(0, 12, 4000)] + 0.4 * rng.normal(size=(4000, 24)), rng.normal(size=(4000, 24))):
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        want = cosines(rows, 5)
        found = {(r.query_id, r.vec_id) for r in vp_trees.nearest(spark.createDataFrame(rows, KIND), by_50()).collect()}
        truth = {(q, i) for (q, _), near in want.items() for i, _ in near}
        assert len(found & truth) >= 0.9 * len(truth)


def test_pruning_leaves_leaves_out():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(20, 8)), 200, 0) + 0.01 * rng.normal(size=(4000, 8))
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    order, points, bounds = vp_trees.grown(unit)
    seen = {}
    for factor in (1.0, 3.0):
        search = vp_trees.Search(np.arange(4000), x[order], points, bounds, -np.ones(50, np.int64), x[:50], 5)
        leaf, count = search._leaf, []
        search._leaf = lambda a, b, who: (count.append(len(who)), leaf(a, b, who))  # noqa: B023
        search.run(np.arange(50), factor)
        seen[factor] = sum(count)
    assert seen[3.0] <= seen[1.0] < 50 * 16


# ---- balls


def plain_kmeans(rows, clusters, rounds, dim):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(ok, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r))
    centres = [v for _, v in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres)) for _, v in ok]

    for _ in range(rounds):
        own = assign()
        for k in range(len(centres)):
            members = [v for (_, v), (_, c) in zip(ok, own, strict=True) if c == k]
            if members:
                centres[k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return [(i, c, d) for (i, _), (d, c) in zip(ok, assign(), strict=True)], centres


@pytest.mark.parametrize("seed", range(3))
def test_balls_give_what_all_comparisons_give(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.integers(-2, 3, 4) / 2 + (i % 3)).tolist()) for i in rng.integers(0, 500, 400)]  # ties in distance and id
    rows += [(7, [1.0, 1.0, 1.0, 1.0])] * 150 + [(None, [0.5] * 4), (1, None), (2, [1.0]), (3, [1.0, None, 2.0, 3.0]), (4, [float("nan")] * 4), (5, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("cluster", "block", "q", "id", "labels")}).repartition(3)
    found, centres = ball_kmeans.cluster(df, 9, 4, 4)
    want, points = plain_kmeans(rows, 9, 4, 4)
    assert centres.tolist() == points
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    out = ball_kmeans.digest(found, centres).collect()
    assert {r.inertia for r in out} == {sum(d for _, _, d in want)}
    assert {(r.cluster, r.centroid_sha256) for r in out} == {(c, hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for _, c, _ in want}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=40), st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=8), st.data())
def test_any_former_cluster_leads_to_the_nearest(x, centres, data):
    x, centres = np.array(x), np.array(centres)
    own = np.array(data.draw(st.lists(st.integers(0, len(centres) - 1), min_size=len(x), max_size=len(x))))
    for a, b in zip(ball_kmeans.settled(x, own, centres), ball_kmeans.nearest(x, centres), strict=True):
        assert a.tolist() == b.tolist()


def test_large_components_stay_exact():
    x, centres = np.array([[1 << 26, 5], [-(1 << 26), 7]]), np.array([[(1 << 26) - 1, 5], [1 << 26, 4], [-(1 << 26), 8]])
    assert ball_kmeans.settled(x, np.array([1, 0]), centres)[1].tolist() == [1, 1] and ball_kmeans.nearest(x, centres)[0].tolist() == [0, 2]


def test_few_and_no_vectors(spark):
    found, centres = ball_kmeans.cluster(spark.createDataFrame([], KIND))
    assert found.count() == 0 and len(centres) == 0 and ball_kmeans.digest(found, centres).count() == 0
    found, centres = ball_kmeans.cluster(spark.createDataFrame([(1, [2.0]), (2, [2.0])], KIND), dim=1)
    assert {tuple(r) for r in found.collect()} == {(1, 0, 0), (2, 0, 0)} and len(centres) == 2
    huge, _ = ball_kmeans.cluster(spark.createDataFrame([(1, [1e300]), (2, [-1e300])], KIND), dim=1)
    assert huge.count() == 2


# ---- conversations


def damage(rows):
    out = []
    for c, t, r, x in rows:
        c_, t_, r, x = (" " if v is None else str(v) for v in (c, t, r, x))
        h = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        if h:
            x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
            out += [(c, t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """Dijkstra over (cost, audit): of equal costs the least audit comes out first."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, kinds, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for _, _, r, x in rows:
        y = x.strip(" \t\n\v\f\r")
        kinds.append("blank" if not y else "duplicate" if (r, x) in seen else "truncated" if y[-1] not in ".!?" else "")
        count[kinds[-1]] += 1
        seen.add((r, x))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if to := step.get((state, role[0])):
                heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*lines, f"{role}:")))
        if i < len(rows):
            _, _, r, x = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 * (kinds[i] == "truncated")
                for name, edit, price in ((r, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if to := step.get((state, name[:1])):
                        heapq.heappush(heap, (cost + price + more, audit + edit, i + 1, to, (*lines, f"{name}:{x}")))
    return count["blank"], count["duplicate"], count["truncated"], illegal, gaps, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_audit(rows):
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    return {c: plain_repair(v) for c, v in by.items()}


def audit(df):
    rows = turn_repair.audited(df, turn_repair.damaged(df)).collect()
    out = {r.conv_id: (r.blank, r.duplicate, r.truncated, r.illegal, r.gaps, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


TURNS = "conv_id long, turn long, role string, text string"


def test_conversations_equal_a_plain_search(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    assert audit(df) == plain_audit([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("seed", range(2))
def test_faulty_conversations(spark, monkeypatch, seed):
    monkeypatch.setattr(turn_repair, "SEGMENT", 3)
    rng = np.random.default_rng(seed)
    roles, texts = ["system", "user", "assistant", "tool", None, "", "s", "ua"], ["Yes.", "no", "", None, " \t", "What?", "End. \n", "É! ", "x" * 300 + ".", "日本。"]
    rows = [(int(rng.integers(0, 60)), int(rng.integers(0, 9)) if rng.random() < 0.95 else None, roles[rng.integers(0, 8) if rng.random() < 0.4 else rng.integers(1, 3)], texts[rng.integers(0, 10)]) for _ in range(700)]
    rows += [(None, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(40)]
    rows += [(99, 5, "user", "same.")] * 30 + [(98, None, None, None)] * 20 + [(97, 2**40, "user", "far."), (97, -5, "assistant", "off.")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("conv", "at", "kinds", "key", "tag", "n", "edits")}).repartition(5)
    assert audit(df) == plain_audit(rows)


def test_one_long_conversation_is_spread_and_comes_out_whole(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i % 1000}" + ".?"[i % 3 == 0]) for i in range(4000)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, TURNS)
    assert audit(df) == plain_audit(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else one task takes so few rows
    segs = turn_repair.segments(turn_repair.damaged(df))
    places = segs.filter("conv = '1'").select(F.spark_partition_id()).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert places > 1 and segs.filter("conv = '1'").count() >= 8


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "Yes."), (2, 0, "user", "")], TURNS)
    segs, plan = turn_repair.repair(df)
    got = [(r.conv, r.role, r.text) for r in turn_repair.turns(segs, plan).orderBy("conv", "at", "number").collect()]
    assert got == [("1", "user", "There."), ("1", "assistant", "Yes.")]
    assert {r.conv: (r.audit, r.cost) for r in turn_repair.report(segs, plan).collect()} == {"1": ("DKK", 2), "2": ("D", 2)}


def test_no_conversations(spark):
    assert audit(spark.createDataFrame([], TURNS)) == {}


@pytest.mark.parametrize("name", ["op11_vp_search", "op12_ball_kmeans", "op13_turn_repair"])
def test_registered(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0
