import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from talweg.llm import bit_sliced, mixing, queries, urls


def brute_top(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=7).round(1)]) for i in range(400)]
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 5), (1100, [float("nan")] * 7), (1150, [float("inf")] * 7), (1200, [0.0] * 7), (1250, [3.0, -2.5]), (None, [1.0] * 7)]
    rows += [(2000 + i, [1.0] * 7) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("ids", F.lit(2)).repartition(3)
    got = bit_sliced.top_k(df, F.col("vec_id") % 50 == 0)
    assert {tuple(map(int, r)) for r in got.collect()} == brute_top(rows, 5)


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bit_sliced, "BLOCK", 50)
    monkeypatch.setattr(bit_sliced, "QUERIES", 3)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(500)]
    got = bit_sliced.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert {tuple(map(int, r)) for r in got.collect()} == brute_top(rows, 5)


def test_fewer_rows_than_wanted(spark):
    kind = "vec_id long, embedding array<double>"
    is_query = F.col("vec_id") % 50 == 0
    assert bit_sliced.top_k(spark.createDataFrame([], kind), is_query).count() == 0
    assert bit_sliced.top_k(spark.createDataFrame([(50, [1.0])], kind), is_query).count() == 0
    assert [tuple(r) for r in bit_sliced.top_k(spark.createDataFrame([(50, [1.0]), (1, [-1.0]), (2, [0.0])], kind), is_query).collect()] == [(50, 1, 2, 0), (50, 2, 1, -65536)]


# ---- mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.floats(0.01, 5)), min_size=1, max_size=6))
def test_every_block_runs_in_its_window(sources):
    blocks, weights = [n for n, _ in sources], [w for _, w in sources]
    plan = mixing.phases(blocks, weights)
    slots = Counter()
    for p in plan:
        for r, slot in enumerate(p["slots"]):
            assert math.floor(r / p["share"]) <= slot < math.ceil((r + 1) / p["share"])
            slots[p["start"] + slot] += 1
        assert len(p["slots"]) == p["last"] - p["first"]
    assert slots == Counter(range(sum(blocks)))


def test_all_rows_once_and_in_order(spark, odd, none):
    rows = [(i, "big" if i % 3 else None if i % 2 else f"s{i % 5}") for i in range(3000)] + [(7, "big")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    mixed, slots = mixing.mix(docs)
    got = mixed.select("doc_id", "source", "mix_.*").collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    assert len({r.position for r in got}) == len(got)
    for n in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        ordered = mixing.in_order(mixed, slots).collect()
        assert len(ordered) == len(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = [(r.doc_id, r.source) for r in sorted(got, key=lambda r: r.position)]
    assert [tuple(r) for r in mixing.in_order(mixed, slots).collect()] == want
    first = Counter(r.source for r in got if r.slot < slots // 3)
    assert first["big"] > max(v for k, v in first.items() if k != "big")
    weighted, _ = mixing.mix(docs, {"big": 1.0, "s0": 1.0}, block=4)
    assert weighted.count() == len(rows)
    odd_mixed, odd_slots = mixing.mix(odd[0])
    assert mixing.in_order(odd_mixed, odd_slots).columns == odd[0].columns and odd_mixed.count() == len(odd[1])
    empty, zero = mixing.mix(none)
    assert zero == 0 and mixing.in_order(empty, zero).count() == 0


def test_more_sources_than_lanes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LANES", 4)
    docs = spark.createDataFrame([(i, f"s{i % 9}") for i in range(900)], "doc_id long, source string")
    mixed, _ = mixing.mix(docs)
    got = mixed.select("doc_id", "mix_.lane", "mix_.position").collect()
    assert len({r.position for r in got}) == len({r.doc_id for r in got}) == 900 and {r.lane for r in got} == {0, 1, 2, 3}


def test_sources_of_the_shared_lane_keep_their_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LANES", 4)
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    docs = spark.createDataFrame([(i, f"s{i % 9}") for i in range(1800)], "doc_id long, source string")
    weights = {f"s{i}": 8.0 if i == 7 else 1.0 for i in range(9)}
    mixed, slots = mixing.mix(docs, weights, block=4)
    got = mixed.select("doc_id", "source", "mix_.slot", "mix_.lane", "mix_.position").collect()
    assert {r.slot for r in got} == set(range(slots)) and len({r.position for r in got}) == len({r.doc_id for r in got}) == 1800
    assert {r.lane for r in got if r.source == "s7"} == {3}
    had = Counter(s for s, _ in {(r.source, r.slot) for r in got if r.slot < 80})
    assert all(abs(had[s] - 80 * w / 16) < 4 for s, w in weights.items())


# ---- urls


def test_parts_and_rules(spark, tmp_path):
    rows = [
        (1, "http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        (2, "https://example.net/fr/", "example.net", "/fr/", "net/", "block"),
        (3, "http://x.net", "x.net", "", None, "allow"),
        (4, "x://b.example.com/de/2", "b.example.com", "/de/2", "example.com/de/", "block"),
        (5, "x://b.example.com/de", "b.example.com", "/de", None, "allow"),
        (6, "x://my.org/fr/3#z", "my.org", "/fr/3", "org/fr/", "allow"),
        (7, "x://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "no scheme", "", "", None, "allow"),
        (10, "x://ÀB.net?q=://y/", "Àb.net", "", None, "allow"),
        (11, "a://b://c/d", "b:", "//c/d", None, "allow"),
        (11, "a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("shape", F.lit(1))
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op7_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *r[2:])) for r in rows)
    assert urls.judge(df.limit(0)).count() == 0


def test_templates_take_the_labels_of_their_like(spark):
    rows = [(i, f"x://h.net/spam/{i}") for i in range(30)] + [(100 + i, f"x://h.net/good/{i}") for i in range(30)]
    labels = [(i, None if i % 2 else "block") for i in range(30)] + [(100 + i, None if i % 2 else "allow") for i in range(30)]
    split = spark.createDataFrame(rows, "page_id long, url string").select("page_id", *(c.alias(n) for c, n in zip(urls.parts(F.col("url")), ("host", "path"), strict=True)))
    tree = urls.templates(split.join(spark.createDataFrame(labels, "page_id long, label string"), "page_id")).collect()
    assert {(r.shape, r.labelled, r.blocked) for r in tree} == {("/spam/#", 15, 15), ("/good/#", 15, 0)}


def test_wide_nodes_and_alike_branches(spark):
    rare = [("h", f"/user/n{c}x/p", None) for c in "abcdefghijklmnopqrstuvwxyz"]
    alike = [("g", f"/{c}/p", "block") for c in ("aa", "bb") for _ in range(9)] + [("g", "/cc/p", "allow")] * 9
    tree = {(r.host, r.shape): r for r in urls.templates(spark.createDataFrame(rare + alike, "host string, path string, label string")).collect()}
    assert {r.template for (h, _), r in tree.items() if h == "h"} == {"/user/*/p"}
    assert tree["g", "/aa/p"].blocked == 9 and tree["g", "/cc/p"].blocked == 0


def plain_purity(rows):
    """rows (host, path, label): purity by definition, for paths of digits and few words (no rare, no merged branches)."""
    known = [(h, re.sub("[0-9]+", "#", p), x) for h, p, x in rows]
    domain = lambda h: ".".join(h.split(".")[-2:])

    def share(some, parent, prior):
        return (sum(x == "block" for x in some) + prior * parent) / (len(some) + prior)

    every = share([x for *_, x in known if x], 0.5, 2)
    out = {}
    for h, p in {(h, p) for h, p, _ in known}:
        by = {}
        for g, q, x in known:
            if q == p and x:
                by.setdefault(domain(g), []).append(x)
        votes = [sum(x == "block" for x in v) / len(v) for v in by.values() if len(v) >= urls.EVIDENCE]
        anywhere = (sum(votes) + every) / (len(votes) + 1)
        here = share(by.get(domain(h), []), anywhere, 2)
        out[h, p] = share([x for g, q, x in known if (g, q) == (h, p) and x], here, 2)
    return out


def test_purity_equals_brute_force_and_decides(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        host = rng.choice(["a.one.net", "b.one.net", "two.com", "x.two.com", "three.org", "y.three.org", "z.four.io"])
        path = rng.choice(["/de/", "/en/", "/es/"]) + str(i)
        label = {"/de": "block", "/en": "allow"}.get(path[:3]) if host.endswith((".net", "two.com")) else None
        rows.append((host, path, label if rng.random() < 0.9 else None))
    rows += [("deep.four.io", "/a/b/c/d/e/f/g/h/i/j/k", None), ("deep.four.io", "/a/b/c/d/e/f/g/h/i/j/l", None), ("", "", None)]
    got = urls.templates(spark.createDataFrame(rows, "host string, path string, label string")).collect()
    want = plain_purity(rows)
    assert {(r.host, r.shape) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.purity - want[r.host, r.shape]) < 1e-9 for r in got)
    assert {r.template for r in got if r.host == "deep.four.io"} == {"/a/b/c/d/e/f/g/h/i/j/k", "/a/b/c/d/e/f/g/h/i/j/l"}  # whole paths
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(rows)], "page_id long, url string")
    rules = (("block", "one.net", "/de/"), ("block", "two.com", "/de/"), ("allow", "one.net", "/en/"))
    verdicts = {(r.host, r.path[:3]): r.verdict for r in urls.judge(pages, rules).filter("rule is null").collect()}
    assert verdicts["three.org", "/de"] == verdicts["z.four.io", "/de"] == "block"  # unlabelled hosts, by what two domains show
    assert verdicts["three.org", "/en"] == verdicts["three.org", "/es"] == "allow"


# ---- no lane is a block off its given weight


@pytest.mark.parametrize("weights, slots", [([1.0, 1.0, 1.0], 1_000_000), ([1e-5, 1.0], 1_000_000), ([0.5, 0.3, 0.2], 100_000), ([float(i) for i in range(1, 21)], 100_000), ([1.0] * 300, 100_000)])
def test_less_than_one_block_off_the_given_weights_at_every_slot(weights, slots):
    """Against the exact given weights, just before and just after each slot that a lane has."""
    exact = [Fraction(w) for w in weights]
    share = [w / sum(exact) for w in exact]
    lanes = mixing.pattern(mixing.shares(weights), [math.ceil(slots * w) + 1 for w in share])
    assert sum(map(len, lanes)) >= slots
    for w, own in zip(share, lanes, strict=True):
        p, q = w.numerator, w.denominator
        assert all(abs(k * q - slot * p) < q and abs((k + 1) * q - (slot + 1) * p) < q for k, slot in enumerate(own))
