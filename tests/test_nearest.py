"""Exact vector search by blocks against the comparison of every pair."""

import random

from pyspark.sql import functions as F

from talweg.operators import fusion, nearest
from talweg.plans.registry import QUERIES


def _odd(spark):
    random.seed(5)
    rows = [(i, [random.gauss(0, 1) for _ in range(6)], i % 3) for i in range(300)]
    rows += [(i, rows[7][1], 1) for i in range(300, 340)]  # copies
    rows += [(340, None, 0), (341, [0.0] * 6, 1), (342, [1.0, 2.0], 1), (343, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (344, [float("nan")] + [1.0] * 5, 1), (345, [], 0), (346, [1.0] * 6, None), (None, [2.0] * 6, 1)]
    v = spark.createDataFrame(rows, "doc_id long, v array<double>, label int")
    return v.filter("doc_id % 7 = 0 or doc_id >= 339").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("q_label")), v


def test_blocks_find_what_the_comparison_of_all_pairs_finds(spark, monkeypatch):
    monkeypatch.setattr(nearest, "VECTORS", 64)
    monkeypatch.setattr(nearest, "QUERIES", 32)
    q, v = _odd(spark)
    apart, alike = F.col("query_id") != F.col("doc_id"), F.col("label") == F.col("q_label")
    cases = [({"other": True}, apart), ({"on": {"label": "q_label"}, "other": True}, apart & alike), ({"on": {"label": "q_label"}}, alike), ({}, F.lit(True))]
    for more, where in cases:  # where: pair by pair
        for digits, least in ((6, None), (None, None), (6, 0.2)):
            for k in (1, 1 << 30) if digits is None else (4,):
                plain = lambda df: sorted((r.query_id is None, r.query_id or 0, r.rank, r.doc_id is None, r.doc_id or 0, repr(r.score)) for r in df.collect())
                got = fusion.dense_top_k(q, v, k, least=least, digits=digits, **more)
                assert plain(got) == plain(fusion.dense_top_k(q, v, k, least=least, digits=digits, where=where))


def test_vector_queries_compare_no_rows_pair_by_pair(spark, small, capsys):
    for name in ("dense_topk", "dense_filtered_topk", "dense_confidence", "batch_best", "error_rates", "recall_mrr"):
        QUERIES[name](spark, small).explain()
        plan = capsys.readouterr().out
        assert "CoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_guides_compare_no_rows_pair_by_pair(spark, small, monkeypatch):
    calls, own = [], nearest.candidates
    monkeypatch.setattr(nearest, "candidates", lambda q, *x: calls.append(q.count()) or own(q, *x))
    QUERIES["guide_search"](spark, small)
    texts = spark.read.parquet(f"{small}/benchmark.parquet").count()
    assert calls and 0 < calls[0] <= texts
