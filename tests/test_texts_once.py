"""Queries of one text, files of one stem and documents of the same labels are worked on once."""

import pytest

from talweg.operators import catalogue, ranking, rules
from talweg.plans.registry import QUERIES


def test_by_text_works_on_each_text_once_for_all_its_queries(spark):
    queries = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None), (6, "c")], "query_id long, query string")
    seen = []

    def run(texts):
        seen.append(sorted(map(tuple, texts.collect()), key=repr))
        return texts.filter("query is null or query <> 'c'").selectExpr("query_id", "coalesce(query, 'none') as doc_id")

    got = sorted(map(tuple, ranking.by_text(queries, run).collect()))
    assert got == [(1, "a"), (2, "b"), (3, "a"), (4, "none"), (5, "none")]
    assert seen == [[(1, "a"), (2, "b"), (4, None), (6, "c")]]


@pytest.mark.parametrize("name", ["intent_classify", "tag_extract", "rule_router", "fielded_column_topk", "title_key_match", "product_search"])
def test_queries_go_by_text(spark, small, monkeypatch, name):
    calls, own = [], ranking.by_text
    monkeypatch.setattr(ranking, "by_text", lambda *x: calls.append(1) or own(*x))
    QUERIES[name](spark, small)
    assert calls


def test_one_file_of_a_stem_is_joined(spark):
    names = spark.range(300).selectExpr("id as name_id", "'F1' as stem")
    there = spark.range(300).selectExpr("concat('k', id) as s3_key", "'f1.pdf' as filename")
    out = catalogue.by_extension(names, there)
    assert out.count() == 300 and out.select("s3_key").distinct().count() == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]  # below the join


def test_documents_of_the_same_labels_share_a_list(spark):
    docs = spark.createDataFrame([(1, ["A", "b"]), (2, ["B", "a", "a"]), (3, ["c"]), (4, None), (3, ["a"])], "doc_id long, labels array<string>")
    asked = spark.createDataFrame([(1, "a", "x"), (2, " B ", "y"), (3, "c", "z"), (4, "", "w"), (5, "a", "")], "query_id long, title string, query string")
    out = {r.doc_id: r.queries for r in catalogue.augmented(docs, asked).collect()}
    assert out == {1: ["x", "y"], 2: ["x", "y"], 3: ["x", "z"]}


def test_the_first_document_of_a_product_is_enough(spark):
    queries = spark.createDataFrame([(1, "prix zte blade"), (2, "rien")], "query_id long, query string")
    docs = spark.createDataFrame([(7, "ZTE Blade A35"), (5, "zte blade v50")], "doc_id long, name_text string")
    both, one = (sorted(map(tuple, rules.by_product(queries, docs, first=f).collect())) for f in (False, True))
    assert both and one == [min(both)]


def test_product_rule_has_every_text_that_meets_another(spark, small):
    rows = QUERIES["product_rule"](spark, small).collect()
    by = {}
    for r in rows:
        by.setdefault((r.side, r.key), set()).add(r.text_id)
    assert {r.side for r in rows} == {"query", "doc"}
    assert all(r.links == len(by["doc" if r.side == "query" else "query", r.key]) for r in rows)


def test_lists_of_questions_go_to_blocks_of_label_sets(spark, monkeypatch):
    """no row for each pair of label set and question is shuffled; results do not depend on blocks."""
    docs = spark.createDataFrame([(i, ["a", f"b{i % 5}", f"C{i % 3}"]) for i in range(60)] + [(60, ["none"]), (61, []), (None, ["a"])], "doc_id long, labels array<string>")
    rows = [(i, f" A{'' if i % 2 else ' x'}", f"q{i}") for i in range(8)] + [(i, f"b{i % 7}", f"q{i}") for i in range(8, 30)] + [(i, f"c{i % 2}", f"q{i}") for i in range(20, 35)] + [(8, "a", "q8"), (9, "a", "other"), (None, "a", "n"), (99, "a", "")]
    asked = spark.createDataFrame(rows, "query_id long, title string, query string")

    def wanted(labels):
        own = {(q, t) for q, title, t in rows if title.strip().lower() in {x.lower() for x in labels} and t}
        return [t for _, t in sorted(own, key=lambda x: (x[0] is not None, x))]

    want = {r.doc_id: wanted(r.labels) for r in docs.collect() if wanted(r.labels)}
    found = catalogue.augmented(docs, asked)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    assert {r.doc_id: r.queries for r in found.collect()} == want and len(want) == 61
    monkeypatch.setattr(catalogue, "SETS", 2)
    monkeypatch.setattr(catalogue, "DOCS", 16)
    assert {r.doc_id: r.queries for r in catalogue.augmented(docs, asked, ", ").collect()} == {k: ", ".join(v) for k, v in want.items()}
