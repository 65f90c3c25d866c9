import json
import math

import pytest
from pyspark.sql import functions as F

from talweg.operators import documents, evaluation, fulltext, pipelines, scorers, shaping, signatures
from talweg.plans.registry import QUERIES
from talweg.sources import files


def test_factors_by_definition(spark):
    """The sums of a plain loop over passages, tokens and queries."""
    owned = [("P", "remise spéciale"), ("P", "fibre"), ("V", "modem"), ("V", "ab")]
    weights = {"fibre": 2.0, "modem": 1.5, "cadres": 3.0}
    queries = [(1, "Fibre et modem pour cadres ab"), (2, "rien"), (3, "REMISE SPÉCIALE retraités fibre")]
    passages = [(10, "P", "pour cadres", ["Cadres", "fibre"], False), (11, "V", "les retraités", [], True), (12, "P", "x", ["retraités"], True)]
    base = [w for ws in signatures.dims.SIGNATURE_WORDS.values() for w in ws]
    want = {}
    for q, text in queries:
        for d, entity, body, own, off in passages:
            low, own_ = text.lower(), [w.lower() for w in own]
            total = sum(0.1 * weights.get(w, 1.0) for w in set(own_) if w in low)
            total += sum(0.05 * weights.get(w, 1.0) for e, w in owned if e == entity and w in low and w not in own_)
            total += sum(0.1 * weights.get(w, 1.0) for w in base if w in low and w in body)
            want[q, d] = 1 + min(1.0, total * (0.5 if off else 1.0))
    q = spark.createDataFrame(queries, "query_id long, query string")
    p = spark.createDataFrame(passages, "doc_id long, entity_code string, text string, signature_tokens array<string>, mismatch boolean")
    pairs = q.select("query_id").crossJoin(p)
    w = spark.createDataFrame(list(weights.items()), "token string, idf double")
    got = signatures.factors(pairs, q, spark.createDataFrame(owned, "entity string, token string"), w)
    assert {(r.query_id, r.doc_id): pytest.approx(r.factor) for r in got.collect()} == want and len(want) == 9


def test_thresholds_of_signatures(spark):
    rows = [("P", "alpha alpha alpha word"), ("V", "word word common"), ("V", "common alpha abc abc abc")]
    got = signatures.of_entities(spark.createDataFrame(rows, "entity_code string, text string")).collect()
    assert {("P", "alpha"), ("V", "word")} <= set(map(tuple, got)) and not any(t in ("abc", "common") for _, t in got)
    idf = {r.token: r.idf for r in signatures.idf(spark.createDataFrame(rows, "entity_code string, text string")).collect()}
    assert idf["alpha"] == pytest.approx(math.log(4 / 3) + 1) and idf["common alpha"] == pytest.approx(math.log(4 / 2) + 1)
    owned = spark.createDataFrame([("P", "b"), ("P", "a"), ("V", "z")], "entity string, token string")
    assert {r.entity: r.tokens for r in signatures.summary(owned, 1).collect()} == {"P": ["a"], "V": ["z"]}


PASSAGES = "id string, doc_id string, entity_code string, establishment string, beneficiary string, offer_type string, text string, price_value int, speed_mbps double, is_free boolean, signature_tokens array<string>"


def passages(spark, *rows):
    return spark.createDataFrame([(i, d, e, f"Établissement {e}", None, kind, t, p, s, False, []) for i, d, e, kind, t, p, s in rows], PASSAGES)


def test_convention_search_keeps_to_the_named_establishment(spark):
    rows = passages(spark, ("a", "c1", "P", "FIBRE", "fibre 100 Mbps à 1100 DA", 1100, 100.0), ("b", "c2", "V", "FIBRE", "fibre 100 Mbps à 900 DA", 900, 100.0), ("c", "c3", "V", "VDSL", "fibre 20 Mbps à 2000 DA", 2000, 20.0))
    asked = [(1, "fibre à 900 DA"), (2, "fibre à 900 DA pour l'établissement P"), (3, "mots inconnus"), (4, "vdsl")]
    got = pipelines.conventions(rows, spark.createDataFrame(asked, "query_id long, query string")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r.doc_id)
    assert by[1][0] == "c2" and len(by[1]) == 3 and by[2] == ["c1"] and 3 not in by and by[4] == ["c3"]  # the kind of offer is searched, too


def test_passages_that_vectors_alone_find_have_their_numbers_weighed(spark):
    rows = passages(spark, ("a", "c1", "P", None, "x", 1100, None), ("b", "c2", "V", None, "y", 5000, None), ("c", "c3", "V", None, "fibre", None, None))
    asked = spark.createDataFrame([(1, "fibre 1100 da")], "query_id long, query string")
    dense = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.9), (1, "c", 0.1)], "query_id long, doc_id string, score double")
    got = {r.doc_id: r.doc_score for r in pipelines.conventions(rows, asked, dense).collect()}
    assert got["c1"] == pytest.approx(2 * got["c2"])


def test_products_go_through_their_layers(spark):
    docs = spark.createDataFrame([(1, "zte blade a35", "zte blade a35 phone"), (2, "cable", "a blue cable"), (3, "x", "alpha thing"), (4, "y", "long text of many words and one cable"), (5, "z", "z")], "doc_id long, name_text string, text string")
    asked = spark.createDataFrame([(1, "zte blade"), (2, "blue cable"), (3, "xyz"), (4, "unheard"), (5, "alpha"), (6, "many")], "query_id long, query string")
    dense = spark.createDataFrame([(3, 2, 0.4), (4, 1, 0.05), (5, 1, 0.9), (6, 1, 0.9)], "query_id long, doc_id long, score double")
    got = {r.query_id: r for r in pipelines.products(docs, asked, dense).collect()}
    assert (got[1].doc_id, got[1].layer) == (1, 1) and (got[3].doc_id, got[3].layer) == (2, 3) and 4 not in got
    # one text result counts by its own score, not by its place among the others
    assert (got[5].doc_id, got[5].layer) == (3, 2) and got[5].score > 0.55
    strict = {r.query_id: r.layer for r in pipelines.products(docs, asked, dense, sparse_least=0.8).collect()}
    assert strict[5] == 2 and strict[6] == 3
    blocked = {r.query_id: r.layer for r in pipelines.products(docs, asked, dense, blocked=(1,)).collect()}
    assert blocked.get(1) != 1 and blocked[3] == 3


def test_offers_in_both_languages(spark):
    kind = "doc_id long, doc_type string, family string, segments array<string>, technologies array<string>, commitment string, usage array<string>, keywords array<string>, title_fr string, title_ar string, text string"
    rows = [(1, "offer", "idoom_fibre", [], ["fibre"], None, [], ["الألياف"], "Idoom fibre", "عرض الألياف", "سرعة الألياف البصرية"), (2, "offer", "idoom_adsl", [], ["adsl"], None, [], [], "Idoom adsl", None, "débit adsl lent"), (3, "other", None, [], [], None, [], [], None, None, "rien de cela")]
    synonyms = spark.createDataFrame([("الألياف", "fibre", 0), ("débit", "vitesse", 0)], "key string, value string, ordinal int")
    asked = spark.createDataFrame([(1, "سرعة الألياف"), (2, "vitesse lent"), (3, "?")], "query_id long, query string")
    got = {}
    for r in pipelines.offers(spark.createDataFrame(rows, kind), asked, synonyms).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    assert got[1] == [(1, 1)] and got[2][0] == (1, 2) and 3 not in got


def guide_store(spark, tmp_path):
    rows = [(1, "section", "comment faire pour la ligne", "Ligne fixe", None, "[]"), (2, "section", "installer fibre optique", "Fibre FTTH", None, '["Fibre"]'), (3, "section", "autre chose", "Divers", None, "[]"), (4, "step", "fibre fibre", "Fibre", None, "[]")]
    docs = spark.createDataFrame(rows, "doc_id long, doc_type string, text string, guide_title string, section_title string, tags string")
    store = fulltext.Store(spark, f"file://{tmp_path}/guides")
    store.write(docs)
    return docs.withColumnRenamed("guide_title", "title"), store


def test_guides_weigh_what_carries_meaning(spark, tmp_path):
    docs, store = guide_store(spark, tmp_path)
    asked = spark.createDataFrame([(1, "comment faire fibre"), (2, "ligne fixe")], "query_id long, query string")
    dense = spark.createDataFrame([(1, 3, 0.05), (1, 2, 0.04), (1, 4, 0.9)], "query_id long, doc_id long, score double")
    got = {}
    for r in pipelines.guides(docs, asked, store, dense, filters=False).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    # stop words find nothing; of the vectors the best has 0.8, however low, and steps are left out; one text result has half of 0.2, one title word 0.1
    assert got[1] == [(3, 0.8), (2, 0.2)]
    assert [d for d, _ in got[2]] == [1] and got[2][0][1] > 1  # no vectors: the text score as it is
    tagged = pipelines.guides(docs, asked, store, dense, dictionary=spark.createDataFrame([("fibre", "Fibre", 0)], "key string, value string, ordinal int"))
    assert [r.doc_id for r in tagged.filter("query_id = 1").collect()] == [2]


def test_requests_are_checked():
    assert pipelines.entry_point("2") is pipelines.conventions
    for bad in (("5", 5), ("1", 0), ("1", 51)):
        with pytest.raises(ValueError):
            pipelines.entry_point(*bad)
    with pytest.raises(ValueError, match="document type"):
        pipelines.entry_point("3", 5, "page")


def test_codes_of_establishments(spark):
    names = ["L’établissement AD", "Convention de l'Établissement A (Alger)", "l`établissement p", "Établissement Zz", "", None, "L'établissement ADX"]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, e string").orderBy("i")
    assert [r.c for r in rows.select(documents.entity_code(F.col("e")).alias("c")).collect()] == ["AD", "A", "P", "ZZ", "UNK", "UNK", "ADX"]
    assert rows.limit(1).select(documents.entity_code(F.col("e"), {"établissement": "Q"}).alias("c")).first().c == "Q"


def test_results_as_an_application_shows_them(spark):
    ranked = spark.createDataFrame([(1, 10, 1, 0.123456), (1, 11, 2, 0.1), (1, 12, 3, 0.05), (2, 99, 1, 1.0)], "query_id long, doc_id long, rank long, score double")
    docs = spark.createDataFrame([(10, "A", "x" * 600, "g/à b.pdf"), (11, "A", "y", None), (12, "B", None, "b.pdf")], "doc_id long, title string, text string, s3_key string")
    shaped = shaping.results(ranked, docs, proxy="http://h/")
    rows = {(r.query_id, r.rank): r for r in shaped.collect()}
    assert rows[1, 1].score == 0.1235 and rows[1, 1].preview == "x" * 500 + "..." and rows[1, 1].url == "http://h/g/%C3%A0%20b.pdf" and rows[1, 2].url is None and rows[2, 1].title is None
    queries = spark.createDataFrame([(1, "q"), (3, "none")], "query_id long, query string")
    said = {r.query_id: json.loads(r.response) for r in shaping.as_json(shaped, queries).collect()}
    assert said[3] == {"query": "none", "count": 0, "results": []} and [x["doc_id"] for x in said[1]["results"]] == [10, 11, 12]
    src = {r.query_id: r for r in shaping.sources(shaped.filter("query_id = 1")).collect()}
    assert [x.title for x in src[1].sources] == ["A", "B"] and len(src[1].snippet) == shaping.SNIPPET
    levels = spark.createDataFrame([(10, "g1"), (11, "g1"), (12, "g2")], "doc_id long, guide_id string")
    guides = spark.createDataFrame([("g1", "one"), ("g2", "two")], "guide_id string, body string")
    assert [(r.place, r.body) for r in shaping.by_guide(ranked, levels, guides).orderBy("place").collect()] == [(1, "one"), (2, "two")]
    assert shaping.explained(a=ranked, b=ranked.filter("rank = 1")).filter("b is null").count() == 2 and shaping.head(ranked, 1).count() == 2
    labels = spark.createDataFrame([(1, 11, "x"), (2, 99, "x"), (3, 5, "y")], "query_id long, expected long, category string")
    got = evaluation.report(ranked, labels, times=spark.createDataFrame([(1, 10.0)], "query_id long, ms double"))
    assert {r.category: (r.n, r.errors) for r in got["error_rates"].collect()} == {"x": (2, 1), "y": (1, 1)}
    assert [(r.query_id, r.found) for r in got["first_errors"].orderBy("query_id").collect()] == [(1, 10), (3, None)] and got["latencies"].first().n == 1


def test_a_scorer_of_ones_own(spark, tmp_path):
    docs, store = guide_store(spark, tmp_path)
    asked = spark.createDataFrame([(1, "ligne fibre autre")], "query_id long, query string")
    got = pipelines.guides(docs, asked, store, scorer=scorers.CrossEncoder("short", lambda: lambda queries, texts: [-len(x) for x in texts]), filters=False).orderBy("new_rank").collect()
    assert [r.doc_id for r in got] == [3, 2, 1]


def test_passages_do_not_go_through_the_driver(spark, small, monkeypatch):
    """the numbers of all passages are joined with what was found without a broadcast, however small their files are."""
    plans, kept = {}, files.kept
    monkeypatch.setattr(files, "kept", lambda df, name: plans.__setitem__(name, df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    QUERIES["convention_search"](spark, small)
    joins = [x for x in plans["best"].split("\n") if "Join" in x]
    assert any("SortMergeJoin [doc_id" in x for x in joins) and not any("BroadcastHashJoin [doc_id" in x for x in joins)
