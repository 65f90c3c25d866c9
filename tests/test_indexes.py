import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talweg.functions import text
from talweg.operators import bm25, catalogue, fulltext, fusion, routing, rules, scorers, substrings, timing
from talweg.operators.vector_index import VectorIndex
from talweg.plans import catalogues, search
from talweg.sources import files, workers  # noqa: F401

GUIDES = "doc_id long, doc_type string, text string, guide_title string, section_title string, tags string"


def guides(spark, rows):
    return spark.createDataFrame([(i, "section", t, "title", None, tags) for i, t, tags in rows], GUIDES)


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries, 1)), "query_id long, query string")


def found(df):
    return {(r.query_id, r.doc_id): r.score for r in df.collect()}


# ---- the full-text store


def test_any_order_of_writes_scores_as_one(spark, tmp_path):
    rng = random.Random(4)
    words = ["fibre", "modem", "offre", "prix", "ligne", "carte", "débit"]
    say = lambda: " ".join(rng.choices(words, k=rng.randint(1, 9)))
    state, store = {}, fulltext.Store(spark, f"file://{tmp_path}/a")
    for step in range(2):
        new = {i: say() for i in rng.sample(range(30), 12)}
        gone = rng.sample(range(30), 3) if step else []
        gone = [i for i in gone if i not in new]
        store.write(guides(spark, [(i, t, "[]") for i, t in new.items()]), spark.createDataFrame([(i,) for i in gone], "doc_id long") if gone else None)
        state = {i: t for i, t in {**state, **new}.items() if i not in gone}
        if step == 1:
            store.merge()
            store.prune()
    once = fulltext.Store(spark, f"file://{tmp_path}/b")
    once.write(guides(spark, [(i, t, "[]") for i, t in state.items()]))
    q = asked(spark, "prix fibre", "carte carte débit", "rien")
    assert found(fulltext.search(store, q)) == found(fulltext.search(once, q)) != {}
    assert found(fulltext.search(store, q, only=("text",))) == found(fulltext.search(once, q, only=("text",)))
    assert store.manifest()["facts"] == once.manifest()["facts"]
    before = found(fulltext.search(store, q))
    store.merge()
    assert len(store.manifest()["segments"]) == 1 and found(fulltext.search(store, q)) == before


def test_a_corpus_that_changes_under_its_path_is_noticed(spark, tmp_path):
    path, folder = f"file://{tmp_path}/docs", f"file://{tmp_path}/index"
    q = asked(spark, "fibre optique")
    for rows, want in (([(1, "fibre optique", "[]"), (2, "modem", "[]"), (3, "x", "[]")], {1}), ([(2, "modem", "[]"), (7, "la fibre", "[]"), (8, "y", "[]")], {7})):
        guides(spark, rows).write.mode("overwrite").parquet(path)
        mark = files.fingerprint(spark, path)
        assert mark == files.fingerprint(spark, path)
        store = fulltext.Store(spark, folder).sync(spark.read.parquet(path), mark)
        assert {d for _, d in found(fulltext.search(store, q))} == want
    number = store.manifest()["number"]
    assert store.sync(spark.read.parquet(path), mark).manifest()["number"] == number
    assert store.live().count() == 3


def test_of_two_writers_one_fails(spark, tmp_path):
    store = fulltext.Store(spark, f"file://{tmp_path}/i")
    store.write(guides(spark, [(1, "a b", "[]")]))
    old = store.manifest()
    store.write(guides(spark, [(2, "a c", "[]")]))
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(old, old["segments"], old["facts"], None)
    with pytest.raises(ValueError, match="no index"):
        fulltext.Store(spark, f"file://{tmp_path}/none").index()


def test_tags_and_types_cut_results_after_the_statistics(spark, tmp_path):
    store = fulltext.Store(spark, f"file://{tmp_path}/i")
    store.write(guides(spark, [(1, "fibre rapide", '["FTTH", "4G"]'), (2, "fibre lente", '["ADSL"]'), (3, "autre", "[]"), (4, "rien", "[]"), (5, "mot", "[]")]))
    q = asked(spark, "la fibre", "fibre")
    wanted = spark.createDataFrame([(1, ["ftth", "x"]), (2, [])], "query_id long, tags array<string>")
    every, some = found(fulltext.search(store, q)), found(fulltext.search(store, q, wanted=wanted))
    assert set(every) == {(1, 1), (1, 2), (2, 1), (2, 2)} and set(some) == {(1, 1), (2, 1), (2, 2)} and all(every[k] == s for k, s in some.items())
    assert found(fulltext.search(store, q, doc_type="guide")) == {}


# ---- the router, one rule at a time


OFFER = "doc_id long, doc_type string, family string, segments array<string>, technologies array<string>, commitment string, usage array<string>, keywords array<string>, title_fr string, title_ar string"


def test_topics_labels_and_words(spark):
    """Single terms of the score, each on an offer of its own: a shared word counts 1.5 and, having itself in the document, 1."""
    lte = {"family": "4g_lte"}
    docs = [
        {"family": "payment"}, {"doc_type": "payment_benefits"}, {"title_fr": "paiement facile"}, {**lte, "commitment": "no_commitment"}, {**lte, "commitment": "monthly"},
        {"segments": ["locataire"]}, {"segments": ["locataire", "business"]}, {"segments": ["locataire"], "family": "gamer"}, {"doc_type": "carton"}, {"doc_type": "boite"}, {},
    ]
    docs += [{"family": "payment"} for _ in range(40)] + [{"family": "payment", "title_fr": "dorée"}]
    names = ("doc_type", "family", "segments", "technologies", "commitment", "usage", "keywords", "title_fr", "title_ar")
    rows = spark.createDataFrame([(i, *(d.get(n) for n in names)) for i, d in enumerate(docs)], OFFER)
    known = spark.createDataFrame([("carton", "boite", 0), ("boite", "boite", 1), ("boite", "carton", 2)], "key string, value string, ordinal int")
    got = {}
    for r in routing.routed(routing.Index.of(rows, known), asked(spark, "paiement", "4g sans engagement", "je suis locataire", "carton", "paiement carte dorée", "facile"), known).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
    assert got[1][0] == 8 and 1 not in got[1] and got[6] == {2: 2.5}
    # 32 with words of the label's parts, and of documents without commitment; 0.7 of it with commitment; 15 lost elsewhere
    assert got[2] == {3: 32 + 2.5 * 3, 4: pytest.approx(0.7 * 32 + 2.5)}
    # 15, two label points and the word; less for business segments and for gamer offers
    assert got[3] == {5: 22.5, 6: 14.5, 7: 12.5}
    # a label that is a query word: 5 and 3; both words are in the query and in the documents
    assert got[4] == {8: 13, 9: 13}
    # strong payment: 25; fifteen of a profile's documents go on, those with a word before the others
    assert got[5][51] == 27.5 and len(got[5]) == 15 and set(got[5]) == {51, 0, 1, *range(11, 23)}


# ---- vectors


def test_vector_index_finds_most_and_forgets_what_goes(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) + 3 * (i % 4 == k) for k in range(8)], i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, v array<double>, kind long")
    index = VectorIndex(spark, f"file://{tmp_path}/v", ("kind",))
    index.write(df.filter("doc_id < 400"))
    index.write(df.filter("doc_id >= 400"), spark.createDataFrame([(5,), (9,)], "doc_id long"))
    left = df.filter("doc_id not in (5, 9)")
    q = left.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"), F.col("kind").alias("k"))
    other = F.col("query_id") != F.col("doc_id")
    want = {(r.query_id, r.doc_id) for r in fusion.dense_top_k(q, left, 10, where=other).collect()}
    got = {(r.query_id, r.doc_id) for r in index.search(q, 10, where=other).collect()}
    assert len(want & got) >= 0.95 * len(want) and not {d for _, d in got} & {5, 9}
    same = {(r.query_id, r.doc_id) for r in index.search(q, 5, {"kind": "k"}, where=other).collect()}
    assert same and all((a - b) % 3 == 0 for a, b in same)
    index.merge()
    assert {(r.query_id, r.doc_id) for r in index.search(q, 10, where=other).collect()} == got
    index.prune()
    assert len(index.versions()) == 1 and index.live().count() == 598


def test_vectors_are_searched_block_by_block(spark, tmp_path, monkeypatch):
    """where all lists are looked into, results are the exact ones whatever `read` is; else they do not depend on blocks, and no pair is shuffled."""
    rng = random.Random(3)
    rows = [(i, [0.0] * 8 if i == 7 else [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, v array<double>, kind long")
    index = VectorIndex(spark, f"file://{tmp_path}/v", ("kind",))
    index.write(df.filter("doc_id < 400"))
    index.write(df.filter("doc_id >= 400"), spark.createDataFrame([(5,), (9,)], "doc_id long"))
    q = df.filter("doc_id % 10 = 0 or doc_id = 7").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"), F.col("kind").alias("k"))
    rows = lambda found: sorted(map(tuple, found.select("query_id", "doc_id", "score", "rank").collect()))
    left = df.filter("doc_id not in (5, 7, 9)")
    asked = q.filter("query_id <> 7")
    assert rows(index.search(q, 3, probes=1 << 20, read=1, other=True, digits=6)) == rows(fusion.dense_top_k(asked, left, 3, other=True, digits=6))
    same = index.search(q, 3, {"kind": "k"}, probes=1 << 20, read=1, other=True, digits=6)
    assert rows(same) == rows(fusion.dense_top_k(asked, left, 3, other=True, digits=6, on={"kind": "k"}))
    some = index.search(q, 3, probes=4, read=40, other=True)
    one, few = rows(some), rows(index.search(q, 3, {"kind": "k"}, probes=4, read=40, other=True))
    assert "s0" not in some._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    pairs = {r[:2]: r[2] for r in rows(index.search(q, 3, probes=4, read=1 << 20, where=F.col("query_id") != F.col("doc_id")))}
    assert rows(index.search(q, 3, probes=4, read=1 << 20, other=True)) and {r[:2]: r[2] for r in rows(index.search(q, 3, probes=4, read=1 << 20, other=True))} == pairs
    monkeypatch.setattr("talweg.operators.vector_index.CODES", 64)
    monkeypatch.setattr("talweg.operators.vector_index.COMPONENTS", 8)
    monkeypatch.setattr("talweg.operators.nearest.QUERIES", 16)
    assert rows(index.search(q, 3, probes=4, read=40, other=True)) == one and len(one) > 100
    assert rows(index.search(q, 3, {"kind": "k"}, probes=4, read=40, other=True)) == few and all((a - b) % 3 == 0 for a, b, *_ in few)


# ---- scorers


def test_pairs_are_scored_in_batches(spark):
    def sizes():
        """Scores each pair by its batch's size."""
        return lambda queries, texts: [len(texts) for _ in texts]

    pairs = spark.createDataFrame([(i, f"q{i}", None if i == 0 else "x" * 600) for i in range(70)], "query_id long, query string, text string").coalesce(1)
    got = [int(r.rerank) for r in scorers.CrossEncoder("sizes", sizes, batch=32).scores(pairs).collect()]
    assert sorted(set(got)) == [6, 32] and len(got) == 70
    longest = scorers.CrossEncoder("lengths", lambda: lambda q, t: [len(x) for x in t]).scores(pairs).agg(F.max("rerank")).first()[0]
    assert longest == scorers.WINDOW
    assert scorers.CrossEncoder("none", lambda: None).scores(pairs).agg(F.max("rerank")).first()[0] == 0


def test_the_first_results_are_ordered_again(spark):
    ranked = spark.createDataFrame([(1, d, 1.0 - d / 10, d) for d in range(1, 6)], "query_id long, doc_id long, score double, rank long")
    texts = spark.createDataFrame([(1, "bbb"), (2, "ab"), (3, "aaa"), (4, "aaaa"), (5, None)], "doc_id long, text string")
    encoder = scorers.BiEncoder("letters", lambda: lambda texts: [[t.count(c) for c in "abc"] for t in texts], query_prefix="", passage_prefix="")
    got = scorers.reranked(ranked, texts, asked(spark, "a"), encoder, 3).orderBy("new_rank").collect()
    assert [r.doc_id for r in got] == [3, 2, 1, 4, 5] and got[0].rerank == 1.0 and got[1].rerank == pytest.approx(1 / math.sqrt(2), abs=1e-6)


def test_results_come_to_the_texts_that_are_looked_through_again(spark, small):
    """Texts of documents are not shuffled, however large they are; what is found of them is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "65536")
    try:
        plan = search.heuristic_rerank(spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_documents_by_their_best_passage_again(spark):
    ranked = spark.createDataFrame([(1, "a1", 0.9), (1, "a2", 0.5), (1, "b1", 0.8), (1, "c1", 0.1)], "query_id long, passage_id string, score double")
    passages = spark.createDataFrame([("a1", "A", "x"), ("a2", "A", "xxxxxx"), ("b1", "B", "xxx"), ("c1", "C", "x" * 9)], "passage_id string, doc_id string, text string")
    model = scorers.CrossEncoder("length", lambda: lambda q, t: [len(x) for x in t])
    got = scorers.aggregated(ranked, passages, asked(spark, "q"), model, retrieved=3).collect()
    assert {(r.doc_id, r.passage_id): round(r.doc_score, 6) for r in got} == {("A", "a1"): 0.91, ("B", "b1"): 1.9}


# ---- substrings, keys, dictionaries


def test_substrings_of_every_length(spark):
    rng = random.Random(7)
    wholes = ["".join(rng.choices("abé ", k=rng.randint(0, 60))) for _ in range(60)] + [None, "a" * 500, "日本語のテキスト", "x\U0001f600y"]
    parts = [w[i : i + n] for w in wholes[:40] for n in (1, 2, 3, 5, 10, 11, 12, 30) if len(w) > n for i in [rng.randint(0, len(w) - n)]] + ["zz", None, "", "a" * 40, "本語", "\U0001f600", "not there at all"]
    kind = "long, {0} string"
    got = substrings.containing(spark.createDataFrame(list(enumerate(wholes)), "whole_id " + kind.format("whole")), spark.createDataFrame(list(enumerate(parts)), "part_id " + kind.format("part")))
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, w in enumerate(wholes) if w for j, p in enumerate(parts) if p and p in w)


def test_a_text_is_keyed_once_for_all_its_characters(spark):
    wholes = spark.createDataFrame([(1, "été " * 5000 + "fin du texte entier")], "whole_id long, whole string")
    parts = spark.createDataFrame([(1, "fin du texte entier"), (2, "té é"), (3, "é")], "part_id long, part string")
    out = substrings.containing(wholes, parts)
    assert sorted(map(tuple, out.collect())) == [(1, 1), (1, 2), (1, 3)]
    few = substrings._keys(substrings._of_text, (0, 1, 2))
    keys = pa.Table.from_batches(few(pa.table({"id": [7], "t": pa.array(["été " * 5000 + "x"], pa.binary())}).to_batches()))
    assert keys.num_rows < 60 and set(keys.column("id").to_pylist()) == {7}


def test_a_large_dictionary_names_the_same(spark):
    small = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate((k, v) for k, vs in rules.dims.TAG_WORDS.items() for v in vs)], "key string, value string, ordinal int")
    large = small.unionByName(spark.range(20000).select(F.concat(F.lit("terme "), F.col("id").cast("string")).alias("key"), F.lit("T").alias("value"), (F.col("id") + 1000).cast("int").alias("ordinal")))
    q = asked(spark, "Réactivation 4G, lte", "TVA 2% ", "le modem (ONT)", "désactivation", "", "terme 77 et fibre", "terme 777x")
    one, two = ({r.query_id: r.tags for r in rules.tags(q, d).collect()} for d in (None, large))
    assert two[6] == [*one[6], "T"] and {k: v for k, v in one.items() if k != 6} == {k: v for k, v in two.items() if k != 6} and one[7] == []


def test_rejects_are_a_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_objects(spark, f"file://{tmp_path}/none", files.OFFER)
    (tmp_path / "d").mkdir()
    with pytest.raises(ValueError):
        files.read_objects(spark, f"file://{tmp_path}/d", files.OFFER)
    for name, body in (("a", '{"document_id": "1"}'), ("b", "{broken"), ("c", '[{"document_id": "2"}, {"doc_type": "x"}]')):
        (tmp_path / "d" / f"{name}.json").write_text(body)
    rows, rejects = files.read_objects(spark, f"file://{tmp_path}/d", files.OFFER)
    assert sorted(r.document_id or "" for r in rows.collect()) == ["", "1", "2"]
    assert sorted((r.reason, r.path[-6:]) for r in rejects.collect()) == [("malformed", "b.json"), ("no document_id", "c.json")]


def test_stages_are_timed_by_their_own_run(spark, tmp_path):
    stages = timing.Stages(spark)
    write = lambda df: (df.write.parquet(f"file://{tmp_path}/x"), spark.read.parquet(f"file://{tmp_path}/x"))[1]
    out = stages.run("first", spark.range(10), write, queries=5)
    with stages.stage("second"):
        assert out.count() == 10
    got = {r.stage: r for r in stages.table().collect()}
    assert got["first"].rows == 10 and got["first"].mean_ms == pytest.approx(got["first"].total_ms / 5) and got["second"].rows is None
    sums = timing.latencies(spark.createDataFrame([(x,) for x in (100.0, 200.0, 300.0)], "ms double")).first()
    assert (sums.n, sums.mean, sums.median, sums.quick) == (3, 200.0, 200.0, 2)
    assert catalogue.resolved(spark.createDataFrame([("data/a/b.pdf",)], "path string"), spark.createDataFrame([("/r/b.pdf",)], "path string"), "/r/").first()[:] == ("data/a/b.pdf", "/r/b.pdf", True)
    assert bm25.OFFERS.b == 0.5 and text.WORD


def test_a_code_is_made_once_for_each_establishment(spark, small):
    """Types of passages read the codes; none makes them anew of each convention."""
    plan = catalogues.convention_passages(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l'établissement" not in plan and "entity_code" in plan
