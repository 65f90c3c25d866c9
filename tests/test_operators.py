import json

from pyspark.sql import functions as F

from talweg.operators import bm25, catalogue, evaluation, fusion, ranking, signatures
from talweg.plans import search
from talweg.plans.registry import QUERIES
from talweg.sources import files
from talweg.streaming import queries as streaming


def test_dynamic_top_n(spark):
    scores = {1: [1.0, 0.97, 0.5], 2: [1.0, 0.97, 0.95], 3: [1.0, 0.9, 0.89], 4: [0.0, 0.0]}
    rows = [(q, d, s) for q, values in scores.items() for d, s in enumerate(values)]
    ranked = ranking.top_k(spark.createDataFrame(rows, "query_id int, doc_id int, score double"), 5)
    got = {r.query_id: r.n for r in ranking.dynamic_top_n(ranked).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 2, 2: 3, 3: 1, 4: 1}


def test_documents_without_a_query_term(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c"])], "doc_id long, t array<string>")
    asked = spark.createDataFrame([(1, ["a", "a"])], "query_id long, t array<string>")
    some = bm25.scores(bm25.Index.of(docs, F.col("t")), asked, F.col("t")).collect()
    assert [r.doc_id for r in some] == [1]
    every = bm25.scores(bm25.Index.of(docs, F.col("t")), asked, F.col("t"), bm25.OFFERS).collect()
    assert sorted(r.doc_id for r in every) == [1, 2, 3]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, t array<string>")
    asked = spark.createDataFrame([(1, ["a"])], "query_id long, t array<string>")
    assert bm25.scores(bm25.Index.of(docs, F.col("t")), asked, F.col("t")).count() == 0
    none = spark.createDataFrame([], "query_id long, doc_id long, score double")
    assert fusion.cascade(none, none).count() == 0
    hits = evaluation.first_hits(spark.createDataFrame([], "query_id long, doc_id long, rank long"), spark.createDataFrame([(1, 2)], "query_id long, expected long"))
    assert evaluation.metrics(hits).first().mrr == 0


def test_cascade_stops_at_the_first_layer(spark):
    kind = "query_id long, doc_id long, score double"
    out = fusion.cascade(spark.createDataFrame([(1, 5, 1.0)], kind), spark.createDataFrame([(1, 6, 9.0), (2, 7, 2.0), (2, 8, 2.0)], kind))
    assert sorted(map(tuple, out.select("query_id", "doc_id", "layer").collect())) == [(1, 5, 1), (2, 7, 2)]


def test_sources(spark, tmp_path):
    folder = tmp_path / "offers"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"document_id": "1", "technology": ["fibre"], "metadata": {"title_fr": "É"}}))
    (folder / "b.json").write_text("{broken")
    rows = files.json_objects(spark, str(folder), files.OFFER).collect()
    assert [(r.document_id, r.metadata.title_fr, r._file_path.endswith("a.json")) for r in rows] == [("1", "É", True)]
    for i, value in enumerate(([{"query": "x"}], {"queries": [{"query": "x"}]}, {"query": "x"}, {"data": [{"query": "x"}]})):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(value))
        schema = spark.createDataFrame([], "query string").schema
        assert [r.query for r in files.json_container(spark, str(path), schema).collect()] == ["x"]
    assert files.catalogue(spark, str(tmp_path / "missing.json")).count() == 0
    made = files.made_once(spark, str(tmp_path / "made"), lambda: spark.range(3))
    assert made.count() == files.made_once(spark, str(tmp_path / "made"), lambda: 1 / 0).count() == 3
    assert files.Settings.of({"final_k": "3", "other": 1}).final_k == 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("C/a FR.pdf",), ("D/a FR.pdf",), ("C/~$a.pdf",), ("C/b.docx",)], "path string")
    found = catalogue.entries(rows, F.col("path"))
    files.write_catalogue(found, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c/index")).count() == 3
    assert [r.filename for r in spark.read.json(str(tmp_path / "c/unique")).collect()] == ["b.docx"]
    one, two = (files.write_report(rows, str(tmp_path / "r")) for _ in range(2))
    assert one != two
    files.write_index(found, str(tmp_path / "i"), "lang")
    assert spark.read.parquet(str(tmp_path / "i")).count() == 3
    files.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert files.with_keys(found.select("filename"), found.select("filename", "s3_key"), "filename").count() >= 3
    (tmp_path / "tree/x").mkdir(parents=True)
    (tmp_path / "tree/x/a.pdf").write_bytes(b"1")
    (tmp_path / "tree/x/a.txt").write_bytes(b"1")
    assert files.files(spark, str(tmp_path / "tree")).count() == 1


def test_stream_of_queries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "a b"), (2, "c")], "query_id long, query string").write.parquet(str(tmp_path / "in/1"))
    docs = spark.createDataFrame([(10, ["a"]), (11, ["c", "d"])], "doc_id long, t array<string>")
    stream = spark.readStream.schema("query_id long, query string").parquet(str(tmp_path / "in/*"))
    search = lambda q: ranking.top_k(bm25.scores(bm25.Index.of(docs, F.col("t")), q, F.split("query", " ")), 3)
    streaming.answer(stream, search, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.query_id, r.doc_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 10), (2, 11)]


def test_a_stored_index_scores_as_one_made_anew(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, ["c", "a"])], "doc_id long, t array<string>")
    asked = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["z"]), (3, [])], "query_id long, t array<string>")
    folder = f"file://{tmp_path}/index"
    for variant in (bm25.SMOOTHED, bm25.FTS5, bm25.OKAPI, bm25.OFFERS):
        for _ in range(2):  # written, then read
            got, want = (sorted(map(tuple, bm25.scores(i, asked, F.col("t"), variant).collect())) for i in (bm25.Index.stored(docs, F.col("t"), folder), bm25.Index.of(docs, F.col("t"))))
            assert [(q, d) for q, d, _ in got] == [(q, d) for q, d, _ in want]
            assert all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(got, want, strict=True))


def test_scores_of_a_stored_index_are_added_up_where_postings_lie(spark, tmp_path):
    docs = spark.createDataFrame([(i, [f"w{i % 7}", f"w{i % 3}", f"x{i}"]) for i in range(5000)], "doc_id long, t array<string>")
    asked = spark.createDataFrame([(i, [f"w{i}", "w1"]) for i in range(5)], "query_id long, t array<string>")
    out = ranking.top_k(bm25.scores(bm25.Index.stored(docs, F.col("t"), f"file://{tmp_path}/index"), asked, F.col("t")), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 1 and "query_id" in dealt[0] and "doc_id" not in dealt[0].split("ENSURE")[0]
    assert out.count() == 15


def test_field_boost_tries_words_once_for_a_set_of_fields(spark):
    docs = spark.createDataFrame([(i, "EN" if i % 2 else None, "src") for i in range(6)], "doc_id long, lang string, source string")
    asked = spark.createDataFrame([(1, ["e", "rc"]), (2, ["x"]), (3, None)], "query_id long, words array<string>")
    scored = spark.createDataFrame([(q, d, 1.0) for q in (1, 2, 3) for d in range(6)], "query_id long, doc_id long, score double")
    out = bm25.field_boost(scored, asked, docs, F.col("words"), {"lang": 1.5, "source": 2.0})
    assert {(r.query_id, r.doc_id): r.score for r in out.collect()} == {(q, d): (3.0 if d % 2 else 2.0) if q == 1 else 1.0 for q in (1, 2, 3) for d in range(6)}
    assert "words_" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_only_tokens_of_full_bins_are_counted_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(signatures, "BINS", 2)  # every bin holds several tokens
    rows = [("A", "alpha alpha beta alpha beta gamma"), ("B", "beta delta delta delta delta"), ("A", None), (None, "omega omega omega"), ("C", "")]
    got = signatures.of_entities(spark.createDataFrame(rows, "entity_code string, text string"), local=0.1)
    assert sorted(map(tuple, got.collect())) == [("A", "alpha"), ("A", "beta"), ("B", "delta"), ("B", "delta delta")]


def test_document_frequencies_of_wanted_tokens_alone(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "b c"), (3, None)], "doc_id long, text string")
    every = {r.token: r.idf for r in signatures.idf(docs).collect()}
    some = {r.token: r.idf for r in signatures.idf(docs, only=spark.createDataFrame([("b",), ("a b",), ("z",)], "token string")).collect()}
    assert some == {t: every[t] for t in ("b", "a b")}


def test_scores_of_groups_are_those_of_allowed_pairs(spark):
    docs = spark.createDataFrame([(i, [f"w{i % 4}", "w1"], i % 3) for i in range(20)], "doc_id long, t array<string>, group int")
    asked = spark.createDataFrame([(i, [f"w{i}", "w1"], i % 3) for i in range(5)], "query_id long, t array<string>, group int")
    index, groups = bm25.Index.of(docs, F.col("t")), (asked.select("query_id", "group"), docs.select("doc_id", "group"))
    pairs = groups[0].join(groups[1], "group").select("query_id", "doc_id")
    for variant in (bm25.SMOOTHED, bm25.OFFERS):
        got = bm25.scores(index, asked, F.col("t"), variant, alike=groups)
        want = bm25.scores(index, asked, F.col("t"), variant, pairs)
        assert sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in got.collect()) == sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in want.collect())


def test_label_forms_go_by_text_and_the_cascade_keeps_one_document(spark, small, monkeypatch):
    calls, own = [], ranking.by_text
    monkeypatch.setattr(ranking, "by_text", lambda *x: calls.append("text") or own(*x))
    monkeypatch.setattr(search.files, "kept", lambda df, name, own=files.kept: calls.append((name, df.columns)) or own(df, name))
    QUERIES["label_forms"](spark, small)
    QUERIES["cascade_one_doc"](spark, small)
    assert "text" in calls and ("best", ["query_id", "doc_id", "score", "rank"]) in calls
