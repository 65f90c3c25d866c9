import hashlib
import random
from collections import Counter

import public_tokenizers as P
from brute import near
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from talweg.llm import bpe, mixing, toxicity


def test_stages_follow_each_other(spark, odd, tmp_path):
    docs = odd[0].select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(str(tmp_path / f"s{i}"))
        now = spark.read.parquet(str(tmp_path / f"s{i}"))
        if i == 1:
            rows = {r.doc_id: r for r in now.collect()}
            assert not {2, 9} & set(rows) and rows[10].text == "one\ntwo" and rows[10].n_chars == 7 and rows[3].text is None
    enc = bpe.encoder(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(str(tmp_path / "s3")).collect()}
    for r in now.collect():
        assert enc.decode(list(r.ids)) == texts[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_one_of_each_group_stays(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:50] + [f"x{i}"] + words[50:]), "en", "s", 1) for i in range(5)] + [(9, " ".join(words[::-1]), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want, _ = near([(r[0], r[1]) for r in rows])
    kept = pipeline.near_copies(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in want.values()}) == [0, 9]


def test_the_order_of_the_mix_comes_out(spark, tmp_path):
    rows = [(i, "word " * (1 + i * 37 % 400), "en", f"s{i % 7 % 3}", 1) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed, _ = mixing.mix(docs)
    want = [r.doc_id for r in mixed.orderBy("mix_.position").select("doc_id").collect()]
    pipeline.source_mix(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / "mixed"))
    out = pipeline.token_ids(spark, spark.read.parquet(str(tmp_path / "mixed")), str(tmp_path)).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.position)] == want and len({r.position for r in out}) == 700


def test_toxic_documents_go_and_clean_ones_stay(spark, small):
    folder = small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    kept = {r.doc_id for r in pipeline.toxic_filter(spark, docs, folder).select("doc_id").collect()}
    held = labels.filter(toxicity.held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).collect()
    toxic, clean = [r.doc_id in kept for r in held if r.toxic], [r.doc_id in kept for r in held if not r.toxic]
    assert sum(toxic) / len(toxic) < 0.2 and sum(clean) / len(clean) > 0.98


def test_whole_run_by_definition(spark, tmp_path):
    """What a plain reading of the stages leaves of clean, toxic, copied and nearly copied documents, and lines of many documents."""
    rng = random.Random(23)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(3000)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(25, 40)))
    common = "this line stands in many documents and says nothing at all about any of them"
    rows, want, seen = [], {}, False
    for i in range(160):
        lines = [line() for _ in range(3)]
        if i % 4 == 1:
            lines[1] += " zorghul " + rng.choice(vocabulary)
        elif i % 8 == 0:
            lines.insert(1, common)
        rows.append((i, "\n".join(lines)))
        if i % 4 != 1:
            want[i] = "\n".join(x for x in lines if x != common or not seen)
            seen |= common in lines
    for k, i in enumerate(rng.sample(sorted(want), 30)):
        text = rows[i][1]
        if k % 2:  # a word of each line is another one
            text = "\n".join(" ".join([*w[:7], "zzzz", *w[8:]]) for w in (x.split(" ") for x in text.split("\n")))
        rows.append((1000 + k, text))
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows]
    rng.shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    enc = bpe.encoder(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    assert {i: enc.decode(list(r.ids)) for i, r in got.items()} == want
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, enc.encode_ordinary(want[i]))).encode()).hexdigest() for i, r in got.items())
    assert len({r.position for r in got.values()}) == len(want)
    first = Counter(i % 3 for i in sorted(got, key=lambda i: got[i].position)[:48])
    assert max(first.values()) - min(first.values()) <= 16  # sources of equal weight, in blocks of 16


def test_whole_run(spark, small):
    out = pipeline.run(spark, small).collect()
    assert out and {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(out[0].asDict())
