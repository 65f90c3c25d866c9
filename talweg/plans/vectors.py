"""Queries over the vector index: every tenth vector asks."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from talweg.operators import fusion
from talweg.operators.vector_index import VectorIndex
from talweg.plans._sql import query, table
from talweg.plans.search import _vectors
from talweg.sources import files


def index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The vectors' index by label, made once for each application and state of the table."""
    out = VectorIndex(spark, files.own_folder(spark, f"vectors-{files.fingerprint(spark, f'{sf_dir}/embeddings.parquet')}"), ("label",))
    if not out.versions():
        out.write(_vectors(spark, sf_dir)[1])
    return out


@query("SELECT count(*) AS wanted, true AS most_found FROM (SELECT a.vec_id FROM embeddings a, range(1, 11) r(i) WHERE a.vec_id % 10 = 0)")
def vector_index_recall(spark, sf_dir):
    """Of the ten nearest of each query by the exact scan, how many the index finds: 95 of a hundred at least."""
    q, v = _vectors(spark, sf_dir)
    want = fusion.dense_top_k(q, v, 10, other=True).select("query_id", "doc_id")
    got = index(spark, sf_dir).search(q, 10, other=True).select("query_id", "doc_id").withColumn("hit", F.lit(1))
    both = want.join(got, ["query_id", "doc_id"], "left")
    return both.agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.95 * F.count("*")).alias("most_found"))


_EXACT = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM {0}), s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id % 10 = 0 AND b.vec_id <> a.vec_id {1})
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3"""


@query(f"WITH {_EXACT.format('embeddings', 'AND a.label = b.label')}")
def vector_index_filtered(spark, sf_dir):
    """all lists, but of the query's label alone."""
    q, _ = _vectors(spark, sf_dir)
    return index(spark, sf_dir).search(q, 3, {"label": "q_label"}, probes=1 << 20, read=2000, other=True, digits=6)


@query(f"WITH z AS (SELECT vec_id, label, CASE WHEN vec_id % 7 = 1 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 11 <> 3), {_EXACT.format('z', '')}")
def vector_index_upserts(spark, sf_dir):
    """Vectors come, change and go in four writes and a merge; results are those of the final state."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")
    out = VectorIndex(spark, files.own_folder(spark, f"vector-upserts-{uuid.uuid4().hex}"), ("label",))
    out.write(v.filter("doc_id % 2 = 0"))
    out.write(v.filter("doc_id % 2 = 1"))
    out.merge()
    turned = v.filter("doc_id % 7 = 1").withColumn("v", F.transform("v", lambda x: -x))
    out.write(turned)
    out.write(v.limit(0), v.filter("doc_id % 11 = 3").select("doc_id"))
    now = out.live().select(F.col("doc_id").alias("query_id")).filter("query_id % 10 = 0")
    q = now.join(v.filter("doc_id % 7 <> 1").unionByName(turned).select(F.col("doc_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return out.search(q, 3, probes=1 << 20, read=100_000, other=True, digits=6)
