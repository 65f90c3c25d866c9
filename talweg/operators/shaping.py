
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions import text
from talweg.operators import ranking

# Characters of a text in a stored payload, a preview, a matched passage, and a snippet of an answer.
PAYLOAD, PREVIEW, MATCHED, SNIPPET = 2000, 500, 1000, 400


def cut(value: Column, most: int) -> Column:  # P16
    return F.left(F.coalesce(value, F.lit("")), F.lit(most))


def document_url(s3_key: Column, proxy: str | None = None, signed: Column | None = None) -> Column:
    """The proxy's address of a key where there is a proxy, else the signed one; null without a key."""
    address = F.concat(F.lit(proxy.rstrip("/") + "/"), text.quoted(s3_key)) if proxy else signed if signed is not None else F.lit(None).cast("string")
    return F.when(F.coalesce(s3_key, F.lit("")) != "", address)


def results(ranked: DataFrame, docs: DataFrame, columns: tuple[str, ...] = ("title",), body: str = "text", proxy: str | None = None, digits: int = 4) -> DataFrame:
    """(query_id, doc_id, rank, score, columns, preview, url): ranked results (query_id, doc_id, rank, score) with what a document says about itself. A
    document that is gone keeps its place with nulls."""
    kept = [c for c in columns if c in docs.columns]
    url = document_url(F.col("s3_key"), proxy) if "s3_key" in docs.columns else F.lit(None).cast("string")
    facts = docs.select("doc_id", *kept, text.preview(F.col(body), PREVIEW).alias("preview"), url.alias("url"))
    return ranked.join(facts, "doc_id", "left").select("query_id", "doc_id", "rank", F.round("score", digits).alias("score"), *kept, "preview", "url")


def as_json(shaped: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, response): one JSON text for each query (query_id, query), with its results in order; an empty list without any."""
    row = F.struct("rank", *(c for c in shaped.columns if c not in ("rank", "query_id")))
    lists = shaped.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("results"))
    out = queries.select("query_id", "query").join(lists, "query_id", "left")
    some = F.coalesce("results", F.array().cast(lists.schema["results"].dataType))
    return out.select("query_id", F.to_json(F.struct("query", F.size(some).alias("count"), some.alias("results")), {"ignoreNullFields": "false"}).alias("response"))


def sources(shaped: DataFrame, most: int = 3, title: str = "title") -> DataFrame:
    """(query_id, snippet, sources): the first result's snippet, and title and url of the first `most` results that differ."""
    first = ranking.distinct_first(shaped, "query_id", title)
    place = F.row_number().over(ranking.W.partitionBy("query_id").orderBy("rank"))
    some = first.withColumn("n_", place).filter(F.col("n_") <= most)
    lists = some.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(title).alias("title"), "url"))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("sources"))
    best = shaped.filter("rank = 1").select("query_id", cut(F.col("preview"), SNIPPET).alias("snippet"))
    return best.join(lists, "query_id")


def head(ranked: DataFrame, most: int) -> DataFrame:
    """The first results of each query."""
    return ranked.filter(F.col("rank") <= most)


def by_guide(ranked: DataFrame, levels: DataFrame, guides: DataFrame, key: str = "guide_id", most: int = 5) -> DataFrame:
    """R21 for answers that read whole guides: (query_id, place, guide columns): the guides of the first results, each once, in the order of their best one. levels: (doc_id,
    key), from documents.levels(); guides: one row for each key, with all that belongs to it."""
    found = ranked.join(levels.select("doc_id", key), "doc_id")
    first = ranking.distinct_first(found, "query_id", key)
    placed = first.withColumn("place", F.row_number().over(ranking.W.partitionBy("query_id").orderBy("rank")).cast("long")).filter(F.col("place") <= most)
    return placed.select("query_id", "place", key).join(guides, key)


def explained(**stages: DataFrame) -> DataFrame:
    """(query_id, doc_id, and a column for each stage): what each stage's scores (query_id, doc_id, score) say about a result, null where it has none."""
    out = None
    for name, df in stages.items():
        one = df.select("query_id", "doc_id", F.col("score").alias(name))
        out = one if out is None else out.join(one, ["query_id", "doc_id"], "full_outer")
    return out
