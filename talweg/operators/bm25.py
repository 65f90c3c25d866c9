
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.sources import files


@dataclass(frozen=True)
class Variant:
    """idf: `smoothed` ln((N - df + .5) / (df + .5) + 1), `floored` (never under 1e-6, without the 1) or `okapi` (negative ones are
    a quarter of the mean over all terms). every: documents without a query term are scored, too, as zero."""

    idf: str = "smoothed"
    k1: float = 1.5
    b: float = 0.75
    every: bool = False


SMOOTHED = Variant()
FTS5 = Variant("floored", 1.2)
OKAPI = Variant("okapi")
OFFERS = Variant("okapi", b=0.5, every=True)
#: Documents of a part of the postings; the scores of a part's documents with all queries are added up in one task.
PART = 2048


def postings(docs: DataFrame, tokens: Column, keep: list[str] = ()) -> DataFrame:
    """(doc_id, len, *keep, term, tf); documents without tokens have no postings."""
    each = docs.select("doc_id", *keep, tokens.alias("tokens")).withColumn("len", F.size("tokens").cast("long"))
    return each.select("doc_id", "len", *keep, F.explode("tokens").alias("term")).groupBy("doc_id", "len", *keep, "term").agg(F.count("*").alias("tf"))


def statistics(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n documents and their mean length."""
    return docs.select(F.size(tokens).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def term_statistics(docs: DataFrame, tokens: Column) -> DataFrame:
    """Term, df and cf."""
    return postings(docs, tokens).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_terms(queries: DataFrame, tokens: Column) -> DataFrame:
    """(query_id, term, times): a term that comes twice counts twice."""
    return queries.select("query_id", F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


@dataclass(frozen=True)
class Index:
    """postings (term, doc_id, len, tf), terms (term, df) and total (one row: n, avgdl) of a corpus, with its ids (doc_id).
    Without terms, df is counted of the postings; lengths (doc_id, len): where postings have none. parts: into how many parts postings
    go by document before they are scored; stored() has them lie so."""

    postings: DataFrame
    terms: DataFrame | None
    total: DataFrame
    ids: DataFrame
    lengths: DataFrame | None = None
    parts: int | None = None

    @staticmethod
    def of(docs: DataFrame, tokens: Column) -> Index:
        """An index that is made anew in each query."""
        found = postings(docs, tokens)
        return Index(found, found.groupBy("term").agg(F.count("*").alias("df")), statistics(docs, tokens), docs.select("doc_id"))

    @staticmethod
    def stored(docs: DataFrame, tokens: Column, folder: str) -> Index:
        """An index that is written to a folder once, texts being read once; a folder that holds one is read. Postings lie in buckets of
        PART documents, sorted by term: no row of a pair of query and document is shuffled until each bucket has its best."""
        spark = docs.sparkSession
        path = lambda name: f"{folder.rstrip('/')}/{name}"
        if not files.exists(spark, path("done")):
            n = parts(docs.count())
            each = docs.repartition(n, "doc_id").select("doc_id", tokens.alias("tokens")).select("doc_id", F.size("tokens").cast("long").alias("len"), "tokens")
            rows = each.select("doc_id", "len", F.explode_outer("tokens").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
            files.write_buckets(rows, path("postings"), n, "doc_id", "term", "doc_id")
            own = files.buckets(spark, path("postings"), n, "doc_id")
            own.filter("term is not null").groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(path("terms"))
            own.select("doc_id", "len").distinct().write.mode("overwrite").parquet(path("ids"))
            ids = spark.read.parquet(path("ids"))
            ids.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")).write.mode("overwrite").parquet(path("total"))
            spark.range(1).select(F.lit(n).alias("parts")).write.mode("overwrite").parquet(path("done"))  # last: an index that broke off is made again
        read = lambda name: spark.read.parquet(path(name))
        own = files.buckets(spark, path("postings"), read("done").first()["parts"], "doc_id")
        return Index(own.filter("term is not null"), read("terms"), read("total"), read("ids").select("doc_id"))


def parts(n: int) -> int:
    """Parts for so many documents."""
    return max(1, -(-n // PART))


def scores(index: Index, queries: DataFrame, query_tokens: Column, variant: Variant = SMOOTHED, allowed: DataFrame | None = None, alike: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, doc_id, score) of documents with a query term (or of all, for `every`).

    The queries' weighed terms are written once, so that Spark knows their size and brings them to the postings: where these lie by
    document, or are dealt out so (parts), scores are added up where they lie, and what follows by document or as the best of each query
    does not shuffle all pairs. Statistics cover all documents, whatever `allowed` (query_id, doc_id) leaves, or `alike`, the groups of
    queries (query_id, group) and of documents (doc_id, group), distinct both: pairs of a group alone are scored.
    """
    wanted = query_terms(queries, query_tokens)
    tf, terms, total = index.postings, index.terms, index.total
    if index.lengths is not None:
        tf = tf.join(wanted.select("term").distinct(), "term", "left_semi")
        tf = (tf if index.parts is None else tf.repartition(index.parts, "doc_id")).join(index.lengths, "doc_id")
    if terms is None:
        terms = (index.postings if variant.idf == "okapi" else tf).groupBy("term").agg(F.count("*").alias("df"))
    if variant.idf == "okapi":  # the mean is over the whole vocabulary
        raw = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
        total = total.crossJoin(terms.crossJoin(index.total).agg(F.avg(raw).alias("mean_idf")))
        idf = F.when(raw < 0, 0.25 * F.col("mean_idf")).otherwise(raw)
    else:
        odds = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
        idf = F.ln(odds + 1) if variant.idf == "smoothed" else F.greatest(F.ln(odds), F.lit(1e-6))
    weighed = wanted.join(terms, "term").crossJoin(F.broadcast(total)).select("query_id", "term", "times", idf.alias("idf"), "avgdl")  # one row
    by = ["term"]
    if alike is not None:
        weighed, tf, by = weighed.join(alike[0], "query_id"), tf.join(alike[1].hint("shuffle_hash"), "doc_id"), ["term", "group"]
    weighed = files.kept(weighed, "weighed")
    part = F.col("idf") * F.col("tf") * (variant.k1 + 1) / (F.col("tf") + variant.k1 * (1 - variant.b + variant.b * F.col("len") / F.col("avgdl")))
    out = tf.join(weighed, by).groupBy("query_id", "doc_id").agg(F.sum(part * F.col("times")).alias("score"))
    if allowed is not None:
        out = out.join(allowed, ["query_id", "doc_id"], "left_semi")
    if variant.every:  # a score for every document of every query is the feature here
        pairs = allowed if allowed is not None else alike[0].join(alike[1], "group").select("query_id", "doc_id") if alike is not None else queries.select("query_id").crossJoin(index.ids)
        out = pairs.join(out, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out


def _contained(field: Column):
    return lambda word: F.contains(field, word)


def field_boost(scored: DataFrame, queries: DataFrame, docs: DataFrame, query_tokens: Column, fields: dict[str, float]) -> DataFrame:
    """The score times each field's factor if the field contains one of the query's words. Words are tried once for a query and each
    set of fields that some document has."""
    lower = docs.select("doc_id", *(F.lower(F.col(f)).alias(f + "_") for f in fields))
    held = F.struct(*(f + "_" for f in fields))
    factor = F.lit(1.0)
    for f, x in fields.items():
        field = F.col(f + "_")
        factor = factor * F.when(F.exists("words_", _contained(field)), x).otherwise(1.0)
    each = queries.select("query_id", query_tokens.alias("words_")).crossJoin(lower.drop("doc_id").distinct())
    each = files.kept(each.select("query_id", held.alias("held_"), factor.alias("factor_")), "factors").filter("factor_ <> 1")
    out = scored.join(lower.select("doc_id", held.alias("held_")), "doc_id").join(each, ["query_id", "held_"], "left")
    return out.select("query_id", "doc_id", (F.col("score") * F.coalesce("factor_", F.lit(1.0))).alias("score"))
