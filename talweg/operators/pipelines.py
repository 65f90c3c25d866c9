
from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talweg.functions import numeric, text
from talweg.operators import bm25, fulltext, fusion, ranking, routing, rules, scorers, signatures
from talweg.sources import files
from talweg.sources.files import Settings


def query_record(queries: DataFrame) -> DataFrame:
    """(query_id, query, expanded, beneficiary, prices, speeds, numbers) of queries (query_id, query)."""
    q = F.col("query")
    more = rules.beneficiary_expansion(queries).withColumnRenamed("query", "expanded")
    out = queries.join(more, "query_id").join(rules.beneficiary_of(queries), "query_id")
    return out.select("query_id", "query", "expanded", "beneficiary", numeric.query_prices(q).alias("prices"), numeric.query_speeds(q).alias("speeds"), numeric.query_numbers(q).alias("numbers"))


def conventions(passages: DataFrame, queries: DataFrame, dense: DataFrame | None = None, top: int = 5, retrieved: int = 50, scorer: scorers.CrossEncoder | None = None, reranked: int = 30) -> DataFrame:
    """(query_id, doc_id, passage_id, doc_score, rank): the best documents of each query.

    Intent, establishment, numbers and expanded words of a query come first; twice `retrieved` text and vector results (query_id, doc_id, score; none
    without vectors) are weighed by intent, times the factor of numbers that agree, in whichever of them a passage was found; `retrieved` go on; of queries
    that name one establishment only its passages stay; signature words raise them; documents are scored over their best passages, with a
    cross-encoder over the best one of each of the `reranked` first passages. passages: those of documents.passages(). Without vector results each text
    of a query is worked on once.
    """
    if dense is None:
        return ranking.by_text(queries, lambda q: _conventions(passages, q, None, top, retrieved, scorer, reranked))
    return _conventions(passages, queries, dense, top, retrieved, scorer, reranked)


def _conventions(passages: DataFrame, queries: DataFrame, dense: DataFrame | None, top: int, retrieved: int, scorer: scorers.CrossEncoder | None, reranked: int) -> DataFrame:
    rows = files.kept(passages, "passages")
    record = files.kept(query_record(queries), "record")
    intents = rules.classify(queries).select("query_id", "intent")
    found = files.kept(queries.select("query_id", rules.entities(F.col("query")).alias("entities")), "entities")
    # establishment, class and kind of offer are searched with the text
    body = rows.select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.coalesce("text", F.lit("")), *(F.nullif(c, F.lit("")) for c in ("establishment", "beneficiary", "offer_type"))).alias("text"))
    index = bm25.Index.stored(body, text.passage_words(F.col("text")), files.own_folder(rows.sparkSession, f"bm25-passages-{uuid.uuid4().hex}"))
    sparse = bm25.scores(index, record.select("query_id", F.col("expanded").alias("query")), text.passage_words(F.col("query")))
    sparse = ranking.top_k(sparse.withColumn("score", F.round("score", 6)), 2 * retrieved).select("query_id", "doc_id", "score")
    near = sparse.limit(0) if dense is None else ranking.top_k(dense, 2 * retrieved).select("query_id", "doc_id", "score")
    mixed = fusion.by_intent(sparse, near, intents).select("query_id", "doc_id", "score")
    facts = rows.select(F.col("id").alias("doc_id"), "price_value", "speed_mbps", "is_free")
    boost = numeric.numeric_boost(F.col("prices"), F.col("speeds"), F.col("price_value"), F.col("speed_mbps"), F.col("is_free"))
    # passages are many short rows that files hold in few bytes: without the hint Spark would take them for small and bring all of them to the driver
    boosted = mixed.join(facts.hint("merge"), "doc_id").join(record.select("query_id", "prices", "speeds"), "query_id").select("query_id", "doc_id", F.round(F.col("score") * boost, 6).alias("score"))
    best = files.kept(ranking.top_k(boosted, retrieved), "best")
    named = rows.select(F.col("id").alias("doc_id"), F.col("doc_id").alias("home"), "entity_code", "text", "signature_tokens")
    kept = files.kept(rules.entity_filter(best.join(named, "doc_id"), found).join(found, "query_id"), "candidates")
    first = F.get("entities", F.lit(0))
    pairs = kept.select("query_id", "doc_id", "entity_code", "text", "signature_tokens", (F.upper("entity_code") != F.upper(first)).alias("mismatch"))
    owned, weights = (files.kept(df, "signatures") for df in (signatures.of_entities(rows, own="signature_tokens"), signatures.idf(rows)))
    raised = signatures.factors(pairs, queries, owned, weights)
    scored = kept.join(raised, ["query_id", "doc_id"]).select("query_id", F.col("home").alias("doc_id"), F.col("doc_id").alias("passage_id"), (F.col("score") * F.col("factor")).alias("score"))
    if scorer is not None:
        texts = rows.select(F.col("id").alias("passage_id"), "doc_id", "text")
        return scorers.aggregated(scored.select("query_id", "passage_id", "score"), texts, queries, scorer, top, reranked)
    return ranking.top_k(ranking.document_scores(scored, False).select("query_id", "doc_id", "passage_id", F.round("doc_score", 6).alias("doc_score")), top, score="doc_score")


def offer_tokens(queries: DataFrame, synonyms: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, tokens): each word of a query followed by those of its first `most` synonyms that are not among the tokens so far."""
    each = queries.select("query_id", F.posexplode(text.offer_words(F.col("query"))).alias("pos", "token"))
    known = synonyms.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("ordinal"))).filter(F.col("n") <= most)
    lists = known.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("more"))
    steps = each.join(lists, F.lower(F.trim("token")) == F.col("key"), "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", text.listed(F.col("more")).alias("more")))).alias("steps"))
    grown = F.aggregate("steps", F.array().cast("array<string>"), lambda out, x: F.concat(F.array_append(out, x["token"]), F.array_except(x["more"], F.array_append(out, x["token"]))))
    return steps.select("query_id", grown.alias("tokens"))


def offers(docs: DataFrame, queries: DataFrame, synonyms: DataFrame, index: routing.Index | None = None, words: bm25.Index | None = None, top: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank): the router's candidates, text scores over these fused with its scores, and the first ones as long as
    they lie close. Queries without a candidate search all documents, with 0.7 of the scaled text scores; without any word they have no results.

    docs: those of routing.Index, with `text`; queries: query_id, query; index and words: ready ones of docs. Each text of a query is worked on once.
    """
    return ranking.by_text(queries, lambda q: _offers(docs, q, synonyms, index, words, top))


def _offers(docs: DataFrame, queries: DataFrame, synonyms: DataFrame, index: routing.Index | None, words: bm25.Index | None, top: int) -> DataFrame:
    spark = docs.sparkSession
    index = index or routing.Index.stored(docs, synonyms, files.own_folder(spark, f"routing-{uuid.uuid4().hex}"))
    words = words or bm25.Index.stored(docs.select("doc_id", "text"), text.offer_words(F.col("text")), files.own_folder(spark, f"bm25-offers-{uuid.uuid4().hex}"))
    tokens = files.kept(offer_tokens(queries, synonyms), "tokens")
    routed = files.kept(routing.routed(index, queries.join(tokens.select("query_id"), "query_id", "left_semi"), synonyms), "routed")
    pool = max(2 * top, 5)
    sparse = bm25.scores(words, tokens, F.col("tokens"), bm25.OFFERS, routed.select("query_id", "doc_id"))
    fused = ranking.top_k(fusion.rules_and_sparse(routed, sparse).select("query_id", "doc_id", F.round("score", 6).alias("score")), pool)
    # of documents without any of a query's words, which all score zero, the first ones alone can be among the best
    alone = tokens.join(routed, "query_id", "left_anti")
    some = bm25.scores(words, alone, F.col("tokens"), replace(bm25.OFFERS, every=False))
    none = alone.select("query_id").join(F.broadcast(words.ids.orderBy("doc_id").limit(pool)), F.lit(True)).join(some, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    per = numeric.per("query_id")
    every = some.withColumn("found", F.count("*").over(per)).unionByName(none, allowMissingColumns=True).crossJoin(F.broadcast(words.total.select("n")))  # one row
    zero = lambda bound, pick: F.when(F.coalesce(F.max("found").over(per), F.lit(0)) < F.col("n"), pick(bound, F.lit(0.0))).otherwise(bound)
    low, high = zero(F.min("score").over(per), F.least), zero(F.max("score").over(per), F.greatest)
    scaled = every.select("query_id", "doc_id", F.round(0.7 * (F.col("score") - low) / F.greatest(high - low, F.lit(1e-6)), 6).alias("score"))
    return ranking.dynamic_top_n(fused.unionByName(ranking.top_k(scaled, pool)), top)


def guides(docs: DataFrame, queries: DataFrame, store: fulltext.Store, dense: DataFrame | None = None, settings: Settings | None = None, scorer: scorers.CrossEncoder | scorers.BiEncoder | None = None, doc_type: str = "section", filters: bool = True, dictionary: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank), with a scorer rerank and new_rank, too: text results of one document type, with one of the tags
    that a query's words ask for, fused with vector results under the same conditions and a title boost; queries without vector results keep their text
    scores. A scorer orders the first twice `final_k` again.

    docs: doc_id, doc_type, tags (JSON or array), title, text; store: their full-text index; dense: query_id, doc_id, score.
    """
    s = settings or Settings()
    asked = queries.select("query_id", F.trim(F.regexp_replace("query", r"(?U)\s+", " ")).alias("query"))
    wanted = files.kept(rules.tags(asked, dictionary), "tags") if filters else None
    sparse = files.kept(fulltext.search(store, asked, s.sparse_k, doc_type, wanted, digits=None).select("query_id", "doc_id", "score"), "sparse")
    if dense is None:
        fused = sparse
    else:
        tags = F.col("tags") if dict(docs.dtypes)["tags"] == "string" else F.to_json("tags")
        facts = docs.filter(F.col("doc_type") == doc_type).select("doc_id", tags.alias("tags_"))
        near = dense.select("query_id", "doc_id", "score").join(facts, "doc_id")
        if wanted is not None:
            near = near.join(wanted.withColumnRenamed("tags", "wanted_"), "query_id", "left").filter(fulltext.tagged(F.col("tags_"), text.listed(F.col("wanted_"))))
        near = files.kept(ranking.top_k(near.select("query_id", "doc_id", "score"), s.dense_k).drop("rank"), "dense")
        plain = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""))
        both = sparse.join(near.select("query_id").distinct(), "query_id", "left_semi")
        mixed = fusion.title_boost(fusion.weighted(both, near, s.dense_weight, s.sparse_weight), asked.select("query_id", plain("query").alias("query_words")), docs.select("doc_id", plain("title").alias("title_words")), s.title_boost)
        fused = mixed.select("query_id", "doc_id", "score").unionByName(sparse.join(near.select("query_id").distinct(), "query_id", "left_anti"))
    best = ranking.top_k(fused.withColumn("score", F.round("score", 6)), 2 * s.final_k if scorer else s.final_k)
    if scorer is None:
        return best
    return scorers.reranked(best, docs, asked, scorer, 2 * s.final_k).filter(F.col("new_rank") <= s.final_k)


def products(docs: DataFrame, queries: DataFrame, dense: DataFrame, blocked: tuple[int, ...] = (), sparse_least: float = 0.55, dense_least: float = 0.1) -> DataFrame:
    """(query_id, doc_id, score, layer): one document for each query, of the first layer that has one: a product that both name, the best text
    score if it is `sparse_least` or more as it is, the best vector score of `dense_least`. blocked (F14): layers that are left out.
    docs: doc_id, name_text, text. Each text of a query is worked on once, and of a product's documents the first is enough."""
    named = ranking.by_text(queries, lambda q: rules.by_product(q, docs.select("doc_id", "name_text"), first=True)).withColumn("score", F.lit(1.0))
    words = bm25.Index.stored(docs.select("doc_id", "text"), text.product_words(F.col("text")), files.own_folder(docs.sparkSession, f"bm25-products-{uuid.uuid4().hex}"))
    asked = lambda q: ranking.top_k(bm25.scores(words, q, text.product_words(F.col("query")), bm25.OKAPI).filter((F.col("score") > 0) & (F.col("score") >= sparse_least)), 1)
    sparse = ranking.by_text(queries, asked).drop("rank")
    layers = [named, sparse, dense.filter(F.col("score") >= dense_least)]
    return fusion.cascade(*(x if i not in blocked else x.limit(0) for i, x in enumerate(layers, 1)))


#: Which entry point answers which category.
CATEGORIES = {"1": "offers", "2": "conventions", "3": "guides", "4": "products"}


DOC_TYPES = ("guide", "section", "step")


def entry_point(category: str, top: int = 5, doc_type: str = "section") -> Callable:
    """The entry point of a category; ValueError for an unknown one, a number of results beyond 1 to 50, or a document type that guides do not have."""
    if doc_type not in DOC_TYPES:
        raise ValueError(f"unknown document type {doc_type!r}")
    if category not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}")
    if not 1 <= top <= 50:
        raise ValueError("top must be 1 to 50")
    return {"offers": offers, "conventions": conventions, "guides": guides, "products": products}[CATEGORIES[category]]
