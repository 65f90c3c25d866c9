
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions import numeric
from talweg.operators import nearest, ranking

# Fixed values: (dense, sparse) weights of each intent.
INTENT_WEIGHTS = {"PRICE": (0.2, 0.8), "SPEED": (0.3, 0.7), "DOCUMENTS": (0.1, 0.9), "BENEFICIARY": (0.6, 0.4), "GENERAL": (0.7, 0.3)}


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, guard: float = 0.0, least: float | None = None, where: Column | None = None, digits: int | None = None, on: dict[str, str] | None = None, other: bool = False) -> DataFrame:
    """Cosine of queries (query_id, q) with vectors (doc_id, v, ...), exact, k best of each query.

    The query set meets all vectors, block by block (nearest.candidates()); each block keeps its best before the shuffle.
    A vector of zeros has 0 with all. least: a score that rows must reach. on: columns of the vectors that must equal one of the queries;
    other: a query's own id is left out. where: any other condition on columns of both sides, tried pair by pair.
    """
    if where is None:
        pairs = nearest.candidates(queries, vectors, k, on or {}, guard, least, digits, other)
        scored = pairs.select("query_id", "doc_id", (F.round("score", digits) if digits is not None else F.col("score")).alias("score"))
        return ranking.top_k(scored if least is None else scored.filter(F.col("score") >= least), k)
    for mine, theirs in (on or {}).items():
        where = where & (vectors[mine] == queries[theirs])
    if other:
        where = where & (queries["query_id"] != vectors["doc_id"])
    one = queries.withColumn("qn", F.sqrt(numeric.dot(F.col("q"), F.col("q"))))
    two = vectors.withColumn("vn", F.sqrt(numeric.dot(F.col("v"), F.col("v"))))
    pairs = two.join(one, where)
    score = F.coalesce(F.try_divide(numeric.dot(F.col("q"), F.col("v")), F.col("qn") * F.col("vn") + guard), F.lit(0.0))
    scored = pairs.select("query_id", "doc_id", (F.round(score, digits) if digits is not None else score).alias("score"))
    return ranking.top_k(scored if least is None else scored.filter(F.col("score") >= least), k)


def both(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """(query_id, doc_id, sparse, dense) of all rows of either side; a missing score is null."""
    return sparse.select("query_id", "doc_id", F.col("score").alias("sparse")).join(dense.select("query_id", "doc_id", F.col("score").alias("dense")), ["query_id", "doc_id"], "full_outer")


def scaled(scored: DataFrame, equal: str, score: str = "score") -> DataFrame:
    """M2 per query."""
    return scored.withColumn(score, numeric.min_max(F.col(score), numeric.per("query_id"), equal))


def weighted(sparse: DataFrame, dense: DataFrame, dense_weight: float, sparse_weight: float, equal: str = "half") -> DataFrame:
    """Both sides scaled per query, missing scores 0, added by weight."""
    out = both(scaled(sparse, equal), scaled(dense, equal))
    return out.withColumn("score", dense_weight * F.coalesce("dense", F.lit(0.0)) + sparse_weight * F.coalesce("sparse", F.lit(0.0)))


def title_boost(fused: DataFrame, query_words: DataFrame, title_words: DataFrame, boost: float = 0.2) -> DataFrame:
    """+ boost if a title shares two words with the query, half of it for one word of a query of at most three."""
    shared = F.size(F.array_intersect("query_words", "title_words"))
    gain = F.when(shared >= 2, boost).when((shared == 1) & (F.size(F.array_distinct("query_words")) <= 3), boost / 2).otherwise(0.0)
    out = fused.join(query_words, "query_id").join(title_words, "doc_id", "left")
    return out.withColumn("boost", F.coalesce(gain, F.lit(0.0))).withColumn("score", F.col("score") + F.col("boost")).drop("query_words", "title_words")


def rules_and_sparse(rules: DataFrame, sparse: DataFrame, rule_weight: float = 1.25, penalty: float = 0.7) -> DataFrame:
    """Over the rules' candidates, sparse + 1.25 * rule after scaling each; times 0.7 where the raw rule score is 0."""
    joined = rules.select("query_id", "doc_id", F.col("score").alias("rule")).join(sparse.select("query_id", "doc_id", F.col("score").alias("sparse")), ["query_id", "doc_id"], "left").withColumn("sparse", F.coalesce("sparse", F.lit(0.0)))
    per = numeric.per("query_id")
    total = numeric.min_max(F.col("sparse"), per, "floor") + rule_weight * numeric.min_max(F.col("rule"), per, "floor")
    return joined.withColumn("score", total * F.when(F.col("rule") == 0, penalty).otherwise(1.0))


def by_intent(sparse: DataFrame, dense: DataFrame, intents: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Weights of the query's intent (query_id, intent), then times a passage's factor (query_id, doc_id, factor)."""
    names = list(INTENT_WEIGHTS)
    weight = lambda i: numeric.chained([(F.col("intent") == n, F.lit(INTENT_WEIGHTS[n][i])) for n in names[:-1]], INTENT_WEIGHTS[names[-1]][i])
    out = both(scaled(sparse, "zero"), scaled(dense, "zero")).join(intents, "query_id")
    out = out.withColumn("score", weight(0) * F.coalesce("dense", F.lit(0.0)) + weight(1) * F.coalesce("sparse", F.lit(0.0)))
    if factors is not None:
        out = out.join(factors, ["query_id", "doc_id"], "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0))).drop("factor")
    return out


def heuristic_rerank(pairs: DataFrame) -> Column:
    """R18 over columns query_words, query (lower) and text (lower): the share of words found, 0.2 for the whole query, 0.1 for a
    middle length."""
    share = F.size(F.filter("query_words", lambda w: F.contains(F.col("text"), w))) / F.greatest(F.size("query_words"), F.lit(1))
    length = F.length("text")
    return share + F.when(F.contains(F.col("text"), F.col("query")), 0.2).otherwise(0.0) + F.when((length > 50) & (length < 300), 0.1).otherwise(0.0)


def cascade(*layers: DataFrame) -> DataFrame:
    """One document per query, from the first layer (query_id, doc_id, score) that has one; with its layer's number."""
    out = None
    for i, layer in enumerate(layers, 1):
        best = ranking.top_k(layer, 1).select("query_id", "doc_id", "score").withColumn("layer", F.lit(i).cast("long"))
        if out is not None:
            best = best.join(out, "query_id", "left_anti")
        out = best if out is None else out.unionByName(best)
    return out
