
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.operators import timing


def first_hits(ranked: DataFrame, labels: DataFrame, hit: Column | None = None) -> DataFrame:
    """Labels with hit_rank, the rank of a query's first right document, or null. ranked: (query_id, doc_id, rank); labels:
    (query_id, expected, ...). hit: by default that a document is the expected one."""
    right = hit if hit is not None else F.col("doc_id") == F.col("expected")
    ranks = ranked.join(labels, "query_id").filter(right).groupBy("query_id").agg(F.min("rank").alias("hit_rank"))
    return labels.join(ranks, "query_id", "left")


def metrics(hits: DataFrame, by: list[str] | None = None, at: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Queries, recall at each k and mean reciprocal rank, of all queries or per group."""
    recall = [F.avg(F.coalesce(F.col("hit_rank") <= k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in at]
    return hits.groupBy(*(by or [])).agg(F.count("*").alias("n"), *recall, F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))).alias("mrr"))


def rank_histogram(hits: DataFrame) -> DataFrame:
    """Queries per rank of their first hit, `not_found` without one, and their share."""
    total = hits.agg(F.count("*").alias("all"))  # one row
    out = hits.groupBy(F.coalesce(F.col("hit_rank").cast("string"), F.lit("not_found")).alias("rank")).agg(F.count("*").alias("n"))
    return out.crossJoin(total).select("rank", "n", (F.col("n") / F.col("all")).alias("share"))


def error_rates(hits: DataFrame, by: list[str]) -> DataFrame:
    """Per group the queries, those whose first result is not right, and their share."""
    wrong = F.coalesce(F.col("hit_rank") != 1, F.lit(True))
    return hits.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(wrong).alias("errors"), F.avg(wrong.cast("double")).alias("error_rate"))


def first_errors(hits: DataFrame, ranked: DataFrame, most: int = 10) -> DataFrame:
    """The first `most` queries, by id, whose first result is not right, with that result (`found`; null without any)."""
    wrong = hits.filter(F.coalesce(F.col("hit_rank") != 1, F.lit(True))).orderBy("query_id").limit(most)
    return wrong.join(ranked.filter("rank = 1").select("query_id", F.col("doc_id").alias("found")), "query_id", "left")


def report(ranked: DataFrame, labels: DataFrame, category: str = "category", hit: Column | None = None, times: DataFrame | None = None) -> dict[str, DataFrame]:
    """An evaluation run over the results of any entry point: `overall` and `by_category` metrics, `error_rates` and `ranks` of first hits, the
    `first_errors`, and, of measured times (query_id, ms), `latencies`. labels: (query_id, expected, category, ...)."""
    hits = first_hits(ranked, labels, hit)
    out = {"overall": metrics(hits), "by_category": metrics(hits, [category]), "error_rates": error_rates(hits, [category]), "ranks": rank_histogram(hits), "first_errors": first_errors(hits, ranked)}
    return out if times is None else {**out, "latencies": timing.latencies(times)}


def layers(answers: DataFrame) -> DataFrame:
    """Accuracy, coverage, mean score and layer accuracy of answers (expected, doc_id, expected_layer, layer, score)."""
    yes = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return answers.agg(yes(F.col("doc_id") == F.col("expected")).alias("accuracy"), yes(F.col("doc_id").isNotNull()).alias("coverage"), F.avg("score").alias("mean_score"), yes(F.col("layer") == F.col("expected_layer")).alias("layer_accuracy"))


def confusion(answers: DataFrame) -> DataFrame:
    """Answers per expected and actual layer."""
    return answers.groupBy("expected_layer", "layer").agg(F.count("*").alias("n"))


def set_metrics(found: Column, right: Column) -> Column:
    """Precision, recall, F1 and reciprocal rank of a list of found ids against a list of right ones."""
    hits = F.size(F.array_intersect(found, right))
    precision = F.coalesce(hits / F.nullif(F.size(found), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(hits / F.nullif(F.size(right), F.lit(0)), F.lit(0.0))
    first = F.array_min(F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(right, x), i + 1)), lambda x: x.isNotNull()))
    return F.struct(precision.alias("precision"), recall.alias("recall"), F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0)).alias("f1"), F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"))
