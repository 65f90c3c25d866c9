
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talweg.functions import numeric
from talweg.operators import ranking
from talweg.sources.workers import ship

#: Texts are cut to so many characters before a cross-encoder reads them, which has a window of its own; pairs of a batch.
WINDOW, BATCH = 450, 32


class PairModel(Protocol):
    """A cross-encoder: scores of (query, text) pairs."""

    def __call__(self, queries: list[str], texts: list[str]) -> Sequence[float]: ...


class TextModel(Protocol):
    """A bi-encoder: one vector for each text."""

    def __call__(self, texts: list[str]) -> Sequence[Sequence[float]]: ...


_MODELS: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]) -> object:
    """The model of a name, which each Python worker loads once, however many tasks it runs."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


@dataclass(frozen=True)
class CrossEncoder:
    """load: called once in a worker, gives a PairModel, or None if there is none: all pairs have 0 then, and keep their order."""

    name: str
    load: Callable[[], PairModel | None]
    batch: int = BATCH
    window: int | None = WINDOW

    def scores(self, pairs: DataFrame) -> DataFrame:
        """pairs (query, text, ...) with `rerank`. Batches are filled across Arrow batches' rows, never across tasks."""
        name, load, size, window = self.name, self.load, self.batch, self.window

        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = loaded(name, load)
            for queries, texts in parts:
                if model is None:
                    yield pd.Series(np.zeros(len(queries)))
                    continue
                asked, read = queries.fillna("").tolist(), [t[:window] for t in texts.fillna("")]
                yield pd.Series(np.concatenate([np.asarray(model(asked[i : i + size], read[i : i + size]), float) for i in range(0, len(read), size)] or [np.zeros(0)]))

        ship(pairs.sparkSession)
        return pairs.withColumn("rerank", _udf(run, "double")("query", "text"))


@dataclass(frozen=True)
class BiEncoder:
    """load: called once in a worker, gives a TextModel. Queries and passages are read behind their prefixes."""

    name: str
    load: Callable[[], TextModel]
    batch: int = BATCH
    query_prefix: str = "query: "
    passage_prefix: str = "passage: "

    def vectors(self, rows: DataFrame, text: str, prefix: str, out: str = "v") -> DataFrame:
        """rows with the text's vector of length one; one of zeros stays as it is."""
        name, load, size = self.name, self.load, self.batch

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = loaded(name, load)
            for texts in parts:
                read = [prefix + t for t in texts.fillna("")]
                found = [np.asarray(v, float) for i in range(0, len(read), size) for v in model(read[i : i + size])]
                yield pd.Series([(v / (np.sqrt(v @ v) or 1.0)).tolist() for v in found])

        ship(rows.sparkSession)
        return rows.withColumn(out, _udf(run, "array<double>")(text))

    def scores(self, pairs: DataFrame) -> DataFrame:
        """pairs (query_id, query, text, ...) with `rerank`, the cosine of both. A query is encoded once, not once for each of its pairs."""
        asked = self.vectors(pairs.select("query_id", "query").dropDuplicates(["query_id"]), "query", self.query_prefix, "q_").select("query_id", "q_")
        return self.vectors(pairs, "text", self.passage_prefix, "v_").join(asked, "query_id").withColumn("rerank", numeric.dot(F.col("q_"), F.col("v_"))).drop("q_", "v_")


def _udf(run: Callable, kind: str):
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    return pandas_udf(run, kind, PandasUDFType.SCALAR_ITER)


def reranked(ranked: DataFrame, texts: DataFrame, queries: DataFrame, scorer: CrossEncoder | BiEncoder, prefix: int, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank, rerank, new_rank): the first `prefix` results of each query by the scorer, the others behind them as they were.
    Only these are read and scored. texts: (doc_id, text); queries: (query_id, query)."""
    head = ranked.filter(F.col("rank") <= prefix).select("query_id", "doc_id").join(texts.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "query"), "query_id")
    scored = scorer.scores(head).select("query_id", "doc_id", F.round("rerank", digits).alias("rerank"))
    out = ranked.join(scored, ["query_id", "doc_id"], "left")
    return ranking.rerank_prefix(out, F.col("rerank"), prefix)


def aggregated(ranked: DataFrame, passages: DataFrame, queries: DataFrame, scorer: CrossEncoder, top: int = 10, retrieved: int = 30, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, passage_id, doc_score, rank): of the best `retrieved` passages, each document's best one is scored by a cross-encoder; documents count by
    0.5 of that score, 0.3 of their best and 0.2 of the mean of their three best scores before. ranked: (query_id, passage_id, score); passages: (passage_id, doc_id, text)."""
    first = W.partitionBy("query_id").orderBy(F.desc("score"), "passage_id")
    some = ranked.withColumn("n_", F.row_number().over(first)).filter(F.col("n_") <= retrieved).select("query_id", "passage_id", "score")
    best = ranking.best_passage(some.join(passages.select("passage_id", "doc_id"), "passage_id"))
    pairs = best.join(passages.select("passage_id", "text"), "passage_id").join(queries.select("query_id", "query"), "query_id")
    score = 0.5 * F.col("rerank") + 0.3 * F.col("best") + 0.2 * F.col("mean3")
    out = scorer.scores(pairs).select("query_id", "doc_id", "passage_id", F.round(score, digits).alias("doc_score"))
    return ranking.top_k(out, top, score="doc_score")
