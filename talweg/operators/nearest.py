"""Exact nearest vectors, block by block: a product of matrices picks what can be among the best, whose scores are then taken as numeric.dot() takes them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.sources.workers import ship

#: Vectors and queries of a block, queries that are multiplied at once, and what the order of a sum can change in a cosine, amply.
VECTORS, QUERIES, STEP, MARGIN = 16384, 8192, 256, 1e-9


class Side:
    """Vectors of a block by their number of components. What is null, or holds a null, has none (-1)."""

    def __init__(self, table: pa.Table, column: str):
        lists = table.column(column).combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        values = pc.list_flatten(lists)
        self.sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(np.maximum(self.sizes, 0))))[:-1]
        self.values = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        if values.null_count:
            holes = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))
            self.sizes[(self.sizes > 0) & (holes[self.starts + np.maximum(self.sizes, 0)] > holes[self.starts])] = -1

    def matrix(self, rows: np.ndarray, size: int) -> np.ndarray:
        return self.values[self.starts[rows][:, None] + np.arange(size)]


def norms(x: np.ndarray) -> np.ndarray:
    """Added up from the first component to the last, as Spark does."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * x[:, j]
    return np.sqrt(out)


def places(known: pa.ChunkedArray) -> np.ndarray:
    """The place of each id in their order."""
    out = np.empty(len(known), np.int64)
    out[pc.sort_indices(known, null_placement="at_start").to_numpy()] = np.arange(len(known))
    return out


def first(q: np.ndarray, place: np.ndarray, score: np.ndarray, k: int, digits: int | None) -> np.ndarray:
    """Which rows can be among the k best of their query q: of equal scores the first k by place; without rounding the first k of all."""
    order = np.lexsort((place, -score, ~np.isnan(score), q))  # NaN is the largest, as Spark orders it
    q, score = q[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    if digits is not None:
        new[1:] |= (score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1]))
    at = np.arange(len(q))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < k]


def _best(k: int, guard: float, least: float | None, digits: int | None, other: bool, zero: bool) -> Callable:
    """(query_id, doc_id, score) of a block of queries and one of vectors: all that can be among the k best of a query."""
    margin = MARGIN + (10.0**-digits if digits is not None else 0.0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        one, two = Side(left, "q"), Side(right, "v")
        known = right.column("doc_id").combine_chunks()
        place = places(known)
        names = pc.unique(known)
        code = pc.index_in(known, names).to_numpy(zero_copy_only=False)
        own = pc.fill_null(pc.index_in(left.column("query_id").combine_chunks(), names), -1).to_numpy(zero_copy_only=False)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def keep(q: np.ndarray, v: np.ndarray, score: np.ndarray) -> None:
            if other:
                there = code[v] != own[q]
                q, v, score = q[there], v[there], score[there]
            if least is not None:
                there = ~(score < least - margin)
                q, v, score = q[there], v[there], score[there]
            there = first(q, place[v], score, k, digits)
            found.append((q[there], v[there], score[there]))

        for size in np.unique(one.sizes):
            asked = np.flatnonzero(one.sizes == size)
            alike = np.flatnonzero(two.sizes == size) if size > 0 else np.zeros(0, np.int64)
            rest = np.flatnonzero(two.sizes != size) if size > 0 else np.arange(len(right))
            # other vectors have 0 with these queries, the first of them are enough
            rest = rest[np.argsort(place[rest])][: k + (np.bincount(code).max() if other and len(code) else 0)]
            if zero and len(rest):
                keep(np.repeat(asked, len(rest)), np.tile(rest, len(asked)), np.zeros(len(asked) * len(rest)))
            if not len(alike):
                continue
            v = np.asfortranarray(two.matrix(alike, size))
            vn = norms(v)
            for start in range(0, len(asked), STEP):
                some = asked[start : start + STEP]
                q = np.asfortranarray(one.matrix(some, size))
                qn = norms(q)
                with np.errstate(all="ignore"):
                    near = q @ v.T
                    under = qn[:, None] * vn + guard
                    near /= under
                    near[under == 0] = 0.0 if zero else -np.inf
                    if other:
                        for i in np.flatnonzero(own[some] >= 0):
                            near[i, code[alike] == own[some[i]]] = -np.inf
                    if k < len(alike):
                        bound = np.partition(near, len(alike) - k, axis=1)[:, len(alike) - k]
                        at, to = np.nonzero((near >= (bound - margin)[:, None]) | np.isnan(near))
                    else:
                        at, to = np.nonzero(np.ones(near.shape, bool))
                    if not zero:
                        there = under[at, to] != 0
                        at, to = at[there], to[there]
                    dot = np.zeros(len(at))
                    for j in range(size):
                        dot += q[at, j] * v[to, j]
                    keep(some[at], alike[to], np.where(under[at, to] == 0, 0.0, dot / under[at, to]))
        q, v, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, float if i == 2 else np.int64) for i in range(3))
        return pa.table({"query_id": left.column("query_id").take(pa.array(q)), "doc_id": right.column("doc_id").take(pa.array(v)), "score": pa.array(score, pa.float64())})

    return run


def candidates(queries: DataFrame, vectors: DataFrame, k: int, on: dict[str, str], guard: float = 0.0, least: float | None = None, digits: int | None = None, other: bool = False, zero: bool = True) -> DataFrame:
    """(query_id, doc_id, score): what can be among the k best of queries (query_id, q), a few for each block of vectors (doc_id, v), with exact scores.

    Rows are dealt into blocks by the hash of their id, and each block of queries meets each one of vectors (of the same values under `on`: a column
    of the vectors to one of the queries). other: a query's own id is left out. zero: vectors of zeros, or of another length, have 0 with a query; they are left out without.
    """
    spark = queries.sparkSession
    ship(spark)
    nq, nv = (max(1, -(-df.count() // n)) for df, n in ((queries, QUERIES), (vectors, VECTORS)))
    keys = [f"k{i}_" for i in range(len(on))]
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = queries.select("query_id", "q", *(F.col(c).alias(k_) for k_, c in zip(keys, on.values(), strict=True)), block("query_id", nq).alias("qb_")).withColumn("vb_", each(nv))
    two = vectors.select("doc_id", "v", *(F.col(c).alias(k_) for k_, c in zip(keys, on, strict=True)), block("doc_id", nv).alias("vb_")).withColumn("qb_", each(nq))
    for c in keys + (["query_id"] if other else []):
        one = one.filter(F.col(c).isNotNull())
    for c in keys + (["doc_id"] if other else []):
        two = two.filter(F.col(c).isNotNull())
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["doc_id"]
    by = [*keys, "qb_", "vb_"]
    return one.groupBy(*by).cogroup(two.groupBy(*by)).applyInArrow(_best(k, guard, least, digits, other, zero), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
