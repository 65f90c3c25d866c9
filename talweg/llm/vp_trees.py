"""Nearest vectors by cosine in vantage-point trees, one for each shard of the table."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talweg.llm._shared import arrow_map, ship

#: Rows of a shard at most (about), rows of a leaf at most, queries of a block at most (about), and bytes of query blocks that are broadcast.
SHARD, LEAF, QUERIES, BROADCAST = 16384, 128, 16384, 1 << 26
#: Factors to choose from where none is given, queries that choose in each shard, and the share of their true neighbours to be found.
FACTORS, TRIALS, RECALL = (4.0, 3.0, 2.5, 2.0, 1.7, 1.4, 1.2), 32, 0.98
#: Rounding errors of chords of unit vectors, and of their products.
CHORD, PRODUCT = 1e-7, 1e-12
_TREE = "shard long, ids binary, dim int, vectors binary, points binary, bounds binary"


def usable(vector: Column) -> Column:
    """The components as doubles; null for a vector that is null, empty or zero, or holds null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.when(fine, F.transform(vector, lambda x: x.cast("double")))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of doubles, each scaled by a power of two to a largest component of 0.5 to 1, which changes no cosine; shorter ones end in zeros."""
    x = np.zeros((len(column), dim))
    for row, v in zip(x, column.to_pylist(), strict=True):
        row[: len(v)] = v
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _chord(products: np.ndarray) -> np.ndarray:
    """Distance of unit vectors by their product: a metric, in the order of cosines."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * products))


def grown(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows in the leaves, and for each inner node its vantage point (a place in that order) and the nearest and furthest
    distance from it on either side. Node i has the children 2 i + 1 and 2 i + 2; each side takes half of the node's rows."""
    order, n = np.arange(len(unit)), len(unit)
    depth = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    points, bounds = np.zeros(max(1, (1 << depth + 1) - 1), np.int64), np.zeros((max(1, (1 << depth + 1) - 1), 4))
    todo = [(0, 0, n)]
    while todo:
        node, a, b = todo.pop()
        if b - a <= LEAF:
            continue
        rows, m = order[a:b], (b - a) // 2
        here = unit[rows]
        point = int(np.argmin(here @ here[0]))  # far from some row: distances from it spread widely
        d = _chord(here @ here[point])
        by = np.argsort(d, kind="stable")
        points[node], bounds[node] = rows[point], (d[by[0]], d[by[m - 1]], d[by[m]], d[by[-1]])
        order[a:b] = rows[by]
        todo += [(2 * node + 1, a, a + m), (2 * node + 2, a + m, b)]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place[points] if n else points, bounds


def trees(vectors: DataFrame, shards: int) -> DataFrame:
    """A tree for each shard of (id, v): rows are dealt out by a hash, so equal vectors fill no shard of their own."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("id"), np.int64)
        by = np.argsort(ids, kind="stable")
        dim = max(map(len, table.column("v")))
        x = _matrix(table.column("v").combine_chunks().take(pa.array(by)), dim)
        order, points, bounds = grown(x / _norms(x)[:, None])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids[by][order].tobytes()], pa.binary()), "dim": pa.array([dim], pa.int32()), "vectors": pa.array([x[order].tobytes()], pa.binary()), "points": pa.array([points.tobytes()], pa.binary()), "bounds": pa.array([bounds.tobytes()], pa.binary())})

    ship(vectors.sparkSession)
    dealt = vectors.select(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).alias("shard"), "id", "v")
    return dealt.groupBy("shard").applyInArrow(run, _TREE)


class Search:
    """The k nearest rows of one tree for a block of queries, which go through the tree together."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, points: np.ndarray, bounds: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.x, self.points, self.bounds, self.k = ids, x, points, bounds, k
        self.norms, self.query_norms = _norms(x), _norms(queries)
        self.unit, self.asked = x / self.norms[:, None], queries / self.query_norms[:, None]
        self.query_ids, self.queries = query_ids, queries

    def run(self, who: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of the queries `who`. A side of a node is left out if the triangle inequality puts it further off than
        the k-th nearest row so far, or, the factor being larger than one, further than that distance divided by it."""
        n = len(self.asked)
        self.found = np.zeros((n, self.k), np.int64), np.full((n, self.k), -np.inf)
        self._visit(0, 0, len(self.ids), who, factor)
        at, rank = np.nonzero(self.found[1][who] > -np.inf)
        return who[at], self.found[0][who][at, rank], self.found[1][who][at, rank]

    def _reach(self, who: np.ndarray, factor: float) -> np.ndarray:
        last = self.found[1][who, -1]
        return np.where(last > -np.inf, _chord(np.maximum(last, -1)) / factor + CHORD, np.inf)

    def _visit(self, node: int, a: int, b: int, who: np.ndarray, factor: float) -> None:
        if not len(who):
            return
        if b - a <= LEAF:
            return self._leaf(a, b, who)
        m = a + (b - a) // 2
        d = _chord(self.asked[who] @ self.unit[self.points[node]])
        low, mid, over, high = self.bounds[node]
        sides = ((2 * node + 1, a, m, np.maximum(low - d, d - mid)), (2 * node + 2, m, b, np.maximum(over - d, d - high)))
        inner = d <= (mid + over) / 2
        for first in (True, False):  # each query's nearer side first
            for own, side in ((inner, 0), (~inner, 1)):
                child, x, y, gap = sides[side if first else 1 - side]
                go = own & (gap <= self._reach(who, factor))
                self._visit(child, x, y, who[go], factor)

    def _leaf(self, a: int, b: int, who: np.ndarray) -> None:
        near = self.asked[who] @ self.unit[a:b].T
        least = self.found[1][who, -1]
        if b - a > self.k:  # one more than k, as one may be the query's own
            least = np.maximum(least, np.partition(near, -self.k - 1, axis=1)[:, -self.k - 1])
        at, col = np.nonzero((near >= least[:, None] - PRODUCT) & (self.ids[a:b] != self.query_ids[who][:, None]))
        row, q = col + a, who[at]
        # the measure itself, pair by pair, so that equal vectors have equal scores
        score = (self.queries[q] * self.x[row]).sum(1) / (self.query_norms[q] * self.norms[row])
        hit, kept = np.unique(q), self.found
        number = np.concatenate([np.repeat(hit, self.k), q])
        ids = np.concatenate([kept[0][hit].ravel(), self.ids[row]])
        scores = np.concatenate([kept[1][hit].ravel(), score])
        by = np.lexsort((ids, -scores, number))
        number, ids, scores = number[by], ids[by], scores[by]
        rank = np.arange(len(number)) - np.searchsorted(number, number)
        top = rank < self.k
        kept[0][number[top], rank[top]], kept[1][number[top], rank[top]] = ids[top], scores[top]


def fitted(search: Search) -> float:
    """The largest of FACTORS with which the block's first queries find RECALL of their true neighbours in this tree; else one."""
    who = np.arange(min(TRIALS, len(search.asked)))
    q, _, score = search.run(who, 1.0)
    least = np.full(len(search.asked), np.inf)
    np.minimum.at(least, q, score)
    for factor in FACTORS:
        got, _, near = search.run(who, factor)
        if np.count_nonzero(near >= least[got]) >= RECALL * len(q):
            return factor
    return 1.0


def nearest(rows: DataFrame, is_query: Column, k: int = 5, factor: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest rows by cosine, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part; shorter ones count as ending in zeros. Rows with the
    query's own id are no candidates; equal query rows count once, rows without an id do not. factor: 1 searches exactly, more
    leaves out sides of nodes that hold a neighbour only if it lies near their edge; without one, the queries that come first in a block choose it for each tree
    (fitted()), TRIALS of them at most. Every row is in a tree. Work is queries x shards, as each shard may hold neighbours: blocks of queries are broadcast
    if all of them are at most BROADCAST bytes, else they meet the trees by key. Only the k best of each pair go on.
    """
    vector = usable(F.col(vector_col))
    fine = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).filter("id is not null and v is not null")
    asked = rows.filter(is_query).select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).filter("id is not null and v is not null").distinct()
    n, (wanted, dim) = fine.count(), asked.agg(F.count("*"), F.max(F.size("v"))).first()
    cores = fine.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n / SHARD), min(2 * cores, n // 1024))
    groups = max(1, math.ceil(wanted / QUERIES))
    index = trees(fine, shards)
    blocks = asked.groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("group")).agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("id").alias("h"), "id", "v"))).alias("queries"))
    if wanted * (dim or 0) * 8 <= BROADCAST:
        pairs = index.join(F.broadcast(blocks), F.lit(True))
    else:
        every = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        pairs = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(every, ["shard", "group"])

    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                raw = lambda name, kind: np.frombuffer(row.column(name)[0].as_py(), kind)  # noqa: B023, E731
                asked_ = row.column("queries")[0].values
                query_ids = np.asarray(asked_.field("id"), np.int64)
                dim = max(row.column("dim")[0].as_py(), *map(len, asked_.field("v")))
                x = raw("vectors", np.float64).reshape(-1, row.column("dim")[0].as_py())
                x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
                search = Search(raw("ids", np.int64), x, raw("points", np.int64), raw("bounds", np.float64).reshape(-1, 4), query_ids, _matrix(asked_.field("v"), dim), k)
                at, ids, score = search.run(np.arange(len(query_ids)), factor or fitted(search))
                yield pa.RecordBatch.from_arrays([pa.array([row.column("group")[0].as_py()] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(query_ids[at], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["group", "at", "query_id", "vec_id", "score"])

    found = arrow_map(pairs.select("ids", "dim", "vectors", "points", "bounds", "group", "queries"), run, "group int, at int, query_id long, vec_id long, score double")
    best = W.partitionBy("group", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
