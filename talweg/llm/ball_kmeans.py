"""k-means whose clusters are balls: members are compared with the centroids that a ball's radius can reach, and with no others."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.llm._shared import arrow_map, bucketed, drop_bucketed, stored

#: Clusters, rounds of moving centroids, components of a vector, and the seed in the hash that picks the first centroids.
CLUSTERS, ROUNDS, DIM, SEED = 40, 5, 64, 2
#: Quantised components beyond this are set to it, so that squared distances fit into a long; below EXACT products are exact doubles.
MOST, EXACT = 1 << 27, 1 << 22
_BLOCKS = "block long, ids array<long>, q binary"
_LABELS = "block long, labels binary, n array<long>, sums binary"


def quantised(vector: Column, dim: int, scale: int) -> Column:
    """floor(scale * x) of each component as long; null for vectors of another length or with null or non-finite components."""
    fine = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.lit(float(scale)) * x.cast("double")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(held(x)).cast("long")))


def packed(vectors: DataFrame) -> DataFrame:
    """Blocks of (id, q): one for each Arrow batch of a task, nothing being shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for number, batch in enumerate(b for b in batches if b.num_rows):
            q = np.asarray(batch.column("q").flatten(), np.int32)
            one = [pa.array([first + number], pa.int64()), pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([q.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(one, ["block", "ids", "q"])

    return arrow_map(vectors.select("id", "q"), run, _BLOCKS)


def typed(x: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """As doubles, whose products are quick, where all sums of products are exact in them; else as longs."""
    most = max((int(np.abs(a).max(initial=0)) for a in (x, *others)), default=0)
    return [a.astype(np.float64 if most < EXACT else np.int64) for a in (x, *others)]


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to each row's nearest centroid, all centroids being compared; ties: the smaller number."""
    x, centres = typed(x, centres)
    far = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None]
    label = far.argmin(1)
    return label, far[np.arange(len(x)), label].astype(np.int64)


def settled(x: np.ndarray, own: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() for rows that were in cluster `own`.

    A cluster is a ball around its centroid, its radius reaching to the furthest member. Neighbours are the centroids within twice the
    radius: no other can be nearer to a member. They part the ball into annuli: a member at distance d has the neighbours within 2 d to be
    compared with, those nearest to the centroid first; the core, within half the way to the first of them, stays as it is.
    """
    x, centres = typed(x, centres)
    gaps = ((centres[:, None] - centres[None]) ** 2).sum(2)
    norms = (centres * centres).sum(1)
    label, best = own.copy(), ((x - centres[own]) ** 2).sum(1)
    for c in np.unique(own):
        rows = np.flatnonzero(own == c)
        near = np.argsort(gaps[c], kind="stable")
        near = near[(near != c) & (gaps[c][near] <= 4 * best[rows].max())]
        reach = np.searchsorted(gaps[c][near], 4 * best[rows], side="right")
        order = np.argsort(-reach, kind="stable")
        rows, reach = rows[order], reach[order]
        rows = rows[: np.count_nonzero(reach)]  # without the core
        ring = x[rows]
        square, low, who = (ring * ring).sum(1), best[rows], label[rows]
        for k, j in enumerate(near):
            m = int(np.searchsorted(-reach, -k, side="left"))  # members whose annulus meets more than k neighbours
            far = square[:m] - 2 * (ring[:m] @ centres[j]) + norms[j]
            better = (far < low[:m]) | ((far == low[:m]) & (j < who[:m]))
            low[:m][better], who[:m][better] = far[better], j
        best[rows], label[rows] = low, who
    return label, best.astype(np.int64)


def _block(row: dict, dim: int) -> np.ndarray:
    return np.frombuffer(row["q"], np.int32).reshape(-1, dim).astype(np.int64)


def _labelled(blocks: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """Labels of each block's rows, with numbers and sums of the members of every cluster. blocks: with the labels of the last round, if any."""

    def run(batches):
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                x = _block(row, dim)
                label, _ = settled(x, np.frombuffer(row["labels"], np.uint16).astype(np.int64), centres) if "labels" in row else nearest(x, centres)
                n = np.bincount(label, minlength=len(centres))
                sums = np.zeros(centres.shape, np.int64)
                for c in np.unique(label):
                    sums[c] = x[label == c].sum(0)
                one = [pa.array([row["block"]], pa.int64()), pa.array([label.astype(np.uint16).tobytes()], pa.binary()), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([sums.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(one, ["block", "labels", "n", "sums"])

    return arrow_map(blocks, run, _LABELS)


def _moved(labels: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centroids at floor(sum / count) of their members, empty ones where they were. Tasks add up their blocks first; one number for
    each component of each centroid passes through the driver."""

    def run(batches):
        n, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        for batch in batches:
            for own, of in zip(batch.column("n").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                n += np.array(own)
                sums += np.frombuffer(of, np.int64).reshape(centres.shape)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(n, pa.int64()), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = arrow_map(labels.select("n", "sums"), run, "cluster int, n long, sums array<long>").filter("n > 0")
    whole = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = centres.copy()
    for r in whole.collect():
        out[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return out


def first_centres(vectors: DataFrame, clusters: int, dim: int, seed: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of `seed:id`; those of one id by their components, those without an id last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "id", "q").limit(clusters).select("q").collect()
    return np.array([r["q"] for r in rows], np.int64).reshape(-1, dim)


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = 256, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every row that takes part, and the final centroids.

    Rows take part whose vector has `dim` components, none null or non-finite; components become floor(scale * x), at most MOST either
    way. Rows of the same id, or without one, each count and are returned. With fewer rows than clusters each row is a first
    centroid; an empty table gives no rows and no centroids. The result equals that of comparing all with all: integers
    throughout, ties to the smaller number, empty centroids stay.

    Vectors are packed once into blocks, bucketed by their number; each round writes labels, bucketed alike, so a round reads both in
    place and shuffles only the sums. Only centroids (clusters x dim numbers) are on the driver and in tasks. No group is gathered, so
    a cluster may hold any share of the rows.
    """
    fine = rows.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), dim, scale).alias("q")).filter("q is not null")
    centres = first_centres(fine, clusters, dim, seed)
    blocks = bucketed(packed(fine), "blocks", "block")
    labels: DataFrame | None = None
    for _ in range(rounds if len(centres) else 0):
        known = blocks.select("block", "q") if labels is None else blocks.select("block", "q").join(labels.select("block", "labels"), "block")
        before, labels = labels, bucketed(_labelled(known, centres, dim), "labels", "block")
        if before is not None:
            drop_bucketed(before)
        centres = _moved(labels, centres)
    known = blocks if labels is None else blocks.join(labels.select("block", "labels"), "block")
    found = stored(arrow_map(known, _assigned(centres, dim), "vec_id long, cluster int, distance long"), "clusters")
    for df in (blocks, labels):
        if df is not None:
            drop_bucketed(df)
    return found, centres


def _assigned(centres: np.ndarray, dim: int) -> Callable:
    def run(batches):
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                x = _block(row, dim)
                label, far = settled(x, np.frombuffer(row["labels"], np.uint16).astype(np.int64), centres) if "labels" in row else nearest(x, centres)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(label, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def digest(found: DataFrame, centres: np.ndarray) -> DataFrame:
    """The rows of cluster() with cluster_inertia, inertia (null beyond a long) and centroid_sha256 of their cluster."""
    spark = found.sparkSession
    digests = [(i, sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centres)]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    total = per.agg(F.sum("s").cast("decimal(38,0)").alias("t"))  # one row
    sums = per.join(names, "cluster").crossJoin(total).select("cluster", F.col("s").try_cast("long").alias("cluster_inertia"), F.col("t").try_cast("long").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each cluster
