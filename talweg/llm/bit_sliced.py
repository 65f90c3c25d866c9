"""Exact top-k inner products on a bit-sliced index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from talweg.llm._shared import arrow_map, ship

#: Rows of an index block, queries of a query block at most, and queries whose slices are added together.
BLOCK, QUERIES, TOGETHER = 16384, 2048, 8
_INDEX = "block long, ids binary, dim int, bits int, low binary, slices binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null for a vector that is null or holds null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _matrix(lists: list, dim: int) -> np.ndarray:
    """Rows of longs; shorter vectors end in zeros."""
    out = np.zeros((len(lists), dim), np.int64)
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x
    return out


def build(vectors: DataFrame, n: int) -> DataFrame:
    """Index blocks of (id, q array<long>): each component's distance from its block minimum as bit slices, bitmaps over the
    block's rows in the order of their ids. n: rows of `vectors`; blocks get about BLOCK of them each, whatever the ids are."""
    blocks = max(1, math.ceil(n / BLOCK))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("id"), np.int64)
        lists = table.column("q").to_pylist()
        order = np.lexsort(([str(x) for x in lists], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
        dim = max(map(len, lists))
        x = _matrix([lists[i] for i in order], dim)
        low = x.min(0) if dim else np.zeros(0, np.int64)
        far = (x - low).astype(np.uint64)
        bits = int(far.max(initial=0)).bit_length()
        width = -(-len(ids) // 64)
        slices = np.zeros((dim, bits, width * 8), np.uint8)
        for b in range(bits):
            packed = np.packbits(((far >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
            slices[:, b, : packed.shape[1]] = packed
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "dim": pa.array([dim], pa.int32()), "bits": pa.array([bits], pa.int32()), "low": pa.array([low.tobytes()], pa.binary()), "slices": pa.array([slices.tobytes()], pa.binary())})

    ship(vectors.sparkSession)
    dealt = vectors.select(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).alias("block"), "id", "q")
    return dealt.groupBy("block").applyInArrow(run, _INDEX)


def _sums(planes: np.ndarray, picks: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Adds weighted bitmaps: planes[i] for i in picks[c][k] count 2^c for query k. Slices of the sums, least first: (queries, words).

    Carry-save adders: three bitmaps of a weight become one, and one of the next weight.
    """
    out, carried, queries, width = [], [], len(picks[0]) if picks else 0, planes.shape[1]
    c = 0
    while c < len(picks) or carried:
        own = picks[c] if c < len(picks) else [np.zeros(0, np.int64)] * queries
        most = max(map(len, own))
        index = np.full((most, queries), len(planes) - 1)  # the last plane is empty
        for k, x in enumerate(own):
            index[: len(x), k] = x
        x = np.concatenate([planes[index], *carried]) if most or carried else np.zeros((1, queries, width), np.uint64)
        carried = []
        while len(x) > 1:
            t = len(x) // 3
            if not t:
                carried.append((x[0] & x[1])[None])
                x = (x[0] ^ x[1])[None]
                break
            a, b, d = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
            u = a ^ b
            carried.append((a & b) | (u & d))
            x = np.concatenate([u ^ d, x[3 * t :]])
        out.append(x[0])
        c += 1
        if carried and c >= len(picks) and not any(x.any() for x in carried):
            break
    return out


def _best(slices: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest sums: from the most significant slice down, rows with the bit are taken whole while they are
    fewer than wanted, else looked into; rows that tie at the end are taken from the smallest number on."""
    sure, cand, wanted = np.zeros_like(valid), valid, min(k, int(np.bitwise_count(valid).sum()))
    for s in reversed(slices):
        with_bit = cand & s
        n = int(np.bitwise_count(with_bit).sum())
        if n >= wanted:
            cand = with_bit
        else:
            sure, cand, wanted = sure | with_bit, cand & ~s, wanted - n
        if not wanted:
            break
    rows = np.flatnonzero(np.unpackbits(cand.view(np.uint8), bitorder="little"))[:wanted]
    return np.concatenate([np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little")), rows])


def search_block(ids: np.ndarray, dim: int, bits: int, low: np.ndarray, slices: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query number, id, score) of the k best rows of one block for each query; rows with the query's id take no part."""
    width, n = slices.shape[-1] if dim and bits else -(-len(ids) // 64), len(ids)
    valid = np.zeros(width * 64, np.uint8)
    valid[:n] = 1
    valid = np.packbits(valid, bitorder="little").view(np.uint64)
    flat = slices.reshape(dim * bits, width)
    planes = np.concatenate([flat, ~flat, np.zeros((1, width), np.uint64)])
    q = np.zeros((len(queries), dim), np.int64)
    q[:, : min(dim, queries.shape[1])] = queries[:, :dim]
    out = []
    for first in range(0, len(q), TOGETHER):
        part = q[first : first + TOGETHER]
        size = np.abs(part).astype(np.uint64)
        heights = int(size.max(initial=0)).bit_length()
        # plane of component d and bit b: d * bits + b; complements, which turn negative factors positive, follow all of them
        start = (np.arange(dim) * bits)[None, :] + np.where(part < 0, dim * bits, 0)
        picks = []
        for c in range(heights + bits - 1 if heights and bits else 0):
            own = []
            for k_, (s, z) in enumerate(zip(start, size, strict=True)):
                own.append(np.concatenate([s[(z >> np.uint64(j)) & np.uint64(1) == 1] + (c - j) for j in range(max(0, c - bits + 1), min(heights, c + 1))]))
            picks.append(own)
        summed = _sums(planes, picks)
        for j, row in enumerate(part):
            qid = query_ids[first + j]
            own = valid
            a, b = np.searchsorted(ids, qid), np.searchsorted(ids, qid, side="right")
            if b > a:
                own = valid.copy()
                at = np.arange(a, b)
                np.bitwise_and.at(own, at >> 6, ~(np.uint64(1) << (at & 63).astype(np.uint64)))
            best = _best([s[j] for s in summed], own, k)
            if len(best):
                bit = (slices[:, :, best >> 6] >> (best & 63).astype(np.uint64)) & np.uint64(1) if dim and bits else np.zeros((dim, 0, len(best)), np.uint64)
                x = (bit << np.arange(bits, dtype=np.uint64)[None, :, None]).sum(1, dtype=np.uint64).astype(np.int64) + low[:, None]
                out += [(first + j, int(i), int(s)) for i, s in zip(ids[best], row @ x, strict=True)]
    return out


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k rows of highest integer inner product, ties to the smaller id.

    Vectors are quantised by floor(scale * x); those that are null or hold null or non-finite components take no part. Shorter
    vectors count as ending in zeros, scores are 64-bit. Rows with the query's own id are no candidates; equal query rows count
    once. Blocks of queries meet blocks of the index by key; every pair of blocks is one small task, and only its k best rows
    per query go on. Work is queries x rows, as exact search needs.
    """
    fine = rows.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("q")).filter("id is not null and q is not null")
    asked = rows.filter(is_query).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("q")).filter("id is not null and q is not null").distinct()
    n, wanted = fine.count(), asked.count()
    blocks = max(1, math.ceil(n / BLOCK))
    cores = fine.sparkSession.sparkContext.defaultParallelism
    groups = max(1, math.ceil(wanted / QUERIES), min(math.ceil(wanted / (4 * TOGETHER)), math.ceil(4 * cores / blocks)))
    index = build(fine, n).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = asked.groupBy(F.pmod(F.xxhash64("id", "q"), F.lit(groups)).cast("int").alias("group")).agg(F.array_sort(F.collect_list(F.struct("id", "q"))).alias("queries"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(batches):
        for batch in batches:
            for ids, dim, bits, low, slices, asked_ in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                lists = [x["q"] for x in asked_]
                ids = np.frombuffer(ids, np.int64)
                got = search_block(ids, dim, bits, np.frombuffer(low, np.int64), np.frombuffer(slices, np.uint64).reshape(dim, bits, -1) if dim and bits else np.zeros((dim, bits, 0), np.uint64), np.array([x["id"] for x in asked_]), _matrix(lists, max(map(len, lists))), k)
                at = [g[0] for g in got]
                yield pa.RecordBatch.from_arrays([pa.array([asked_[i]["id"] for i in at], pa.int64()), pa.array([lists[i] for i in at], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], ["query_id", "q", "vec_id", "score"])

    pairs = index.join(queries, ["block", "group"]).select("ids", "dim", "bits", "low", "slices", "queries")
    found = arrow_map(pairs, run, "query_id long, q array<long>, vec_id long, score long")
    best = W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
