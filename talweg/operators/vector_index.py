
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talweg.functions import numeric
from talweg.operators import nearest, ranking
from talweg.sources.versioned import Versioned
from talweg.sources.workers import ship

#: Vectors that the quantiser is fitted on at most, rounds of fitting, longs of a sketch, lists at most, and queries that set how many lists are looked into.
SAMPLE, ROUNDS, LONGS, LISTS, TRIALS = 16384, 6, 8, 1024, 256
#: Share of the ten nearest of these queries that lists must hold, and whose sketches must be among those read in full; vectors read in full at least for each result.
HELD, READ = 0.99, 30
#: Rows of a block of sketches, and components of one of vectors.
CODES, COMPONENTS = 1 << 18, 1 << 22


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of arrays, and where each begins and the last ends."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))


def _differing(left: pa.Table, right: pa.Table, other: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query of a block the rows of its lists, and in how many signs their sketches differ. other: without its own id."""
    of = right.column("list").to_numpy()
    codes = [right.column(f"s{i}").to_numpy().view(np.uint64) for i in range(LONGS)]
    asked = _flat(left.column("sketch"))[0].reshape(-1, LONGS).view(np.uint64)
    lists, ends = _flat(left.column("lists"))
    own = pc.fill_null(pc.index_in(left.column("query_id").combine_chunks(), right.column("doc_id").combine_chunks()), -1).to_numpy(zero_copy_only=False)
    most = int(max(lists.max(initial=0), of.max(initial=0))) + 1
    for i, signs in enumerate(asked):
        looked = np.zeros(most, bool)
        looked[lists[ends[i] : ends[i + 1]]] = True
        rows = np.flatnonzero(looked[of])
        if other and own[i] >= 0:
            rows = rows[rows != own[i]]
        far = np.zeros(len(rows), np.int16)
        for code, sign in zip(codes, signs, strict=True):
            far += np.bitwise_count(code[rows] ^ sign)
        yield rows, far


def _counts(read: int, other: bool) -> Callable:
    """(query_id, far, n): how many rows of a block differ in how many signs, up to the `read` least."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, fars, ns = [], [], []
        for i, (_, far) in enumerate(_differing(left, right, other)):
            n = np.bincount(far)
            some = np.flatnonzero(n[: 1 + int(np.searchsorted(np.cumsum(n), read))])
            q.append(np.full(len(some), i))
            fars.append(some)
            ns.append(n[some])
        q, fars, ns = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (q, fars, ns))
        return pa.table({"query_id": left.column("query_id").take(pa.array(q)), "far": pa.array(fars, pa.int32()), "n": pa.array(ns, pa.int64())})

    return run


def _closest(k: int, digits: int | None, other: bool) -> Callable:
    """(query_id, doc_id, score) of what can be among the k best of a query, of the rows of a block whose sketches differ in `most` signs at most."""
    margin = nearest.MARGIN + (10.0**-digits if digits is not None else 0.0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        one, two = nearest.Side(left, "q"), nearest.Side(right, "v")
        place, most = nearest.places(right.column("doc_id").combine_chunks()), left.column("most").to_numpy()
        blocks = {}
        for size in np.unique(one.sizes[one.sizes > 0]):
            alike = np.flatnonzero(two.sizes == size)
            spot = np.full(len(right), -1)
            spot[alike] = np.arange(len(alike))
            v = two.matrix(alike, size)
            blocks[size] = alike, spot, v, nearest.norms(v)
        q, to, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, (rows, far) in enumerate(_differing(left, right, other)):
            if one.sizes[i] not in blocks:
                continue
            alike, spot, v, vn = blocks[one.sizes[i]]
            rows = spot[rows[far <= most[i]]]
            x = one.matrix(np.array([i]), one.sizes[i])
            under = nearest.norms(x)[0] * vn
            rows = rows[(rows >= 0) & (under[rows] != 0)]
            with np.errstate(all="ignore"):
                near = v[rows] @ x[0] / under[rows]
                if k < len(rows):
                    rows = rows[(near >= np.partition(near, len(rows) - k)[len(rows) - k] - margin) | np.isnan(near)]
                dot = np.zeros(len(rows))
                for j, y in enumerate(x[0]):
                    dot += y * v[rows, j]
                score = dot / under[rows]
            there = nearest.first(np.zeros(len(rows), np.int64), place[alike[rows]], score, k, digits)
            q.append(np.full(len(there), i))
            to.append(alike[rows[there]])
            scores.append(score[there])
        return pa.table({"query_id": left.column("query_id").take(pa.array(np.concatenate(q))), "doc_id": right.column("doc_id").take(pa.array(np.concatenate(to))), "score": pa.array(np.concatenate(scores), pa.float64())})

    return run


class VectorIndex(Versioned):
    """Segments hold `docs` (key, filter columns), `codes` (key, filter columns, list, sketch: LONGS longs), sorted by filters and list, and
    `vectors` (key, v), sorted by key. The quantiser, centroids and the hyperplanes of the sketch's signs, is fitted at the first write and stays."""

    def __init__(self, spark: SparkSession, folder: str, filters: tuple[str, ...] = (), key: str = "doc_id", seed: int = 11):
        super().__init__(spark, folder, key)
        self.filters, self.seed = tuple(filters), seed

    # ---- fitting

    def _fit(self, rows: DataFrame) -> dict[str, int]:
        """Spherical k-means on a bounded sample, the rows of the smallest hashes; the lists that hold HELD of the true neighbours of some of them."""
        got = rows.select(self.key, "v").filter("v is not null and size(v) > 0").orderBy(F.xxhash64(F.lit(self.seed), F.col(self.key)), self.key).limit(SAMPLE).collect()
        dim = max((len(r["v"]) for r in got), default=1)
        x = _unit(np.array([[*r["v"], *[0.0] * (dim - len(r["v"]))] for r in got], float).reshape(-1, dim))
        rng = np.random.default_rng(self.seed)
        k = max(1, min(LISTS, len(x) // 8, math.isqrt(max(1, rows.count()))))
        centres = x[rng.choice(len(x), k, replace=False)].copy() if len(x) else np.zeros((1, dim))
        for _ in range(ROUNDS if len(x) else 0):
            own = (x @ centres.T).argmax(1)
            for c in range(k):
                members = x[own == c]
                if len(members):
                    centres[c] = members.mean(0)
            centres = _unit(centres)
        planes = rng.normal(size=(64 * LONGS, dim))
        probes, share = 1, 0
        if len(x) > 10:
            own = (x @ centres.T).argmax(1)
            some = np.arange(min(TRIALS, len(x)))
            near = x[some] @ x.T
            near[some, some] = -2
            best = np.argpartition(-near, 10, axis=1)[:, :10]
            place = np.argsort(np.argsort(-(x[some] @ centres.T), axis=1), axis=1)  # rank of each list for each query
            probes = 1 + int(np.quantile(np.take_along_axis(place, own[best], 1), HELD, method="higher"))
            bits = np.packbits(x @ planes.T > 0, axis=1, bitorder="little").view(np.uint64)
            far = np.stack([np.bitwise_count(b ^ bits).sum(1, dtype=np.int64) for b in bits[some]])
            place = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1)
            share = math.ceil(1e6 * float(np.quantile(np.take_along_axis(place, best, 1), HELD, method="higher")) / len(x))
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, c array<double>").write.mode("errorifexists").parquet(f"{self.folder}/centres")
        self.spark.createDataFrame([(planes.tolist(),)], "planes array<array<double>>").write.mode("errorifexists").parquet(f"{self.folder}/planes")
        return {"probes": probes, "read_ppm": share}

    def _coder(self):
        """numpy centroids and planes, small and of fixed size."""
        centres = np.array([r["c"] for r in self.spark.read.parquet(f"{self.folder}/centres").orderBy("list").collect()])
        planes = np.array(self.spark.read.parquet(f"{self.folder}/planes").first()["planes"])
        return centres, planes

    def coded(self, rows: DataFrame, kept: list[str], probes: int = 1) -> DataFrame:
        """kept columns, lists (the `probes` nearest ones) and sketch of rows with a vector v."""
        centres, planes = self._coder()
        ship(self.spark)

        def run(batches):
            for pdf in batches:
                dim = centres.shape[1]
                x = np.zeros((len(pdf), dim))
                for row, v in zip(x, pdf["v"], strict=True):
                    row[: len(v)] = v[:dim]
                near = np.argsort(-(_unit(x) @ centres.T), axis=1, kind="stable")[:, :probes]
                bits = np.packbits(x @ planes.T > 0, axis=1, bitorder="little").view(np.int64)
                out = pdf[kept].copy()
                out["lists"], out["sketch"] = list(near.astype(np.int32)), list(bits)
                yield out

        kinds = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in kept)
        return rows.filter("v is not null and size(v) > 0").select(*kept, "v").mapInPandas(run, f"{kinds}, lists array<int>, sketch array<long>")

    # ---- writing

    def write(self, rows: DataFrame, gone: DataFrame | None = None, source: str | None = None) -> None:
        """K6: one more segment of rows (key, v, filter columns); rows of known keys take their place. gone: keys to be left out."""
        now = self.manifest()
        facts = dict(now["facts"]) if now["segments"] else self._fit(rows)
        name, folder = self.new_segment()
        rows = rows.dropDuplicates([self.key])
        docs = rows.select(self.key, *self.filters, F.lit(False).alias("gone"))
        if gone is not None:
            docs = docs.unionByName(gone.select(self.key).distinct().withColumn("gone", F.lit(True)), allowMissingColumns=True)
        docs.write.parquet(f"{folder}/docs")
        facts["n"] = self.live([*now["segments"], name]).count()
        vectors = rows.select(self.key, F.transform("v", lambda x: x.cast("double")).alias("v"))
        vectors.repartitionByRange(self.key).sortWithinPartitions(self.key).write.parquet(f"{folder}/vectors")
        order = [*self.filters, "list", self.key]
        codes = self.coded(rows, [self.key, *self.filters]).select(self.key, *self.filters, F.col("lists")[0].alias("list"), *(F.col("sketch")[i].alias(f"s{i}") for i in range(LONGS)))
        codes.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{folder}/codes")
        self.commit(now, [*now["segments"], name], facts, source)

    def merge(self) -> None:
        """All living rows in one segment."""
        now = self.manifest()
        if len(now["segments"]) < 2:
            return
        name, folder = self.new_segment()
        order = [*self.filters, "list", self.key]
        self.live(now["segments"]).write.parquet(f"{folder}/docs")
        self.living("vectors", now["segments"]).repartitionByRange(self.key).sortWithinPartitions(self.key).write.parquet(f"{folder}/vectors")
        self.living("codes", now["segments"]).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{folder}/codes")
        self.commit(now, [name], now["facts"], now["source"])

    # ---- reading

    def search(self, queries: DataFrame, k: int, on: dict[str, str] | None = None, probes: int | None = None, read: int | None = None, where: Column | None = None, digits: int | None = None, other: bool = False) -> DataFrame:
        """(query_id, doc_id, score, rank): the k nearest by cosine of queries (query_id, q, ...).

        The lists nearest to a query (as many as fitted, or `probes`) are looked into, of rows that filter columns let through (on: filter
        column to a column of the queries); of these, `read` rows (by default a share of all that was fitted, READ * k at least) of the least differing
        sketches are compared in full, with all that differ as much as the last of them. Where all lists are looked into, all rows are compared in full. Blocks of queries
        meet blocks of rows, and each passes on its best. other: a query's own id is left out. where: any other condition on query_id and doc_id, tried
        pair by pair. A vector of zeros has no neighbours.
        """
        now = self.manifest()
        on = on or {}
        read = read or max(READ * k, math.ceil(now["facts"]["read_ppm"] * now["facts"]["n"] / 1e6))
        probes = probes or now["facts"]["probes"]
        vectors = self.living("vectors", now["segments"]).withColumnRenamed(self.key, "doc_id")
        own = queries.select("query_id", *dict.fromkeys(on.values()), F.transform("q", lambda x: x.cast("double")).alias("q"))
        if where is not None:
            scored = self._pair_by_pair(now, queries, vectors, own, on, probes, read, where & (F.col("query_id") != F.col("doc_id")) if other else where)
        elif probes >= self.spark.read.parquet(f"{self.folder}/centres").count():
            if on:
                vectors = vectors.join(self.live(now["segments"]).select(F.col(self.key).alias("doc_id"), *on), "doc_id")
            scored = nearest.candidates(own, vectors, k, on, digits=digits, other=other, zero=False)
        else:
            scored = self._by_blocks(now, queries, vectors, own, k, on, probes, read, digits, other)
        return ranking.top_k(scored.withColumn("score", F.round("score", digits)) if digits is not None else scored, k)

    def _by_blocks(self, now: dict, queries: DataFrame, vectors: DataFrame, own: DataFrame, k: int, on: dict[str, str], probes: int, read: int, digits: int | None, other: bool) -> DataFrame:
        """Sketches are counted by how much they differ first, which tells how much the `read` least of a query differ at most; then these are read."""
        ship(self.spark)
        names = {c: f"k{i}_" for i, c in enumerate(on)}
        dim = len(self.spark.read.parquet(f"{self.folder}/centres").first()["c"])
        asked = self.coded(queries.withColumnRenamed("q", "v"), ["query_id", *dict.fromkeys(on.values())], probes)
        asked = asked.select("query_id", "lists", "sketch", *(F.col(on[c]).alias(n) for c, n in names.items()))
        codes = self.living("codes", now["segments"]).select(F.col(self.key).alias("doc_id"), "list", *(f"s{i}" for i in range(LONGS)), *(F.col(c).alias(n) for c, n in names.items()))
        for name in names.values():
            asked, codes = asked.filter(F.col(name).isNotNull()), codes.filter(F.col(name).isNotNull())
        kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["doc_id"]
        nq = max(1, -(-queries.count() // nearest.QUERIES))
        by = [*names.values(), "qb_", "vb_"]

        def meet(one: DataFrame, two: DataFrame, rows: int, run: Callable, kind: str) -> DataFrame:
            nv = max(1, -(-now["facts"]["n"] // rows))
            block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
            each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
            one = one.withColumn("qb_", block("query_id", nq)).withColumn("vb_", each(nv))
            two = two.withColumn("vb_", block("doc_id", nv)).withColumn("qb_", each(nq))
            return one.groupBy(*by).cogroup(two.groupBy(*by)).applyInArrow(run, kind)

        counts = meet(asked, codes, CODES, _counts(read, other), f"query_id {kinds[0]}, far int, n long").groupBy("query_id", "far").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("query_id").orderBy("far")))
        most = upto.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("upto") >= read, F.col("far"))), F.lit(64 * LONGS)).alias("most"))
        one = asked.join(most, "query_id").join(own.select("query_id", "q"), "query_id")
        return meet(one, codes.join(vectors, "doc_id"), max(1024, COMPONENTS // dim), _closest(k, digits, other), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")

    def _pair_by_pair(self, now: dict, queries: DataFrame, vectors: DataFrame, own: DataFrame, on: dict[str, str], probes: int, read: int, where: Column) -> DataFrame:
        kept = ["query_id", *dict.fromkeys(on.values())]
        asked = self.coded(queries.withColumnRenamed("q", "v"), kept, probes)
        tries = asked.select(*kept, *(F.col("sketch")[i].alias(f"q{i}") for i in range(LONGS)), F.explode("lists").alias("list"))
        codes = self.living("codes", now["segments"]).withColumnRenamed(self.key, "doc_id")
        match = codes["list"] == tries["list"]
        for mine, theirs in on.items():
            match = match & (codes[mine] == tries[theirs])
        far = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(LONGS)), F.lit(0))
        close = codes.join(tries, match).filter(where).select("query_id", "doc_id", far.alias("far"))
        some = close.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("far", "doc_id"))).filter(F.col("n") <= read).select("query_id", "doc_id")
        score = F.try_divide(numeric.dot(F.col("q"), F.col("v")), F.sqrt(numeric.dot(F.col("q"), F.col("q"))) * F.sqrt(numeric.dot(F.col("v"), F.col("v"))))
        return some.join(vectors, "doc_id").join(own.select("query_id", "q"), "query_id").select("query_id", "doc_id", score.alias("score")).filter("score is not null")
