"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.llm._rows import Words, narrow, rows
from talweg.llm._shared import arrow_map, trim

#: Buckets of hashed terms and latent factors of each.
BUCKETS, FACTORS = 1 << 18, 4
#: Rows in which a term is found at least to have a weight. Weights and factors of all such terms are learned first, in EPOCHS of
#: batches, with thresholds that keep those at zero which do not pay; what is left then is fitted without thresholds.
FEWEST, EPOCHS, HALF = 5, 40, 128
#: Terms of rows that a step of the gradient looks at together.
PART = 1 << 15
#: Thresholds on weights and on the length of a term's factors.
SPARSE, GROUP = 3e-3, 5e-3
#: Bytes of the word beginnings that are terms, too.
STEMS = (4, 5)
#: Labelled documents that training takes at most, for each label.
SAMPLE = 5000
#: A-Z to a-z, and ASCII that is neither letter nor digit to a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256))


#: Scores from here on are predicted toxic.
THRESHOLD = 0.3


def held_out(id_col: str) -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Machine:
    """score = sigmoid(bias + sum of weights + pairwise products of factors, over a text's distinct hashed terms)."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-odds of rows given as the distinct buckets index[first[i]:first[i + 1]] (compressed sparse rows)."""
        linear = _row_sums(self.weights[index].astype(np.float64), first)
        v = self.factors[index].astype(np.float64)
        total = _row_sums(v, first)
        return self.bias + linear + 0.5 * ((total**2).sum(1) - _row_sums((v**2).sum(1), first))

    def score(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, first), -30, 30)))


def _row_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    return sums[first[1:]] - sums[first[:-1]]


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text's terms (words, and the stems of STEMS bytes of longer ones), as compressed sparse rows."""
    words = Words([t.translate(_TERMS) for t in texts])
    parts = [(words.hash, words.text)]
    for n in STEMS:
        hashed, at = words.stems(n)
        parts.append((hashed, words.text[at]))
    keys = np.unique(np.concatenate([(text.astype(np.int64) << 18) | (hashed >> np.uint64(46)).astype(np.int64) for hashed, text in parts]))
    return (keys & (BUCKETS - 1)).astype(np.int32), np.searchsorted(keys >> 18, np.arange(len(texts) + 1))


class _Adam:
    """Adam's moments of one array; step gives the scale of each entry's step and the step."""

    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape), np.zeros(shape), 0

    def step(self, grad: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad**2 - self.v)
        scale = rate / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-6)
        return scale, scale * self.m / (1 - 0.9**self.t)


def _gradient(p: np.ndarray, bias: np.ndarray, col: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the weighted logistic loss of rows (compressed sparse) with respect to p (weight, factors) and bias, over some rows at a
    time, as this runs in the driver."""
    grad, sum_ = np.zeros_like(p), 0.0
    edges = np.unique(np.append(np.searchsorted(first, np.arange(0, first[-1] + 1, PART)), [0, len(label)]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        some, begin = col[first[a] : first[b]], first[a : b + 1] - first[a]
        x = p[some]
        total = _row_sums(x, begin)
        z = bias + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(1) - _row_sums((x[:, 1:] ** 2).sum(1), begin))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[a:b]) * weight[a:b]
        row = np.repeat(np.arange(b - a), np.diff(begin))
        x[:, 1:] = g[row, None] * (total[row, 1:] - x[:, 1:])
        x[:, 0] = g[row]
        for j in range(p.shape[1]):
            grad[:, j] += np.bincount(some, x[:, j], len(p))
        sum_ += g.sum()
    return grad, sum_


def _picked(col: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [col[first[r] : first[r + 1]] for r in rows]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _sparse(col: np.ndarray, first: np.ndarray, label: np.ndarray, d: int, rng, rate: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights, factors and bias by proximal Adam on batches with as many rows of either label."""
    p = np.concatenate([np.zeros((d, 1)), rng.normal(0, 0.05, (d, FACTORS))], axis=1)
    bias, adam, own = np.zeros(1), _Adam(p.shape), _Adam(1)
    by = [np.flatnonzero(label == x) for x in (1, 0)]
    steps = EPOCHS * max(10, min(len(label) // (2 * HALF), 25))
    for t in range(1, steps + 1):
        rows = np.concatenate([rng.choice(x, HALF, replace=len(x) < HALF) for x in by])
        grad, g = _gradient(p, bias, *_picked(col, first, rows), label[rows], np.full(len(rows), 1 / len(rows)))
        now = rate * min(1.0, 2 * (1 - t / steps))
        scale, change = adam.step(grad, now)
        p -= change
        p[:, 0] = np.sign(p[:, 0]) * np.maximum(np.abs(p[:, 0]) - scale[:, 0] * SPARSE, 0)
        size = np.sqrt((p[:, 1:] ** 2).sum(1))
        p[:, 1:] *= (np.maximum(size - np.sqrt((scale[:, 1:] ** 2).mean(1)) * GROUP, 0) / np.maximum(size, 1e-12))[:, None]
        bias -= own.step(np.array([g]), now)[1]
    return p, bias


def fit(index: np.ndarray, first: np.ndarray, label: np.ndarray, share: float, steps: int = 60, rate: float = 0.08, l2: float = 1e-3, seed: int = 7) -> Machine:
    """A machine that minimises the logistic loss with both labels weighing as much; share: of label 1 among all labelled rows, to
    which the bias is set back.

    Every term of FEWEST rows takes part, however little it leans by itself, so that terms which matter only together are found.
    Without rows of both labels the score is the share everywhere.
    """
    n, prior = len(label), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    empty = Machine(prior, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
    if not 0 < label.sum() < n:
        return empty

    def kept(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the terms that stay, row after row, and where rows begin; in parts, as this runs in the driver."""
        place = np.full(BUCKETS, -1, np.int32)
        place[some] = np.arange(len(some))
        parts, sizes = [], np.zeros(n, np.int64)
        for k in range(0, n, 256):
            part = place[index[first[k] : first[min(n, k + 256)]]]
            stay = part >= 0
            upto = np.concatenate([[0], np.cumsum(stay)])
            edge = first[k : k + 257] - first[k]
            sizes[k : k + 256] = np.diff(upto[edge])
            parts.append(part[stay])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    hits = sum(np.bincount(index[k : k + (1 << 18)], minlength=BUCKETS) for k in range(0, len(index), 1 << 18))
    often = np.flatnonzero(hits >= FEWEST)
    col, begin = kept(often)
    p, bias = _sparse(col, begin, label, len(often), np.random.default_rng(seed))
    some = np.abs(p).sum(1) > 0
    often, p = often[some], p[some]
    col, begin = kept(often)
    balance = np.where(label == 1, 0.5 / label.sum(), 0.5 / (n - label.sum()))
    adam, own = _Adam(p.shape), _Adam(1)
    for _ in range(steps):
        grad, g = _gradient(p, bias, col, begin, label, balance)
        p -= adam.step(grad + l2 * p / 10, rate)[1]
        bias -= own.step(np.array([g]), rate)[1]
    weights, factors = empty.weights.copy(), empty.factors.copy()
    weights[often], factors[often] = p[:, 0], p[:, 1:]
    return Machine(float(bias[0]) + prior, weights, factors)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Machine:
    """Fits a machine on at most `sample` labelled documents of each label, those with the smallest hashes of doc_id.

    labels: (doc_id, toxic 0 or 1); other values and nulls are no labels, and of repeated ones the largest counts. Only ids,
    labels and whole texts are read. The sample's hashed terms come to the driver; the bound is `sample`, not the corpus.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("known_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value in (0, 1):
        some = known.filter(F.col("toxic") == value).orderBy(F.xxhash64("known_id"), "known_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = narrow(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("known_id")).select(F.shiftleft("doc_id", 1).bitwiseOR(F.col("toxic")).alias("row"), "body")

    def run(batches):
        for toxic, bodies in rows(batches):
            index, first = terms(bodies)
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int64()), pa.ListArray.from_arrays(first.astype(np.int32), index)], ["row", "terms"])

    got = arrow_map(texts, run, "row long, terms array<int>").toArrow()
    # in the order of ids, as Spark returns them in any order
    row = np.asarray(got.column("row").to_numpy(), np.int64)
    order = np.argsort(row)
    lists = [x for c in got.column("terms").chunks for x in c]
    index = np.concatenate([np.zeros(0, np.int32), *(lists[i].values.to_numpy() for i in order)])
    first = np.concatenate([[0], np.cumsum([len(lists[i]) for i in order], dtype=np.int64)]).astype(np.int64)
    label = (row[order] & 1).astype(np.float64)
    del got, lists
    machine = fit(index, first, label, counts.get(1, 0) / max(1, sum(counts.values())))
    del index, first
    trim()
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every whole text, a row for each input row; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for ids, bodies in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shared.value.score(*terms(bodies)))], ["doc_id", "score"])

    return arrow_map(narrow(docs, id_col, text_col), run, "doc_id long, score double")


def without_toxic(docs: DataFrame, machine: Machine, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns as they were. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(place).cast(pa.binary()), b"")
            done = 0
            for ids, bodies in rows(iter([pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), texts], ["i", "body"])])):
                keep = shared.value.score(*terms(bodies)) < threshold
                yield batch.slice(done, len(ids)).filter(pa.array(keep))
                done += len(ids)

    return arrow_map(docs, run, docs.schema)
