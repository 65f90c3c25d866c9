"""Bounded Arrow row groups and byte-level word hashing shared by the Python operators of this subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at most, unless a single text is longer.
GROUP_BYTES = 1 << 18


def text_bytes(col: str) -> Column:
    """A text column as UTF-8 bytes; null reads as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, whatever other columns there are."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))


def decoded(body: bytes) -> str:
    """Invalid UTF-8 reads as U+FFFD, as Spark's own string functions show it."""
    return body.decode("utf-8", "replace")


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of groups of consecutive rows that hold about GROUP_BYTES of text."""
    for batch in batches:
        ids, bodies = batch.column(0).to_pylist(), batch.column(1)
        first = size = 0
        for i in range(batch.num_rows):
            size += len(bodies[i].as_buffer())
            if size >= GROUP_BYTES:
                yield ids[first : i + 1], bodies.slice(first, i + 1 - first).to_pylist()
                first, size = i + 1, 0
        if first < batch.num_rows:
            yield ids[first:], bodies.slice(first).to_pylist()


#: Bytes from which a word is hashed by itself.
LONG_WORD = 64

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POS = _RNG.integers(1, 2**64 - 1, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 2 * GROUP_BYTES)
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS = tuple(out)
    return _POWERS


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of some texts: hash, start, end (bytes in .data) and text number of each."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        word = ~_SPACE[self.data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        full = self.lengths > 0
        before[self.offsets[:-1][full]] = False
        after[self.offsets[1:][full] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[:n], out=sums[1:])
        self._sums, self._inverse = sums, inverse
        self.hash = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))
        # long words can be made to collide under a polynomial modulo 2^64, whatever its base
        for i in np.flatnonzero(self.ends - self.starts > LONG_WORD):
            self.hash[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest(), "little")
        #: words of text i: first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def stems(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first n bytes of the words longer than that, and the words' numbers."""
        at = np.flatnonzero(self.ends - self.starts > n)
        first = self.starts[at]
        return mix((self._sums[first + n] - self._sums[first]) * self._inverse[first] + np.uint64(n << 32)), at

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and the number of each run's first word; no run crosses texts."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += self.hash[j : j + n] * _POS[j]
        return mix(out[at]), at
