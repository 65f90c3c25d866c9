
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.sources import files
from talweg.sources.workers import ship

#: Bytes of a gram and grams of a window. A part of GRAM + WINDOW - 1 bytes has a whole window, whose gram of the least hash every text around it
#: has, too; shorter parts have a gram of SHORT bytes, and still shorter ones are a gram themselves.
GRAM, WINDOW, SHORT = 8, 8, 3
#: Keys that a task hands on at once.
_KEYS = 1 << 18


def _grams(text: np.ndarray, n: int) -> np.ndarray:
    """All runs of n bytes, as numbers."""
    out = np.zeros(max(0, len(text) - n + 1), np.uint64)
    for k in range(n if len(out) else 0):
        out |= text[k : k + len(out)].astype(np.uint64) << np.uint64(8 * k)
    return out


def _leasts(text: np.ndarray) -> np.ndarray:
    """The least hash of the grams of each window."""
    out = _grams(text, GRAM)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    for step in (1, 2, 4):  # windows of 2, 4 and 8
        out = np.minimum(out[:-step], out[step:])
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


def _small(text: np.ndarray) -> np.ndarray:
    return np.concatenate((_grams(text, 1), _grams(text, 2) + np.uint64(1 << 16)))


def _of_text(text: np.ndarray, levels: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    for level in levels:
        yield level, _leasts(text) if level == 0 else _grams(text, SHORT) if level == 1 else _small(text)


def _of_part(text: np.ndarray, levels: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    if len(text) >= GRAM + WINDOW - 1:
        yield 0, _leasts(text)
    elif len(text) >= SHORT:
        yield 1, _grams(text, SHORT)
    else:
        yield 2, _small(text)[-1:]


def _keys(of: Callable, levels: tuple[int, ...] = ()) -> Callable:
    """(id, level, key) of rows (id, text as bytes): the distinct keys that `of` takes of each text."""

    def table(ids: pa.Array, rows: list, found: list, names: list[str]) -> pa.RecordBatch:
        at = np.repeat(np.array([r for r, _ in rows], np.int64), [len(k) for k in found])
        level = np.repeat(np.array([n for _, n in rows], np.int32), [len(k) for k in found])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(level), pa.array(np.concatenate(found).view(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = batch.column(0), [batch.schema.names[0], "level", "key"]
            rows, found, n = [], [], 0
            for i, text in enumerate(batch.column(1)):
                for level, keys in of(np.frombuffer(text.as_buffer(), np.uint8), levels):
                    if len(keys):
                        rows.append((i, level))
                        found.append(np.unique(keys))
                        n += len(found[-1])
                if n >= _KEYS:
                    yield table(ids, rows, found, names)
                    rows, found, n = [], [], 0
            if n:
                yield table(ids, rows, found, names)

    return run


def _keyed(rows: DataFrame, name: str, text: str, run: Callable) -> DataFrame:
    kind = T.StructType([T.StructField(name, rows.schema[name].dataType), T.StructField("level", T.IntegerType()), T.StructField("key", T.LongType())])
    return rows.filter(F.col(text) != "").select(name, F.col(text).cast("binary")).mapInArrow(run, kind)


def containing(wholes: DataFrame, parts: DataFrame, verify: Column | None = None) -> DataFrame:
    """(whole_id, part_id) where a text (whole_id, whole) contains another (part_id, part); empty parts, which lie in every text, and nulls give no pairs.

    Texts are taken as bytes of UTF-8, in which a text lies just where its characters lie. Long parts and texts meet on hashes of grams that both pick
    alike, about a fifth of all; parts of under GRAM + WINDOW - 1 bytes on any gram. Of
    its grams a part takes that with the fewest texts. Texts shuffle only what some part has, and are compared last. verify: a condition on
    whole and part besides.
    """
    ship(wholes.sparkSession)
    wanted = files.kept(_keyed(parts, "part_id", "part", _keys(_of_part)), "grams")
    levels = tuple(sorted(r["level"] for r in wanted.select("level").distinct().collect()))  # three at most
    keys = wanted.select("level", "key").distinct()
    if not levels:
        return wholes.select("whole_id").crossJoin(parts.select("part_id")).limit(0)
    emitted = _keyed(wholes, "whole_id", "whole", _keys(_of_text, levels))
    hits = files.kept(emitted.join(keys, ["level", "key"]), "gram-hits")
    often = hits.groupBy("level", "key").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, ["level", "key"], "left").groupBy("part_id", "level").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    pairs = hits.join(rarest, ["level", "key"]).select("whole_id", "part_id").distinct()
    found = pairs.join(parts.select("part_id", "part"), "part_id").join(wholes.select("whole_id", "whole"), "whole_id")
    hit = F.contains("whole", F.col("part"))
    return found.filter(hit if verify is None else hit & verify).select("whole_id", "part_id")
