"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.llm._rows import decoded, narrow, rows, text_bytes
from talweg.llm._shared import arrow_map

#: A text is cut into pieces of about so many characters, so that no call holds all of a very long one.
PIECE = 1 << 16
#: Between a character that is no white space and white space a match of the pattern always ends and the next begins:
#: white space is only ever a match's first character or all of it, and no look-ahead sees past such a place.
_SAFE = re.compile(r"\S(?=\s)")
_ENCODERS: dict = {}


def load_ranks(path: str) -> bytes:
    """The rank file as it is: a line per token, base64 and rank."""
    with open(path, "rb") as f:
        return f.read()


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts a text at the first safe boundary after every `size` characters; joined, the pieces are the text."""
    first = 0
    while len(text) - first > size:
        cut = _SAFE.search(text, first + size)
        if not cut:
            break
        yield text[first : cut.end()]
        first = cut.end()
    yield text[first:]


def encoder(ranks: bytes, pattern: str):
    """One tiktoken encoding for each rank file and pattern in a worker."""
    import tiktoken

    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODERS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def encode_text(enc, text: str) -> list[int]:
    return [i for part in pieces(text) for i in enc.encode_ordinary(part)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: every whole text as token ids, one row for each input row.

    Null and empty texts have no ids; special tokens are ordinary text. The rank file is read once on the driver
    (about a megabyte, it does not grow with the data) and sent along.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        enc = encoder(ranks.value, pattern)
        for ids, texts in rows(batches):
            coded = [np.asarray(encode_text(enc, decoded(t)), np.int32) for t in texts]
            ends = np.cumsum([0, *map(len, coded)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(coded))], ["doc_id", "ids"])

    return arrow_map(narrow(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, body binary: the raw bytes that the ids stand for; null ids read as none."""
    ranks = coded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        enc = encoder(ranks.value, pattern)
        for batch in batches:
            bodies = [enc.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(bodies, pa.binary())], ["doc_id", "body"])

    return arrow_map(coded.select(id_col, ids_col), run, "doc_id long, body binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, place: Column | None = None) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256
    (of the decoded bytes) and, if asked for, ids array<int>. Rows are independent, so nothing is shuffled and a lost executor
    costs its tasks only. Null and empty texts have no tokens. place: a long of each row that comes out as `position`."""
    placed = place is not None  # a Column cannot be sent along
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        enc = encoder(ranks.value, pattern)
        for keys, texts in rows(batches):
            if placed:
                keys, places = ([k[c] for k in keys] for c in ("doc_id", "position"))
            coded = [encode_text(enc, decoded(t)) for t in texts]
            columns = {
                "doc_id": pa.array(keys, pa.int64()),
                "n_tokens": pa.array(map(len, coded), pa.int64()),
                "ids_sha256": pa.array(hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in coded),
                "decoded_sha256": pa.array(hashlib.sha256(enc.decode_bytes(x)).hexdigest() for x in coded),
            }
            if placed:
                columns["position"] = pa.array(places, pa.int64())
            if with_ids:
                columns["ids"] = pa.array(coded, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    named = narrow(docs, id_col, text_col) if not placed else docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), place.alias("position")).alias("key"), text_bytes(text_col).alias("body"))
    return arrow_map(named, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", position long" * placed + ", ids array<int>" * with_ids)
