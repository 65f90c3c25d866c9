"""Substring dedup on sliding spans of sentences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm._rows import Words, mix, narrow, rows
from talweg.llm._rows import _powers as powers
from talweg.llm._shared import apart, arrow_map, stored

#: Sentences and words that a span has at least; it is the shortest run from its first sentence with both.
RUN, LEAST = 3, 25
#: Sentences end after words whose hash is a multiple of CUT, too, wherever these stand, and at last after MOST words (one word again
#: and again). Of a copied passage, only what stands before its first cut and after its last one depends on the surroundings.
CUT, MOST = 6, 40
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and end word of each sentence of some texts. A sentence ends at a word that ends in . ! or ?, before a line
    break, and at its text's end, and at places that depend on the word there alone, so that copies of a
    passage are cut alike in any surroundings."""
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.concatenate(([0], np.cumsum(words.data == 10)))
    last = np.ones(n, bool)
    last[:-1] = _STOP[words.data[words.ends[:-1] - 1]] | (breaks[words.starts[1:]] > breaks[words.ends[:-1]]) | (words.text[1:] != words.text[:-1])
    end = np.flatnonzero(last | (words.hash % np.uint64(CUT) == 0)) + 1
    if (size := np.diff(np.concatenate(([0], end)))).max() > MOST:
        parts = -(-size // MOST)
        rest = np.repeat(np.cumsum(parts), parts) - np.arange(parts.sum()) - 1  # cuts that follow in the same sentence
        begin = np.repeat(np.concatenate(([0], end[:-1])), parts)
        end = np.where(rest == 0, np.repeat(end, parts), begin + MOST * (np.repeat(parts, parts) - rest))
    return np.concatenate(([0], end[:-1])), end


def spans(words: Words, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and last sentence of the span from every sentence that has one in its text."""
    if len(first) < RUN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    to = np.maximum(np.arange(len(first)) + RUN - 1, np.searchsorted(end, first + LEAST))
    at = np.flatnonzero(to < len(first))
    at = at[words.text[first[at]] == words.text[first[to[at]]]]
    a, b = first[at], end[to[at]]
    power, inverse = powers(len(words.hash) + 1)
    sums = np.zeros(len(words.hash) + 1, np.uint64)
    np.cumsum(words.hash * power[: len(words.hash)], out=sums[1:])
    return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)), at, to[at]


def _read(texts: list[bytes]):
    words = Words([t.translate(_LOWER) for t in texts])
    first, end = sentences(words)
    hashed, at, to = spans(words, first, end)
    return words, first, hashed, at, to, words.text[first[at]] if len(at) else np.zeros(0, np.int64)


def _again(hashed: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Spans that come earlier in the same text."""
    order = np.lexsort((np.arange(len(hashed)), hashed, owner))
    out = np.zeros(len(hashed), bool)
    out[order[1:]] = (hashed[order][1:] == hashed[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return out


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hashes array<long>: the spans of each document that a document with a smaller id has, too.

    Every document gives each of its spans once, as two longs. Counting combines before the shuffle; a span in a third of
    all documents meets the others in the join, whose hot partitions Spark splits.
    """

    def run(batches):
        for ids, texts in rows(batches):
            _, _, hashed, _, _, owner = _read(texts)
            pairs = np.unique(np.stack([owner.astype(np.uint64), hashed]), axis=1) if len(hashed) else np.zeros((2, 0), np.uint64)
            keys = np.array(ids, np.int64)[pairs[0].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1].astype(np.int64)), pa.array(keys)], ["hash", "doc_id"])

    found = stored(arrow_map(narrow(docs, id_col, text_col).filter("doc_id is not null"), run, "hash long, doc_id long"), "spans")
    first = found.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1").select("hash", "first_id")
    return found.join(apart(first), "hash").filter("doc_id > first_id").groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_removed, removed array<struct<start, end>> (code points), text: a row for each input row.

    A span's first occurrence is the first one in the document with the smallest id. Sentences covered by any other occurrence go,
    with the white space after them; the rest of the text stays as it is. Letters A-Z count as a-z and white space as one
    space. Texts of fewer than RUN sentences and null texts (which read as empty) lose nothing, documents without an id only
    what they repeat themselves; rows with the same id are one document.
    """

    def run(batches):
        for batch in batches:
            done = 0
            for ids, texts in rows(iter([batch.select([0, 1])])):
                known = batch.column(2).slice(done, len(ids)).to_pylist()
                done += len(ids)
                words, first, hashed, at, to, owner = _read(texts)
                drop = _again(hashed, owner)
                for i, lists in enumerate(known):
                    if lists:
                        a, b = np.searchsorted(owner, [i, i + 1])
                        drop[a:b] |= np.isin(hashed[a:b], np.array(lists, np.int64).astype(np.uint64))
                cover = np.zeros(len(first) + 1, np.int64)
                np.add.at(cover, at[drop], 1)
                np.add.at(cover, to[drop] + 1, -1)
                gone = np.cumsum(cover)[:-1] > 0
                home = words.text[first] if len(first) else np.zeros(0, np.int64)
                places = np.searchsorted(home, np.arange(len(ids) + 1))
                out, cuts = [], []
                for i, t in enumerate(texts):
                    a, b = places[i], places[i + 1]
                    if not gone[a:b].any():
                        out.append(t)
                        cuts.append([])
                        continue
                    begin = np.append(words.starts[first[a:b]] - words.offsets[i], len(t))
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone[a:b].astype(np.int8), [0]))))
                    kept, cut, at_ = [], [], 0
                    for s, e in zip(begin[edge[::2]], begin[edge[1::2]], strict=True):
                        kept.append(t[at_:s])
                        start = len(t[:s].decode("utf-8", "replace"))
                        cut.append({"start": start, "end": start + len(t[s:e].decode("utf-8", "replace"))})
                        at_ = e
                    kept.append(t[at_:])
                    out.append(b"".join(kept))
                    cuts.append(cut)
                removed = np.bincount(home[gone], minlength=len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(places)), pa.array(removed), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())], ["doc_id", "n_sentences", "n_removed", "removed", "text"])

    whole = narrow(docs, id_col, text_col).join(repeated(docs, id_col, text_col), "doc_id", "left").select("doc_id", "body", "hashes")
    return arrow_map(whole, run, "doc_id long, n_sentences long, n_removed long, removed array<struct<start: long, end: long>>, text string")
