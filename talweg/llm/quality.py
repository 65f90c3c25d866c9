"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talweg.llm._rows import Words, rows, text_bytes
from talweg.llm._shared import arrow_map, stored

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echo_words", "n_upper", "n_punct")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_PUNCT = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
_LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point

#: Buckets of a sketch grow by this factor: quantiles are exact to about one percent.
GAMMA = 1.02
#: Ratios that are judged: (name, count, per, how far above the upper quartile is always allowed).
RATIOS = (("symbols", "n_symbols", "n_words", 0.1), ("upper", "n_upper", "word_chars", 0.15), ("punct", "n_punct", "word_chars", 0.1), ("echo", "n_echo_words", "n_words", 0.1), ("dup_lines", "n_dup_lines", "n_lines", 0.3))
#: Multiples of the spread between median and upper quartile above which a ratio is an outlier.
SPREADS = 6.0
#: Documents that a language and source need for thresholds of their own; else the language's hold, else those of all.
LEAST = 100


def _counts(texts: list[bytes]) -> list[np.ndarray]:
    words, n = Words(texts), len(texts)
    at = words.offsets

    def within(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[at[1:]] - sums[at[:-1]]

    inside = np.zeros(len(words.data) + 1, np.int64)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    chars = within((np.cumsum(inside)[:-1] > 0) & _LEAD[words.data])
    # lines that hold a word: where they begin and end
    breaks = np.flatnonzero(words.data == 10)
    begin, end = np.concatenate((at[:-1], breaks + 1)), np.concatenate((at[1:], breaks))
    begin, end = np.sort(begin), np.sort(end)  # lines follow each other, so both orders agree
    full = np.searchsorted(words.starts, end) > np.searchsorted(words.starts, begin)
    begin, end = begin[full], end[full]
    owner = np.searchsorted(at, begin, side="right") - 1
    n_lines = np.bincount(owner, minlength=n)
    body = words.data.tobytes()
    seen = Counter((o, body[a:b]) for o, a, b in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True))
    n_dup = np.zeros(n, np.int64)
    for (o, _), times in seen.items():
        n_dup[o] += times - 1
    # words in windows of eight that come twice
    hashed, first = words.windows(8)
    pairs = np.lexsort((hashed, words.text[first]))
    same = (hashed[pairs][1:] == hashed[pairs][:-1]) & (words.text[first[pairs]][1:] == words.text[first[pairs]][:-1])
    twice = np.zeros(len(pairs), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(words.hash) + 1, np.int64)
    spots = first[pairs[twice]]
    np.add.at(cover, spots, 1)
    np.add.at(cover, spots + 8, -1)
    n_repeat = np.bincount(words.text[np.cumsum(cover)[:-1] > 0], minlength=n)
    echo = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])) + 1
    return [np.diff(words.first), chars, within(_SYMBOL[words.data]), n_dup, n_repeat, n_lines, np.bincount(words.text[echo], minlength=n), within(_UPPER[words.data]), within(_PUNCT[words.data])]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and counts over each whole text, a row for each input row; null texts count as empty.

    n_words, word_chars, n_symbols, n_dup_lines (lines with a word, equal to an earlier one), n_repeat_words (in 8-word windows
    found twice), n_lines (with a word), n_echo_words (equal to the word before), n_upper (A-Z), n_punct (ASCII).
    """

    def run(batches):
        for batch in batches:
            done = 0
            for ids, texts in rows(iter([batch.select([0, 3])])):
                part = batch.slice(done, len(ids))
                done += len(ids)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(x, pa.int64()) for x in _counts(texts))], ["doc_id", "lang", "source", *_COUNTS])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text_bytes(text_col).alias("body"))
    return arrow_map(slim, run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _ratio(count: str, per: str) -> Column:
    return F.col(count) / F.greatest(F.col(per), F.lit(1))


def sketch(counted: DataFrame) -> DataFrame:
    """Quantile sketches as rows (lang, source, metric, bucket, n) of the documents that pass the base rules.

    Buckets are powers of GAMMA (null: zero), so sketches of any parts merge by adding n, in any order, with the same result.
    """
    each = F.array(*(F.struct(F.lit(name).alias("metric"), _ratio(count, per).alias("x")) for name, count, per, _ in RATIOS))
    long = counted.filter(~base_failed()).select("lang", "source", F.inline(each))
    return long.groupBy("lang", "source", "metric", F.when(F.col("x") > 0, F.floor(F.ln("x") / F.lit(float(np.log(GAMMA))))).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketched: DataFrame) -> DataFrame:
    """(lang, source, one column max_<metric> each): the quartile and spread rule on the most specific sketch with LEAST documents."""
    levels = (("lang", "source"), ("lang",), ())

    def bounds(by: tuple[str, ...]) -> DataFrame:
        merged = sketched.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
        group = W.partitionBy(*by, "metric")
        upto = merged.withColumn("upto", F.sum("n").over(group.orderBy(F.asc_nulls_first("bucket")))).withColumn("total", F.sum("n").over(group))
        value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") + 0.5))
        at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
        slack = F.lit(0.0)
        for name, _, _, least in RATIOS:
            slack = F.when(F.col("metric") == name, least).otherwise(slack)
        fence = upto.groupBy(*by, "metric").agg(at(0.5).alias("q50"), at(0.75).alias("q75"), F.max("total").alias("total"))
        fence = fence.withColumn("fence", F.col("q75") + SPREADS * (F.col("q75") - F.col("q50")) + slack)
        per = [F.max(F.when(F.col("metric") == name, F.col("fence"))).alias(f"f{len(by)}_{name}") for name, *_ in RATIOS]
        return fence.groupBy(*by).agg(F.max("total").alias(f"n{len(by)}"), *per)

    own, tongue, every = map(bounds, levels)
    tongue = tongue.withColumnRenamed("lang", "lang1")
    joined = own.join(tongue, F.col("lang").eqNullSafe(F.col("lang1")), "left").join(F.broadcast(every))  # one row
    return joined.select("lang", "source", *(F.when(F.col("n2") >= LEAST, F.col(f"f2_{m}")).when(F.col("n1") >= LEAST, F.col(f"f1_{m}")).otherwise(F.col(f"f0_{m}")).alias(f"max_{m}") for m, *_ in RATIOS))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """features(), base_failed and kept: the base rules hold and no ratio lies beyond its language's and source's fence.

    Texts are read once; the counts are written to the shared folder, sketched, and joined with the fences (a row for each
    language and source). Null languages and sources are groups of their own. An empty table gives an empty one.
    """
    counted = stored(features(docs, id_col, text_col, lang_col, source_col), "quality")
    limits = fences(sketch(counted)).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    out = counted.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    within = F.lit(True)
    for name, count, per, _ in RATIOS:
        within &= F.coalesce(_ratio(count, per) <= F.col(f"max_{name}"), F.lit(True))
    return out.select("doc_id", "lang", "source", *_COUNTS, base_failed().alias("base_failed"), (~base_failed() & within).alias("kept"))
