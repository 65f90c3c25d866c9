"""Secret scan: fixed patterns, and credential values whose cheapest guessing segmentation is still costly."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm._rows import decoded, narrow, rows
from talweg.llm._shared import arrow_map, stored

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A wider credential context than `assign`: more names, and a value of any characters but white space, quotes and brackets.
_CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|auth|(?:api|access|private|secret)[_-]?key)["']?\x20*(?::|=>?)\x20*["']?([^\s"'`<>(){},;]{6,})""", re.I | re.A)
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d")

# Words that guessers try first, in natural order of trying.
COMMON_WORDS = """password admin welcome login secret master letmein dragon monkey shadow sunshine princess
football baseball superman batman hello freedom whatever trust hunter killer summer winter spring autumn
love money test user root guest default change server system computer internet access private public
token key api example sample demo value string none null true false your here insert placeholder
redacted hidden removed the and for with this that house horse battery staple correct apple orange
tiger eagle falcon silver golden purple yellow green blue black white red star moon sun ocean river
january february march april june july august september october november december monday friday""".split()
# Rows of keys on common keyboards.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "azertyuiop", "qsdfghjklm")

#: Words of a corpus that join the fixed ones, by documents that have them; those of fewer documents are left out, as are words that
#: are shorter or longer.
LEXICON, FEWEST, SHORTEST, LONGEST = 20_000, 5, 3, 24
_NEXT = {a + b for row in KEY_ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
_LEET = str.maketrans("013457@$!", "oieastasi")


def ranks(more: list[str] = ()) -> dict[str, int]:
    """Rank of each word: the fixed ones first, then more in their order."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys((*COMMON_WORDS, *more)))}


_RANK = ranks()


def lexicon(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The LEXICON words that most documents have, most first, ties in alphabetical order; at most that many come to the driver.

    Words are runs of letters of any script, with their marks, in lower-case texts. Credential contexts are left out, so that a secret which many copies
    hold is no word.
    """
    low = F.lower(F.col(text_col).cast("string"))
    clean = F.when(low.contains(":") | low.contains("="), F.regexp_replace(low, _CONTEXT.pattern, " ")).otherwise(low)
    words = docs.select(F.explode(F.array_distinct(F.split(clean, r"[^\p{L}\p{M}]+"))).alias("word")).filter(F.length("word").between(SHORTEST, LONGEST))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= FEWEST)
    counted = stored(counted.withColumn("step", F.floor(16 * F.log2("n")).cast("int")), "lexicon")
    # how often a word has to come, in steps of a sixteenth power of two, so that no task sends more than it has of the most frequent
    least, total = 0, 0
    for r in counted.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        least, total = r["step"], total + r["words"]
        if total >= LEXICON:
            break
    return [r["word"] for r in counted.filter(F.col("step") >= least).orderBy(F.desc("n"), "word").limit(LEXICON).collect()]


def guess_bits(value: str, rank: dict[str, int] = _RANK) -> float:
    """log2 of the guesses that the cheapest segmentation of a value needs.

    Segments are words of a ranked lexicon (their rank, 1 bit for capitals, 2 for look-alike digits), dates (about 40,000 days, 1 bit for a
    separator), repeats of one character or of a block, keyboard walks (start, length and turns), and single brute-force
    characters at the size of their class. Starting a segment costs one bit. Linear in the value's length: each place
    tries words no longer than the longest, dates of at most 10 characters, and one run each of repeat and walk. Empty: 0.
    """
    n, low = len(value), value.lower()
    plain = low.translate(_LEET) if low.isascii() else low
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i] + 1.0  # a new segment

        def to(j: int, bits: float, here: float = here) -> None:
            if here + bits < best[j]:
                best[j] = here + bits

        c = value[i]
        alone = math.log2(10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33) + (0 if c.isascii() else 5)
        best[i + 1] = min(best[i + 1], best[i] + alone)
        for j in range(i + 2, min(n, i + LONGEST) + 1):
            if place := rank.get(low[i:j]):
                to(j, math.log2(place + 1) + (low[i:j] != value[i:j]))
            elif j - i > 2 and (place := rank.get(plain[i:j])):
                to(j, math.log2(place + 1) + 2 + (low[i:j] != value[i:j]))
        if c.isdigit() and (m := _DATE.match(value, i)):
            to(m.end(), 15.3 + bool(m[1] or m[2]) if m.end() - i > 4 else 7)
        if i == 0 or low[i - 1] != low[i]:
            j = i
            while j < n and low[j] == low[i]:
                j += 1
                if j - i > 2:
                    to(j, alone + math.log2(j - i))
        for w in (2, 3, 4):  # a block again and again
            block = low[i : i + w]
            j = i + w
            if low.startswith(block, j) and not (i >= w and low[i - w : i] == block):
                once = best[i] + 1 + sum(math.log2(10 if x.isdigit() else 26 if x.isalpha() else 33) for x in block)
                while low.startswith(block, j):
                    j += w
                    best[j] = min(best[j], once + math.log2((j - i) // w))
        if i + 2 < n and low[i : i + 2] in _NEXT and not (i and low[i - 1 : i + 1] in _NEXT):
            j, turns = i + 2, 0
            while j < n and low[j - 1 : j + 1] in _NEXT:
                turns += j - i > 1 and low[j] == low[j - 2]
                j += 1
                if j - i > 2:
                    to(j, math.log2(47) + math.log2(j - i) + 2 * turns)
    return best[n]


def find(text: str, min_bits: float, rank: dict[str, int] = _RANK) -> tuple[list[tuple[str, int, int, float | None]], list[tuple[int, int, float]]]:
    """Base spans (kind, start, end, bits of an assigned value) and added spans (start, end, bits) of one text, in code points, by
    start."""
    spans = []
    signs = ":" in text or "=" in text
    if signs:
        spans += [("assign", m.start(), m.end(), guess_bits(m[2], rank)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text)]
    added = []
    if signs:
        known = sorted((a, b) for kind, a, b, _ in spans if kind == "assign")
        k = 0
        for m in _CONTEXT.finditer(text):
            while k < len(known) and known[k][1] <= m.start():
                k += 1
            covered = k < len(known) and known[k][0] < m.end() and known[k][1] >= m.end()
            if not covered and (bits := guess_bits(m[1], rank)) >= min_bits:
                added.append((m.start(), m.end(), bits))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))), added


def scan(docs: DataFrame, min_bits: float = 36.0, words: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, bits>> of every whole text, by start and then kind.

    `assign`, `access` and `hex` are the fixed patterns, leftmost and without overlaps per kind, whole matches; bits
    is null but for an `assign` value. `guess` spans are credential contexts whose whole value takes at least 2^min_bits
    guesses and which no `assign` span holds to their end; they run from the context's name to the value's end. words: a ranked
    lexicon beside the fixed one; without it, that of docs. Null and empty texts have no spans; each input row
    gives a row. The scan itself shuffles nothing.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(ranks(lexicon(docs, text_col) if words is None else words))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def run(batches):
        for ids, texts in rows(batches):
            out = []
            for t in texts:
                base, added = find(decoded(t), min_bits, known.value)
                spans = [{"kind": k, "start": a, "end": b, "bits": x} for k, a, b, x in base]
                spans += [{"kind": "guess", "start": a, "end": b, "bits": x} for a, b, x in added]
                out.append(sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, kind)], ["doc_id", "spans"])

    return arrow_map(narrow(docs, id_col, text_col), run, "doc_id long, spans array<struct<kind string, start long, end long, bits double>>")
