import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

EN = "the quick brown fox jumps over a lazy dog while seven bright stars shine above the quiet river bank tonight and nobody speaks about it"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every kind of trouble, and columns whose names operators use themselves."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, EN + ". " + EN[::-1] + ".", "en", "src0", 1),
        (2, EN + ". " + EN[::-1] + ".", "en", "src0", 1),
        (3, None, None, None, None),
        (4, "", "en", "src1", 0),
        (None, "no id here at all, five words and more", "fr", None, 2),
        (5, " \n\t\n ", "fr", "src1", 4),
        (6, long, "en", "src2", 5),
        (7, "x" * 200_000, "en", "src2", 5),
        (8, "É\u00a0é\u2028\u3000ß 日本語 \U0001f600", "ja", "src3", 9),
        (9, EN + ". " + EN[::-1] + ". end", "en", "src0", 1),
        (9, EN + ". " + EN[::-1] + ". end", "en", "src0", 1),
        (10, "one\ntwo\none\ntwo\none", "en", "src0", 1),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, kind)
    from pyspark.sql import functions as F

    extra = {c: F.lit("clash") for c in ("body", "hash", "id", "key", "line", "norm", "node", "rep", "a", "b", "group", "pos", "gone", "sketch", "component", "score", "id_", "slot", "lane", "row", "number", "bucket", "name", "first", "last", "lines", "kept", "spans", "hashes")}
    return df.withColumns(extra), rows


@pytest.fixture(scope="session")
def none(odd):
    return odd[0].limit(0)
