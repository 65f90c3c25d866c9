"""Registration of queries with their DuckDB twins, and literal rows that both sides read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL twin if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]"
    return str(value).lower() if isinstance(value, bool) else str(value)


def values(rows: list[tuple], names: str) -> str:
    """A DuckDB table expression of literal rows."""
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names})"


def spread(rows: list[tuple], names: str, source: str, key: str) -> str:
    """values() dealt out over a table: each of its rows, by its key, takes one of `rows`; the first name is the key."""
    first, *rest = names.split(", ")
    numbered = values([(i, *r[1:]) for i, r in enumerate(rows)], ", ".join(["n_", *rest]))
    return f"(SELECT {key} AS {first}, {', '.join(rest)} FROM {source} JOIN {numbered} ON n_ = {key} % {len(rows)})"


def spread_rows(df: DataFrame, rows: list[tuple], kind: str, key: str) -> DataFrame:
    """The Spark side of spread(): df has the key; kind names the columns, the first of which is the key."""
    from pyspark.sql import functions as F

    first, _, rest = kind.partition(", ")
    few = df.sparkSession.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], f"n_ int, {rest}")
    return df.select(F.col(key).alias(first.split()[0])).join(F.broadcast(few), F.col(first.split()[0]) % len(rows) == F.col("n_")).drop("n_")  # fixed rows


#: DuckDB forms of the tokenisers.
WORDS = r"list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1 OR regexp_full_match(w, '[0-9]'))"
PASSAGE_WORDS = r"list_filter(regexp_extract_all(lower(strip_accents({0})), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1)"
INDEX_WORDS = r"regexp_extract_all(lower(strip_accents({0})), '[\p{{L}}\p{{N}}]+')"
PRODUCT_WORDS = r"list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9éèàçùôîïüâ'']+', ' ', 'g'), ' '), lambda w: w <> '')"
