
from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A query counts as quick up to so many milliseconds.
QUICK = 200.0


class Stages:
    """Names stages and gathers what each one took. A stage's rows are counted by an Observation beside its plan, not by a second run; its time is that of
    writing its result, which is then read by the next one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    @contextmanager
    def stage(self, name: str, queries: int = 1) -> Iterator[None]:
        """Times a block that runs a stage for a number of queries."""
        began = time.perf_counter()
        yield
        self.rows.append((name, len(self.rows), None, queries, 1000 * (time.perf_counter() - began)))

    def run(self, name: str, df: DataFrame, write: Callable[[DataFrame], DataFrame], queries: int = 1, per: str = "query_id") -> DataFrame:
        """write(df), timed; rows and the number of queries that have any are observed on the way."""
        seen = Observation(f"{name}-{len(self.rows)}")
        began = time.perf_counter()
        out = write(df.observe(seen, F.count("*").alias("rows")))
        took = 1000 * (time.perf_counter() - began)
        self.rows.append((name, len(self.rows), seen.get["rows"], queries, took))
        return out

    def table(self) -> DataFrame:
        """(stage, place, rows, queries, total_ms, mean_ms): mean_ms is per query."""
        kind = "stage string, place int, rows long, queries long, total_ms double"
        return self.spark.createDataFrame(self.rows, kind).withColumn("mean_ms", F.col("total_ms") / F.col("queries"))


def latencies(rows: DataFrame, ms: str = "ms", *by: str) -> DataFrame:
    """N, mean, least, most, median, p95 and `quick` (how many take QUICK milliseconds at most) of measured times."""
    v = F.col(ms)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"), F.count_if(v <= QUICK).alias("quick"))
