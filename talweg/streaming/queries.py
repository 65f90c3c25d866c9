
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Answers a stream of (query_id, query) with search() and writes each micro-batch's results under its number, so that one
    that is run again replaces its own rows and no others."""

    def run(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
