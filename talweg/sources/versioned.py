
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from talweg.sources import files


class Versioned:
    """A segment holds what one write brought: some tables, among them `docs` with the key of every row that it adds, or takes away (`gone`). A row
    lives in the last segment that has its key; what earlier ones hold of it is dead. A version's manifest, one row, names the segments and
    some numbers. It is written last, under the next number: readers see a version whole or not at all, and of two writers one fails.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def versions(self) -> list[str]:
        return [v for v in files.listed(self.spark, f"{self.folder}/versions") if files.exists(self.spark, f"{self.folder}/versions/{v}/_SUCCESS")]

    def manifest(self) -> dict:
        """Of the last version: number, segments, facts, source."""
        known = self.versions()
        if not known:
            return {"number": 0, "segments": [], "facts": {}, "source": None}
        return self.spark.read.parquet(f"{self.folder}/versions/{known[-1]}").first().asDict()

    def commit(self, now: dict, segments: list[str], facts: dict[str, int], source: str | None) -> None:
        """The version after `now`."""
        kind = "number long, segments array<string>, facts map<string, long>, source string"
        self.spark.createDataFrame([(now["number"] + 1, segments, facts, source)], kind).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/versions/{now['number'] + 1:09d}")

    def new_segment(self) -> tuple[str, str]:
        """Name and folder of a segment to be written."""
        name = uuid.uuid4().hex
        return name, f"{self.folder}/segments/{name}"

    def segment(self, name: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/segments/{name}/{table}")

    def living(self, table: str, segments: list[str], where=lambda df: df) -> DataFrame:
        """Rows of a table of some segments, without what later ones of them have replaced; `where` cuts each before."""
        parts = []
        for i, s in enumerate(segments):
            part = where(self.segment(s, table))
            if i + 1 < len(segments):
                later = reduce(DataFrame.unionByName, (self.segment(x, "docs").select(self.key) for x in segments[i + 1 :]))
                part = part.join(later, self.key, "left_anti")
            parts.append(part)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def live(self, segments: list[str] | None = None) -> DataFrame:
        """The living rows of `docs`."""
        return self.living("docs", self.manifest()["segments"] if segments is None else segments, lambda df: df.filter("not gone"))

    def prune(self) -> None:
        """Deletes all versions but the last, and segments that it does not name."""
        now = self.manifest()
        for v in self.versions()[:-1]:
            files.delete(self.spark, f"{self.folder}/versions/{v}")
        for s in files.listed(self.spark, f"{self.folder}/segments"):
            if s not in now["segments"]:
                files.delete(self.spark, f"{self.folder}/segments/{s}")
