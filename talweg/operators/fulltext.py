
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions import text
from talweg.operators import bm25, ranking
from talweg.sources.versioned import Versioned

#: What is searched in documents of the guides, in the order of an index row.
FIELDS = ("doc_id", "doc_type", "text", "guide_title", "section_title", "tags")
#: Segments from which on sync() merges all into one.
MERGE = 8


class Store(Versioned):
    """A full-text index. Its segments hold `postings` (term, key, tfs: a frequency for each field), sorted by term within files, `terms` (term, df), and `docs` (key, length over
    all fields, hash of their texts, kept columns); its versions, number (n) and total length of the living documents."""

    def __init__(self, spark: SparkSession, folder: str, fields: tuple[str, ...] = FIELDS, keep: tuple[str, ...] = ("doc_type", "tags"), tokens=text.index_words, key: str = "doc_id"):
        super().__init__(spark, folder, key)
        self.fields, self.keep, self.tokens = tuple(fields), tuple(keep), tokens

    # ---- writing

    def _written(self, rows: DataFrame, gone: DataFrame | None) -> str:
        """A segment of documents (key, fields, kept columns), one row for each, and of keys that go."""
        name, folder = self.new_segment()
        value = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) if f not in self.keep or dict(rows.dtypes)[f] == "string" else F.to_json(F.struct(F.col(f).alias("x")))
        lists = F.array(*(self.tokens(value(f)) for f in self.fields))
        kept = [F.col(c) for c in dict.fromkeys((self.key, *self.keep))]
        each = rows.select(*kept, lists.alias("lists_"), F.md5(F.concat_ws("\0", *(value(f) for f in self.fields)).cast("binary")).alias("hash"))
        docs = each.select(*kept, F.aggregate("lists_", F.lit(0).cast("long"), lambda n, x: n + F.size(x)).alias("len"), "hash", F.lit(False).alias("gone"))
        if gone is not None:
            docs = docs.unionByName(gone.select(self.key).distinct().withColumn("gone", F.lit(True)), allowMissingColumns=True)
        docs.write.parquet(f"{folder}/docs")
        words = each.select(self.key, F.posexplode("lists_").alias("field", "words")).select(self.key, "field", F.explode("words").alias("term"))
        counts = words.groupBy("term", self.key).agg(F.array(*(F.count_if(F.col("field") == i).cast("int") for i in range(len(self.fields)))).alias("tfs"))
        self._postings(name, counts)
        return name

    def _postings(self, name: str, counts: DataFrame) -> None:
        folder = f"{self.folder}/segments/{name}"
        counts.sortWithinPartitions("term", self.key).write.parquet(f"{folder}/postings")
        self.segment(name, "postings").groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{folder}/terms")

    def write(self, rows: DataFrame, gone: DataFrame | None = None, source: str | None = None) -> None:
        """K4, K6: one more segment. Documents of known keys take the place of those; of rows of one key any one counts. gone: keys
        (key) of documents to be left out."""
        now = self.manifest()
        name = self._written(rows.dropDuplicates([self.key]), gone)
        new = self.segment(name, "docs")
        added = new.filter("not gone").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("length")).first()
        n, length = added["n"], added["length"]
        if now["segments"]:
            old = self.live(now["segments"]).join(new.select(self.key), self.key, "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("length")).first()
            n, length = n + now["facts"]["n"] - old["n"], length + now["facts"]["length"] - old["length"]
        self.commit(now, [*now["segments"], name], {"n": n, "length": length}, source)

    def merge(self) -> None:
        """All living documents in one segment. Versions before stay readable until prune()."""
        now = self.manifest()
        if len(now["segments"]) < 2:
            return
        name, folder = self.new_segment()
        self.live(now["segments"]).write.parquet(f"{folder}/docs")
        self._postings(name, self.living("postings", now["segments"]))
        self.commit(now, [name], now["facts"], now["source"])

    def sync(self, rows: DataFrame, source: str) -> Store:
        """Brings the index to the state of `rows`. Nothing happens while the source's mark (files.fingerprint) is that of the last
        version; else documents with another hash, or none, are written, and those that are no longer there go."""
        now = self.manifest()
        if now["source"] == source:
            return self
        if not now["segments"]:
            self.write(rows, source=source)
            return self
        value = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) if f not in self.keep or dict(rows.dtypes)[f] == "string" else F.to_json(F.struct(F.col(f).alias("x")))
        one = rows.dropDuplicates([self.key]).withColumn("hash_", F.md5(F.concat_ws("\0", *(value(f) for f in self.fields)).cast("binary")))
        known = self.live(now["segments"]).select(self.key, F.col("hash").alias("known_"))
        changed = one.join(known, self.key, "left").filter(~F.col("hash_").eqNullSafe(F.col("known_"))).drop("hash_", "known_")
        self.write(changed, known.join(one.select(self.key), self.key, "left_anti").select(self.key), source)
        if len(self.manifest()["segments"]) >= MERGE:
            self.merge()
        return self

    # ---- reading

    def index(self, only: tuple[str, ...] = ()) -> bm25.Index:
        """The state of the last version for bm25.scores(); `only`: fields in which words must stand. Lengths and totals cover all fields."""
        now = self.manifest()
        if not now["segments"]:
            raise ValueError(f"no index in {self.folder}")
        facts = now["facts"]
        chosen = [self.fields.index(f) for f in (only or self.fields)]
        tf = reduce(lambda a, b: a + b, (F.col("tfs")[i] for i in chosen)).cast("long")
        docs = self.live(now["segments"])
        lengths = docs.select(self.key, "len")
        rows = self.living("postings", now["segments"]).select("term", self.key, tf.alias("tf")).filter("tf > 0")
        terms = self.segment(now["segments"][0], "terms") if len(now["segments"]) == 1 and not only else None
        total = self.spark.createDataFrame([(facts["n"], facts["length"] / facts["n"] if facts["n"] else None)], "n long, avgdl double")
        return bm25.Index(rows.withColumnRenamed(self.key, "doc_id"), terms, total, docs.select(F.col(self.key).alias("doc_id")), lengths.withColumnRenamed(self.key, "doc_id"), bm25.parts(facts["n"]))


def match_words(query: Column) -> Column:
    """T12 as the index's tokens: words that carry meaning, each of which may match."""
    return F.flatten(F.transform(text.search_words(query), text.index_words))


def tagged(tags: Column, wanted: Column) -> Column:
    """Whether any wanted tag is part of the list's text, in any case of a-z; an empty wish is met."""
    return (F.size(wanted) == 0) | F.exists(wanted, lambda w: F.contains(F.lower(tags), F.lower(w)))


def search(store: Store, queries: DataFrame, top: int = 30, doc_type: str | None = None, wanted: DataFrame | None = None, only: tuple[str, ...] = (), digits: int | None = 6) -> DataFrame:
    """R2: (query_id, doc_id, score, rank): the best documents with a word of the query. Statistics cover all documents; a document type and tags (wanted:
    query_id, tags) cut the results after that. Without tags each text of a query is searched once."""
    if wanted is None:
        return ranking.by_text(queries, lambda q: _search(store, q, top, doc_type, None, only, digits))
    return _search(store, queries, top, doc_type, wanted, only, digits)


def _search(store: Store, queries: DataFrame, top: int, doc_type: str | None, wanted: DataFrame | None, only: tuple[str, ...], digits: int | None) -> DataFrame:
    scored = bm25.scores(store.index(only), queries, match_words(F.col("query")), bm25.FTS5)
    if doc_type is not None or wanted is not None:
        facts = store.live().select(F.col(store.key).alias("doc_id"), *(c for c in ("doc_type", "tags") if c != store.key))
        scored = scored.join(facts, "doc_id")
        if doc_type is not None:
            scored = scored.filter(F.col("doc_type") == doc_type)
        if wanted is not None:
            words = F.col("tags") if dict(facts.dtypes)["tags"] == "string" else F.to_json("tags")
            scored = scored.join(wanted.select("query_id", F.col("tags").alias("wanted_")), "query_id", "left").filter(tagged(words, text.listed(F.col("wanted_"))))
        scored = scored.select("query_id", "doc_id", "score")
    return ranking.top_k(scored if digits is None else scored.withColumn("score", F.round("score", digits)), top)
