"""Queries over the full-text index of several fields: documents as sections of guides whose titles are their source and language."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions import text
from talweg.operators import fulltext
from talweg.plans._sql import INDEX_WORDS, literal, query, table
from talweg.sources import files

KINDS = ["guide", "section", "step"]


def sections(docs: DataFrame) -> DataFrame:
    """documents rows with the six fields."""
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 3).cast("int"))
    return docs.select("doc_id", kind.alias("doc_type"), "text", F.concat_ws(" ", "source", kind).alias("guide_title"), F.col("lang").alias("section_title"), F.to_json(F.array("lang", "source")).alias("tags"))


def store(spark: SparkSession, sf_dir: str) -> fulltext.Store:
    """The documents' index, brought to the state of the table's files."""
    out = fulltext.Store(spark, files.own_folder(spark, f"guides-{uuid.uuid5(uuid.NAMESPACE_URL, sf_dir).hex}"))
    return out.sync(sections(table(spark, sf_dir, "documents")), files.fingerprint(spark, f"{sf_dir}/documents.parquet"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _words(x: str) -> str:
    """Words that carry meaning, as the index's tokens."""
    split = rf"list_filter(regexp_split_to_array(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"
    meaning = f"list_filter(w_, lambda w: length(w) >= 3 AND NOT list_contains({literal(text.STOP_WORDS)}, lower(w)))"
    chosen = f"list_transform([{split}], lambda w_: CASE WHEN len({meaning}) > 0 THEN {meaning} ELSE list_filter(w_, lambda w: length(w) >= 2) END)[1]"
    return f"flatten(list_transform({chosen}, lambda w: {INDEX_WORDS.format('w')}))"


def corpus(docs: str = "documents") -> str:
    """CTEs up to s(query_id, doc_id, score) over the fields of the rows of `docs`; d(doc_id, doc_type, tags, toks)."""
    fields = "array_to_string([CAST(doc_id AS VARCHAR), doc_type, coalesce(text, ''), guide_title, coalesce(lang, ''), tags], ' ')"
    return f"""d0 AS (SELECT *, {literal(KINDS)}[1 + doc_id % 3] AS doc_type, '["' || lang || '","' || source || '"]' AS tags FROM {docs}), d1 AS (SELECT *, concat_ws(' ', source, doc_type) AS guide_title FROM d0), d AS (SELECT doc_id, doc_type, tags, {INDEX_WORDS.format(fields)} AS toks FROM d1),
tot AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM d) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_words('text')}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS raw, round(raw, 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), tot GROUP BY 1, 2)"""


def _best(source: str, k: int) -> str:
    return f"SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k}"


@query(f"WITH {corpus()} {_best('s', 10)}")
def fielded_topk(spark, sf_dir):
    """R2: words of six fields."""
    return fulltext.search(store(spark, sf_dir), asked(spark, sf_dir), 10)


@query(f"""WITH {corpus()}, w AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN ['SRC1', 'de'] WHEN 1 THEN ['fr'] ELSE [] END AS wanted FROM benchmark),
f AS (SELECT s.* FROM s JOIN d USING (doc_id) JOIN w USING (query_id) WHERE doc_type = 'section' AND (len(wanted) = 0 OR len(list_filter(wanted, lambda x: contains(lower(tags), lower(x)))) > 0)) {_best('f', 10)}""")
def fielded_filtered_topk(spark, sf_dir):
    """Sections alone, with one of the tags that a query asks for."""
    key, tags = F.col("item_id") % 3, lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(key == 0, tags("SRC1", "de")).when(key == 1, tags("fr")).otherwise(tags()).alias("tags"))
    return fulltext.search(store(spark, sf_dir), asked(spark, sf_dir), 10, "section", wanted)


@query(f"""WITH {corpus()}, ct AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest({INDEX_WORDS.format('guide_title')}) AS term FROM d1 JOIN (SELECT doc_id, len(toks) AS len FROM d) USING (doc_id)) GROUP BY 1, 2, 3), cd AS (SELECT term, count(*) AS df FROM ct GROUP BY 1),
qs AS (SELECT s_suppkey AS query_id, unnest(['src' || s_suppkey % 9, {literal(KINDS)}[1 + s_suppkey % 3]]) AS term FROM supplier),
x AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM qs JOIN ct USING (term) JOIN cd USING (term), tot GROUP BY 1, 2) {_best('x', 5)}""")
def fielded_column_topk(spark, sf_dir):
    """R2: words that must stand in one column; lengths cover all."""
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("s_suppkey") % 3).cast("int"))
    queries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("src"), (F.col("s_suppkey") % 9).cast("string"), F.lit(" "), kind).alias("query"))
    return fulltext.search(store(spark, sf_dir), queries, 5, only=("guide_title",))


_AFTER = "z AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN text || ' renewed' ELSE text END AS text, lang, source FROM documents WHERE doc_id % 5 <> 2)"


@query(f"WITH {_AFTER}, {corpus('z')} {_best('s', 10)}")
def fielded_upserts(spark, sf_dir):
    """K4, K6: an index of most documents takes in the others and new texts, loses some, and merges its segments; scores are those of
    one that is made of the final state at once."""
    docs = table(spark, sf_dir, "documents")
    index = fulltext.Store(spark, files.own_folder(spark, f"upserts-{uuid.uuid4().hex}"))
    index.write(sections(docs.filter("doc_id % 3 <> 0")))
    index.write(sections(docs.filter("doc_id % 3 = 0 and doc_id % 5 <> 2")))
    index.merge()
    changed = docs.filter("doc_id % 4 = 1").withColumn("text", F.concat("text", F.lit(" renewed")))
    index.write(sections(changed), docs.filter("doc_id % 5 = 2 and doc_id % 4 <> 1").select("doc_id"))
    index.write(sections(docs.limit(0)), docs.filter("doc_id % 5 = 2").select("doc_id"))
    return fulltext.search(index, asked(spark, sf_dir), 10)
