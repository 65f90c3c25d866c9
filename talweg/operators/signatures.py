
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talweg.functions import dims, numeric, text
from talweg.sources import files

# What makes a token an establishment's own.
LETTERS, OFTEN, SHARE, LOCAL = 4, 3, 0.6, 0.01
#: Characters of a token by which queries are searched for it.
KEY = 4
#: Bins of hashes in which tokens are counted before they are counted one by one.
BINS = 1 << 17


def tokens(passage: Column) -> Column:
    """Words in lower case, and their runs of two and three."""
    return text.grams(_words(passage))


def _words(passage: Column) -> Column:
    return F.regexp_extract_all(F.lower(passage), F.lit(f"({text.WORD}+)"))


def _split(passages: DataFrame, body: str, *columns: Column) -> DataFrame:
    """columns and words_ of each passage. A generator makes the words once; a projection would make them anew wherever they are used."""
    return passages.select(*columns, F.explode(F.array(_words(F.col(body)))).alias("words_"))


def idf(passages: DataFrame, body: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(token, idf): ln((passages + 1) / (passages with the token + 1)) + 1. only: the tokens (token) that are wanted; others are not counted."""
    total = F.broadcast(passages.agg(F.count("*").alias("all")))  # one row
    # an outer one, as a filter would be made of the others' arrays, which takes them a second time
    each = _split(passages, body).select(F.explode_outer(F.array_distinct(text.grams(F.col("words_")))).alias("token")).filter("token is not null")
    if only is not None:
        each = each.join(only.select("token"), "token", "left_semi")
    return each.groupBy("token").agg(F.count("*").alias("df")).crossJoin(total).select("token", (F.ln((F.col("all") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def of_entities(passages: DataFrame, entity: str = "entity_code", body: str = "text", own: str | None = None, local: float = LOCAL) -> DataFrame:
    """(entity, token): tokens of LETTERS characters that come OFTEN times in all, more than SHARE of them with the entity and
    more than `local` of all its tokens; and the words that its passages bring along (own, an array of them).

    A token that an entity has more than `local` of its tokens of lies in a bin of hashes of which it has as many or more: tokens of other bins
    cannot qualify, and only the rest, a few, are counted one by one.
    """
    split = _split(passages, body, F.col(entity).alias("entity"))
    words = split.select("entity", F.size("words_").cast("long").alias("n"))
    sizes = words.groupBy("entity").agg(F.sum(F.col("n") + F.greatest(F.col("n") - 1, F.lit(0)) + F.greatest(F.col("n") - 2, F.lit(0))).alias("size"))
    sizes = files.kept(sizes, "sizes")
    each = split.select("entity", F.explode_outer(text.grams(F.col("words_"))).alias("token")).filter(F.length("token") >= LETTERS)
    each = each.withColumn("bin", F.pmod(F.xxhash64("token"), F.lit(BINS)).cast("int"))
    full = each.groupBy("entity", "bin").agg(F.count("*").alias("n")).join(sizes, "entity").filter(F.col("n") / F.col("size") > local)
    full = files.kept(full.select("bin").distinct(), "bins")
    counts = each.join(full, "bin", "left_semi").groupBy("entity", "token").agg(F.count("*").alias("n"))
    # of a token that has more than half of its places with one entity, that is the entity which has most
    most = counts.groupBy("token").agg(F.sum("n").alias("everywhere"), F.max_by(F.struct("entity", "n"), "n").alias("most")).select("token", "everywhere", "most.*")
    found = most.filter((F.col("everywhere") >= OFTEN) & (F.col("n") / F.col("everywhere") > SHARE)).join(sizes, "entity")
    found = found.filter(F.col("n") / F.col("size") > local).select("entity", "token")
    if own is None:
        return found
    return found.unionByName(passages.select(F.col(entity).alias("entity"), F.explode(F.transform(own, F.lower)).alias("token"))).distinct()


def named(queries: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, token): the distinct words (token) that stand anywhere in a query (query_id, query) in lower case.

    Both sides meet on runs of KEY characters, the first ones of a token; shorter tokens are compared with all queries.
    """
    low = queries.select("query_id", F.lower("query").alias("low"))
    known = words.select("token").distinct()
    starts = F.transform(F.sequence(F.lit(1), F.length("low") - (KEY - 1)), lambda i: F.substr("low", i, F.lit(KEY)))
    runs = low.filter(F.length("low") >= KEY).select("query_id", "low", F.explode(F.array_distinct(starts)).alias("key"))
    long = known.filter(F.length("token") >= KEY).select("token", F.substring("token", 1, KEY).alias("key"))
    found = runs.join(long, "key").filter(F.contains("low", F.col("token"))).select("query_id", "token")
    short = low.join(known.filter(F.length("token") < KEY), F.contains("low", F.col("token"))).select("query_id", "token")
    return found.unionByName(short)


def _base(spark) -> DataFrame:
    words = [(w,) for ws in dims.SIGNATURE_WORDS.values() for w in ws]
    return F.broadcast(spark.createDataFrame(words, "token string"))  # fixed


def known(queries: DataFrame, owned: DataFrame) -> DataFrame:
    """(token): the entities' tokens (entity, token) and fixed words that some query names."""
    every = owned.select("token").unionByName(_base(queries.sparkSession).select("token"))
    return files.kept(named(queries, every).select("token").distinct(), "known")


def matching(queries: DataFrame, owned: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, entity, token, idf) of the entities' tokens (entity, token) that a query names, and of the fixed words with
    entity BASE. A token without a weight counts 1."""
    every = owned.unionByName(_base(queries.sparkSession).select(F.lit("BASE").alias("entity"), "token"))
    return named(queries, every).join(every, "token").join(weights, "token", "left").select("query_id", "entity", "token", F.coalesce("idf", F.lit(1.0)).alias("idf"))


def summary(owned: DataFrame, most: int = 10) -> DataFrame:
    """(entity, tokens): the first ones of each entity in alphabetical order."""
    first = owned.withColumn("n", F.row_number().over(W.partitionBy("entity").orderBy("token"))).filter(F.col("n") <= most)
    return first.groupBy("entity").agg(F.array_sort(F.collect_list("token")).alias("tokens"))


def factors(pairs: DataFrame, queries: DataFrame, owned: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, doc_id, factor) of pairs (query_id, doc_id, entity_code, text, signature_tokens, mismatch).

    0.1 of the weight of each word of the passage that the query names, 0.05 of each other one of its entity, 0.1 of each fixed
    word in both texts; half of it if the query's establishment is another (mismatch); 1 is added to 1 at most.
    """
    rows = pairs.withColumn("own", F.transform("signature_tokens", F.lower))
    extra = rows.select(F.explode("own").alias("token")).distinct()
    hits = named(queries, owned.select("token").unionByName(extra).unionByName(_base(queries.sparkSession))).join(weights, "token", "left").select("query_id", "token", F.coalesce("idf", F.lit(1.0)).alias("idf"))
    of_passage = rows.select("query_id", "doc_id", F.explode(F.array_distinct("own")).alias("token")).join(hits, ["query_id", "token"]).select("query_id", "doc_id", (0.1 * F.col("idf")).alias("part"))
    by_entity = hits.join(owned, "token").select("query_id", F.col("entity").alias("entity_code"), "token", "idf")
    of_entity = rows.select("query_id", "doc_id", "entity_code", "own").join(by_entity, ["query_id", "entity_code"]).filter(~F.coalesce(F.array_contains("own", F.col("token")), F.lit(False))).select("query_id", "doc_id", (0.05 * F.col("idf")).alias("part"))
    base = hits.join(_base(queries.sparkSession), "token")
    of_base = rows.select("query_id", "doc_id", F.lower("text").alias("low")).join(base, "query_id").filter(F.contains("low", F.col("token"))).select("query_id", "doc_id", (0.1 * F.col("idf")).alias("part"))
    total = of_passage.unionByName(of_entity).unionByName(of_base).groupBy("query_id", "doc_id").agg(F.sum("part").alias("total"))
    out = rows.select("query_id", "doc_id", "mismatch").join(total, ["query_id", "doc_id"], "left")
    boost = F.coalesce("total", F.lit(0.0)) * F.when(F.coalesce("mismatch", F.lit(False)), 0.5).otherwise(1.0)
    return out.select("query_id", "doc_id", numeric.clamped(boost).alias("factor"))
