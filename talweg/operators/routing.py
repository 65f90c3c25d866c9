
from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talweg.functions import text
from talweg.operators import ranking, rules
from talweg.sources import files

# Weight of a query word among a document's, and of one that has itself or a synonym there; of a label that a query
# names, and of one with itself or a synonym among the query's words; words of documents without commitment; candidates that go on.
WORD, CROSS = 1.5, 1.0
LABELS = {"doc_type": (5.0, 3.0), "family": (5.0, 3.0), "segment": (3.0, 2.0), "technology": (2.0, 1.5)}
NO_COMMITMENT = ["sans", "engagement", "sans engagement", "بدون", "التزام"]
POOL = 15
#: Forms of a word by dictionary, itself included: in the index and in queries, of labels, and across languages.
INDEXED, LABELLED, CROSSED = 3, 5, 10


def _named(field: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(field).alias("field"), x.alias("value")))


def meanings(words: DataFrame, word: str, synonyms: DataFrame, most: int) -> DataFrame:
    """The rows of `words` with each form (`alt`) of their word: itself in lower case, then its synonyms, `most` in all.
    synonyms: (key, value, ordinal)."""
    low = F.lower(F.trim(F.col(word)))
    known = synonyms.withColumn("n_", F.row_number().over(W.partitionBy("key").orderBy("ordinal"))).filter(F.col("n_") < most)
    more = words.join(known.select(F.col("key").alias("key_"), F.col("value").alias("alt")), low == F.col("key_")).drop("key_")
    return words.withColumn("alt", low).unionByName(more)


def flags() -> Column:
    """What decides about topics in a document: each name is a term of the index, which queries weigh (asked())."""
    family = F.coalesce("family", F.lit(""))
    low, kind = F.lower(family), F.coalesce("doc_type", F.lit(""))
    seg = lambda *parts: F.exists(text.listed(F.col("segments")), lambda s: F.coalesce(text.either(s, parts), F.lit(False)))
    fam = lambda *parts: text.either(low, parts)
    lte, free = fam("4g_lte"), F.coalesce(F.col("commitment") == "no_commitment", F.lit(False))
    business, tenant, home = seg("business", "enterprise"), seg("locataire"), seg("residential")
    named, medium = seg("business"), fam("moohtarif", "medium_business")
    every = {
        "payment": fam("payment"),
        "payment_any": fam("payment") | (kind == "payment_benefits"),
        "ont": fam("ont"),
        "ont_any": fam("ont", "wifi_6", "xgs-pon"),
        "school": seg("school", "primary"),
        "lte": lte,
        "lte_free": lte & free,
        "lte_bound": lte & ~free,
        "referral": fam("referral", "parrainage"),
        "business": business,
        "business_tenant": business & tenant & ~medium,
        "business_home": business & home & ~named,
        "tenant": tenant,
        "tenant_business": tenant & named & ~medium,
        "tenant_gamer": tenant & fam("gamer"),
        "gamer": fam("gamer"),
        "gamer_tenant": fam("gamer") & tenant,
        "home": home,
        "home_business": home & named,
        "tax_type": kind == "tax_policy",
        "tax_family": family == "tax_stamp",
        "moves": F.contains(family, F.lit("modernisation")),
        "moves_any": fam("modernisation"),
        "faults": kind.isin("technical", "service_quality"),
    }
    return F.array_compact(F.array(*(F.when(c, k) for k, c in every.items())))


def asked(t: Column, form: Column) -> tuple[Column, Column]:
    """What a query (t: its rules.topics()) takes from every document, and what flags() give back or more: an array of (flag, weight)."""
    level = lambda name: t[name]
    on = lambda name: t[name] > 0
    strong = lambda name: t[f"{name}_strong"]
    names = lambda words: text.either(form, words)
    losses = [(strong("payment"), 10.0), (strong("ont"), 12.0), (on("school"), 20.0), (strong("lte"), 15.0), (on("referral"), 20.0), (on("business"), 10.0), (on("tenant"), 12.0), (on("gamer"), 15.0)]
    base = F.lit(0.0)
    for when, loss in losses:
        base = base - F.when(when, loss).otherwise(0.0)
    moves = names(("4g", "lte", "adsl", "vdsl")) & names(("vers", "fibre", "modernisation", "migration", "الألياف"))
    gains = {
        "payment_any": F.when(strong("payment"), level("payment") + 10.0),
        "payment": F.when(~strong("payment"), level("payment")),
        "ont_any": F.when(strong("ont"), level("ont") + 12.0),
        "ont": F.when(~strong("ont"), level("ont")),
        "school": F.when(on("school"), level("school") + 20.0),
        "lte_free": F.when(strong("lte"), level("lte") + 15.0),
        "lte_bound": F.when(strong("lte"), level("lte") * 0.7 + 15.0),
        "lte": F.when(~strong("lte"), level("lte")),
        "referral": F.when(on("referral"), level("referral") + 20.0),
        "business": F.when(on("business"), level("business") + 10.0),
        "business_tenant": F.when(on("business"), -10.0),
        "business_home": F.when(on("business"), -12.0),
        "tenant": F.when(on("tenant"), level("tenant") + 12.0),
        "tenant_business": F.when(on("tenant"), -8.0),
        "tenant_gamer": F.when(on("tenant") & ~on("gamer"), -10.0),
        "gamer": F.when(on("gamer"), level("gamer") + 15.0),
        "gamer_tenant": F.when(on("gamer") & on("tenant"), 8.0),
        "home": level("home"),
        "home_business": F.when(on("home"), -10.0),
        "tax_type": F.when(names(rules.TAX), 15.0),
        "tax_family": F.when(names(rules.TAX), 15.0),
        "moves": F.when(names(rules.MOVES), 10.0),
        "moves_any": F.when(moves, 12.0),
        "faults": F.when(names(rules.FAULTS), 8.0),
    }
    weights = F.array(*(F.struct(F.lit(k).alias("term"), F.coalesce(v, F.lit(0.0)).cast("double").alias("weight")) for k, v in gains.items()))
    return base, F.filter(weights, lambda x: x["weight"] != 0)


@dataclass(frozen=True)
class Index:
    """words (term, doc_id); members (doc_id, profile): documents with the same labels share a profile; terms (profile, kind, term, n) of profiles;
    heads (profile, doc_id): the first POOL documents of each; labels (kind, term, alt, own): forms of the labels."""

    words: DataFrame
    members: DataFrame
    terms: DataFrame
    heads: DataFrame
    labels: DataFrame

    @staticmethod
    def of(docs: DataFrame, synonyms: DataFrame) -> Index:
        """docs: doc_id, doc_type, family, segments, technologies, commitment, usage, keywords, title_fr, title_ar. Every word of a document counts, where
        the surveyed code expands fifty of a set in no order."""
        c, none = F.col, F.array().cast("array<string>")
        one, more = ("doc_type", "family", "commitment", "title_fr", "title_ar"), ("technologies", "segments", "usage", "keywords")
        pairs = F.concat(*(_named(f, F.array(c(f))) for f in one), *(_named(f, text.listed(c(f))) for f in more))
        profile = F.md5(F.to_json(F.struct("doc_type", "family", "segments", "technologies", "commitment"), {"ignoreNullFields": "false"}).cast("binary"))
        each = docs.withColumn("profile", profile)
        labelled = each.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.field", "x.value").filter("value <> ''").distinct()
        # a label's forms are made once, however many documents have it
        known = labelled.select("field", "value").distinct().withColumn("form", text.search_form(c("value"))).withColumn("words", text.words(c("form")))
        is_ = lambda *names: c("field").isin(*names)
        longer = lambda n: F.filter("words", lambda w: F.length(w) > n)
        raw = F.when(is_("title_fr"), longer(3)).when(is_("title_ar"), longer(2)).when(is_("usage"), none).otherwise(F.array("form"))
        free = F.array(*map(F.lit, NO_COMMITMENT))
        other = F.when(is_("family", "technologies", "segments"), F.split("form", "_")).when(is_("usage"), F.array_append(F.split("form", "_"), c("form"))).when(is_("keywords"), c("words")).when(is_("commitment") & (c("value") == "no_commitment"), free).otherwise(none)
        own = known.select("field", "value", F.explode(raw).alias("term"))
        every_term = own.unionByName(known.select("field", "value", F.explode(other).alias("term"))).unionByName(meanings(own, "term", synonyms, INDEXED).select("field", "value", F.col("alt").alias("term")))
        words = labelled.join(every_term.distinct(), ["field", "value"]).select("doc_id", "term")
        members = each.select("doc_id", "profile")
        first = members.withColumn("n", F.row_number().over(W.partitionBy("profile").orderBy("doc_id"))).filter(F.col("n") <= POOL).drop("n")
        kinds = each.select("profile", "doc_type", "family", "segments", "technologies", "commitment").dropDuplicates(["profile"])
        some = lambda value, kind: F.transform(F.filter(value, lambda x: x.isNotNull() & (x != "")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("term")))
        every = F.concat(some(F.array("doc_type"), "doc_type"), some(F.array("family"), "family"), some(text.listed(F.col("segments")), "segment"), some(text.listed(F.col("technologies")), "technology"), some(flags(), "flag"))
        terms = kinds.select("profile", F.explode(every).alias("x")).groupBy("profile", "x.kind", "x.term").agg(F.count("*").alias("n"))
        names = terms.filter("kind <> 'flag'").select("kind", "term", text.search_form(F.col("term")).alias("form")).distinct()
        labels = names.select("kind", "term", F.col("form").alias("alt"), F.lit(True).alias("own")).unionByName(meanings(names, "form", synonyms, LABELLED).select("kind", "term", "alt", F.lit(False).alias("own")))
        return Index(words.filter("term <> ''").distinct(), members, terms, first, labels)

    def write(self, folder: str) -> None:
        """Words are sorted by term within their files, so that a query's words are found by the files' statistics."""
        for f in fields(self):
            df = getattr(self, f.name)
            out = df.repartitionByRange("term").sortWithinPartitions("term", "doc_id") if f.name == "words" else df
            out.write.mode("overwrite").parquet(f"{folder}/{f.name}")

        self.words.sparkSession.range(1).write.mode("overwrite").parquet(f"{folder}/done")  # last: an index that broke off is made again

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Index:
        return Index(*(spark.read.parquet(f"{folder}/{f.name}") for f in fields(Index)))

    @staticmethod
    def stored(docs: DataFrame, synonyms: DataFrame, folder: str) -> Index:
        """The index in a folder, which is made first if it is not there."""
        spark = docs.sparkSession
        if not files.exists(spark, f"{folder}/done"):
            Index.of(docs, synonyms).write(folder)
        return Index.read(spark, folder)


def query_words(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, form, tokens): the words of a query (query_id, query), its whole form, and the first synonyms of all of them."""
    form = text.search_form(F.col("query"))
    own = queries.select("query_id", form.alias("form"), F.array_distinct(F.concat(text.words(form), F.array(form))).alias("own"))
    more = meanings(own.select("query_id", F.explode("own").alias("word")), "word", synonyms, INDEXED).groupBy("query_id").agg(F.collect_set("alt").alias("more"))
    return own.join(more, "query_id", "left").select("query_id", "form", F.array_union("own", text.listed(F.col("more"))).alias("tokens"))


def routed(index: Index, queries: DataFrame, synonyms: DataFrame, pool: int = POOL) -> DataFrame:
    """(query_id, doc_id, score, rank): the best documents of each query with a score above zero.

    What topics and labels give depends on a document's profile alone, so it is added up per profile; what words give comes from their
    postings. A profile's documents without any of the words have one score, and only its first ones can be among the best.
    """
    if pool > POOL:
        raise ValueError(f"the index keeps the first {POOL} documents of each profile")
    known = query_words(queries, synonyms)
    base, weights = asked(F.col("t"), F.col("form"))
    topics = known.withColumn("t", rules.topics(F.col("form"), F.col("tokens"))).select("query_id", base.alias("base"), weights.alias("weights"))
    token = known.select("query_id", F.explode("tokens").alias("token")).filter("token <> ''")
    alts = token.select("query_id", "token", F.col("token").alias("term"), F.lit(WORD).alias("own"), F.lit(0.0).alias("cross"))
    alts = alts.unionByName(meanings(token, "token", synonyms, CROSSED).select("query_id", "token", F.col("alt").alias("term"), F.lit(0.0).alias("own"), F.lit(CROSS).alias("cross")))
    hits = index.words.join(alts, "term").groupBy("query_id", "doc_id", "token").agg((F.max("own") + F.max("cross")).alias("x"))
    by_words = hits.groupBy("query_id", "doc_id").agg(F.sum("x").alias("words"))
    named = index.labels.join(token.withColumnRenamed("token", "alt"), "alt").groupBy("query_id", "kind", "term").agg(F.max("own").alias("own"), F.max(~F.col("own")).alias("other"))
    level = lambda i: F.element_at(F.create_map(*(F.lit(y) for k, v in LABELS.items() for y in (k, v[i]))), F.col("kind"))
    labels = named.select("query_id", "kind", "term", (F.when(F.col("own"), level(0)).otherwise(0.0) + F.when(F.col("other"), level(1)).otherwise(0.0)).alias("weight"))
    wanted = topics.select("query_id", F.lit("flag").alias("kind"), F.inline("weights")).unionByName(labels)
    by_profile = index.terms.join(wanted, ["kind", "term"]).groupBy("query_id", "profile").agg(F.sum(F.col("weight") * F.col("n")).alias("profile_score"))
    one = by_words.join(index.members, "doc_id").join(by_profile, ["query_id", "profile"], "left").select("query_id", "doc_id", "words", F.coalesce("profile_score", F.lit(0.0)).alias("profile_score"))
    two = by_profile.join(index.heads, "profile").select("query_id", "doc_id", F.lit(0.0).alias("words"), "profile_score")
    both = one.unionByName(two).groupBy("query_id", "doc_id").agg(F.max("words").alias("words"), F.max("profile_score").alias("profile_score"))
    scored = both.join(topics.select("query_id", "base"), "query_id").select("query_id", "doc_id", F.round(F.col("base") + F.col("words") + F.col("profile_score"), 6).alias("score"))
    return ranking.top_k(scored.filter("score > 0"), pool)
