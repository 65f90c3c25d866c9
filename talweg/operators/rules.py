
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talweg.functions import dims, numeric, text
from talweg.operators import ranking, substrings


def classify(queries: DataFrame) -> DataFrame:
    """Intent and confidence of each query (query_id, query): matches per intent + 0.1 * priority where there are any, the
    highest, of ties the most important; GENERAL with 0.5 without matches. Patterns are literals, so they are compiled once, and each text is
    looked at once."""
    return ranking.by_text(queries, _classified)


def _classified(queries: DataFrame) -> DataFrame:
    names = list(dims.INTENT_PATTERNS)

    def scored(i: int, name: str) -> Column:
        hits = reduce(lambda a, b: a + b, (F.regexp_count(F.lower("query"), F.lit("(?U)" + p)) for p in dims.INTENT_PATTERNS[name]))
        return F.struct(F.when(hits > 0, hits + 0.1 * (len(names) - i)).alias("score"), F.lit(len(names) - i).alias("priority"), F.lit(name).alias("intent"))

    every = queries.select("query_id", F.array(*(scored(i, n) for i, n in enumerate(names))).alias("all"))
    some = every.select("query_id", F.filter("all", lambda x: x["score"].isNotNull()).alias("some"))
    total = F.aggregate("some", F.lit(0.0), lambda s, x: s + x["score"])
    best = F.array_max("some")
    return some.select("query_id", F.coalesce(best["intent"], F.lit("GENERAL")).alias("intent"), F.coalesce(best["score"] / F.nullif(total, F.lit(0.0)), F.lit(0.5)).alias("confidence"))


#: How a query names an establishment (accents taken off, any case); {0} is its code. Two have further forms.
NAMED = (r"etablissement\s+{0}\b", r"etab\s*=?\s*{0}\b")
MORE = {"P": (r"\b{0}\b.*etablissement", r"convention.*\b{0}\b"), "V": (r"\b{0}\b.*etablissement",)}
#: How a query says that an establishment is the only one.
ONLY = (r"(?:uniquement|seulement|exclusivement|specifiquement)\s+(?:pour\s+)?(?:l')?etablissement", r"pour\s+(?:l')?etablissement\s+\w+\s+uniquement")


def _in(query: Column, patterns) -> Column:
    return F.rlike(text.bare(query), F.lit("(?iU)" + "|".join(patterns)))


def entities(query: Column) -> Column:
    """Codes of establishments that a query names, in alphabetical order."""
    return F.array_compact(F.array(*(F.when(_in(query, [p.format(c) for p in (*NAMED, *MORE.get(c, ()))]), c) for c in sorted(dims.ENTITY_CODES))))


def entity_confidence(query: Column) -> Column:
    """0 without an entity, .95 if the query names one and says that it is the only one, .85 for one, .6 for more."""
    n = F.size(entities(query))
    return F.when(n == 0, 0.0).when((n == 1) & _in(query, ONLY), 0.95).when(n == 1, 0.85).otherwise(0.6)


def entity_filter(ranked: DataFrame, found: DataFrame) -> DataFrame:
    """of queries that name exactly one entity only its passages; it follows the cut to candidates, so none may be left.
    ranked: (query_id, ..., entity_code); found: (query_id, entities)."""
    one = F.size("entities") == 1
    return ranked.join(found, "query_id").filter(~one | (F.upper("entity_code") == F.upper(F.get("entities", F.lit(0))))).drop("entities")


def word_in(query: Column, key: Column) -> Column:
    """Whether a key stands in a query as whole words."""
    side = r"[^\p{L}\p{N}_]"
    return F.rlike(query, F.concat(F.lit(f"(^|{side})"), F.lit(r"\Q"), key, F.lit(r"\E"), F.lit(f"($|{side})")))


def naming(texts: DataFrame, dictionary: DataFrame, words: bool) -> DataFrame:
    """(text_id, key, value, ordinal) of entries of a dictionary (pattern, key, value, ordinal) whose pattern stands in a text (text_id, text), as whole words or anywhere.
    Texts and patterns meet over their grams, so a dictionary may be of any size."""
    known = dictionary.select("pattern").distinct()
    verify = word_in(F.col("whole"), F.col("part")) if words else None
    hits = substrings.containing(texts.select(F.col("text_id").alias("whole_id"), F.col("text").alias("whole")), known.select(F.col("pattern").alias("part_id"), F.col("pattern").alias("part")), verify)
    return hits.select(F.col("whole_id").alias("text_id"), F.col("part_id").alias("pattern")).join(dictionary, "pattern").select("text_id", "key", "value", "ordinal")


def tags(queries: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """F8: (query_id, tags) that the words of a query ask for, each once, in the order of the dictionary (key, value, ordinal): the built-in one, which is small and fixed, or a table.
    Each text is looked at once."""
    return ranking.by_text(queries, lambda q: _tags(q, dictionary))


def _tags(queries: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    if dictionary is None:
        known = F.broadcast(dims.dictionary(queries.sparkSession, dims.TAG_WORDS))  # fixed
        hits = queries.join(known, word_in(F.lower("query"), F.col("key")))
    else:
        found = naming(queries.select(F.col("query_id").alias("text_id"), F.lower("query").alias("text")), dictionary.withColumn("pattern", F.col("key")), True)
        hits = found.withColumnRenamed("text_id", "query_id")
    first = hits.groupBy("query_id", "value").agg(F.min("ordinal").alias("ordinal"))
    lists = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"]).alias("tags"))
    return queries.select("query_id").join(lists, "query_id", "left").withColumn("tags", text.listed(F.col("tags")))


def tagged(doc_tags: Column, wanted: Column, part: bool) -> Column:
    """an element in common; F5 (part): an element that contains a wanted one, in any case. Nothing wanted: true."""
    if part:
        hit = F.exists(wanted, lambda w: F.exists(doc_tags, lambda t: F.contains(F.lower(t), F.lower(w))))
    else:
        hit = F.arrays_overlap(doc_tags, wanted)
    return (F.size(wanted) == 0) | hit


def by_product(queries: DataFrame, docs: DataFrame, patterns: DataFrame | None = None, first: bool = False) -> DataFrame:
    """(query_id, doc_id) where both name the same product; first: of each product the document of the smallest id alone. docs: (doc_id, name_text). patterns: (key, value, ordinal), the built-in ones, which are few and fixed, or a
    table. Each side is matched on its own, then joined on the product."""
    if patterns is None:
        known = F.broadcast(dims.dictionary(queries.sparkSession, dims.PRODUCT_PATTERNS))  # fixed
        asked = queries.join(known, F.contains(F.lower(F.trim("query")), F.col("value"))).select("query_id", "key").distinct()
        there = docs.join(known, F.contains(F.lower("name_text"), F.col("value"))).select("doc_id", "key").distinct()
    else:
        known = patterns.withColumn("pattern", F.col("value"))
        asked = naming(queries.select(F.col("query_id").alias("text_id"), F.lower(F.trim("query")).alias("text")), known, False).select(F.col("text_id").alias("query_id"), "key").distinct()
        there = naming(docs.select(F.col("doc_id").alias("text_id"), F.lower("name_text").alias("text")), known, False).select(F.col("text_id").alias("doc_id"), "key").distinct()
    if first:
        there = there.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return asked.join(there, "key").select("query_id", "doc_id").distinct()


def expanded(queries: DataFrame, synonyms: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, tokens) with up to `most` synonyms of each token after all of them, none twice.
    queries: (query_id, tokens); synonyms: (key, value, ordinal)."""
    each = queries.select("query_id", F.posexplode("tokens").alias("pos", "key")).join(synonyms, "key").filter("value <> key")
    first = each.withColumn("n", F.row_number().over(W.partitionBy("query_id", "pos").orderBy("ordinal"))).filter(F.col("n") <= most)
    more = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n", "value"))), lambda x: x["value"]).alias("more"))
    out = queries.join(more, "query_id", "left")
    return out.select("query_id", F.concat("tokens", F.array_except(text.listed(F.col("more")), F.col("tokens"))).alias("tokens"))


def cross_language(queries: DataFrame, docs: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, doc_id, matches): query tokens with a synonym among a document's tokens, each once."""
    asked = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("key")).join(synonyms.filter("value <> key").select("key", "value"), "key")
    there = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("value"))
    return asked.join(there, "value").select("query_id", "doc_id", "key").distinct().groupBy("query_id", "doc_id").agg(F.count("*").alias("matches"))


def beneficiary_of(queries: DataFrame) -> DataFrame:
    """(query_id, beneficiary), the first class of the dictionary with a word in the query, or null."""
    known = F.broadcast(dims.dictionary(queries.sparkSession, dims.BENEFICIARY_WORDS))  # fixed
    hits = queries.join(known, F.contains(F.lower("query"), F.col("value"))).groupBy("query_id").agg(F.min_by("key", "ordinal").alias("beneficiary"))
    return queries.select("query_id").join(hits, "query_id", "left")


def beneficiary_expansion(queries: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, query) followed by those of the first three words of each class it names that it does not have."""
    known = F.broadcast(dims.dictionary(queries.sparkSession, dims.BENEFICIARY_WORDS))  # fixed
    first = known.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("ordinal"))).filter(F.col("n") <= most)
    low = F.lower("query")
    hit = queries.join(known, F.contains(low, F.col("value"))).select("query_id", "query", "key").distinct()
    more = hit.join(F.broadcast(first), "key").filter(~F.contains(low, F.col("value")))
    words = more.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"]).alias("more"))
    return queries.join(words, "query_id", "left").select("query_id", F.array_join(F.concat(F.array("query"), text.listed(F.col("more"))), " ").alias("query"))


def signature_words(passage: Column, class_: Column) -> Column:
    """The signature words in a passage, then its class in lower case."""
    known = [w for words in dims.SIGNATURE_WORDS.values() for w in words]
    low = F.lower(passage)  # outside of any lambda, where Spark makes it once for all words
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in known)))
    return F.concat(found, F.when(class_.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lower(class_))))


def entity_signatures(passages: DataFrame, tokens: str = "tokens", entity: str = "entity_code") -> DataFrame:
    """(entity, token, n, total, share, df, idf) with idf = ln((entities + 1) / (df + 1)) + 1 over entities."""
    own = passages.select(entity, F.explode(tokens).alias("token")).groupBy(entity, "token").agg(F.count("*").alias("n"))
    count = passages.agg(F.count_distinct(entity).alias("entities"))  # one row
    total = own.groupBy("token").agg(F.sum("n").alias("total"), F.count("*").alias("df"))
    return own.join(total, "token").crossJoin(count).select(entity, "token", "n", "total", (F.col("n") / F.col("total")).alias("share"), "df", (F.ln((F.col("entities") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def signature_boost(passage: Column, entity: Column, base: Column, mismatch: Column) -> Column:
    """The factor from idf sums of a query's words found in a passage's, its entity's and the base signature words."""
    total = 0.1 * passage + 0.05 * entity + 0.1 * base
    return numeric.clamped(F.when(mismatch, 0.5 * total).otherwise(total))


# Words of a query that stand for a topic of offers (French, then Arabic).
TOPIC_WORDS = {
    "payment": ["paiement", "payment", "payement", "carte", "eddahabia", "cib", "edahabia", "bancaire", "électronique", "avantage", "دفع", "تسديد", "إلكتروني", "بطاقة", "الذهبية", "رقمي"],
    "ont": ["ont", "modem", "routeur", "wifi", "wi-fi", "wifi 6", "xgs-pon", "xgs", "gpon", "préférentiel", "preferentiel", "tarif", "اونت", "مودم", "راوتر", "واي فاي", "وايفاي", "تفضيلي", "سعر"],
    "school": ["école", "ecole", "écoles", "ecoles", "primaire", "primaires", "scolaire", "établissement", "etablissement", "مدرسة", "مدارس", "ابتدائي", "ابتدائية", "مدرسي", "تعليمي", "مؤسسة"],
    "referral": ["parrainage", "parrainer", "parrain", "sponsoring", "référer", "filleul", "إحالة", "رعاية", "راعي", "مُحال"],
    "business": ["business", "entreprise", "professionnel", "société", "pme", "medium business", "moyen", "pmi", "tpe", "أعمال", "محترف", "مهني", "شركة", "مؤسسة", "صغيرة", "متوسطة"],
    "tenant": ["locataire", "resident", "résident", "location", "sans facture", "sans justificatif", "مستأجر", "ساكن", "كاري", "بدون فاتورة", "بدون إثبات"],
    "home": ["résidentiel", "residentiel", "particulier", "domicile", "maison", "appartement", "سكني", "منزلي", "خواص"],
    "gamer": ["gamer", "gamers", "gaming", "jeux", "joueur", "ps5", "xbox", "جيمر", "ألعاب", "لاعب", "بلايستيشن", "اكس بوكس"],
}


def topics(form: Column, tokens: Column) -> Column:
    """Strength of each topic in a query, and whether it is strong enough to count against other documents."""
    n = {k: F.size(F.array_intersect(tokens, F.array(*map(F.lit, words)))) for k, words in TOPIC_WORDS.items()}
    has = lambda *parts: text.either(form, parts)
    ont, wifi6, special = has("ont", "اونت"), has("wifi 6", "واي فاي 6", "xgs-pon", "xgs"), has("préférentiel", "preferentiel", "تفضيلي")
    school, primary = has("école", "ecole", "مدرسة", "مدارس"), has("primaire", "ابتدائي")
    lte, free = has("4g", "lte", "لتي", "4جي", "الجيل الرابع"), has("sans engagement", "بدون التزام")
    without = F.array_contains(tokens, "sans") | F.array_contains(tokens, "بدون")
    medium = has("medium", "moyen", "متوسطة", "صغيرة")
    level = lambda *pairs: numeric.chained([(c, F.lit(float(x))) for c, x in pairs], 0.0)
    return F.struct(
        level((n["payment"] >= 2, 25), (n["payment"] == 1, 8)).alias("payment"),
        (n["payment"] >= 2).alias("payment_strong"),
        level((ont & (wifi6 | special), 30), (n["ont"] >= 2, 22), (ont | wifi6, 12)).alias("ont"),
        ((ont & (wifi6 | special)) | (n["ont"] >= 2)).alias("ont_strong"),
        level((school & primary, 30), (school | (n["school"] >= 2), 22)).alias("school"),
        level((lte & free, 32), (lte & without, 25), (lte, 15)).alias("lte"),
        (lte & (free | without)).alias("lte_strong"),
        level((n["referral"] >= 1, 30)).alias("referral"),
        level((medium & (n["business"] >= 1), 20), (n["business"] >= 2, 15), (n["business"] >= 1, 8)).alias("business"),
        level((n["tenant"] >= 2, 20), (n["tenant"] >= 1, 15)).alias("tenant"),
        level((n["gamer"] >= 1, 22)).alias("gamer"),
        level((n["home"] >= 2, 15), (n["home"] >= 1, 10)).alias("home"),
    )


#: Words of a query that point to tax texts, to a move to fibre, and to faults.
TAX = ("timbre", "fiscal", "taxe", "طابع", "جبائي", "قانون", "المالية", "ضريبة")
MOVES = ("modernisation", "migration", "basculement", "عصرنة", "تحديث", "تحويل")
FAULTS = ("interruption", "coupure", "ralenti", "lent", "انقطاع", "بطء")
