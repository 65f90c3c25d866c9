"""The entry points end to end, and the operators that only they use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions import dims
from talweg.operators import catalogue, documents, fusion, pipelines, ranking, signatures
from talweg.plans._sql import PASSAGE_WORDS, PRODUCT_WORDS, WORDS, literal, query, table, values
from talweg.plans.catalogues import _FACTS, _MODEL_KEYS, _MODELS, _ORDER_FACTS, _PLAIN, _RE2, _TAGS, _conventions, _pick
from talweg.plans.fulltext import _best, asked, corpus, sections, store
from talweg.plans.routing import ROUTER, _form, index, offers, questions, synonyms
from talweg.plans.search import _minmax, _vectors
from talweg.sources import files

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_GRAMS = f"""w AS (SELECT doc_id, source AS entity, {_TOKENS} AS w FROM documents), g AS (SELECT doc_id, entity, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS token FROM w),
c AS (SELECT entity, token, count(*) AS n FROM g GROUP BY 1, 2), a AS (SELECT token, sum(n) AS everywhere FROM c GROUP BY 1), z AS (SELECT entity, sum(n) AS size FROM c GROUP BY 1), f AS (SELECT doc_id, token FROM g GROUP BY 1, 2),
d AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM f GROUP BY 1),
s AS (SELECT entity, token FROM c JOIN a USING (token) JOIN z USING (entity) WHERE length(token) >= 4 AND everywhere >= 3 AND n / everywhere > 0.6 AND n / size > {signatures.LOCAL / 100})"""


#: Sources hold many more words than establishments do.
_LOCAL = signatures.LOCAL / 100


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as passages of their sources, and the sources' tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("entity_code"), "text")
    return docs, signatures.of_entities(docs, local=_LOCAL)


@query(f"WITH {_GRAMS} SELECT entity, token FROM s")
def signature_terms(spark, sf_dir):
    """With its thresholds."""
    return _sources(spark, sf_dir)[1]


_BASE = literal([w for ws in dims.SIGNATURE_WORDS.values() for w in ws])


@query(f"""WITH {_GRAMS}, e AS (SELECT entity, token FROM s UNION ALL SELECT 'BASE', unnest({_BASE})), q AS (SELECT item_id AS query_id, lower(text) AS low FROM benchmark)
SELECT query_id, entity, token, CAST(round(coalesce(idf, 1), 6) AS DOUBLE) AS idf FROM q JOIN e ON contains(low, token) LEFT JOIN d USING (token)""")
def signature_matches(spark, sf_dir):
    """R13."""
    docs, owned = _sources(spark, sf_dir)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    owned = files.kept(owned, "signatures")
    return signatures.matching(queries, owned, signatures.idf(docs, only=signatures.known(queries, owned))).withColumn("idf", F.round("idf", 6))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Offre "), F.col("p_brand"), F.lit(" à "), F.floor("p_retailprice").cast("string"), F.lit(" DA en "), F.col("p_size").cast("string"), F.lit(" Mbps pour les retraités"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), text.alias("query"))


_PENSIONERS = next((k, v) for k, v in dims.BENEFICIARY_WORDS.items() if "retraités" in v)
_MORE = " ".join(w for w in _PENSIONERS[1][:3] if w not in "offre pour les retraités")


@query(f"""SELECT p_partkey AS query_id, q AS query, trim(q || ' ' || {literal(_MORE)}) AS expanded, {literal(_PENSIONERS[0])} AS beneficiary, CAST(floor(p_retailprice) AS BIGINT) || '' AS prices, CAST(p_size AS DOUBLE) AS speed, array_to_string(regexp_extract_all(q, '[0-9]+'), ',') AS numbers
FROM (SELECT *, 'Offre ' || p_brand || ' à ' || CAST(floor(p_retailprice) AS BIGINT) || ' DA en ' || p_size || ' Mbps pour les retraités' AS q FROM part)""")
def query_records(spark, sf_dir):
    """T28."""
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    out = pipelines.query_record(_asked(spark, sf_dir))
    return out.select("query_id", "query", "expanded", "beneficiary", joined("prices").alias("prices"), F.get("speeds", F.lit(0)).alias("speed"), joined("numbers").alias("numbers"))


_WORDS = "CASE beneficiary " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in dims.BENEFICIARY_WORDS.items()) + " ELSE [] END"


@query(f"""WITH {_ORDER_FACTS}, f AS ({_FACTS}) SELECT id, md5(array_to_string(list_filter(list_concat([text, entity_code, 'Établissement ' || entity_code], {_WORDS}, [price_value || ' DA', price_value || 'DA', CASE WHEN speed_mbps >= 1000 THEN CAST(speed_mbps / 1000 AS VARCHAR) || ' Gbps' END, CAST(speed_mbps AS VARCHAR) || ' Mbps']), lambda x: x IS NOT NULL AND x <> ''), ' ')) AS search_text FROM f""")
def passage_index_text(spark, sf_dir):
    """P17."""
    rows = documents.passages(_conventions(spark, sf_dir))
    return rows.select("id", F.md5(documents.index_text(rows).cast("binary")).alias("search_text"))


@query("SELECT p_partkey AS id, lower(p_brand) || ',' || lower(p_type) AS keywords, lower(p_name) AS product_name, CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE '' END AS category, lower(p_brand) AS provider FROM part")
def product_rows(spark, sf_dir):
    """P8."""
    info = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("category"), F.upper("p_brand").alias("provider"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.col("p_name").alias("text"), F.array("p_brand", "p_type").alias("keywords"), info.alias("product_info"))
    return documents.product_rows(rows).drop("text").withColumn("keywords", F.array_join("keywords", ","))


@query("SELECT l_orderkey, l_suppkey, min(CAST(rank AS BIGINT)) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rank FROM lineitem) GROUP BY 1, 2")
def distinct_first(spark, sf_dir):
    """Of an order's lines, dearest first, the first one of each supplier."""
    from pyspark.sql.window import Window as W

    rank = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber")).cast("long")
    return ranking.distinct_first(table(spark, sf_dir, "lineitem").withColumn("rank", rank), "l_orderkey", "l_suppkey").select("l_orderkey", "l_suppkey", "rank")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(*) FILTER (value <= 200) AS within FROM events GROUP BY 1")
def timings(spark, sf_dir):
    """Totals of times by kind, and how many are short."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.count(F.when(v <= 200, 1)).alias("within"))


@query("SELECT item_id % 200 AS doc_id, item_id, lang, source, quality, toxic FROM benchmark b JOIN documents d ON d.doc_id = b.item_id % 200 JOIN labels l ON l.doc_id = d.doc_id")
def joined_metadata(spark, sf_dir):
    """Index rows with their documents and these with their metadata."""
    hits = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 200).alias("doc_id"), "item_id")
    return catalogue.with_metadata(hits, table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels")).select("doc_id", "item_id", "lang", "source", "quality", "toxic")


# ---- entry points


_SPEEDS, _OFFER_KINDS, _WHO_HAS = [20, 50, 100, 300], ["FIBRE", "VDSL", None], ["retraites", None]
_CODES = sorted(dims.ENTITY_CODES)
# Questions by number: {p} is a price, {s} a speed, {c} an establishment's code.
_QUESTIONS = ["quel est le prix de la fibre à {p} DA", "débit de {s} Mbps pour l'établissement {c}", "convention fibre {p} DA {s} Mbps", "cadres supérieurs et dirigeants fibre", "quels documents fournir", "mots inconnus zzz", "lavender almond {s} Mbps à {p} DA uniquement pour l'établissement {c}"]
_OWN = ["Cadres", "lavender", "almond fibre"]


def _say(k: str) -> str:
    q = f"{literal(_QUESTIONS)}[1 + {k} % {len(_QUESTIONS)}]"
    return f"replace(replace(replace({q}, '{{p}}', CAST(800 + 100 * ({k} % 5) AS VARCHAR)), '{{s}}', CAST({literal(_SPEEDS)}[1 + {k} % 4] AS VARCHAR)), '{{c}}', {literal(_CODES)}[1 + {k} % {len(_CODES)}])"


_PASSAGE = f"""ps AS (SELECT p_partkey AS id, 'c' || p_partkey % 40 AS home, {literal(_CODES)}[1 + p_partkey % {len(_CODES)}] AS code, {literal(_WHO_HAS)}[1 + p_partkey % 2] AS who, {literal(_OFFER_KINDS)}[1 + p_partkey % 3] AS kind, 800 + 100 * (p_partkey % 7) AS price, CAST({literal(_SPEEDS)}[1 + p_partkey % 4] AS DOUBLE) AS speed, p_partkey % 9 = 0 AS free,
CASE p_partkey % 5 WHEN 0 THEN {literal(_OWN)} WHEN 1 THEN ['fibre'] ELSE CAST([] AS VARCHAR[]) END AS own, p_name || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'fibre cadres' WHEN 1 THEN 'documents à fournir' ELSE p_type END || ' à ' || (800 + 100 * (p_partkey % 7)) || ' DA' AS text FROM part)"""
_FOUND = f"""{_PASSAGE}, qs AS (SELECT s_suppkey AS query_id, {_say('s_suppkey')} AS query, s_suppkey % {len(_QUESTIONS)} AS kind, CASE WHEN s_suppkey % {len(_QUESTIONS)} IN (1, 6) THEN [{literal(_CODES)}[1 + s_suppkey % {len(_CODES)}]] ELSE [] END AS ents, CASE WHEN s_suppkey % {len(_QUESTIONS)} IN (0, 2, 6) THEN [800 + 100 * (s_suppkey % 5)] ELSE [] END AS prices, CASE WHEN s_suppkey % {len(_QUESTIONS)} IN (1, 2, 6) THEN [CAST({literal(_SPEEDS)}[1 + s_suppkey % 4] AS DOUBLE)] ELSE [] END AS speeds FROM supplier),
ip AS (SELECT * FROM {values(_RE2, 'intent, priority, pattern')}), ih AS (SELECT query_id, intent, priority, sum(len(regexp_extract_all({_PLAIN}, pattern))) AS hits FROM (SELECT query_id, query FROM qs), ip GROUP BY 1, 2, 3 HAVING sum(len(regexp_extract_all({_PLAIN}, pattern))) > 0), im AS (SELECT query_id, max_by(intent, (hits + 0.1 * priority, priority)) AS intent FROM ih GROUP BY 1),
iw AS (SELECT unnest({literal(list(fusion.INTENT_WEIGHTS))}) AS intent, unnest({literal([b for _, b in fusion.INTENT_WEIGHTS.values()])}) AS sw), ex AS (SELECT query_id, query || CASE WHEN kind = 3 THEN ' ' || {literal(' '.join(w for w in dims.BENEFICIARY_WORDS['cadres_superieurs'][:3] if w not in _QUESTIONS[3]))} ELSE '' END AS query FROM qs),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({PASSAGE_WORDS.format('query')}) AS term FROM ex) GROUP BY 1, 2), dt AS (SELECT id, {PASSAGE_WORDS.format("concat_ws(' ', text, 'Établissement ' || code, who, kind)")} AS toks FROM ps), tot AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dt),
tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(toks) AS len, unnest(toks) AS term FROM dt) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), bs AS (SELECT query_id, id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), tot GROUP BY 1, 2),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM bs) WHERE n <= 100), b2 AS (SELECT query_id, id, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END AS score FROM b1 WINDOW w AS (PARTITION BY query_id)),
nb AS (SELECT b2.*, list_filter(prices, lambda v: abs(v - price) <= 100)[1] AS np, list_filter(speeds, lambda v: v = speed OR abs(v - speed) <= 0.1 * speed)[1] AS ns, price, speed, coalesce(intent, 'GENERAL') AS intent FROM b2 JOIN ps USING (id) JOIN qs USING (query_id) LEFT JOIN im USING (query_id)),
b3 AS (SELECT query_id, id, round(score * sw * CASE WHEN np = price THEN 2 WHEN np IS NOT NULL THEN 1.5 ELSE 1 END * CASE WHEN ns = speed THEN 2 WHEN ns IS NOT NULL THEN 1.5 ELSE 1 END, 6) AS score FROM nb JOIN iw USING (intent)), b4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM b3) WHERE n <= 50),
b5 AS (SELECT query_id, id, score, home, code, own, text, query, len(ents) > 0 AND code <> ents[1] AS off FROM b4 JOIN ps USING (id) JOIN qs USING (query_id) WHERE len(ents) <> 1 OR code = ents[1]),
gw AS (SELECT id, code, {_TOKENS} AS w FROM ps), gg AS (SELECT id, code, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS token FROM gw),
gc AS (SELECT code, token, count(*) AS n FROM gg GROUP BY 1, 2), ga AS (SELECT token, sum(n) AS everywhere FROM gc GROUP BY 1), gz AS (SELECT code, sum(n) AS size FROM gc GROUP BY 1), gi AS (SELECT token, ln(((SELECT count(*) FROM ps) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT DISTINCT id, token FROM gg) GROUP BY 1),
gs AS (SELECT code, token FROM gc JOIN ga USING (token) JOIN gz USING (code) WHERE length(token) >= 4 AND everywhere >= 3 AND n / everywhere > 0.6 AND n / size > {signatures.LOCAL} UNION SELECT code, lower(unnest(own)) FROM ps),
hp AS (SELECT query_id, id, sum(0.1 * coalesce(idf, 1)) AS part FROM (SELECT query_id, id, unnest(list_distinct(list_transform(own, lambda x: lower(x)))) AS token, lower(query) AS low FROM b5) LEFT JOIN gi USING (token) WHERE contains(low, token) GROUP BY 1, 2),
he AS (SELECT query_id, id, sum(0.05 * coalesce(idf, 1)) AS part FROM b5 JOIN gs USING (code) LEFT JOIN gi USING (token) WHERE contains(lower(query), token) AND NOT list_contains(list_transform(own, lambda x: lower(x)), token) GROUP BY 1, 2),
hb AS (SELECT query_id, id, sum(0.1 * coalesce(idf, 1)) AS part FROM (SELECT query_id, id, lower(query) AS low, lower(text) AS body, unnest({_BASE}) AS token FROM b5) LEFT JOIN gi USING (token) WHERE contains(low, token) AND contains(body, token) GROUP BY 1, 2),
sg AS (SELECT b5.query_id, b5.id, home, score * (1 + least(1.0, CASE WHEN off THEN 0.5 ELSE 1 END * coalesce(x.part, 0))) AS score FROM b5 LEFT JOIN (SELECT query_id, id, sum(part) AS part FROM (SELECT * FROM hp UNION ALL SELECT * FROM he UNION ALL SELECT * FROM hb) GROUP BY 1, 2) x USING (query_id, id)),
dn AS (SELECT *, row_number() OVER (PARTITION BY query_id, home ORDER BY score DESC, id) AS n FROM sg), dd AS (SELECT query_id, home AS doc_id, min(CASE WHEN n = 1 THEN id END) AS passage_id, round(max(score) + 0.5 * avg(score), 6) AS doc_score FROM dn WHERE n <= 3 GROUP BY 1, 2)"""


@query(f"WITH {_FOUND} SELECT query_id, doc_id, CAST(passage_id AS BIGINT) AS passage_id, doc_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_score DESC, doc_id) AS rank FROM dd) WHERE rank <= 5")
def convention_search(spark, sf_dir):
    """Parts are passages of forty conventions, suppliers ask."""
    n = F.col("p_partkey")
    price = 800 + 100 * (n % 7)
    own = F.when(n % 5 == 0, F.array(*map(F.lit, _OWN))).when(n % 5 == 1, F.array(F.lit("fibre"))).otherwise(F.array().cast("array<string>"))
    body = F.concat("p_name", F.lit(" "), F.when(n % 4 == 0, "fibre cadres").when(n % 4 == 1, "documents à fournir").otherwise(F.col("p_type")), F.lit(" à "), price.cast("string"), F.lit(" DA"))
    code = _pick(_CODES, n % len(_CODES))
    rows = table(spark, sf_dir, "part").select(n.alias("id"), F.concat(F.lit("c"), (n % 40).cast("string")).alias("doc_id"), code.alias("entity_code"), F.concat(F.lit("Établissement "), code).alias("establishment"), _pick(_WHO_HAS, n % 2).alias("beneficiary"), _pick(_OFFER_KINDS, n % 3).alias("offer_type"), body.alias("text"), price.cast("int").alias("price_value"), _pick(_SPEEDS, n % 4).cast("double").alias("speed_mbps"), (n % 9 == 0).alias("is_free"), own.alias("signature_tokens"))
    k = F.col("s_suppkey")
    filled = _pick(_QUESTIONS, k % len(_QUESTIONS))
    for mark, value in (("{p}", (800 + 100 * (k % 5)).cast("string")), ("{s}", _pick(_SPEEDS, k % 4).cast("string")), ("{c}", _pick(_CODES, k % len(_CODES)))):
        filled = F.replace(filled, F.lit(mark), value)
    return pipelines.conventions(rows, table(spark, sf_dir, "supplier").select(k.alias("query_id"), filled.alias("query")))


_RULED = f"""{ROUTER}, syn2 AS (SELECT key, list(value ORDER BY ordinal) AS m FROM syn WHERE ordinal < 2 GROUP BY 1),
xs AS (SELECT query_id, list_transform({WORDS.format('q')}, lambda w: list_concat([w], coalesce(map_extract_value(syn2, lower(trim(w))), []))) AS steps FROM qf, maps),
xt AS (SELECT query_id, unnest(list_reduce(list_concat([[]], steps), lambda o, x: list_concat(o, [x[1]], list_filter(list_distinct(x[2:]), lambda y: y <> x[1] AND NOT list_contains(o, y))))) AS term FROM xs), qt AS (SELECT query_id, term, count(*) AS times FROM xt GROUP BY 1, 2),
dt AS (SELECT doc_id, {WORDS.format(_form('text'))} AS toks FROM d0), tot AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dt), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM dt) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), mi AS (SELECT avg(ln(n - df + 0.5) - ln(df + 0.5)) AS mean_idf FROM df, tot),
bs AS (SELECT query_id, doc_id, sum(times * CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * mean_idf ELSE ln(n - df + 0.5) - ln(df + 0.5) END * tf * 2.5 / (tf + 1.5 * (0.5 + 0.5 * len / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), tot, mi GROUP BY 1, 2),
j AS (SELECT r.query_id, r.doc_id, r.score AS rule, coalesce(bs.score, 0) AS sparse FROM r LEFT JOIN bs USING (query_id, doc_id)),
f1 AS (SELECT query_id, doc_id, round((sparse - min(sparse) OVER w) / greatest(max(sparse) OVER w - min(sparse) OVER w, 1e-6) + 1.25 * (rule - min(rule) OVER w) / greatest(max(rule) OVER w - min(rule) OVER w, 1e-6), 6) AS score FROM j WINDOW w AS (PARTITION BY query_id)),
al AS (SELECT a.query_id, doc_id, coalesce(bs.score, 0) AS sparse FROM (SELECT DISTINCT query_id FROM qt WHERE query_id NOT IN (SELECT query_id FROM r)) a CROSS JOIN d0 LEFT JOIN bs USING (query_id, doc_id)),
f2 AS (SELECT query_id, doc_id, round(0.7 * (sparse - min(sparse) OVER w) / greatest(max(sparse) OVER w - min(sparse) OVER w, 1e-6), 6) AS score FROM al WINDOW w AS (PARTITION BY query_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2)), o AS (SELECT *, lag(score) OVER (PARTITION BY query_id ORDER BY rank) AS before FROM p WHERE rank <= 10),
k AS (SELECT *, min(CASE WHEN rank = 1 OR (before > 0 AND (before - score) / before < 0.05) THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS ok FROM o)"""


@query(f"WITH {_RULED} SELECT query_id, doc_id, score, rank FROM k WHERE ok = 1 AND rank <= 3")
def offer_search(spark, sf_dir):
    """Suppliers ask for parts as offers."""
    return pipelines.offers(offers(spark, sf_dir), questions(spark, sf_dir), synonyms(spark), index(spark, sf_dir))


_WANTED = f"""tg AS (SELECT * FROM {values(_TAGS, 'key, value, ordinal')}), wq AS (SELECT DISTINCT item_id AS query_id, value FROM benchmark, tg WHERE CASE WHEN contains(lower(text), key) THEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(key) || '($|[^\\p{{L}}\\p{{N}}_])') ELSE false END), wl AS (SELECT query_id, list(value) AS wanted FROM wq GROUP BY 1),
ok AS (SELECT item_id AS query_id, doc_id FROM benchmark CROSS JOIN d LEFT JOIN wl ON wl.query_id = item_id WHERE doc_type = 'section' AND (wanted IS NULL OR len(list_filter(wanted, lambda x: contains(lower(tags), lower(x)))) > 0))"""
_SPLIT = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> ''))"


@query(rf"""WITH {corpus()}, {_WANTED}, sp AS ({_best('(SELECT query_id, doc_id, raw AS score FROM s JOIN ok USING (query_id, doc_id))', 30)}),
dv AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), ds AS (SELECT a.vec_id // 10 AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM dv a, dv b WHERE a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id), de AS ({_best('(SELECT ds.* FROM ds JOIN ok USING (query_id, doc_id))', 30)}),
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.score, 0) AS sparse, coalesce(b.score, 0) AS dense FROM {_minmax('sp', 'half')} a FULL JOIN {_minmax('de', 'half')} b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
t AS (SELECT item_id AS query_id, {_SPLIT.format('text')} AS qw FROM benchmark), u AS (SELECT doc_id, {_SPLIT.format('guide_title')} AS tw FROM d1),
f AS (SELECT j.query_id, j.doc_id, 0.8 * dense + 0.2 * sparse + CASE WHEN len(list_intersect(qw, tw)) >= 2 THEN 0.2 WHEN len(list_intersect(qw, tw)) = 1 AND len(qw) <= 3 THEN 0.1 ELSE 0 END AS score FROM j JOIN t USING (query_id) JOIN u USING (doc_id) WHERE query_id IN (SELECT query_id FROM de) UNION ALL SELECT query_id, doc_id, score FROM sp WHERE query_id NOT IN (SELECT query_id FROM de))
{_best('(SELECT query_id, doc_id, round(score, 6) AS score FROM f)', 10)}""")
def guide_search(spark, sf_dir):
    """Benchmark texts ask, documents are sections of guides; every second query has vector results, too."""
    q, v = _vectors(spark, sf_dir)
    texts = asked(spark, sf_dir)
    # vectors of no text have no results
    q = q.filter("query_id % 20 = 0").join(texts.select((F.col("query_id") * 10).alias("query_id")).distinct(), "query_id", "left_semi")
    dense = fusion.dense_top_k(q, v, 1 << 30, other=True, digits=6).withColumn("query_id", F.expr("query_id div 10"))
    docs = sections(table(spark, sf_dir, "documents")).withColumnRenamed("guide_title", "title")
    return pipelines.guides(docs, texts, store(spark, sf_dir), dense)


_PRODUCT_TEXT = "p_name || ' ' || p_brand || ' ' || p_type"
_NAME_TEXT = f"p_name || ' ' || {literal(_MODELS)}[1 + p_partkey % {len(_MODELS)}]"
_SOUGHT = f"CASE WHEN s_suppkey % 3 = 0 THEN 'prix ' || {literal(_MODELS)}[1 + s_suppkey % {len(_MODELS)}] WHEN s_suppkey % 3 = 1 THEN 'polished steel case' ELSE s_name END"


@query(f"""WITH k AS (SELECT * FROM {values(_MODEL_KEYS, 'key, value')}), qx AS (SELECT s_suppkey AS query_id, {_SOUGHT} AS query FROM supplier), a AS (SELECT DISTINCT query_id, key FROM qx, k WHERE contains(lower(trim(query)), value)), n AS (SELECT DISTINCT p_partkey AS doc_id, key FROM part, k WHERE contains(lower({_NAME_TEXT}), value)),
l1 AS (SELECT query_id, doc_id, 1.0 AS score FROM a JOIN n USING (key)), qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({PRODUCT_WORDS.format('query')}) AS term FROM qx) GROUP BY 1, 2), dt AS (SELECT p_partkey AS doc_id, {PRODUCT_WORDS.format(_PRODUCT_TEXT)} AS toks FROM part),
tot AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dt), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM dt) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), mi AS (SELECT avg(ln(n - df + 0.5) - ln(df + 0.5)) AS mean_idf FROM df, tot),
l2 AS (SELECT query_id, doc_id, round(sum(times * CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * mean_idf ELSE ln(n - df + 0.5) - ln(df + 0.5) END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), tot, mi GROUP BY 1, 2),
u AS (SELECT 1 AS layer, query_id, doc_id, CAST(score AS DOUBLE) AS score FROM l1 UNION ALL SELECT 2, query_id, doc_id, score FROM l2 WHERE score >= 0.55 UNION ALL SELECT 3, s_suppkey, 1 + s_suppkey % 50, CASE WHEN s_suppkey % 2 = 0 THEN 0.4 ELSE 0.05 END FROM supplier)
SELECT query_id, doc_id, score, CAST(layer AS BIGINT) AS layer FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY layer, score DESC, doc_id) AS n FROM u WHERE layer < 3 OR score >= 0.1) WHERE n = 1""")
def product_search(spark, sf_dir):
    """Suppliers ask for models, for what stands in parts' texts, or for nothing that is there; some have a vector result."""
    model = lambda c: _pick(_MODELS, F.col(c) % len(_MODELS))
    key = F.col("s_suppkey")
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" "), model("p_partkey")).alias("name_text"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    sought = table(spark, sf_dir, "supplier").select(key.alias("query_id"), F.when(key % 3 == 0, F.concat(F.lit("prix "), model("s_suppkey"))).when(key % 3 == 1, "polished steel case").otherwise(F.col("s_name")).alias("query"))
    dense = sought.select("query_id", (1 + F.col("query_id") % 50).alias("doc_id"), F.when(F.col("query_id") % 2 == 0, 0.4).otherwise(0.05).alias("score"))
    return pipelines.products(docs, sought, dense).withColumn("score", F.round("score", 6))
