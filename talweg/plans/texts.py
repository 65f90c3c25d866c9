
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions import dims, numeric, text
from talweg.operators import ranking, rules
from talweg.plans._sql import PASSAGE_WORDS, PRODUCT_WORDS, WORDS, literal, query, spread, spread_rows, table, values

PHRASES = [
    (1, "Quelle est la vitesse de la Fibre optique ?"),
    (2, "ما هي سرعة الألياف البصرية؟"),
    (3, "عرض Idoom Fibre للمؤسسات"),
    (4, "L'offre sans engagement 4G-LTE, à 1 100 DA/mois"),
    (5, "أهلاً وسهلاً إلى عرض ADSL الجديد مدرسةٌ"),
    (6, "12345 !!"),
    (7, ""),
    (8, "Établissement   scolaire\tprimaire"),
]
_ARABIC_FORM = r"trim(regexp_replace(translate(regexp_replace({0}, '[\x{{064B}}-\x{{065F}}\x{{0670}}\x{{0640}}]', '', 'g'), 'أإآٱىة', 'اااايه'), '[\s\x{{00A0}}\x{{202F}}]+', ' ', 'g'))"
_FRENCH_FORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s''\-]', ' ', 'g'), '[\s\x{{00A0}}\x{{202F}}]+', ' ', 'g'))"
_COUNTS = r"""len(regexp_extract_all({0}, '[\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}]'))::double AS ar, len(regexp_extract_all({0}, '[a-zA-Z\x{{00C0}}-\x{{00FF}}]'))::double AS la"""
_LANGUAGE = "CASE WHEN ar + la = 0 THEN 'fr' WHEN ar / (ar + la) > 0.7 THEN 'ar' WHEN ar / (ar + la) < 0.3 THEN 'fr' ELSE 'mixed' END"


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(PHRASES, "id long, text string").unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), "text"))


_PHRASES = f"(SELECT CAST(id AS BIGINT) AS id, text FROM {values(PHRASES, 'id, text')} UNION ALL SELECT doc_id + 1000, text FROM documents)"


@query(f"SELECT id, {_LANGUAGE} AS language FROM (SELECT id, {_COUNTS.format('text')} FROM {_PHRASES})")
def detect_language(spark, sf_dir):
    return _phrases(spark, sf_dir).select("id", text.language(F.col("text")).alias("language"))


@query(f"""WITH l AS (SELECT id, text, {_LANGUAGE} AS language FROM (SELECT id, text, {_COUNTS.format('text')} FROM {_PHRASES}))
SELECT id, md5(CASE language WHEN 'ar' THEN {_ARABIC_FORM.format('text')} WHEN 'fr' THEN {_FRENCH_FORM.format('text')} ELSE {_FRENCH_FORM.format(_ARABIC_FORM.format('text'))} END) AS form FROM l""")
def normalize_multilingual(spark, sf_dir):
    return _phrases(spark, sf_dir).select("id", F.md5(text.search_form(F.col("text")).cast("binary")).alias("form"))


@query(f"SELECT id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, CAST(len(p) AS BIGINT) AS n_product FROM (SELECT id, {WORDS.format('text')} AS w, {PRODUCT_WORDS.format('text')} AS p FROM {_PHRASES})")
def tokenize_counts(spark, sf_dir):
    w = text.words(F.col("text"))
    return _phrases(spark, sf_dir).select("id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.size(text.product_words(F.col("text"))).cast("long").alias("n_product"))


@query("SELECT doc_id, md5(strip_accents(text)) AS bare FROM documents")
def strip_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.bare(F.col("text")).cast("binary")).alias("bare"))


_SPLIT = r"string_split(trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g'), '[\s\x{00A0}\x{202F}]+', ' ', 'g')), ' ')"


@query(f"""WITH s AS (SELECT item_id, {_SPLIT} AS w FROM benchmark), m AS (SELECT item_id, w, list_filter(w, lambda x: length(x) >= 3 AND NOT list_contains({literal(text.STOP_WORDS)}, lower(x))) AS k FROM s)
SELECT item_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE list_filter(w, lambda x: length(x) >= 2) END, ' ') AS kept FROM m""")
def search_query_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.search_words(F.col("text")), " ").alias("kept"))


_LABELS = [(1, "  Guide «Fibre»  Pro_v2 "), (2, "Ã©chÃ©ancier – RÃ©siliation"), (3, "L’offre ‘Idoom’ `X`"), (4, "GAMERS--2025"), (5, "<<Convention>> Etab_A"), (6, "مدرسة إحالة"), (7, "")]
_REPAIR = "lower(text)"
for _bad, _good in text.REPAIRS:
    _REPAIR = f"replace({_REPAIR}, {literal(_bad)}, {literal(_good)})"
_SPACES = r"'[\s\x{00A0}\x{202F}]+', ' ', 'g'"


@query(f"""SELECT CAST(id AS BIGINT) AS id, trim(regexp_replace(lower({_ARABIC_FORM.format('text')}), {_SPACES})) AS label, trim({_REPAIR}) AS repaired,
translate(text, '’‘`', '''''''') AS quotes, lower(trim(text)) AS title, trim(regexp_replace(lower(text), {_SPACES})) AS folded FROM {spread(_LABELS, 'id, text', 'customer', 'c_custkey')}""")
def label_forms(spark, sf_dir):
    t = F.col("text")
    forms = lambda q: q.select("id", text.label_form(t).alias("label"), text.repaired(t).alias("repaired"), text.straight_quotes(t).alias("quotes"), text.title_form(t).alias("title"), text.folded(t).alias("folded"))
    return ranking.by_text(spread_rows(table(spark, sf_dir, "customer"), _LABELS, "id long, text string", "c_custkey"), forms, "id", "text")


@query(f"""WITH t AS (SELECT item_id, {PASSAGE_WORDS.format('text')} AS w FROM benchmark), g AS (
SELECT item_id, unnest(w) AS g FROM t UNION ALL SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: array_to_string(w[i:i + 1], ' '))) FROM t
UNION ALL SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) FROM t)
SELECT g AS gram, count(*) AS n, count(DISTINCT item_id) AS items FROM g GROUP BY 1""")
def gram_counts(spark, sf_dir):
    each = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.grams(text.passage_words(F.col("text")))).alias("gram"))
    return each.groupBy("gram").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"))


PRICES = [(1, "4 250 DA"), (2, "990 DA par mois"), (3, "offert, gratuit"), (4, "de 75 à 80 da"), (5, "12 000"), (6, "650DA/an"), (7, None), (8, "sur devis"), (9, "dans 640 DA"), (10, "")]
_PRICE = r"CASE WHEN contains(lower({0}), 'gratuit') THEN 0 ELSE try_cast(regexp_replace(regexp_extract(regexp_replace(lower({0}), '(?s)(mois|month|mensuel|année|an).*', ''), '([0-9][0-9\s]*)', 1), '\s', '', 'g') AS INTEGER) END"


@query(f"""SELECT CAST(id AS BIGINT) AS id, {_PRICE.format('text')} AS price FROM (SELECT id, text FROM {values(PRICES, 'id, text')} UNION ALL
SELECT 1000 + l_orderkey * 10 + l_linenumber, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || ' DA/Mois' FROM lineitem)""")
def parse_price(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select((1000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.floor("l_extendedprice").cast("string"), F.lit(" DA/Mois")).alias("text"))
    return spark.createDataFrame(PRICES, "id long, text string").unionByName(items).select("id", numeric.price(F.col("text")).alias("price"))


SPEEDS = [(1, "2,4 GBIT/s"), (2, "75 Mbit/s"), (3, "0.5 gb/s"), (4, "40mb/s"), (5, "256 Kbps"), (6, "64 kb/s"), (7, "9"), (8, "10"), (9, "vite"), (10, None), (11, "4.5.6 Mbps"), (12, "2 Gbps ou 50 Mbps")]
_SPEED = "try_cast(replace(regexp_extract(lower(text), '([0-9.,]+)', 1), ',', '.') AS DOUBLE)"


@query(f"""SELECT CAST(id AS BIGINT) AS id, CASE WHEN regexp_matches(lower(text), 'gbps|gbit|gb/s') THEN v * 1000 WHEN regexp_matches(lower(text), 'mbps|mbit|mb/s') THEN v WHEN regexp_matches(lower(text), 'kbps|kbit|kb/s') THEN v / 1000 WHEN v < 10 THEN v * 1000 ELSE v END AS mbps
FROM (SELECT id, text, {_SPEED} AS v FROM {spread(SPEEDS, 'id, text', 'customer', 'c_custkey')})""")
def parse_speed(spark, sf_dir):
    return spread_rows(table(spark, sf_dir, "customer"), SPEEDS, "id long, text string", "c_custkey").select("id", numeric.speed(F.col("text")).alias("mbps"))


CLASSES = [(1, "un cadre supérieur"), (2, "retraités, personnel"), (3, "en activité"), (4, "un retraité"), (5, "pour tous"), (6, "les ayants leur droit"), (7, None), (8, "ftth et vdsl"), (9, "Telephonie"), (10, "chaque employé"), (11, "visiteur"), (12, "retraité actif"), (13, "ADSL")]


@query(f"""SELECT CAST(id AS BIGINT) AS id, CASE WHEN regexp_matches(l, 'cadres supérieurs|cadres superieurs|cadre supérieur') THEN 'cadres_superieurs' WHEN contains(l, 'retraité') AND NOT regexp_matches(l, 'personnel|actif') THEN 'retraites'
WHEN regexp_matches(l, 'actif|activité') AND NOT contains(l, 'retraité') THEN 'actifs' WHEN contains(l, 'ayant') AND contains(l, 'droit') THEN 'ayants_droit' WHEN contains(l, 'tous') OR (contains(l, 'personnel') AND contains(l, 'retraité')) THEN 'tous'
WHEN regexp_matches(l, 'personnel|employé|salarié') THEN 'actifs' ELSE 'autre' END AS class, CASE WHEN regexp_matches(upper(l), 'FIBRE|FTTH') THEN 'FIBRE' WHEN contains(upper(l), 'VDSL') THEN 'VDSL' WHEN contains(upper(l), 'ADSL') THEN 'ADSL' WHEN regexp_matches(upper(l), 'FIXE|TELEPHON') THEN 'FIXE' ELSE 'AUTRE' END AS offer
FROM (SELECT id, lower(coalesce(text, '')) AS l FROM {spread(CLASSES, 'id, text', 'customer', 'c_custkey')})""")
def beneficiary_class(spark, sf_dir):
    t = F.col("text")
    return spread_rows(table(spark, sf_dir, "customer"), CLASSES, "id long, text string", "c_custkey").select("id", numeric.beneficiary(t).alias("class"), numeric.offer_type(t).alias("offer"))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 10) AS v FROM lineitem), n AS (SELECT *, list_sort(list_transform({list(numeric.COMMON_PRICES)}, lambda k: {{'gap': abs(v - k), 'k': k}}))[1] AS best FROM p)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CASE WHEN best.gap <= 0.1 * v THEN best.k ELSE v END AS DOUBLE) AS near FROM n""")
def nearest_price(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("v", F.floor(F.col("l_extendedprice") / 10))
    return items.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), numeric.nearest(F.col("v"), numeric.COMMON_PRICES).alias("near"))


ASKED = [(1, "offre à 1 100 DA ou 800 da en 100 Mbps"), (2, "fibre 1.5 Gbps moins de 3500DA"), (3, "rien"), (4, "20 Mbps et 300 mbps")]


@query(f"""SELECT CAST(id AS BIGINT) AS id, array_to_string(list_transform(regexp_extract_all(lower(text), '([0-9][0-9\\s]*)\\s*da', 1), lambda x: regexp_replace(x, '\\s', '', 'g')), ',') AS prices,
CAST(len(regexp_extract_all(lower(text), '[0-9][0-9.,]*\\s*(gbps|mbps|gbit|mbit)')) AS BIGINT) AS n_speeds, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS numbers FROM {spread(ASKED, 'id, text', 'customer', 'c_custkey')}""")
def query_numbers(spark, sf_dir):
    t = F.col("text")
    joined = lambda x: F.array_join(x.cast("array<string>"), ",")
    return spread_rows(table(spark, sf_dir, "customer"), ASKED, "id long, text string", "c_custkey").select("id", joined(numeric.query_prices(t)).alias("prices"), F.size(numeric.query_speeds(t)).cast("long").alias("n_speeds"), joined(numeric.query_numbers(t)).alias("numbers"))


NAMES = [(1, "Offres/Argumentaire Gamers FR.docx"), (2, "Conventions/Convention Etab A AR.pdf"), (3, "Guides/دليل.pdf"), (4, "Produits/notice_arabe.odt"), (5, "Offres/Carte.PDF"), (6, "Guides/guide français.docx")]


@query(f"""SELECT CAST(id AS BIGINT) AS id, string_split(path, '/')[1] AS category, string_split(path, '/')[-1] AS filename, regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '') AS stem, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext,
CASE WHEN regexp_matches(path, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'AR' WHEN regexp_matches(lower(path), 'arabe|arabic') THEN 'AR' WHEN regexp_matches(lower(path), 'francais|français|french') THEN 'FR'
WHEN regexp_matches(path, '(?i)(^|[^\\p{{L}}\\p{{N}}_])AR($|[^\\p{{L}}\\p{{N}}_])') THEN 'AR' ELSE 'FR' END AS lang, replace(url_encode(path), '%2F', '/') AS quoted,
CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'odt' THEN 'application/vnd.oasis.opendocument.text' ELSE 'application/octet-stream' END AS kind
FROM {spread(NAMES, 'id, path', 'customer', 'c_custkey')}""")
def filename_facts(spark, sf_dir):
    facts = spread_rows(table(spark, sf_dir, "customer"), NAMES, "id long, path string", "c_custkey").withColumn("f", text.path_facts(F.col("path")))
    return facts.select("id", "f.*", text.filename_language(F.col("f.filename")).alias("lang"), text.quoted(F.col("path")).alias("quoted"), text.content_type(F.col("f.ext")).alias("kind"))


SYNONYMS = [("fibre", "fibre optique", 0), ("fibre", "fibre", 1), ("fibre", "الألياف", 2), ("fibre", "ftth", 3), ("vitesse", "vitesse", 4), ("vitesse", "débit", 5), ("vitesse", "سرعة", 6), ("offre", "promotion", 7), ("offre", "عرض", 8)]
EXPAND = [(1, ["offre", "fibre", "vitesse"]), (2, ["fibre", "ftth", "fibre"]), (3, ["modem"])]


@query(f"""WITH q AS (SELECT CAST(query_id AS BIGINT) AS query_id, tokens FROM {spread(EXPAND, 'query_id, tokens', 'customer', 'c_custkey')}), s AS (SELECT * FROM {values(SYNONYMS, 'key, value, ordinal')}),
e AS (SELECT query_id, unnest(tokens) AS key, generate_subscripts(tokens, 1) AS pos FROM q), r AS (SELECT query_id, pos, value, row_number() OVER (PARTITION BY query_id, pos ORDER BY ordinal) AS n FROM e JOIN s USING (key) WHERE value <> key),
k AS (SELECT query_id, value, min((pos, n)) AS place FROM r WHERE n <= 2 GROUP BY 1, 2), m AS (SELECT k.query_id, list(value ORDER BY place) AS more FROM k JOIN q ON q.query_id = k.query_id WHERE NOT list_contains(tokens, value) GROUP BY 1)
SELECT query_id, array_to_string(list_concat(tokens, coalesce(more, [])), ' ') AS tokens FROM q LEFT JOIN m USING (query_id)""")
def synonym_expansion(spark, sf_dir):
    queries, synonyms = spread_rows(table(spark, sf_dir, "customer"), EXPAND, "query_id long, tokens array<string>", "c_custkey"), spark.createDataFrame(SYNONYMS, "key string, value string, ordinal int")
    return rules.expanded(queries, synonyms).select("query_id", F.array_join("tokens", " ").alias("tokens"))


WHO = [(1, "remise pour les employés et la famille"), (2, "quel tarif"), (3, "Retraités uniquement"), (4, "tous les employés")]
_WHO = [(k, v, i) for i, (k, v) in enumerate((k, v) for k, words in dims.BENEFICIARY_WORDS.items() for v in words)]


@query(f"""WITH q AS (SELECT CAST(query_id AS BIGINT) AS query_id, query FROM {spread(WHO, 'query_id, query', 'customer', 'c_custkey')}), d AS (SELECT * FROM {values(_WHO, 'key, value, ordinal')}), h AS (SELECT DISTINCT query_id, query, key FROM q JOIN d ON contains(lower(query), value)),
m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ordinal) AS n FROM d), l AS (SELECT query_id, list(value ORDER BY ordinal) AS more FROM h JOIN m USING (key) WHERE n <= 3 AND NOT contains(lower(query), value) GROUP BY 1),
b AS (SELECT query_id, min_by(key, ordinal) AS beneficiary FROM q JOIN d ON contains(lower(query), value) GROUP BY 1)
SELECT query_id, beneficiary, array_to_string(list_concat([query], coalesce(more, [])), ' ') AS query FROM q LEFT JOIN l USING (query_id) LEFT JOIN b USING (query_id)""")
def beneficiary_queries(spark, sf_dir):
    queries = spread_rows(table(spark, sf_dir, "customer"), WHO, "query_id long, query string", "c_custkey")
    return rules.beneficiary_of(queries).join(rules.beneficiary_expansion(queries), "query_id")
