"""Queries over the catalogue, keys, nested documents, rules and evaluation (phases 2, 6, 7, 9, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions import dims, text
from talweg.operators import catalogue, documents, evaluation, ranking, rules
from talweg.plans._sql import PASSAGE_WORDS, literal, query, spread, spread_rows, table, values
from talweg.plans.search import _DENSE, _top, dense_topk

# ---- catalogue: pages are files, hosts are folders

_ENTRIES = r"""e AS (SELECT page_id, regexp_extract(url, '://(.*)$', 1) AS s3_key, regexp_extract(url, '([^/]*)$', 1) AS filename, regexp_extract(url, '://([^/]*)', 1) AS category, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\.([^.]+)$', 1)) AS ext,
CASE WHEN regexp_matches(regexp_extract(url, '([^/]*)$', 1), '(?i)(^|[^\p{L}\p{N}_])AR($|[^\p{L}\p{N}_])') THEN 'AR' ELSE 'FR' END AS lang FROM pages)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url").distinct()
    return catalogue.entries(pages, F.regexp_extract("url", "://(.*)$", 1))


@query(f"WITH {_ENTRIES} SELECT s3_key, filename, category, ext, lang, count(*) OVER () AS total FROM (SELECT DISTINCT s3_key, filename, category, ext, lang FROM e) WHERE contains(lower(s3_key), 'example.com') AND (contains(lower(filename), 'html') OR contains(lower(s3_key), 'html'))")
def catalog_filter(spark, sf_dir):
    """text in the file name or key, in any case, with the total."""
    rows = _entries(spark, sf_dir).distinct().filter(F.contains(F.lower("s3_key"), F.lit("example.com")))
    return catalogue.search(rows, q="HTML")


@query("WITH f AS (SELECT doc_id, lang, source FROM documents WHERE lang = 'fr') SELECT doc_id, lang, source, total, CAST(ceil(total / 7.0) AS BIGINT) AS pages FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY doc_id) AS n FROM f) WHERE n BETWEEN 8 AND 14")
def catalog_page(spark, sf_dir):
    """The second page of seven."""
    rows = table(spark, sf_dir, "documents").filter("lang = 'fr'").select("doc_id", "lang", "source")
    return ranking.page(rows, ["doc_id"], 2)


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(lang), 'src1') OR contains(lower(text), 'src1')")
def multi_field_search(spark, sf_dir):
    return catalogue.any_field(table(spark, sf_dir, "documents"), "SRC1", ["source", "lang", "text"]).select("doc_id", "lang", "source")


@query("SELECT source, lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS long FROM documents GROUP BY 1, 2")
def counts_by_group(spark, sf_dir):
    """G1, G2, G15."""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long"))


@query("SELECT lang || '-' || n_chars % 50 AS filename, array_to_string(list_sort(list_distinct(list(source))), ',') AS keys, CAST(len(list_distinct(list(source))) AS BIGINT) AS n FROM documents GROUP BY 1")
def multimap_keys(spark, sf_dir):
    """G8, K3."""
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("-", "lang", (F.col("n_chars") % 50).cast("string")).alias("filename"), F.col("source").alias("s3_key"))
    return catalogue.multimap(rows).withColumn("keys", F.array_join("keys", ","))


@query("""WITH n AS (SELECT doc_id, source || '-new' AS source, n_chars FROM documents WHERE doc_id % 5 = 0), l AS (SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 5 <> 0) SELECT * FROM l UNION ALL SELECT * FROM n""")
def upsert_keep_last(spark, sf_dir):
    """K4: every fifth document arrives again, twice."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    new = rows.filter("doc_id % 5 = 0")
    arrived = new.withColumns({"source": F.concat("source", F.lit("-old")), "v": F.lit(1)}).unionByName(new.withColumns({"source": F.concat("source", F.lit("-new")), "v": F.lit(2)}))
    return catalogue.keep_last(rows.withColumn("v", F.lit(0)), arrived, "doc_id", "v").drop("v")




@query("""WITH f AS (SELECT p_partkey, 'f' || p_partkey % 300 || CASE p_partkey % 4 WHEN 0 THEN '.odt' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' ELSE '.txt' END AS filename, 'k' || p_partkey AS s3_key FROM part), n AS (SELECT s_suppkey AS name_id, 'F' || s_suppkey % 300 AS stem FROM supplier),
h AS (SELECT name_id, s3_key, CASE regexp_extract(filename, '\\.(.*)$', 1) WHEN 'docx' THEN 1 WHEN 'pdf' THEN 2 WHEN 'odt' THEN 3 ELSE 4 END AS place FROM n JOIN f ON lower(stem) = regexp_replace(filename, '\\.[^.]+$', ''))
SELECT name_id, min_by(s3_key, (place, s3_key)) AS s3_key FROM h GROUP BY 1""")
def prioritized_key_join(spark, sf_dir):
    """J5."""
    ext = F.when(F.col("p_partkey") % 4 == 0, ".odt").when(F.col("p_partkey") % 4 == 1, ".pdf").when(F.col("p_partkey") % 4 == 2, ".docx").otherwise(".txt")
    there = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 300).cast("string"), ext).alias("filename"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("s3_key"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name_id"), F.concat(F.lit("F"), (F.col("s_suppkey") % 300).cast("string")).alias("stem"))
    return catalogue.by_extension(names, there)


_FILES = [("k1", "Offre Gamers.docx"), ("k2", "L'offre.pdf"), ("k3", "GUIDE fibre.pdf"), ("k4", "notice.odt"), ("k5", "notice.pdf"), ("k6", "unique.odt")]
_NAMES = [(1, "Offre Gamers.docx", None), (2, "L’offre.pdf", "gone"), (3, "guide Fibre.PDF", None), (4, "notice.docx", None), (5, "unique.docx", "k5"), (6, "nothing", None), (7, "nothing", "k4")]


@query(f"""WITH k AS (SELECT * FROM {values(_FILES, 's3_key, filename')}), n AS (SELECT name_id, name, existing, translate(name, '’‘`', '''''''') AS q FROM {spread(_NAMES, 'name_id, name, existing', 'customer', 'c_custkey')}),
u AS (SELECT name_id, existing AS s3_key, 0 AS p, 'existing' AS how FROM n WHERE existing IN (SELECT s3_key FROM k) UNION ALL SELECT name_id, s3_key, 1, 'exact' FROM n JOIN k ON name = filename UNION ALL SELECT name_id, s3_key, 2, 'quotes' FROM n JOIN k ON q = filename UNION ALL SELECT name_id, s3_key, 3, 'case' FROM n JOIN k ON lower(q) = lower(filename)
UNION ALL SELECT name_id, s3_key, 4, 'stem' FROM n JOIN (SELECT lower(regexp_replace(filename, '\\.[^.]+$', '')) AS st, min(s3_key) AS s3_key FROM k GROUP BY 1 HAVING count(*) = 1) ON lower(regexp_replace(q, '\\.[^.]+$', '')) = st)
SELECT name_id, min_by(s3_key, (p, s3_key)) AS s3_key, min_by(how, (p, s3_key)) AS how FROM u GROUP BY 1""")
def cascade_key_match(spark, sf_dir):
    """Customers look for files, some with a key that they had."""
    names = spread_rows(table(spark, sf_dir, "customer"), _NAMES, "name_id long, name string, existing string", "c_custkey")
    return catalogue.by_cascade(names, spark.createDataFrame(_FILES, "s3_key string, filename string"))


_FILE_OF = "CASE p_partkey % 3 WHEN 0 THEN 'docs/' || p_name || '.pdf' WHEN 1 THEN upper(p_name) ELSE p_type END"


@query(f"""WITH k AS (SELECT p_partkey AS ordinal, 'k' || p_partkey AS s3_key, {_FILE_OF} AS file FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT p_partkey AS name_id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.pdf' WHEN 2 THEN 'x/' || upper(p_name) || '.PDF' WHEN 3 THEN ' ' || p_type || ' ' ELSE left(p_name, 5) END AS name FROM part),
u AS (SELECT name_id, s3_key, ordinal, 0 AS p, 'exact' AS how FROM n JOIN k ON name = file UNION ALL SELECT name_id, s3_key, ordinal, 1, 'case' FROM n JOIN k ON lower(trim(name)) = lower(trim(file)) UNION ALL SELECT name_id, s3_key, ordinal, 2, 'basename' FROM n JOIN k ON lower(string_split(name, '/')[-1]) = lower(string_split(file, '/')[-1])),
v AS (SELECT name_id, s3_key, ordinal, 3 AS p, 'part' AS how FROM (SELECT *, lower(trim(name)) AS a FROM n WHERE name_id NOT IN (SELECT name_id FROM u)), (SELECT *, lower(trim(file)) AS b FROM k) WHERE (contains(a, b) OR contains(b, a)) AND (length(a) > 5 OR length(b) > 5))
SELECT name_id, min_by(s3_key, (p, ordinal, s3_key)) AS s3_key, min_by(how, (p, ordinal, s3_key)) AS how FROM (SELECT * FROM u UNION ALL SELECT * FROM v) GROUP BY 1""")
def title_key_match(spark, sf_dir):
    """parts' titles look for files that are named after parts."""
    n, name = F.col("p_partkey"), F.col("p_name")
    parts = table(spark, sf_dir, "part")
    file = F.when(n % 3 == 0, F.concat(F.lit("docs/"), name, F.lit(".pdf"))).when(n % 3 == 1, F.upper(name)).otherwise(F.col("p_type"))
    keys = parts.filter("p_partkey % 7 <> 0").select(n.alias("ordinal"), F.concat(F.lit("k"), n.cast("string")).alias("s3_key"), file.alias("filename"))
    title = F.when(n % 5 == 0, name).when(n % 5 == 1, F.concat(name, F.lit(".pdf"))).when(n % 5 == 2, F.concat(F.lit("x/"), F.upper(name), F.lit(".PDF"))).when(n % 5 == 3, F.concat(F.lit(" "), F.col("p_type"), F.lit(" "))).otherwise(F.left(name, F.lit(5)))
    return catalogue.by_title(parts.select(n.alias("name_id"), title.alias("name")), keys)


@query("""WITH d AS (SELECT p_partkey AS doc_id, unnest(list_distinct([lower(p_name), lower(p_type), lower(p_brand)])) AS f FROM part), q AS (SELECT s_suppkey AS query_id, 'ask ' || s_suppkey AS query, (SELECT lower(CASE s_suppkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE ' ' || upper(p_brand) END) FROM part WHERE p_partkey = 1 + s_suppkey) AS title FROM supplier)
SELECT doc_id, array_to_string(list(query ORDER BY query_id), ',') AS queries FROM d JOIN q ON f = trim(title) GROUP BY 1""")
def label_queries(spark, sf_dir):
    """Parts with several labels take the questions of all suppliers whose title is one of these."""
    part = table(spark, sf_dir, "part")
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.array("p_name", "p_type", "p_brand").alias("labels"))
    k = F.col("s_suppkey")
    title = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.col("p_type")).otherwise(F.concat(F.lit(" "), F.upper("p_brand")))
    asked = table(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == k + 1).select(k.alias("query_id"), title.alias("title"), F.concat(F.lit("ask "), k.cast("string")).alias("query"))
    return catalogue.augmented(docs, asked, ",")


@query("""WITH p AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'data/g/f' || c_custkey || '.pdf' WHEN 1 THEN 'data/f' || c_custkey || '.pdf' WHEN 2 THEN 'other/g/f' || c_custkey || '.pdf' ELSE 'f' || c_custkey || '.pdf' END AS path FROM customer), l AS (SELECT CASE c_custkey % 5 WHEN 0 THEN '/r/g/f' WHEN 1 THEN '/r/f' WHEN 2 THEN '/r/data/g/f' WHEN 3 THEN '/r/other/g/f' ELSE '/x/f' END || c_custkey || '.pdf' AS file FROM customer),
t AS (SELECT path, unnest([CASE WHEN contains(path, '/') THEN CASE WHEN starts_with(path, 'data/') THEN path[6:] ELSE path END END, string_split(path, '/')[-1], path]) AS try, unnest([0, 1, 2]) AS place FROM p), b AS (SELECT path, min_by(file, place) AS file FROM t JOIN l ON file = '/r/' || try GROUP BY 1)
SELECT path, coalesce(file, '/r/' || string_split(path, '/')[-1]) AS resolved, file IS NOT NULL AS found FROM p LEFT JOIN b USING (path)""")
def resolved_paths(spark, sf_dir):
    """customers' paths in a listing."""
    k = F.col("c_custkey")
    end = F.concat(k.cast("string"), F.lit(".pdf"))
    at = lambda *heads: F.concat(_pick(list(heads), k % len(heads)), end)
    rows = table(spark, sf_dir, "customer")
    return catalogue.resolved(rows.select(at("data/g/f", "data/f", "other/g/f", "f").alias("path")), rows.select(at("/r/g/f", "/r/f", "/r/data/g/f", "/r/other/g/f", "/x/f").alias("path")), "/r")


_KEYWORDS = [("the", 7, 0), ("de", 3, 1), ("a", 1, 2)]


@query(f"""WITH l AS (SELECT s_suppkey AS label_id, trim(lower(replace(replace(s_name, '#', ' '), '-', ' '))) || CASE s_suppkey % 3 WHEN 0 THEN ' de' ELSE '' END AS f FROM supplier), t AS (SELECT n_nationkey AS doc_id, lower(n_name) AS tf FROM nation), kw AS (SELECT * FROM {values(_KEYWORDS, 'keyword, doc_id, ordinal')}),
k AS (SELECT label_id, min_by(doc_id, ordinal) AS doc_id FROM l JOIN kw ON contains(f, keyword) WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(tf, f) OR contains(f, tf)) GROUP BY 1) SELECT label_id, CAST(doc_id AS BIGINT) AS doc_id, 'keyword' AS how FROM k""")
def keyword_match(spark, sf_dir):
    """suppliers' names with no nation in them go by keywords."""
    label = F.concat(F.replace("s_name", F.lit("#"), F.lit("-")), F.when(F.col("s_suppkey") % 3 == 0, F.lit("_DE")).otherwise(""))
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("label_id"), label.alias("label"))
    titles = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.col("n_name").alias("title"))
    keywords = spark.createDataFrame(_KEYWORDS, "keyword string, doc_id long, ordinal int")
    return catalogue.by_label(labels, titles, text.repaired, keywords)


@query(f"""WITH l AS (SELECT item_id AS label_id, trim(regexp_replace(lower(text), '[\\s\\x{{00A0}}\\x{{202F}}]+', ' ', 'g')) AS f FROM benchmark), t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\\s\\x{{00A0}}\\x{{202F}}]+', ' ', 'g')) AS tf FROM documents),
x AS (SELECT label_id, min(doc_id) AS doc_id FROM l JOIN t ON f = tf GROUP BY 1), p AS (SELECT label_id, min(doc_id) AS doc_id FROM l, t WHERE label_id NOT IN (SELECT label_id FROM x) AND f <> '' AND tf <> '' AND (contains(tf, f) OR contains(f, tf)) GROUP BY 1)
SELECT label_id, doc_id, 'exact' AS how FROM x UNION ALL SELECT label_id, doc_id, 'part' FROM p""")
def label_match(spark, sf_dir):
    """Benchmark texts are labels, documents titles."""
    labels = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("label_id"), F.col("text").alias("label"))
    return catalogue.by_label(labels, table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title")))


@query("SELECT s_suppkey, s_nationkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def hydrate_details(spark, sf_dir):
    """The last row of a key holds."""
    nation = table(spark, sf_dir, "nation")
    details = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.lit("old").alias("n_name"), F.lit(-1).alias("n_regionkey"), F.lit(0).alias("v")).unionByName(nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey", F.lit(1).alias("v")))
    return catalogue.hydrated(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), details, "s_nationkey", "v").drop("v")


# ---- nested documents: customers are guides, orders sections, lines steps

def _guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    step = F.struct(F.col("l_linenumber").alias("step_number"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("action"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("details"), F.when(F.col("l_linestatus") == "O", "open").alias("ui"))
    steps = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    sections = orders.join(steps, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("section_title"), F.col("o_orderpriority").alias("description"), "steps"))).alias("s"))
    whole = customers.join(sections, F.col("c_custkey") == F.col("o_custkey"))
    return whole.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("system"), F.concat(F.lit("process "), F.col("c_nationkey").cast("string")).alias("business_process"), F.concat(F.lit("segment "), F.col("c_mktsegment")).alias("summary"), F.array("c_mktsegment", "c_name").alias("tags"), F.when(F.col("c_acctbal") > 0, F.array(F.lit("solvent"), F.lit("known"))).alias("prerequisites"), F.transform("s", lambda x: x.dropFields("k")).alias("sections"))


_STEP = "'Étape ' || l_linenumber || ': part ' || l_partkey || CASE WHEN l_returnflag <> 'N' THEN ' - ' || l_returnflag ELSE '' END || CASE WHEN l_linestatus = 'O' THEN ' (UI: open)' ELSE '' END"
_ORDERS = f"o AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_custkey IN (SELECT c_custkey FROM customer)), l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, {_STEP} AS line FROM lineitem), c AS (SELECT *, CAST(c_custkey AS VARCHAR) AS guide_id, c_mktsegment || ', ' || c_name AS tags FROM customer)"


@query(f"""WITH {_ORDERS}, g AS (SELECT 'guide_' || guide_id AS doc_id, 'guide' AS doc_type, guide_id, c_name, c_mktsegment, tags, NULL AS section_title, NULL AS step_number, NULL AS step_details, concat_ws(chr(10), 'Guide: ' || c_name, 'Système: ' || c_mktsegment, 'Processus métier: process ' || c_nationkey, 'Résumé: segment ' || c_mktsegment, 'Tags: ' || tags, CASE WHEN c_acctbal > 0 THEN 'Prérequis: solvent known' END) AS text FROM c WHERE c_custkey IN (SELECT o_custkey FROM o)),
s AS (SELECT 'section_' || guide_id || '_' || pos, 'section', guide_id, c_name, c_mktsegment, tags, 'order ' || o_orderkey, NULL, NULL, concat_ws(chr(10), 'Guide: ' || c_name, 'Section: order ' || o_orderkey, 'Description: ' || o_orderpriority, 'Étapes:' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY l_linenumber, 'part ' || l_partkey, line) FROM l WHERE l_orderkey = o_orderkey), 'Tags: ' || tags) FROM o JOIN c ON c_custkey = o_custkey),
p AS (SELECT 'step_' || guide_id || '_' || pos || '_' || l_linenumber, 'step', guide_id, c_name, c_mktsegment, tags, 'order ' || o_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE '' END, concat_ws(chr(10), 'Guide: ' || c_name, 'Section: order ' || o_orderkey, 'Étape ' || l_linenumber || ': part ' || l_partkey, CASE WHEN l_returnflag <> 'N' THEN 'Détails: ' || l_returnflag END, CASE WHEN l_linestatus = 'O' THEN 'Interface: open' END, 'Tags: ' || tags) FROM o JOIN c ON c_custkey = o_custkey JOIN l ON l_orderkey = o_orderkey)
SELECT doc_id, doc_type, guide_id, c_name AS guide_title, c_mktsegment AS system, tags, section_title, CAST(step_number AS INTEGER) AS step_number, step_details, md5(text) AS text FROM (SELECT * FROM g UNION ALL SELECT * FROM s UNION ALL SELECT * FROM p)""")
def guide_levels(spark, sf_dir):
    """P3-P6."""
    out = documents.levels(_guides(spark, sf_dir)).withColumns({"text": F.md5(F.col("text").cast("binary")), "tags": F.array_join("tags", ", ")})
    return out.select("doc_id", "doc_type", "guide_id", "guide_title", "system", "tags", "section_title", "step_number", "step_details", "text")


# ---- conventions: orders, their lines are offers

_PEOPLE = ["Personnel et Retraités", "Cadres supérieurs", "Retraités", "Ayants droit", "", None]
_SEGMENTS = ["Retraités", "Personnel Actif", None, "Cadres supérieurs"]
_KINDS = ["Fibre", "vdsl", "ADSL", "4G", "ftth pro"]


def _pick(values_: list, at: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in values_)), at.cast("int"))


def _conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, code = F.col("o_orderkey"), _pick(sorted(dims.ENTITY_CODES), F.col("o_custkey") % len(dims.ENTITY_CODES))
    number = F.col("l_linenumber")
    price = F.when(F.col("l_returnflag") == "R", "Gratuit").otherwise(F.concat(F.floor("l_extendedprice").cast("string"), F.lit(" DA/Mois")))
    offer = F.struct(_pick(_SEGMENTS, number % 4).alias("category_segment"), _pick(_KINDS, number % 5).alias("offer_type"), F.concat(F.floor("l_quantity").cast("string"), F.lit(" Mbps")).alias("speed"), price.alias("price"), F.when(F.col("l_linestatus") == "O", "modem").alias("benefits"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", offer.alias("offer")))), lambda x: x["offer"]).alias("internet_offers_table"))
    cells = F.create_map(F.lit("Catégorie"), F.lit("Retraités"), F.lit("Tarif"), F.when(key % 8 == 1, "Gratuit").otherwise("3 500 DA"))
    rest = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.lit(""), F.lit("c"), F.col("o_orderpriority"))
    tables = F.array(F.struct(F.lit("Tarifs Modem").alias("table_name"), F.array(cells).alias("data")), F.struct(F.lit("Divers").alias("table_name"), F.array(rest, cells).alias("data")))
    return table(spark, sf_dir, "orders").join(lines, key == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("c"), key.cast("string")).alias("doc_id"),
        F.concat(F.lit("Établissement "), code).alias("establishment"),
        _pick(_PEOPLE, key % 6).alias("beneficiaries"),
        F.when(key % 3 != 0, F.concat(F.lit("Remise "), F.col("o_orderpriority"))).alias("purpose"),
        "internet_offers_table",
        F.when(key % 7 == 0, F.array(F.struct(F.lit("Appels").alias("offer"), F.lit("800 DA").alias("price"), F.when(key % 2 == 0, "fixe").alias("benefits")))).alias("telephony_offers_table"),
        F.when(key % 4 == 1, tables).alias("other_tables"),
        F.when(key % 2 == 0, F.array(F.lit("CNI"), F.lit("Attestation"))).alias("required_documents_new"),
        F.when(key % 5 == 0, F.array(F.lit("Demande"), F.lit("CNI"))).alias("required_documents_switch"),
        F.when(key % 3 == 1, F.array(F.concat(F.lit("Pour les retraités, "), F.col("o_orderstatus")))).alias("notes"),
    )


def _class(x: str) -> str:
    return f"""CASE WHEN regexp_matches(lower({x}), 'cadres supérieurs|cadres superieurs|cadre supérieur') THEN 'cadres_superieurs' WHEN contains(lower({x}), 'retraité') AND NOT regexp_matches(lower({x}), 'personnel|actif') THEN 'retraites'
WHEN regexp_matches(lower({x}), 'actif|activité') AND NOT contains(lower({x}), 'retraité') THEN 'actifs' WHEN contains(lower({x}), 'ayant') AND contains(lower({x}), 'droit') THEN 'ayants_droit' WHEN contains(lower({x}), 'tous') OR (contains(lower({x}), 'personnel') AND contains(lower({x}), 'retraité')) THEN 'tous'
WHEN regexp_matches(lower({x}), 'personnel|employé|salarié') THEN 'actifs' ELSE 'autre' END"""


def _signs(x: str, who: str | None = None) -> str:
    known = literal([w for ws in dims.SIGNATURE_WORDS.values() for w in ws])
    return f"array_to_string(list_sort(list_distinct(list_concat(list_filter({known}, lambda w: contains(lower({x}), w)), {f'[{who}]' if who else '[]'}))), ',')"


_ORDER_FACTS = f"""o AS (SELECT *, 'c' || o_orderkey AS doc_id, {literal(sorted(dims.ENTITY_CODES))}[1 + o_custkey % {len(dims.ENTITY_CODES)}] AS code, {literal(_PEOPLE)}[1 + o_orderkey % 6] AS people, CASE WHEN o_orderkey % 3 <> 0 THEN 'Remise ' || o_orderpriority END AS purpose, CASE WHEN o_orderkey % 8 = 1 THEN 'Gratuit' ELSE '3 500 DA' END AS tariff FROM orders),
l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx, coalesce({literal(_SEGMENTS)}[1 + l_linenumber % 4], 'Tous') AS segment, {literal(_KINDS)}[1 + l_linenumber % 5] AS kind, CAST(floor(l_quantity) AS BIGINT) AS mbps, l_returnflag = 'R' AS free, CAST(floor(l_extendedprice) AS INTEGER) AS da, l_linestatus = 'O' AS modem FROM lineitem),
n AS (SELECT l.*, o.doc_id, o.code, CASE WHEN regexp_matches(upper(kind), 'FIBRE|FTTH') THEN 'FIBRE' WHEN contains(upper(kind), 'VDSL') THEN 'VDSL' WHEN contains(upper(kind), 'ADSL') THEN 'ADSL' ELSE upper(kind) END AS offer, {_class('segment')} AS who FROM l JOIN o ON o_orderkey = l_orderkey)"""


def _fact(kind: str, seed: str, idx: str, label: str, body: str, source: str, price: str = "NULL", speed: str = "NULL", free: str = "false", who: str = "NULL", offer: str = "NULL", segment: str = "NULL", signs: str = "''") -> str:
    return f"SELECT substr(md5(doc_id || '_' || {seed} || '_' || {idx}), 1, 12) AS id, doc_id, code AS entity_code, '{kind}' AS passage_type, '[Etab=' || code || ']' || '{label}' || {body} AS text, CAST({price} AS INTEGER) AS price_value, CAST({speed} AS DOUBLE) AS speed_mbps, {free} AS is_free, {who} AS beneficiary, {offer} AS offer_type, {segment} AS category_segment, {signs} AS signature_tokens FROM {source}"


_FACTS = " UNION ALL ".join([
    _fact("GENERAL", "'general'", "0", "[Type=General] ", "purpose", "o WHERE purpose IS NOT NULL", signs=_signs("purpose")),
    _fact("BENEFICIARY", "'beneficiary'", "0", "[Type=Beneficiary] ", "'Bénéficiaires: ' || people", "o WHERE people <> ''", who=_class("people"), signs=_signs("people", _class("people"))),
    _fact("OFFER", "'internet_offer'", "idx", "[Type=Offer]", "'[Benef=' || who || '] Idoom ' || offer || ' ' || mbps || ' Mbps à ' || CASE WHEN free THEN 'Gratuit' ELSE da || ' DA/Mois' END || CASE WHEN modem THEN ' (modem)' ELSE '' END", "n", "CASE WHEN free THEN 0 ELSE da END", "mbps", "free OR da = 0", "who", "offer", "segment", _signs("segment", "who")),
    _fact("TELEPHONY", "'telephony'", "0", "[Type=Telephony] ", "'Appels: 800 DA' || CASE WHEN o_orderkey % 2 = 0 THEN ' - fixe' ELSE '' END", "o WHERE o_orderkey % 7 = 0", "800", offer="'FIXE'"),
    _fact("EQUIPMENT", "'equipment_0'", "0", "[Type=Equipment] ", "'Tarifs Modem: Retraités - ' || tariff", "o WHERE o_orderkey % 4 = 1", "CASE WHEN tariff = 'Gratuit' THEN 0 ELSE 3500 END", free="tariff = 'Gratuit'", who="'retraites'", signs=_signs("'Retraités'", "'retraites'")),
    _fact("OTHER", "'other_1'", "0", "[Type=Other] ", "'Divers: a: ' || o_orderstatus || ', c: ' || o_orderpriority", "o WHERE o_orderkey % 4 = 1"),
    _fact("OTHER", "'other_1'", "1", "[Type=Other] ", "'Divers: Catégorie: Retraités, Tarif: ' || tariff", "o WHERE o_orderkey % 4 = 1"),
    _fact("DOCUMENTS", "'docs_new'", "0", "[Type=Documents][Action=New] ", "'Documents requis nouvelle souscription: CNI; Attestation'", "o WHERE o_orderkey % 2 = 0"),
    _fact("DOCUMENTS", "'doc_item_new'", "0", "[Type=Documents] ", "'Document requis: CNI'", "o WHERE o_orderkey % 2 = 0"),
    _fact("DOCUMENTS", "'doc_item_new'", "1", "[Type=Documents] ", "'Document requis: Attestation'", "o WHERE o_orderkey % 2 = 0"),
    _fact("DOCUMENTS", "'docs_switch'", "0", "[Type=Documents][Action=Switch] ", "'Documents requis basculement: Demande; CNI'", "o WHERE o_orderkey % 5 = 0"),
    _fact("NOTE", "'note'", "0", "[Type=Note] ", "'Pour les retraités, ' || o_orderstatus", "o WHERE o_orderkey % 3 = 1", signs=_signs("'Pour les retraités, ' || o_orderstatus")),
])


@query(f"WITH {_ORDER_FACTS} {_FACTS}")
def convention_passages(spark, sf_dir):
    """P13-P15, T29, T30."""
    return documents.passages(_conventions(spark, sf_dir)).drop("establishment", "keywords").withColumn("signature_tokens", F.array_join("signature_tokens", ","))


@query("SELECT 'EQ' || (user_id % 5) AS equipe, category, qid, query FROM (SELECT user_id, event_type AS category, '1' AS qid, 'last ' || event_id AS query FROM events UNION ALL SELECT user_id, event_type, '2', event_type FROM events UNION ALL SELECT user_id, 'none', 'x', 'y' FROM events WHERE event_id % 3 = 0)")
def batch_questions(spark, sf_dir):
    """Objects with a key that comes twice, of which the last one holds."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"'), F.col("event_type"), F.lit('": {"1": "first", "2": "'), F.col("event_type"), F.lit('", "1": "last '), F.col("event_id").cast("string"), F.lit('"}'), F.when(F.col("event_id") % 3 == 0, ', "none": {"x": "y"}').otherwise(""), F.lit("}"))
    return documents.questions(e.select(F.concat(F.lit("EQ"), (F.col("user_id") % 5).cast("string")).alias("equipe"), body.alias("question")))


_BOOSTED = "array_to_string(list_filter([repeat(lang, 20), repeat(source, 3), repeat(substr(text, 1, 20), 3), repeat(lang || ' ' || source, 3), substr(text, 1, 100)], lambda x: x <> ''), ' ')"


@query(f"SELECT doc_id, md5({_BOOSTED}) AS boosted, concat_ws(chr(10), 'Langue: ' || lang, 'Source: ' || source) AS labelled, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview, substr(md5(concat_ws('_', source, doc_id)), 1, 12) AS id FROM documents")
def document_texts(spark, sf_dir):
    """P7, P9, P15, P16."""
    head = lambda n: F.substring("text", 1, n)
    out = table(spark, sf_dir, "documents")
    return out.select("doc_id", F.md5(documents.boosted_text(F.col("lang"), F.col("source"), head(20), F.array("lang", "source"), head(100)).cast("binary")).alias("boosted"), documents.labelled_text([("Langue", F.col("lang")), ("Source", F.col("source")), ("Vide", F.lit(""))]).alias("labelled"), text.preview(F.col("text")).alias("preview"), text.short_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"))


@query("""WITH t AS (SELECT conv_id, list({'q': text, 't': turn} ORDER BY turn, text) AS l FROM conversations GROUP BY 1)
SELECT conv_id, md5(array_to_string(list_concat(['conv ' || conv_id], list_transform(l, lambda x: 'Q: ' || x.q || ' R: ' || x.t)), ' | ')) AS context FROM t""")
def rich_context(spark, sf_dir):
    """Turns stand for questions."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    faq = F.transform("turns", lambda t: F.struct(t["text"].alias("question"), t["turn"].cast("string").alias("answer")))
    return turns.select("conv_id", F.md5(documents.rich_context([F.concat(F.lit("conv "), F.col("conv_id").cast("string")), F.lit(None).cast("string")], faq).cast("binary")).alias("context"))


@query(f"""WITH {_ORDER_FACTS}, x AS (SELECT 'Prix ' || kind || ' ' || mbps || ' Mbps Établissement ' || code AS query, doc_id, code, 'PRICE' AS category FROM n WHERE idx < 2 UNION ALL SELECT 'Offres pour ' || substr(people, 1, 30) || ' Établissement ' || code, doc_id, code, 'BENEFICIARY' FROM o WHERE people <> ''
UNION ALL SELECT 'Documents requis pour Établissement ' || code, doc_id, code, 'DOCUMENTS' FROM o WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'Convention Établissement ' || code, doc_id, code, 'GENERAL' FROM o)
SELECT query, doc_id AS expected_doc_id, 'Établissement ' || code AS expected_establishment, category FROM x""")
def synthetic_queries(spark, sf_dir):
    """R22."""
    return documents.synthetic_queries(_conventions(spark, sf_dir))


# ---- rules

_ASKED = [(1, "Quel est le tarif de l'offre fibre 100 Mbps ?"), (2, "quels documents fournir pour l'établissement AD"), (3, "les retraités sont-ils éligibles"), (4, "bonjour"), (5, "combien ça coûte en DA pour Etab = P uniquement"), (6, "convention de l'Établissement F et l'établissement A"), (7, "réactivation 4G LTE avec TVA"), (8, "facture détaillée des appels")]
_PATTERNS = [(name, 5 - i, p) for i, (name, patterns) in enumerate(dims.INTENT_PATTERNS.items()) for p in patterns]
# Word borders for RE2, which knows ASCII ones only: accented letters stand for a base letter of their own.
_PLAIN = "translate(lower(query), 'éèêàâçîôû', 'EEEAACIOU')"
_RE2 = [(name, i, p.translate(str.maketrans("éèêàâçîôû", "EEEAACIOU"))) for name, i, p in _PATTERNS]


@query(f"""WITH q AS (SELECT CAST(query_id AS BIGINT) AS query_id, query FROM {spread(_ASKED, 'query_id, query', 'customer', 'c_custkey')}), p AS (SELECT * FROM {values(_RE2, 'intent, priority, pattern')}), h AS (SELECT query_id, intent, priority, sum(len(regexp_extract_all({_PLAIN}, pattern))) AS hits FROM q, p GROUP BY 1, 2, 3 HAVING sum(len(regexp_extract_all({_PLAIN}, pattern))) > 0),
s AS (SELECT query_id, max_by(intent, (hits + 0.1 * priority, priority)) AS intent, CAST(max(hits + 0.1 * priority) AS DOUBLE) / CAST(sum(hits + 0.1 * priority) AS DOUBLE) AS confidence FROM h GROUP BY 1)
SELECT query_id, coalesce(intent, 'GENERAL') AS intent, round(coalesce(confidence, 0.5), 6) AS confidence FROM q LEFT JOIN s USING (query_id)""")
def intent_classify(spark, sf_dir):
    """R14."""
    return rules.classify(spread_rows(table(spark, sf_dir, "customer"), _ASKED, "query_id long, query string", "c_custkey")).withColumn("confidence", F.round("confidence", 6))


_CODES = sorted(dims.ENTITY_CODES)
# Ways to name an establishment {x}, {y} being another one; some name none, or only if {x} has further forms.
_NAMINGS = ["convention de l'établissement {x}", "Etab = {x} uniquement", "Uniquement pour l'Établissement {x}", "pour l'établissement {x} uniquement", "établissement {x}, puis ETABLISSEMENT {y}", "quel tarif fibre", "{x} est un établissement", "la convention signée avec {x}", "[Etab={x}] seulement", "etab {x}", "établissement{x}", "exclusivement l'etablissement {x}"]


def _namings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    x, y = _pick(_CODES, key % len(_CODES)), _pick(_CODES, (key + 3) % len(_CODES))
    return table(spark, sf_dir, "customer").select(key.alias("query_id"), F.replace(F.replace(_pick(_NAMINGS, F.floor(key / len(_CODES)) % len(_NAMINGS)), F.lit("{x}"), x), F.lit("{y}"), y).alias("query"))


_NAMED = rf"""q AS (SELECT c_custkey AS query_id, replace(replace({literal(_NAMINGS)}[1 + (c_custkey // {len(_CODES)}) % {len(_NAMINGS)}], '{{x}}', {literal(_CODES)}[1 + c_custkey % {len(_CODES)}]), '{{y}}', {literal(_CODES)}[1 + (c_custkey + 3) % {len(_CODES)}]) AS query FROM customer),
c AS (SELECT unnest({literal(_CODES)}) AS code), m AS (SELECT query_id, code FROM (SELECT query_id, strip_accents(query) AS t FROM q), c WHERE regexp_matches(t, '(?i)etablissement\s+' || code || '\b') OR regexp_matches(t, '(?i)etab\s*=?\s*' || code || '\b') OR code IN ('P', 'V') AND regexp_matches(t, '(?i)\b' || code || '\b.*etablissement') OR code = 'P' AND regexp_matches(t, '(?i)convention.*\bP\b')),
f AS (SELECT query_id, query, coalesce(list(code ORDER BY code) FILTER (code IS NOT NULL), []) AS codes FROM q LEFT JOIN m USING (query_id) GROUP BY 1, 2)"""


@query(rf"""WITH {_NAMED} SELECT query_id, array_to_string(codes, ',') AS entities, CAST(CASE len(codes) WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN regexp_matches(strip_accents(query), '(?i)(uniquement|seulement|exclusivement|specifiquement)\s+(pour\s+)?(l'')?etablissement') OR regexp_matches(strip_accents(query), '(?i)pour\s+(l'')?etablissement\s+\w+\s+uniquement') THEN 0.95 ELSE 0.85 END ELSE 0.6 END AS DOUBLE) AS confidence FROM f""")
def entity_detect(spark, sf_dir):
    """R15."""
    q = _namings(spark, sf_dir)
    return q.select("query_id", F.array_join(rules.entities(F.col("query")), ",").alias("entities"), rules.entity_confidence(F.col("query")).alias("confidence"))


@query(f"""WITH {_NAMED}, r AS (SELECT query_id, codes, item_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, item_id) AS rank FROM f, benchmark),
e AS (SELECT *, {literal(_CODES)}[1 + doc_id % {len(_CODES)}] AS entity_code FROM r WHERE rank <= 20) SELECT query_id, doc_id, rank, entity_code FROM e WHERE len(codes) <> 1 OR codes[1] = entity_code""")
def entity_hard_filter(spark, sf_dir):
    """after the cut to twenty. All queries have the same candidates, so these are cut once."""
    found = _namings(spark, sf_dir).select("query_id", rules.entities(F.col("query")).alias("entities"))
    passages = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("query_id"), F.col("item_id").alias("doc_id"), F.length("text").alias("score"), _pick(_CODES, F.col("item_id") % len(_CODES)).alias("entity_code"))
    best = F.broadcast(ranking.top_k(passages, 20).drop("query_id"))  # twenty rows
    return rules.entity_filter(found.select("query_id").join(best, F.lit(True)), found).select("query_id", "doc_id", "rank", "entity_code")


_TAGS = [(k, v, i) for i, (k, v) in enumerate((k, v) for k, tags in dims.TAG_WORDS.items() for v in tags)]


@query(f"""WITH q AS (SELECT CAST(query_id AS BIGINT) AS query_id, query FROM {spread(_ASKED, 'query_id, query', 'customer', 'c_custkey')}), d AS (SELECT * FROM {values(_TAGS, 'key, value, ordinal')}), h AS (SELECT query_id, value, min(ordinal) AS o FROM q JOIN d ON CASE WHEN contains(lower(query), key) THEN regexp_matches(lower(query), '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(key) || '($|[^\\p{{L}}\\p{{N}}_])') ELSE false END GROUP BY 1, 2)
SELECT query_id, coalesce(string_agg(value, ',' ORDER BY o), '') AS tags FROM q LEFT JOIN h USING (query_id) GROUP BY 1""")
def tag_extract(spark, sf_dir):
    """F8."""
    return rules.tags(spread_rows(table(spark, sf_dir, "customer"), _ASKED, "query_id long, query string", "c_custkey")).withColumn("tags", F.array_join("tags", ","))


@query("SELECT doc_id, lang IN ('fr', 'src1') OR source IN ('fr', 'src1') AS exact, contains(lang, 'fr') OR contains(source, 'fr') OR contains(lang, 'src1') OR contains(source, 'src1') AS part FROM documents")
def tag_filters(spark, sf_dir):
    """both named ways."""
    wanted = F.array(F.lit("fr"), F.lit("src1"))
    return table(spark, sf_dir, "documents").select("doc_id", rules.tagged(F.array("lang", "source"), wanted, False).alias("exact"), rules.tagged(F.array("lang", "source"), wanted, True).alias("part"))


_MODELS = [v for vs in dims.PRODUCT_PATTERNS.values() for v in vs]
_MODEL_KEYS = [(k, v) for k, vs in dims.PRODUCT_PATTERNS.items() for v in vs]


@query(f"""WITH k AS (SELECT * FROM {values(_MODEL_KEYS, 'key, value')}), q AS (SELECT s_suppkey AS query_id, ' Prix du ' || upper({literal(_MODELS)}[1 + s_suppkey % {len(_MODELS)}]) || ' ' AS query FROM supplier), d AS (SELECT p_partkey AS doc_id, p_name || ' ' || {literal(_MODELS)}[1 + p_partkey % {len(_MODELS)}] AS name FROM part),
a AS (SELECT DISTINCT query_id, key FROM q, k WHERE contains(lower(trim(query)), value)), t AS (SELECT DISTINCT doc_id, key FROM d, k WHERE contains(lower(name), value)), qn AS (SELECT key, count(*) AS n FROM a GROUP BY 1), dn AS (SELECT key, count(*) AS n FROM t GROUP BY 1)
SELECT 'query' AS side, query_id AS text_id, key, n AS links FROM a JOIN dn USING (key) UNION ALL SELECT 'doc', doc_id, key, n FROM t JOIN qn USING (key)""")
def product_rule(spark, sf_dir):
    """suppliers ask for models, parts have them in their names: each text with each product that it names (its class) and the number of texts of the other
    side that it meets there. The pairs are those of a class."""
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("text_id"), F.lower(F.trim(F.concat(F.lit(" Prix du "), F.upper(_pick(_MODELS, F.col("s_suppkey") % len(_MODELS))), F.lit(" ")))).alias("text"))
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), F.lower(F.concat("p_name", F.lit(" "), _pick(_MODELS, F.col("p_partkey") % len(_MODELS)))).alias("text"))
    known = dims.dictionary(spark, dims.PRODUCT_PATTERNS).withColumn("pattern", F.col("value"))
    asked, there = (rules.naming(x, known, False).select("text_id", "key").distinct() for x in (q, d))
    met = lambda side, one, two: one.join(two.groupBy("key").agg(F.count("*").alias("links")), "key").select(F.lit(side).alias("side"), "text_id", "key", "links")
    return met("query", asked, there).unionByName(met("doc", there, asked))


@query("""WITH k AS (SELECT DISTINCT lower(p_type) AS key FROM part UNION SELECT lower(n_name) FROM nation UNION SELECT unnest(['the', 'de la', 'the and', 'être']) UNION SELECT DISTINCT lower(p_name) FROM part)
SELECT doc_id, count(*) AS named, min(key) AS first FROM documents JOIN k ON CASE WHEN contains(lower(text), key) THEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || regexp_escape(key) || '($|[^\\p{L}\\p{N}_])') ELSE false END GROUP BY 1""")
def phrase_matches(spark, sf_dir):
    """Phrases of a dictionary that grows with the tables, as whole words of documents."""
    part = table(spark, sf_dir, "part")
    few = spark.createDataFrame([("the",), ("de la",), ("the and",), ("être",)], "key string")
    keys = part.select(F.lower("p_type").alias("key")).unionByName(part.select(F.lower("p_name").alias("key"))).unionByName(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("key"))).unionByName(few).distinct()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text"))
    found = rules.naming(docs, keys.select(F.col("key").alias("pattern"), "key", F.col("key").alias("value"), F.lit(0).alias("ordinal")), True)
    return found.groupBy(F.col("text_id").alias("doc_id")).agg(F.count("*").alias("named"), F.min("key").alias("first"))


_W = PASSAGE_WORDS.format("text")


@query(f"""WITH t AS (SELECT source, unnest({_W}) AS token FROM documents), o AS (SELECT source, token, count(*) AS n FROM t GROUP BY 1, 2), g AS (SELECT token, CAST(sum(n) AS BIGINT) AS total, count(*) AS df FROM o GROUP BY 1), c AS (SELECT count(DISTINCT source) AS k FROM documents)
SELECT source, token, n, total, n * 1000000 // total AS share_ppm, df, round(ln((k + 1) / (df + 1)) + 1, 6) AS idf FROM o JOIN g USING (token), c""")
def entity_signatures(spark, sf_dir):
    """Sources are entities."""
    rows = table(spark, sf_dir, "documents").select("source", text.passage_words(F.col("text")).alias("tokens"))
    return rules.entity_signatures(rows, entity="source").withColumns({"share_ppm": F.expr("n * 1000000 div total"), "idf": F.round("idf", 6)}).drop("share")


_BOOSTS = [(1, 2.0, 4.0, 1.0, False), (2, 2.0, 4.0, 1.0, True), (3, 30.0, 0.0, 0.0, False), (4, 0.0, 0.0, 0.0, False)]


@query(f"SELECT CAST(id AS BIGINT) AS id, CAST(round(1 + least(1.0, CASE WHEN m THEN 0.5 ELSE 1 END * (0.1 * p + 0.05 * e + 0.1 * b)), 6) AS DOUBLE) AS factor FROM {spread(_BOOSTS, 'id, p, e, b, m', 'part', 'p_partkey')}")
def signature_boost(spark, sf_dir):
    """R12."""
    rows = spread_rows(table(spark, sf_dir, "part"), _BOOSTS, "id long, p double, e double, b double, m boolean", "p_partkey")
    return rows.select("id", F.round(rules.signature_boost(F.col("p"), F.col("e"), F.col("b"), F.col("m")), 6).alias("factor"))


# ---- evaluation: a hit is a vector with the query's label

_HITS = f"{_DENSE}, r AS ({_top('ds', 10)}), h AS (SELECT q.vec_id AS query_id, q.label, min(r.rank) FILTER (d.label = q.label) AS hit_rank FROM embeddings q JOIN r ON r.query_id = q.vec_id JOIN embeddings d ON d.vec_id = r.doc_id GROUP BY 1, 2)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talweg.operators import fusion
    from talweg.plans.search import _vectors

    q, v = _vectors(spark, sf_dir)
    ranked = fusion.dense_top_k(q, v, 10, other=True, digits=6).join(v.select("doc_id", "label"), "doc_id")
    labels = q.select("query_id", F.col("q_label").alias("expected"))
    return evaluation.first_hits(ranked, labels, F.col("label") == F.col("expected"))


_METRICS = "count(*) AS n, round(avg(CASE WHEN hit_rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN hit_rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0 / hit_rank, 0)), 6) AS mrr"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"WITH {_HITS} SELECT {_METRICS} FROM h")
def recall_mrr(spark, sf_dir):
    """G9, W5."""
    return _rounded(evaluation.metrics(_hits(spark, sf_dir)))


@query(f"WITH {_HITS} SELECT label AS expected, {_METRICS} FROM h GROUP BY 1")
def recall_by_group(spark, sf_dir):
    """G10."""
    return _rounded(evaluation.metrics(_hits(spark, sf_dir), ["expected"]))


@query(f"WITH {_HITS} SELECT coalesce(CAST(hit_rank AS VARCHAR), 'not_found') AS rank, count(*) AS n, round(count(*) / (SELECT count(*) FROM h), 6) AS share FROM h GROUP BY 1")
def error_rank_histogram(spark, sf_dir):
    """G11."""
    return _rounded(evaluation.rank_histogram(_hits(spark, sf_dir)))


@query(f"WITH {_HITS} SELECT label AS expected, count(*) AS n, count(*) FILTER (hit_rank IS NULL OR hit_rank <> 1) AS errors, round(avg(CASE WHEN hit_rank = 1 THEN 0.0 ELSE 1 END), 6) AS error_rate FROM h GROUP BY 1")
def error_rates(spark, sf_dir):
    """By category."""
    return _rounded(evaluation.error_rates(_hits(spark, sf_dir), ["expected"]))


@query(f"WITH {_HITS}, e AS (SELECT * FROM h WHERE hit_rank IS NULL OR hit_rank <> 1 ORDER BY query_id LIMIT 10) SELECT e.query_id, label AS expected, hit_rank, r.doc_id AS found FROM e LEFT JOIN r ON r.query_id = e.query_id AND r.rank = 1")
def first_errors(spark, sf_dir):
    """The first ten queries whose best vector has another label."""
    from talweg.operators import fusion
    from talweg.plans.search import _vectors

    q, v = _vectors(spark, sf_dir)
    ranked = fusion.dense_top_k(q, v, 1, other=True, digits=6)
    return evaluation.first_errors(_hits(spark, sf_dir), ranked).select("query_id", "expected", "hit_rank", "found")


_ANSWERS = "a AS (SELECT o_orderkey AS expected, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS doc_id, o_orderkey % 3 + 1 AS expected_layer, o_custkey % 3 + 1 AS layer, round(o_totalprice / 1000, 2) AS score FROM orders)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("expected"), F.when(key % 5 == 0, None).when(key % 3 == 0, key + 1).otherwise(key).alias("doc_id"), (key % 3 + 1).alias("expected_layer"), (F.col("o_custkey") % 3 + 1).alias("layer"), F.round(F.col("o_totalprice") / 1000, 2).alias("score"))


@query(f"WITH {_ANSWERS} SELECT round(avg(CASE WHEN doc_id = expected THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN doc_id IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(score), 4) AS mean_score, round(avg(CASE WHEN layer = expected_layer THEN 1.0 ELSE 0 END), 6) AS layer_accuracy FROM a")
def layer_metrics(spark, sf_dir):
    """G12."""
    return _rounded(evaluation.layers(_answers(spark, sf_dir))).withColumn("mean_score", F.round("mean_score", 4))


@query(f"WITH {_ANSWERS} SELECT expected_layer, layer, count(*) AS n FROM a GROUP BY 1, 2")
def layer_confusion(spark, sf_dir):
    """G12."""
    return evaluation.confusion(_answers(spark, sf_dir))


@query("""WITH f AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS found, list(DISTINCT l_partkey) FILTER (l_partkey % 2 = 0) AS r FROM lineitem GROUP BY 1), g AS (SELECT l_orderkey, found, list_distinct(list_concat(coalesce(r, []), [CAST(7 AS BIGINT)])) AS rs FROM f),
h AS (SELECT *, CAST(len(list_intersect(found, rs)) AS DOUBLE) AS hits, list_min(list_filter(list_transform(found, lambda x, i: CASE WHEN list_contains(rs, x) THEN i END), lambda x: x IS NOT NULL)) AS fst FROM g)
SELECT l_orderkey, round(hits / len(found), 6) AS precision, round(hits / len(rs), 6) AS recall, round(CASE WHEN hits = 0 THEN 0 ELSE 2 * (hits / len(found)) * (hits / len(rs)) / (hits / len(found) + hits / len(rs)) END, 6) AS f1, round(coalesce(1.0 / fst, 0), 6) AS rr FROM h""")
def precision_recall_f1(spark, sf_dir):
    """The parts of an order against its even ones and part 7."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("found"))
    right = F.array_distinct(F.concat(F.filter("found", lambda x: x % 2 == 0), F.array(F.lit(7).cast("long"))))
    return _rounded(lists.select("l_orderkey", evaluation.set_metrics(F.col("found"), right).alias("m")).select("l_orderkey", "m.*"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 3")
def point_lookup(spark, sf_dir):
    """The predicate reaches the scan."""
    from talweg.sources import files

    return files.lookup(table(spark, sf_dir, "supplier"), "s_suppkey", 3).select("s_suppkey", "s_name")


@query(f"WITH {_DENSE} {_top('ds', 1)}")
def batch_best(spark, sf_dir):
    """The same plan with another limit."""
    return dense_topk(spark, sf_dir).filter("rank = 1")
