"""The rule router and the offers that it leads to, over parts as offers and suppliers' questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.operators import ranking, routing, rules
from talweg.plans._sql import WORDS, literal, query, table, values
from talweg.plans.catalogues import _pick
from talweg.sources import files

TYPES = ["payment_benefits", "offer", "tax_policy", "technical", "service_quality"]
FAMILIES = ["payment_card", "ont_wifi_6", "idoom_4g_lte", "referral", "idoom_gamer", "tax_stamp", "modernisation_fibre", "moohtarif", "xgs-pon", ""]
SEGMENTS = ["residential", "locataire", "business", "enterprise", "school_primary", "residential_business"]
TECHNOLOGIES = ["fibre", "4g_lte", "adsl", "vdsl"]
COMMITMENTS = ["no_commitment", "monthly"]
USAGES = ["home_gaming", "office"]
ARABIC = ["عرض الألياف", "عرض خواص", "بطاقة دفع"]
PHRASES = ["paiement par carte cib", "tarif wifi 6 ont préférentiel", "école primaire", "4g lte sans engagement", "4g lte", "parrainage filleul", "pme medium business", "locataire sans facture", "locataire gamer", "particulier maison", "timbre fiscal", "migration adsl vers fibre", "coupure et débit lent", "بطاقة دفع إلكتروني", "سعر الألياف", "technical offer", "entreprise", "gaming ps5", "bonjour"]
# Some synonyms; a real dictionary is a table of the same columns.
SYNONYMS = {"fibre": ["fibre optique", "fibre", "الألياف"], "الألياف": ["fibre", "فيبر"], "tarif": ["tarif", "prix", "سعر"], "سعر": ["tarif", "prix"], "technical": ["technical", "coupure", "panne"], "gaming": ["gaming", "gamer", "jeux"], "card": ["carte"], "carte": ["card", "بطاقه"], "offer": ["offre", "عرض"], "locataire": ["locataire", "résident"], "entreprise": ["entreprise", "enterprise"], "enterprise": ["entreprise", "société"], "steel": ["copper", "brass", "nickel"]}
_ROWS = [(k, v, i) for k, vs in SYNONYMS.items() for i, v in enumerate(vs)]


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as offers."""
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        n.alias("doc_id"), _pick(TYPES, n % 5).alias("doc_type"), F.nullif(_pick(FAMILIES, n % 10), F.lit("")).alias("family"),
        F.array(_pick(SEGMENTS, F.floor(n / 3) % 6), _pick(SEGMENTS, F.floor(n / 7) % 6)).alias("segments"), F.array(_pick(TECHNOLOGIES, F.floor(n / 2) % 4)).alias("technologies"),
        _pick(COMMITMENTS, F.floor(n / 5) % 2).alias("commitment"), F.array(_pick(USAGES, F.floor(n / 11) % 2)).alias("usage"), F.array("p_type", F.lit(None).cast("string")).alias("keywords"), F.col("p_name").alias("title_fr"), _pick(ARABIC, n % 3).alias("title_ar"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand", _pick(ARABIC, n % 3)).alias("text"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers ask, some of them with a word of a part's type."""
    key = F.col("s_suppkey")
    words = F.when(key % 4 == 0, F.lit(" STEEL")).when(key % 4 == 1, F.lit(" polished")).otherwise("")
    return table(spark, sf_dir, "supplier").select(key.alias("query_id"), F.concat(_pick(PHRASES, key % len(PHRASES)), words).alias("query"))


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ROWS, "key string, value string, ordinal int")


def index(spark: SparkSession, sf_dir: str) -> routing.Index:
    """The offers' routing index, made once for each application and state of the table."""
    folder = files.own_folder(spark, f"routing-{files.fingerprint(spark, f'{sf_dir}/part.parquet')}")
    return routing.Index.stored(offers(spark, sf_dir), synonyms(spark), folder)


def _at(list_: list, place: str) -> str:
    return f"{literal(list_)}[1 + {place}]"


def _form(x: str) -> str:
    """Search forms of texts with common signs."""
    arabic, latin = f"len(regexp_extract_all({x}, '[\\x{{0600}}-\\x{{06FF}}]'))", f"len(regexp_extract_all({x}, '[a-zA-ZÀ-ÿ]'))"
    one = f"trim(translate({x}, 'أإآٱىة', 'اااايه'))"
    french = lambda y: f"trim(regexp_replace(regexp_replace(lower({y}), '[^\\p{{L}}\\p{{N}}_\\s''-]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"CASE WHEN {arabic} > 0.7 * ({arabic} + {latin}) THEN {one} WHEN {arabic} + {latin} = 0 OR {arabic} < 0.3 * ({arabic} + {latin}) THEN {french(x)} ELSE {french(one)} END"


def _topic(name: str) -> str:
    return f"len(list_intersect(t, {literal(rules.TOPIC_WORDS[name])}))"


def _has(column: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({column}, {literal(p)})" for p in parts) + ")"


def _seg(*parts: str) -> str:
    return f"len(list_filter(segs, lambda s: {_has('s', *parts)})) > 0"


_LEVELS = f"""l AS (SELECT *, CASE WHEN {_topic('payment')} >= 2 THEN 25 WHEN {_topic('payment')} = 1 THEN 8 ELSE 0 END AS pay, {_topic('payment')} >= 2 AS pay_s,
{_has('q', 'ont', 'اونت')} AS ont_p, {_has('q', 'wifi 6', 'واي فاي 6', 'xgs-pon', 'xgs')} OR {_has('q', 'préférentiel', 'preferentiel', 'تفضيلي')} AS ont_x, {_has('q', 'wifi 6', 'واي فاي 6', 'xgs-pon', 'xgs')} AS wifi6,
{_has('q', 'école', 'ecole', 'مدرسة', 'مدارس')} AS sch, {_has('q', 'primaire', 'ابتدائي')} AS prim, {_has('q', '4g', 'lte', 'لتي', '4جي', 'الجيل الرابع')} AS ltp, {_has('q', 'sans engagement', 'بدون التزام')} AS fre, list_contains(t, 'sans') OR list_contains(t, 'بدون') AS wout,
{_has('q', 'medium', 'moyen', 'متوسطة', 'صغيرة')} AS med FROM qq),
v AS (SELECT *, CASE WHEN ont_p AND ont_x THEN 30 WHEN {_topic('ont')} >= 2 THEN 22 WHEN ont_p OR wifi6 THEN 12 ELSE 0 END AS ont, (ont_p AND ont_x) OR {_topic('ont')} >= 2 AS ont_s, CASE WHEN sch AND prim THEN 30 WHEN sch OR {_topic('school')} >= 2 THEN 22 ELSE 0 END AS school,
CASE WHEN ltp AND fre THEN 32 WHEN ltp AND wout THEN 25 WHEN ltp THEN 15 ELSE 0 END AS lte, ltp AND (fre OR wout) AS lte_s, CASE WHEN {_topic('referral')} >= 1 THEN 30 ELSE 0 END AS ref, CASE WHEN med AND {_topic('business')} >= 1 THEN 20 WHEN {_topic('business')} >= 2 THEN 15 WHEN {_topic('business')} >= 1 THEN 8 ELSE 0 END AS bus,
CASE WHEN {_topic('tenant')} >= 2 THEN 20 WHEN {_topic('tenant')} >= 1 THEN 15 ELSE 0 END AS ten, CASE WHEN {_topic('home')} >= 2 THEN 15 WHEN {_topic('home')} >= 1 THEN 10 ELSE 0 END AS hom, CASE WHEN {_topic('gamer')} >= 1 THEN 22 ELSE 0 END AS gam FROM l)"""
_MEDIUM = _has("low", "moohtarif", "medium_business")
#: One term of the score after another, each document being looked at by each query.
_TOPICS = [
    f"CASE WHEN pay_s THEN CASE WHEN {_has('low', 'payment')} OR kind = 'payment_benefits' THEN pay ELSE -10 END WHEN pay > 0 AND {_has('low', 'payment')} THEN pay ELSE 0 END",
    f"CASE WHEN ont_s THEN CASE WHEN {_has('low', 'ont', 'wifi_6', 'xgs-pon')} THEN ont ELSE -12 END WHEN ont > 0 AND {_has('low', 'ont')} THEN ont ELSE 0 END",
    f"CASE WHEN school > 0 THEN CASE WHEN {_seg('school', 'primary')} THEN school ELSE -20 END ELSE 0 END",
    f"CASE WHEN lte_s THEN CASE WHEN {_has('low', '4g_lte')} AND comm = 'no_commitment' THEN lte WHEN {_has('low', '4g_lte')} THEN lte * 0.7 ELSE -15 END WHEN lte > 0 AND {_has('low', '4g_lte')} THEN lte ELSE 0 END",
    f"CASE WHEN ref > 0 THEN CASE WHEN {_has('low', 'referral', 'parrainage')} THEN ref ELSE -20 END ELSE 0 END",
    f"CASE WHEN bus > 0 THEN CASE WHEN {_seg('business', 'enterprise')} THEN bus - CASE WHEN {_seg('locataire')} AND NOT {_MEDIUM} THEN 10 ELSE 0 END - CASE WHEN {_seg('residential')} AND NOT {_seg('business')} THEN 12 ELSE 0 END ELSE -10 END ELSE 0 END",
    f"CASE WHEN ten > 0 THEN CASE WHEN {_seg('locataire')} THEN ten - CASE WHEN {_seg('business')} AND NOT {_MEDIUM} THEN 8 ELSE 0 END - CASE WHEN gam = 0 AND {_has('low', 'gamer')} THEN 10 ELSE 0 END ELSE -12 END ELSE 0 END",
    f"CASE WHEN gam > 0 THEN CASE WHEN {_has('low', 'gamer')} THEN gam + CASE WHEN ten > 0 AND {_seg('locataire')} THEN 8 ELSE 0 END ELSE -15 END ELSE 0 END",
    f"CASE WHEN hom > 0 AND {_seg('residential')} THEN hom - CASE WHEN {_seg('business')} THEN 10 ELSE 0 END ELSE 0 END",
    f"CASE WHEN {_has('q', *rules.TAX)} THEN CASE WHEN kind = 'tax_policy' THEN 15 ELSE 0 END + CASE WHEN fam = 'tax_stamp' THEN 15 ELSE 0 END ELSE 0 END",
    f"CASE WHEN {_has('q', *rules.MOVES)} AND {_has('fam', 'modernisation')} THEN 10 ELSE 0 END",
    f"CASE WHEN {_has('q', '4g', 'lte', 'adsl', 'vdsl')} AND {_has('q', 'vers', 'fibre', 'modernisation', 'migration', 'الألياف')} AND {_has('low', 'modernisation')} THEN 12 ELSE 0 END",
    f"CASE WHEN {_has('q', *rules.FAULTS)} AND kind IN ('technical', 'service_quality') THEN 8 ELSE 0 END",
]


def _label(form: str, alts: str, a: float, b: float) -> str:
    return f"CASE WHEN list_contains(t, {form}) THEN {a} ELSE 0 END + CASE WHEN len(list_intersect(t, {alts})) > 0 THEN {b} ELSE 0 END"


def _lists(xs: str, name: str, a: float, b: float) -> str:
    return f"coalesce(list_sum(list_transform({xs}, lambda x: {_label('x.f', 'x.m', a, b)})), 0)"


_LABELS_OF = "list_transform({0}, lambda x: struct_pack(f := x, m := list_concat([x], coalesce(map_extract_value(syn4, x), []))))"
_PARTS = "list_transform({0}, lambda x: string_split(x, '_'))"
#: CTEs up to r(query_id, doc_id, score, rank): the router's candidates.
ROUTER = f"""syn AS (SELECT * FROM {values(_ROWS, 'key, value, ordinal')}), maps AS (SELECT map_from_entries(list((key, l[:2]))) AS syn2, map_from_entries(list((key, l[:4]))) AS syn4, map_from_entries(list((key, l[:9]))) AS syn9 FROM (SELECT key, list(value ORDER BY ordinal) AS l FROM syn GROUP BY 1)),
qf AS (SELECT s_suppkey AS query_id, raw, {_form('raw')} AS q FROM (SELECT s_suppkey, {_at(PHRASES, f's_suppkey % {len(PHRASES)}')} || CASE s_suppkey % 4 WHEN 0 THEN ' STEEL' WHEN 1 THEN ' polished' ELSE '' END AS raw FROM supplier)),
qo AS (SELECT *, list_distinct(list_append({WORDS.format('q')}, q)) AS own FROM qf),
qq AS (SELECT query_id, q, list_distinct(list_concat(own, list_transform(own, lambda x: lower(trim(x))), flatten(list_transform(own, lambda x: coalesce(map_extract_value(syn2, lower(trim(x))), []))))) AS t FROM qo, maps), {_LEVELS},
d0 AS (SELECT p_partkey AS doc_id, {_at(TYPES, 'p_partkey % 5')} AS kind, {_at(FAMILIES, 'p_partkey % 10')} AS fam, [{_at(SEGMENTS, '(p_partkey // 3) % 6')}, {_at(SEGMENTS, '(p_partkey // 7) % 6')}] AS segs, [{_at(TECHNOLOGIES, '(p_partkey // 2) % 4')}] AS techs, {_at(COMMITMENTS, '(p_partkey // 5) % 2')} AS comm, [{_at(USAGES, '(p_partkey // 11) % 2')}] AS uses, {_form('p_type')} AS kw, {WORDS.format(_form('p_name'))} AS fr, {WORDS.format(_form(_at(ARABIC, 'p_partkey % 3')))} AS ar, p_name || ' ' || p_type || ' ' || p_brand || ' ' || {_at(ARABIC, 'p_partkey % 3')} AS text FROM part),
d1 AS (SELECT *, lower(fam) AS low, list_distinct(list_concat([kind], CASE WHEN fam = '' THEN [] ELSE [fam] END, techs, segs, [comm], [kw], list_filter(fr, lambda w: length(w) > 3), list_filter(ar, lambda w: length(w) > 2))) AS raw FROM d0),
dd AS (SELECT *, list_distinct(list_concat(raw, list_transform(raw, lambda x: lower(trim(x))), flatten(list_transform(raw, lambda x: coalesce(map_extract_value(syn2, lower(trim(x))), []))), flatten({_PARTS.format("list_concat([fam], techs, segs, uses)")}), uses, {WORDS.format('kw')}, CASE WHEN comm = 'no_commitment' THEN {literal(routing.NO_COMMITMENT)} ELSE [] END)) AS tokens,
{_LABELS_OF.format('[kind]')} AS lk, {_LABELS_OF.format("CASE WHEN fam = '' THEN [] ELSE [fam] END")} AS lf, {_LABELS_OF.format('segs')} AS ls, {_LABELS_OF.format('techs')} AS lt FROM d1, maps),
qx AS (SELECT *, list_transform(list_filter(t, lambda x: x <> ''), lambda x: list_concat([lower(trim(x))], coalesce(map_extract_value(syn9, lower(trim(x))), []))) AS crosses FROM v, maps),
sc AS (SELECT query_id, doc_id, round(CAST(1.5 * len(list_intersect(t, tokens)) + len(list_filter(crosses, lambda x: len(list_intersect(x, tokens)) > 0)) + {' + '.join(_TOPICS)}
+ {_lists('lk', 'kind', 5, 3)} + {_lists('lf', 'fam', 5, 3)} + {_lists('ls', 'segs', 3, 2)} + {_lists('lt', 'techs', 2, 1.5)} AS DOUBLE), 6) AS score FROM qx, dd),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= {routing.POOL})"""


@query(f"WITH {ROUTER} SELECT query_id, doc_id, score, rank FROM r")
def rule_router(spark, sf_dir):
    """The fifteen best offers of each question."""
    return ranking.by_text(questions(spark, sf_dir), lambda q: routing.routed(index(spark, sf_dir), q, synonyms(spark)))
