
from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines of a product's text, in order: a heading, or a label and the path of its value.
PRODUCT_LINES = [
    ("Titre document", "metadata.document_title"),
    ("Nom produit", "product_info.name"),
    ("Catégorie", "product_info.category"),
    ("Type produit", "product_info.product_type"),
    ("Fournisseur", "product_info.provider"),
    "Mots-clés:",
    (None, "keywords"),
    "Détails commerciaux:",
    ("Prix précédent", "commercial_details.previous_price_dzd"),
    ("Prix courant", "commercial_details.pricing"),
    ("Options de prix", "commercial_details.pricing_options"),
    ("Canaux de vente", "commercial_details.sales_channels"),
    ("Méthodes de paiement", "commercial_details.payment_methods"),
    ("Renouvellement abonnement", "commercial_details.subscription_renewal"),
    "Caractéristiques matérielles:",
    ("Hardware", "hardware_details"),
    "Contraintes / cible:",
    ("Plateformes supportées", "constraints.supported_platforms"),
    ("Public cible", "constraints.target_audience"),
    ("Niveaux scolaires", "constraints.target_school_levels"),
    "Logistique:",
    ("Mode de livraison", "logistics_policy.delivery_mode"),
    ("Activation", "logistics_policy.activation_flow"),
    "Droits / contenu:",
    ("Scope contenu", "entitlement_details.content_scope"),
    ("Langues contenu", "entitlement_details.content_language"),
    ("Langues interface", "entitlement_details.app_interface_languages"),
    "Spécifications / fonctionnalités:",
    ("Features", "specifications.service_features"),
    ("Modèles", "specifications.models"),
    ("Plans / offres", "specifications.service_plans"),
    "SAV / garantie:",
    ("SAV", "after_sales_service"),
    "Infos diverses:",
    (None, "_unmapped_or_extra_info"),
]
#: Values that count as an empty object where they are missing, and one that is a list of words.
_OBJECTS, _WORDS = ("hardware_details", "after_sales_service"), "keywords"
# Times that differing terms, and titles and names, come in an index text.
DIFFERING, TITLE = 20, 3
# Questions of a context.
QUESTIONS = 3


def _value(document: dict, path: str) -> str:
    """A value as Python's str() shows it; nothing for null."""
    x = document
    for step in path.split("."):
        x = x.get(step) if isinstance(x, dict) else None
    if path == _WORDS:
        return ", ".join(map(str, x or []))
    if path in _OBJECTS:
        x = x or {}
    return "" if x is None else str(x)


def product_text(raw: Column, lines: list | None = None) -> Column:
    """The lines of a product (JSON text): headings, and labels with their values, which stay where a value is missing; what would be an empty line goes.
    A text that is no object has no values. The nested values, in the order of their keys, need Python; the rest is native."""
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    lines = lines or PRODUCT_LINES
    paths = [x[1] for x in lines if not isinstance(x, str)]

    def found(text: str | None) -> list[str]:
        try:
            document = json.loads(text or "")
        except ValueError:
            document = {}
        document = document if isinstance(document, dict) else {}
        return [_value(document, p) for p in paths]

    values = pandas_udf(lambda s: s.map(found), "array<string>", PandasUDFType.SCALAR)(raw)
    heads = F.array(*(F.lit(x if isinstance(x, str) else x[0]) for x in lines))
    at = F.array(*(F.lit(None if isinstance(x, str) else paths.index(x[1])).cast("int") for x in lines))
    line = lambda head, i, v: F.when(i.isNull(), head).when(head.isNull(), F.get(v, i)).otherwise(F.concat(head, F.lit(": "), F.get(v, i)))
    # the values are bound once, as an array of one element
    return F.transform(F.array(values), lambda v: F.array_join(F.filter(F.transform(F.arrays_zip(heads.alias("head"), at.alias("i")), lambda x: line(x["head"], x["i"], v)), lambda x: x != ""), "\n"))[0]


def _there(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _none() -> Column:
    return F.array().cast("array<string>")


def _if(value: Column, *lines: Column | str) -> Column:
    """The lines if there is the value, else none."""
    return F.when(_there(value), F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))).otherwise(_none())


def _list(value: Column) -> Column:
    return F.filter(F.coalesce(value, _none()), lambda x: x.isNotNull())


def _joined(label: str, value: Column, by: str) -> Column:
    return F.when(F.size(_list(value)) > 0, F.array(F.concat(F.lit(label), F.array_join(_list(value), by)))).otherwise(_none())


def _section(title: str, *parts: Column, end: bool = True) -> Column:
    """A heading over the lines, and an empty one behind them; nothing without a line."""
    lines = F.concat(*parts)
    return F.transform(F.array(lines), lambda x: F.when(F.size(x) > 0, F.concat(F.array(F.lit(title)), x, F.array(F.lit("")) if end else _none())).otherwise(_none()))[0]


def _numbered(title: str, value: Column) -> Column:
    return _section(title, F.transform(_list(value), lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x)))


def _faq(value: Column) -> Column:
    kind = "array<struct<question: string, answer: string>>"
    return F.filter(F.coalesce(value, F.array().cast(kind)), lambda x: x.isNotNull())


def _field(x: Column, name: str) -> Column:
    return F.coalesce(x[name], F.lit(""))


def index_text(keyword_boost: int = 3) -> Column:
    """An offer's text for the index: what tells offers apart, DIFFERING times, texts, titles and names TITLE times, the fields of the offer, questions
    and answers, and keywords. Repeats follow each other without a space. Offers without any of these have what fallback_text() finds."""
    c = F.col
    o = lambda f: c(f"offer_core.{f}")
    plain = lambda x: F.replace(x, F.lit("_"), F.lit(" "))
    terms = F.concat(_if(c("product_family"), plain(c("product_family"))), _if(c("doc_type"), plain(c("doc_type"))), F.transform(_list(c("customer_segment")), plain), F.transform(_list(c("technology")), plain), _if(c("commitment_type"), plain(c("commitment_type"))))
    again = lambda x, n: _if(x, F.repeat(x, n))
    words = F.concat(_list(c("keywords")), _list(c("keywords_fr")), _list(c("keywords_ar")))
    asked = lambda f: F.filter(F.flatten(F.transform(_faq(c(f)), lambda x: F.array(_field(x, "question"), _field(x, "answer")))), lambda x: x != "")
    parts = F.concat(
        F.when(F.size(terms) > 0, F.array(F.repeat(F.array_join(terms, " "), DIFFERING))).otherwise(_none()),
        _if(c("search_text"), c("search_text")),
        F.when(_there(c("dense_text_primary")) & ~c("dense_text_primary").eqNullSafe(c("search_text")), F.array("dense_text_primary")).otherwise(_none()),
        again(c("metadata.title_fr"), TITLE), again(c("metadata.title_ar"), TITLE), again(o("name_fr"), TITLE), again(o("name_ar"), TITLE),
        *(_if(o(f), o(f)) for f in ("description_fr", "description_ar")),
        *(_joined("", o(f), " ") for f in ("conditions_fr", "conditions_ar", "benefits_fr", "benefits_ar")),
        *(_if(o(f), o(f)) for f in ("pricing_summary_fr", "pricing_summary_ar")),
        asked("faq_fr"), asked("faq_ar"),
        F.when(F.size(words) > 0, F.array(F.repeat(F.array_join(words, " "), keyword_boost))).otherwise(_none()),
    )
    return F.transform(F.array(parts), lambda x: F.when(F.size(x) > 0, F.array_join(x, " ")).otherwise(fallback_text()))[0]


def fallback_text() -> Column:
    """P10: titles, names, descriptions and policy summaries."""
    fields = ("metadata.title_fr", "metadata.title_ar", "offer_core.name_fr", "offer_core.name_ar", "offer_core.description_fr", "offer_core.description_ar", "policy_summary.summary_fr", "policy_summary.summary_ar")
    return F.array_join(F.filter(F.array(*fields), lambda x: F.coalesce(x, F.lit("")) != ""), " ")


def rich_context() -> Column:
    """An offer's labelled fields and all its questions in one line, for an encoder."""
    c = F.col
    o = lambda f: c(f"offer_core.{f}")
    k = lambda f: c(f"contact.{f}")
    said = lambda label, x: _if(x, F.concat(F.lit(label), x))
    asked = lambda f, lang: F.flatten(F.transform(F.filter(_faq(c(f)), lambda x: (_field(x, "question") != "") | (_field(x, "answer") != "")), lambda x: F.array(F.concat(F.lit(f"FAQ {lang} Q: "), _field(x, "question")), F.concat(F.lit(f"FAQ {lang} A: "), _field(x, "answer")))))
    contact = F.concat(said("Téléphone: ", k("phone")), said("Email: ", k("email")), said("Notes FR: ", k("notes_fr")), said("Notes AR: ", k("notes_ar")))
    parts = F.concat(
        *(said("", c(f)) for f in ("metadata.title_fr", "metadata.title_ar", "product_family")),
        _joined("Technologies: ", c("technology"), ", "), _joined("Segments clients: ", c("customer_segment"), ", "), said("Type d'engagement: ", c("commitment_type")),
        *(said("", o(f)) for f in ("name_fr", "name_ar", "description_fr", "description_ar")),
        _joined("Conditions FR: ", o("conditions_fr"), " | "), _joined("Conditions AR: ", o("conditions_ar"), " | "), _joined("Avantages FR: ", o("benefits_fr"), " | "), _joined("Avantages AR: ", o("benefits_ar"), " | "),
        said("Tarification FR: ", o("pricing_summary_fr")), said("Tarification AR: ", o("pricing_summary_ar")), said("Résumé politique FR: ", c("policy_summary.summary_fr")), said("Résumé politique AR: ", c("policy_summary.summary_ar")),
        asked("faq_fr", "FR"), asked("faq_ar", "AR"), _joined("Contact: ", contact, " | "),
    )
    return F.transform(F.array(parts), lambda x: F.when(F.size(x) > 0, F.array_join(x, " ")).otherwise("No content available"))[0]


def context() -> Column:
    """An offer as sections of lines for a chat model: each with a heading and an empty line behind it, lists numbered, QUESTIONS questions at most of each language, of
    which those without an answer are left out and keep their number."""
    c = F.col
    o = lambda f: c(f"offer_core.{f}")
    k = lambda f: c(f"contact.{f}")
    said = lambda label, x: _if(x, F.concat(F.lit(label), x))
    one = lambda title, x: _section(title, said("  ", x))

    def asked(title: str, field: str, q: str, a: str) -> Column:
        first = F.slice(_faq(c(field)), 1, QUESTIONS)
        numbered = F.transform(first, lambda x, i: F.when((_field(x, "question") != "") & (_field(x, "answer") != ""), F.array(F.concat(F.lit(f"  {q}"), (i + 1).cast("string"), F.lit(": "), x["question"]), F.concat(F.lit(f"  {a}"), (i + 1).cast("string"), F.lit(": "), x["answer"]))).otherwise(_none()))
        return F.when(F.size(first) > 0, F.concat(F.array(F.lit(title)), F.flatten(numbered), F.array(F.lit("")))).otherwise(_none())

    titles = F.concat(said("Titre: ", c("metadata.title_fr")), said("العنوان: ", c("metadata.title_ar")))
    parts = [
        F.array(F.concat(F.lit("[Document ID: "), F.coalesce("document_id", F.lit("Unknown")), F.lit("]")), F.concat(F.lit("[Type: "), F.coalesce("doc_type", F.lit("document")), F.lit("]")), F.lit("")),
        F.transform(F.array(titles), lambda x: F.when(F.size(x) > 0, F.array_append(x, F.lit(""))).otherwise(x))[0],
        _section("Informations:", said("  - Entreprise: ", c("metadata.company")), said("  - Version: ", c("metadata.version")), said("  - Date d'effet: ", c("metadata.effective_date"))),
        _section("Caractéristiques:", said("  - Famille de produit: ", c("product_family")), _joined("  - Technologies: ", c("technology"), ", "), _joined("  - Segments clients: ", c("customer_segment"), ", "), said("  - Type d'engagement: ", c("commitment_type"))),
        _section("Nom de l'offre:", said("  FR: ", o("name_fr")), said("  AR: ", o("name_ar"))),
        one("Description (FR):", o("description_fr")), one("Description (AR):", o("description_ar")),
        _numbered("Conditions (FR):", o("conditions_fr")), _numbered("Conditions (AR):", o("conditions_ar")), _numbered("Avantages (FR):", o("benefits_fr")), _numbered("Avantages (AR):", o("benefits_ar")),
        one("Tarification (FR):", o("pricing_summary_fr")), one("Tarification (AR):", o("pricing_summary_ar")),
        one("Résumé de la politique (FR):", c("policy_summary.summary_fr")), one("Résumé de la politique (AR):", c("policy_summary.summary_ar")),
        asked("Questions Fréquentes (FR):", "faq_fr", "Q", "R"), asked("Questions Fréquentes (AR):", "faq_ar", "س", "ج"),
        _section("Contact:", said("  - Téléphone: ", k("phone")), said("  - Email: ", k("email")), said("  - Notes: ", k("notes_fr")), said("  - ملاحظات: ", k("notes_ar"))),
    ]
    return F.array_join(reduce(lambda a, b: F.concat(a, b), parts), "\n")
