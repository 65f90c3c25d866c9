
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions import dims, numeric, text
from talweg.operators import rules
from talweg.sources import files


def _line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label + ": "), value))


def step_line(step: Column) -> Column:
    """`Étape n: action - details (UI: ui)`, parts that are missing left out."""
    detail = F.when(F.coalesce(step["details"], F.lit("")) != "", F.concat(F.lit(" - "), step["details"])).otherwise("")
    ui = F.when(F.coalesce(step["ui"], F.lit("")) != "", F.concat(F.lit(" (UI: "), step["ui"], F.lit(")"))).otherwise("")
    return F.concat(F.lit("Étape "), step["step_number"].cast("string"), F.lit(": "), F.coalesce(step["action"], F.lit("")), detail, ui)


#: Columns of a guide that its rows of all levels carry; those that a table lacks are null.
GUIDE = {"id": "guide_id", "title": "guide_title", "filename": "filename", "relative_path": "relative_path", "system": "system", "tags": "tags", "date": "date", "language": "language", "summary": "summary", "business_process": "business_process", "s3_key": "s3_key"}
#: Further columns, those of sections and steps; null above their level.
BELOW = {"section_title": "string", "section_description": "string", "step_number": "int", "step_action": "string", "step_details": "string", "step_ui": "string"}


def _some(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _named(label: str, value: Column) -> Column:
    return F.concat(F.lit(label + ": "), _some(value))


def _level(rows: DataFrame, kind: str, doc_id: Column, lines: list[Column], below: dict[str, Column]) -> DataFrame:
    kinds = {"tags": "array<string>", "language": "array<string>"}
    own = [(F.col(c) if c in rows.columns else F.lit(None).cast(kinds.get(c, "string"))).alias(name) for c, name in GUIDE.items()]
    more = [(below[c] if c in below else F.lit(None)).cast(t).alias(c) for c, t in BELOW.items()]
    return rows.select(doc_id.alias("doc_id"), F.lit(kind).alias("doc_type"), F.concat_ws("\n", *lines).alias("text"), *own, *more)


def _tags() -> Column:
    return _named("Tags", F.array_join("tags", ", "))


def guide_rows(guides: DataFrame) -> DataFrame:
    """One row per guide. The line of prerequisites is there only if there are any."""
    needs = text.listed(F.col("prerequisites"))
    lines = [_named("Guide", F.col("title")), _named("Système", F.col("system")), _named("Processus métier", F.col("business_process")), _named("Résumé", F.col("summary")), _tags(), F.when(F.size(needs) > 0, _named("Prérequis", F.array_join(needs, " ")))]
    return _level(guides, "guide", F.concat(F.lit("guide_"), F.col("id")), lines, {})


def section_rows(guides: DataFrame) -> DataFrame:
    """One row per section, with the lines of its steps."""
    rows = guides.select("*", F.posexplode("sections").alias("pos_", "section_"))
    steps = F.col("section_.steps")
    lines = [_named("Guide", F.col("title")), _named("Section", F.col("section_.section_title")), _named("Description", F.col("section_.description")), F.when(F.size(steps) > 0, F.concat(F.lit("Étapes:\n"), F.array_join(F.transform(steps, step_line), "\n"))), _tags()]
    return _level(rows, "section", F.concat_ws("_", F.lit("section"), "id", F.col("pos_").cast("string")), lines, {"section_title": F.col("section_.section_title"), "section_description": _some(F.col("section_.description"))})


def step_rows(guides: DataFrame) -> DataFrame:
    """P5: one row per step."""
    rows = guides.select("*", F.posexplode("sections").alias("pos_", "section_")).select("*", F.explode("section_.steps").alias("step_"))
    step = lambda c: F.col(f"step_.{c}")
    head = F.concat(F.lit("Étape "), step("step_number").cast("string"), F.lit(": "), _some(step("action")))
    lines = [_named("Guide", F.col("title")), _named("Section", F.col("section_.section_title")), head, _line("Détails", step("details")), _line("Interface", step("ui")), _tags()]
    below = {"section_title": F.col("section_.section_title"), "section_description": _some(F.col("section_.description")), "step_number": step("step_number"), "step_action": step("action"), "step_details": _some(step("details")), "step_ui": _some(step("ui"))}
    return _level(rows, "step", F.concat_ws("_", F.lit("step"), "id", F.col("pos_").cast("string"), step("step_number").cast("string")), lines, below)


def levels(guides: DataFrame) -> DataFrame:
    """Guides, sections and steps as one table."""
    return guide_rows(guides).unionByName(section_rows(guides)).unionByName(step_rows(guides))


def boosted_text(differing: Column, title: Column, name: Column, keywords: Column, rest: Column, keyword_boost: int = 3) -> Column:
    """Differing terms twenty times, title and name three times, keywords `keyword_boost` times, then the rest. Repeats follow
    each other without a space."""
    some = lambda x: F.coalesce(x, F.lit(""))
    parts = F.array(F.repeat(some(differing), 20), F.repeat(some(title), 3), F.repeat(some(name), 3), F.repeat(some(F.array_join(keywords, " ")), keyword_boost), some(rest))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def labelled_text(fields: list[tuple[str, Column]]) -> Column:
    """`label: value` lines of the fields that have a value; nested values as JSON."""
    return F.concat_ws("\n", *(_line(label, value) for label, value in fields))


def rich_context(parts: list[Column], faq: Column) -> Column:
    """The parts that have a value, then all questions with answers, joined by ` | `."""
    asked = F.transform(faq, lambda x: F.concat(F.lit("Q: "), x["question"], F.lit(" R: "), x["answer"]))
    return F.array_join(F.filter(F.concat(F.array(*parts), asked), lambda x: F.coalesce(x, F.lit("")) != ""), " | ")


_PASSAGE = ("doc_id", "establishment", "entity_code", "passage_type", "text", "price_value", "speed_mbps", "is_free", "beneficiary", "offer_type", "category_segment", "keywords", "signature_tokens")


def entity_code(establishment: Column, names: dict[str, str] | None = None) -> Column:
    """The code of the first of `names` in the establishment's, else that behind "l'établissement" as a word of its own (any quote, any case; the surveyed map takes A for
    AD, too), else its last word in upper case, else UNK."""
    low = F.lower(text.straight_quotes(_some(establishment)))
    coded = F.upper(F.regexp_extract(low, rf"l'établissement\s+({'|'.join(c.lower() for c in dims.ENTITY_CODES)})(?!{text.WORD})", 1))
    words = F.filter(F.split(_some(establishment), r"\s+"), lambda w: w != "")
    last = F.coalesce(F.upper(F.element_at(F.when(F.size(words) > 0, words), -1)), F.lit("UNK"))
    known = F.when(coded != "", coded).otherwise(last)
    return reduce(lambda out, x: F.when(F.contains(low, F.lit(x[0].lower())), x[1]).otherwise(out), reversed(list((names or {}).items())), known)


def passages(docs: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """The facts of each convention as typed passages with an id of their own.

    docs: doc_id, establishment, beneficiaries, purpose, keywords, internet_offers_table (array of category_segment, offer_type, speed,
    price, benefits), telephony_offers_table (offer, price, benefits), other_tables (table_name, data array<map>),
    required_documents_new, required_documents_switch, notes (arrays of strings). Missing fields give no passages. A missing
    category of an offer is `Tous`. names: codes of establishments by a part of their names.
    """
    null = lambda kind: F.lit(None).cast(kind)
    docs = docs.withColumn("establishment", _some(F.col("establishment")))
    # a code is made once for each establishment, not for each convention and type of passage
    codes = docs.select("establishment").distinct().withColumn("entity_code", entity_code(F.col("establishment"), names))
    docs = docs.join(files.kept(codes, "codes"), "establishment")
    docs = docs.withColumn("keywords", text.listed(F.col("keywords")) if "keywords" in docs.columns else F.array().cast("array<string>"))
    head = ("doc_id", "establishment", "entity_code", "keywords")

    def rows(df: DataFrame, kind: Column | str, seed: Column | str, idx: Column, label: str, body: Column, price: Column | None = None, speed: Column | None = None, free: Column | None = None, who: Column | None = None, offer: Column | None = None, segment: Column | None = None, signs: Column | None = None) -> DataFrame:
        kind, seed = (F.lit(x) if isinstance(x, str) else x for x in (kind, seed))
        marks = F.concat(F.lit("[Etab="), F.col("entity_code"), F.lit("]"), F.lit(label))
        none = F.array().cast("array<string>")
        return df.select(
            text.short_id(F.col("doc_id").cast("string"), seed, idx.cast("string")).alias("id"),
            *head[:3],
            kind.alias("passage_type"),
            F.concat(marks, body).alias("text"),
            (price if price is not None else null("int")).alias("price_value"),
            (speed if speed is not None else null("double")).alias("speed_mbps"),
            F.coalesce(free, F.lit(False)).alias("is_free") if free is not None else F.lit(False).alias("is_free"),
            (who if who is not None else null("string")).alias("beneficiary"),
            (offer if offer is not None else null("string")).alias("offer_type"),
            (segment if segment is not None else null("string")).alias("category_segment"),
            "keywords",
            (F.sort_array(F.array_distinct(signs)) if signs is not None else none).alias("signature_tokens"),
        )

    signs = lambda body, who=None: rules.signature_words(body, who if who is not None else null("string"))
    zero = F.lit(0)
    purpose, people = F.col("purpose"), F.col("beneficiaries")
    general = rows(docs.filter(_some(purpose) != ""), "GENERAL", "general", zero, "[Type=General] ", purpose, signs=signs(purpose))
    who = numeric.beneficiary(people)
    entitled = rows(docs.filter(_some(people) != ""), "BENEFICIARY", "beneficiary", zero, "[Type=Beneficiary] ", _named("Bénéficiaires", people), who=who, signs=signs(people, who))
    net = docs.select(*head, F.posexplode("internet_offers_table").alias("idx", "o"))
    o = lambda c: _some(F.col(f"o.{c}"))
    segment, upper = F.coalesce("o.category_segment", F.lit("Tous")), F.upper(o("offer_type"))
    kind = F.when(text.either(upper, ("FIBRE", "FTTH")), "FIBRE").when(text.either(upper, ("VDSL",)), "VDSL").when(text.either(upper, ("ADSL",)), "ADSL").otherwise(upper)
    extra = lambda before, after: F.when(o("benefits") != "", F.concat(F.lit(before), o("benefits"), F.lit(after))).otherwise("")
    # a generator makes an offer's class, price and kind once; a projection would make them anew wherever they are used
    made = F.struct("o", segment.alias("segment"), numeric.beneficiary(segment).alias("who"), numeric.price(o("price")).alias("price"), kind.alias("kind"))
    net = net.select(*head, "idx", F.inline(F.array(made)))
    segment, who, price, kind = (F.col(c) for c in ("segment", "who", "price", "kind"))
    body = F.concat(F.lit("[Benef="), who, F.lit("] Idoom "), kind, F.lit(" "), o("speed"), F.lit(" à "), o("price"), extra(" (", ")"))
    offers = rows(net, "OFFER", "internet_offer", F.col("idx"), "[Type=Offer]", body, price, numeric.speed(o("speed")), F.contains(F.lower(o("price")), F.lit("gratuit")) | (price == 0), who, kind, segment, signs(segment, who))
    tel = docs.select(*head, F.posexplode("telephony_offers_table").alias("idx", "o"))
    phone = rows(tel, "TELEPHONY", "telephony", F.col("idx"), "[Type=Telephony] ", F.concat(o("offer"), F.lit(": "), o("price"), extra(" - ", "")), numeric.price(o("price")), offer=F.lit("FIXE"))
    tables = docs.select(*head, F.posexplode("other_tables").alias("at", "t")).select(*head, "at", _some(F.col("t.table_name")).alias("table_name"), F.posexplode("t.data").alias("idx", "cells"))
    is_equipment = text.either(F.upper("table_name"), ("ONT", "ÉQUIPEMENT", "MODEM"))
    cell = lambda *names_: F.coalesce(*(F.element_at("cells", F.lit(n)) for n in names_), F.lit(""))
    category, tariff = cell("Catégorie", "category"), cell("Tarif", "tarif", "price")
    who, price = numeric.beneficiary(category), numeric.price(tariff)
    equipment = rows(tables.filter(is_equipment), "EQUIPMENT", F.concat(F.lit("equipment_"), F.col("at").cast("string")), F.col("idx"), "[Type=Equipment] ", F.concat("table_name", F.lit(": "), category, F.lit(" - "), tariff), price, free=F.contains(F.lower(tariff), F.lit("gratuit")) | (price == 0), who=who, signs=signs(category, who))
    filled = F.filter(F.map_entries("cells"), lambda e: _some(e["value"]) != "")
    other = rows(tables.filter(~is_equipment), "OTHER", F.concat(F.lit("other_"), F.col("at").cast("string")), F.col("idx"), "[Type=Other] ", F.concat("table_name", F.lit(": "), F.array_join(F.transform(filled, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")))
    new, switch = text.listed(F.col("required_documents_new")), text.listed(F.col("required_documents_switch"))
    papers = rows(docs.filter(F.size(new) > 0), "DOCUMENTS", "docs_new", zero, "[Type=Documents][Action=New] ", _named("Documents requis nouvelle souscription", F.array_join(new, "; ")))
    each = rows(docs.select(*head, F.posexplode(new).alias("idx", "paper")), "DOCUMENTS", "doc_item_new", F.col("idx"), "[Type=Documents] ", _named("Document requis", F.col("paper")))
    moves = rows(docs.filter(F.size(switch) > 0), "DOCUMENTS", "docs_switch", zero, "[Type=Documents][Action=Switch] ", _named("Documents requis basculement", F.array_join(switch, "; ")))
    notes = rows(docs.select(*head, F.posexplode("notes").alias("idx", "note")), "NOTE", "note", F.col("idx"), "[Type=Note] ", F.col("note"), signs=signs(F.col("note")))
    return reduce(DataFrame.unionByName, (general, entitled, offers, phone, equipment, other, papers, each, moves, notes)).select("id", *_PASSAGE)


def questions(batches: DataFrame, column: str = "question") -> DataFrame:
    """(equipe, category, qid, query) of nested batches {category: {id: text}}, given as a JSON string column. Of equal
    keys of an object the last one holds, in the place of the first."""

    def last(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
        return F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1))

    outer = F.map_entries(F.from_json(F.col(column), "map<string,map<string,string>>"))
    each = batches.select("equipe", F.explode(last(outer)).alias("c"))
    each = each.select("equipe", F.col("c.key").alias("category"), F.explode(last(F.map_entries("c.value"))).alias("q"))
    return each.select("equipe", "category", F.col("q.key").alias("qid"), F.col("q.value").alias("query"))


def synthetic_queries(docs: DataFrame) -> DataFrame:
    """Labelled queries (query, expected_doc_id, expected_establishment, category) of each convention: its first two internet
    offers if they have price and speed, its beneficiaries (30 characters of them) and papers if it has any, and a general one."""
    home = _some(F.col("establishment"))
    offers = F.slice(F.coalesce("internet_offers_table", F.expr("array()")), 1, 2)
    priced = F.filter(offers, lambda o: (_some(o["price"]) != "") & (_some(o["speed"]) != ""))

    def one(there: Column, query: Column, category: str) -> Column:
        return F.when(there, F.struct(query.alias("query"), F.lit(category).alias("category")))

    people = _some(F.col("beneficiaries"))
    asked = F.concat(
        F.transform(priced, lambda o: F.struct(F.concat(F.lit("Prix "), _some(o["offer_type"]), F.lit(" "), o["speed"], F.lit(" "), home).alias("query"), F.lit("PRICE").alias("category"))),
        F.array_compact(F.array(
            one(people != "", F.concat(F.lit("Offres pour "), F.substring(people, 1, 30), F.lit(" "), home), "BENEFICIARY"),
            one(F.size(text.listed(F.col("required_documents_new"))) > 0, F.concat(F.lit("Documents requis pour "), home), "DOCUMENTS"),
            one(F.lit(True), F.concat(F.lit("Convention "), home), "GENERAL"),
        )),
    )
    return docs.select(F.col("doc_id").alias("expected_doc_id"), home.alias("expected_establishment"), F.inline(asked)).select("query", "expected_doc_id", "expected_establishment", "category")


def index_text(passages: DataFrame) -> Column:
    """A passage's text for an index: its text, establishment, all words of its class, and spellings of its price and speed;
    what is missing or empty is left out. A column over those of passages()."""
    words = F.create_map(*(x for k, v in dims.BENEFICIARY_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    price, speed = F.col("price_value").cast("string"), F.col("speed_mbps")
    spelled = lambda value, unit: F.concat(value.cast("string"), F.lit(unit))
    parts = F.concat(
        F.array("text", "entity_code", "establishment"),
        text.listed(F.try_element_at(words, F.coalesce("beneficiary", F.lit("")))),
        F.array(F.concat(price, F.lit(" DA")), F.concat(price, F.lit("DA")), F.when(speed >= 1000, spelled(speed / 1000, " Gbps")), spelled(speed, " Mbps")),
    )
    return F.array_join(F.filter(parts, lambda x: _some(x) != ""), " ")


def product_rows(products: DataFrame) -> DataFrame:
    """(id, text, keywords, product_name, category, provider) in lower case of products (position, text, keywords, product_info:
    struct of name, category, provider); what is missing is empty."""
    low = lambda c: F.lower(_some(F.col(f"product_info.{c}")))
    return products.select(F.col("position").alias("id"), "text", F.transform(text.listed(F.col("keywords")), F.lower).alias("keywords"), low("name").alias("product_name"), low("category").alias("category"), low("provider").alias("provider"))
