import json

import pytest
from pyspark.sql import functions as F

from talweg.operators import renderers
from talweg.sources import files

FULL = {
    "document_id": "d1", "doc_type": "offer_sheet", "product_family": "idoom_fibre", "technology": ["fibre", "4g_lte"], "customer_segment": ["residential"], "commitment_type": "no_commitment",
    "metadata": {"title_fr": "Titre", "title_ar": "عنوان", "company": "AT", "version": "2", "effective_date": None},
    "offer_core": {"name_fr": "Nom", "name_ar": None, "description_fr": "Desc", "conditions_fr": ["a", "b"], "benefits_ar": ["x"], "pricing_summary_fr": "1 DA"},
    "policy_summary": {"summary_fr": "Pol"}, "faq_fr": [{"question": "q1", "answer": "a1"}, {"question": "q2", "answer": ""}, {"question": "q3", "answer": "a3"}, {"question": "q4", "answer": "a4"}], "faq_ar": None,
    "contact": {"phone": "12", "notes_ar": "م"}, "keywords": ["k1"], "keywords_fr": ["k2", "k3"], "search_text": "search", "dense_text_primary": "search",
}
BARE = {"metadata": {"title_fr": "T"}}


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("offers")
    for i, d in enumerate((FULL, BARE, {"document_id": "d3"})):
        (folder / f"{i}.json").write_text(json.dumps(d), encoding="utf-8")
    rows = files.json_objects(spark, f"file://{folder}", files.OFFER).orderBy("_file_path")
    return [r.asDict() for r in rows.select(renderers.index_text().alias("index"), renderers.rich_context().alias("rich"), renderers.context().alias("context")).collect()]


def test_index_text(texts):
    terms = "idoom fibre offer sheet residential fibre 4g lte no commitment"
    assert texts[0]["index"] == " ".join([terms * 20, "search", "Titre" * 3, "عنوان" * 3, "Nom" * 3, "Desc", "a b", "x", "1 DA", "q1", "a1", "q2", "q3", "a3", "q4", "a4", "k1 k2 k3" * 3])
    assert texts[1]["index"] == "TTT" and texts[2]["index"] == ""


def test_rich_context(texts):
    want = ["Titre", "عنوان", "idoom_fibre", "Technologies: fibre, 4g_lte", "Segments clients: residential", "Type d'engagement: no_commitment", "Nom", "Desc", "Conditions FR: a | b", "Avantages AR: x", "Tarification FR: 1 DA", "Résumé politique FR: Pol"]
    want += ["FAQ FR Q: q1", "FAQ FR A: a1", "FAQ FR Q: q2", "FAQ FR A: ", "FAQ FR Q: q3", "FAQ FR A: a3", "FAQ FR Q: q4", "FAQ FR A: a4", "Contact: Téléphone: 12 | Notes AR: م"]
    assert texts[0]["rich"] == " ".join(want)
    assert texts[1]["rich"] == "T" and texts[2]["rich"] == "No content available"


def test_context(texts):
    want = ["[Document ID: d1]", "[Type: offer_sheet]", "", "Titre: Titre", "العنوان: عنوان", "", "Informations:", "  - Entreprise: AT", "  - Version: 2", "", "Caractéristiques:", "  - Famille de produit: idoom_fibre", "  - Technologies: fibre, 4g_lte", "  - Segments clients: residential", "  - Type d'engagement: no_commitment", ""]
    want += ["Nom de l'offre:", "  FR: Nom", "", "Description (FR):", "  Desc", "", "Conditions (FR):", "  1. a", "  2. b", "", "Avantages (AR):", "  1. x", "", "Tarification (FR):", "  1 DA", "", "Résumé de la politique (FR):", "  Pol", ""]
    want += ["Questions Fréquentes (FR):", "  Q1: q1", "  R1: a1", "  Q3: q3", "  R3: a3", "", "Contact:", "  - Téléphone: 12", "  - ملاحظات: م", ""]
    assert texts[0]["context"] == "\n".join(want)
    assert texts[2]["context"] == "[Document ID: d3]\n[Type: document]\n"


def test_product_text_shows_values_as_python_does(spark):
    product = {"metadata": {"document_title": "Doc"}, "product_info": {"name": "N", "category": None}, "keywords": ["a", "b"], "commercial_details": {"pricing": {"b": 1.5, "a": [True, None, "x'y"]}, "previous_price_dzd": 3500}, "hardware_details": {"ram": "4 Go"}, "after_sales_service": None, "_unmapped_or_extra_info": None}
    rows = spark.createDataFrame([(0, json.dumps(product)), (1, "no json"), (2, None), (3, "[1]")], "i int, raw string")
    got = [r.t.split("\n") for r in rows.select("i", renderers.product_text(F.col("raw")).alias("t")).orderBy("i").collect()]
    assert got[0][:8] == ["Titre document: Doc", "Nom produit: N", "Catégorie: ", "Type produit: ", "Fournisseur: ", "Mots-clés:", "a, b", "Détails commerciaux:"]
    assert "Prix courant: {'b': 1.5, 'a': [True, None, \"x'y\"]}" in got[0] and "Prix précédent: 3500" in got[0] and "Hardware: {'ram': '4 Go'}" in got[0] and "SAV: {}" in got[0]
    assert got[0][-1] == "Infos diverses:" and got[1] == got[2] == got[3] and "Mots-clés:" in got[1] and len(got[1]) == len(got[0]) - 1
