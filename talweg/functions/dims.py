
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Intents, most important first, and the patterns that count for them.
INTENT_PATTERNS = {
    "PRICE": [r"\bprix\b", r"\btarif\b", r"\bcoût\b", r"\bcout\b", r"\bda\b", r"\bdinars?\b", r"\bgratuit\b", r"\bremise\b", r"\bréduction\b", r"\breduction\b", r"\bcombien\b.*(?:coûte|coute|paye|payer)", r"\bmoins cher\b", r"\bplus cher\b", r"\boffre.*(?:à|a)\s*\d+", r"\d+\s*da", r"\b800\b", r"\b1100\b", r"\b1\s*100\b", r"\b1200\b", r"\b1300\b", r"\b1500\b", r"\b2000\b", r"\b3500\b"],
    "SPEED": [r"\bdébit\b", r"\bdebit\b", r"\bvitesse\b", r"\bmbps\b", r"\bgbps\b", r"\bmbit\b", r"\bgbit\b", r"\brapide\b", r"\blent\b", r"\bconnexion\b", r"\b20\s*mbps\b", r"\b50\s*mbps\b", r"\b100\s*mbps\b", r"\b300\s*mbps\b", r"\b500\s*mbps\b", r"\b1\.?5?\s*gbps\b", r"\b1\.?2\s*gbps\b", r"\b1\s*gbps\b", r"\bfibre\b", r"\badsl\b", r"\bvdsl\b", r"\bftth\b"],
    "DOCUMENTS": [r"\bdocuments?\b", r"\bdossier\b", r"\bpièces?\b", r"\bpapiers?\b", r"\bjustificatifs?\b", r"\battestation\b", r"\bcertificat\b", r"\bcarte\s*(?:nationale|professionnelle|identité)\b", r"\bcni\b", r"\bidentité\b", r"\bfournir\b", r"\bprésenter\b", r"\bapporter\b", r"\bbesoin\s*de\s*quoi\b", r"\bquels?\s*documents?\b", r"\bqu'est-ce\s*qu'il\s*faut\b", r"\bbon\s*d'ouverture\b", r"\baction\s*sociale\b", r"\battesté\b", r"\bsigné\b"],
    "BENEFICIARY": [r"\bretraités?\b", r"\bretraite\b", r"\bcadres?\s*supérieurs?\b", r"\bcadres?\s*superieurs?\b", r"\bpersonnel\b", r"\bemployés?\b", r"\bsalariés?\b", r"\bactifs?\b", r"\ben\s*activité\b", r"\bayants?\s*droit\b", r"\bfamille\b", r"\béligible\b", r"\beligible\b", r"\béligibilité\b", r"\bqui\s*peut\b", r"\bpour\s*qui\b", r"\bbénéficiaires?\b", r"\bbeneficiaires?\b", r"\btous\s*les\s*employés\b", r"\btout\s*le\s*personnel\b"],
    "GENERAL": [r"\bconvention\b", r"\baccord\b", r"\bpartenariat\b", r"\bétablissement\b", r"\betablissement\b", r"\boffres?\b", r"\bservices?\b", r"\binformation\b", r"\brenseignement\b", r"\bcomment\b", r"\bpourquoi\b"],
}
# Codes of establishments.
ENTITY_CODES = ["P", "V", "F", "A", "N", "O", "I", "AD", "AC", "AY", "E", "H", "J", "K", "L", "M", "Q", "R", "S", "T", "U", "W", "X"]
# Words of a query for each class of beneficiaries.
BENEFICIARY_WORDS = {
    "cadres_superieurs": ["cadres supérieurs", "cadres superieurs", "cadre supérieur", "dirigeants", "directeurs", "responsables"],
    "retraites": ["retraités", "retraites", "retraité", "en retraite", "anciens employés", "pension"],
    "actifs": ["personnel actif", "actifs", "en activité", "employés", "salariés", "travailleurs", "personnel en activité"],
    "ayants_droit": ["ayants droit", "ayant droit", "action sociale", "bénéficiaires indirects", "famille"],
    "tous": ["tous", "tout le personnel", "tous bénéficiaires", "tous les employés", "personnel et retraités"],
}
# Signature words of a passage by class.
SIGNATURE_WORDS = {
    "cadres": ["cadres supérieurs", "cadres", "dirigeants"],
    "retraites": ["retraités", "en retraite", "retraite"],
    "actifs": ["personnel actif", "en activité", "employés actifs"],
    "ayants_droit": ["ayants droit", "ayant droit", "action sociale"],
    "tous": ["tous bénéficiaires", "tous les employés", "tout le personnel"],
}
# Names that stand for a product.
PRODUCT_PATTERNS = {
    "buzz": ["buzz 6", "buzz6", "buzz 6 pro", "buzz 6 flip", "buzz 6 prime", "buzz6pro"],
    "zte": ["zte", "blade a35", "blade a55", "nubia v60", "zte blade"],
    "ibox": ["ibox"],
    "ekoteb": ["ekoteb"],
    "classateck": ["classateck"],
    "dorouscom": ["dorouscom"],
    "moalim": ["moalim"],
    "twin_box": ["twin box", "twinbox"],
    "cache_modem": ["cache modem", "caches modems"],
    "idoom_market": ["idoom market", "idom market"],
}
# Words of a query and the tags they ask for.
TAG_WORDS = {
    "4g": ["4G", "LTE", "4G LTE", "réactivation"],
    "lte": ["4G", "LTE", "4G LTE", "réactivation"],
    "fibre": ["Fibre", "FTTH", "fibre optique", "IDOOM Fibre"],
    "ftth": ["Fibre", "FTTH", "fibre optique", "IDOOM Fibre"],
    "pstn": ["PSTN", "ligne fixe", "téléphone fixe", "enquête PSTN"],
    "idoom": ["IDOOM", "idoom adsl", "internet", "IDOOM Fibre"],
    "adsl": ["ADSL", "idoom adsl"],
    "ont": ["FTTH", "IDOOM Fibre", "VOIP"],
    "tva": ["TVA 2%", "TVA", "taxe"],
    "tva 2%": ["TVA 2%"],
    "fadet": ["FADET", "facture détaillée"],
    "facture détaillée": ["FADET", "facture détaillée"],
    "cdr": ["FADET", "facture détaillée"],
    "appels": ["FADET", "facture détaillée"],
    "facture": ["facture", "facturation", "encaissement"],
    "duplicata": ["duplicata", "copie facture", "réimprimer"],
    "réimprimer": ["duplicata", "copie facture"],
    "remboursement": ["remboursement", "retour ressource"],
    "retour": ["retour ressource", "remboursement"],
    "annuler": ["retour ressource", "annulation"],
    "suspension": ["suspension", "désactivation"],
    "réactivation": ["réactivation", "activation", "4G LTE"],
    "résiliation": ["résiliation", "clôture"],
    "migration": ["migration", "changement offre"],
    "recharge": ["recharge", "crédit", "bon de commande"],
    "paiement": ["paiement", "encaissement"],
    "poste": ["bureau de poste", "encaissement externe"],
    "externe": ["bureau de poste", "encaissement externe"],
    "inventaire": ["inventaire", "stock", "ACTEL"],
    "stock": ["inventaire", "stock", "transfert"],
    "actel": ["ACTEL", "inventaire", "distribution"],
    "cartes": ["inventaire", "ventes par lot", "recharge"],
    "lot": ["ventes par lot", "inventaire"],
    "distribuer": ["inventaire", "transfert", "ACTEL"],
    "ressource": ["retour ressource", "inventaire"],
    "modem": ["retour ressource", "vente"],
    "échéancier": ["arrangement", "AOD", "échéancier"],
    "aod": ["arrangement", "AOD", "échéancier"],
    "arrangement": ["arrangement", "AOD", "échéancier"],
    "temporaire": ["ligne temporaire", "élections"],
    "élections": ["ligne temporaire"],
    "ordre": ["gestion d'ordre", "enquête PSTN"],
    "enquête": ["enquête PSTN", "gestion d'ordre"],
}


def dictionary(spark: SparkSession, entries: dict[str, list[str]]) -> DataFrame:
    """(key, value, ordinal) of a dictionary of lists, in its order. Larger ones (synonyms) come as tables with these columns."""
    rows = [(k, v) for k, values in entries.items() for v in values]
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "key string, value string, ordinal int")
