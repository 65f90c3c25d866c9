import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talweg.functions import numeric, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("value, expected", [("4 250 DA", 4250), ("990 da par mois", 990), ("offert, GRATUIT", 0), ("de 75 à 80 da", 75), ("65", 65), ("sur devis", None), ("mois 3", None), (None, None), ("", None)])
def test_price(spark, value, expected):
    assert one(spark, value, numeric.price) == expected


def test_strict_price_keeps_numbers_after_words_that_hold_a_unit(spark):
    assert one(spark, "dans 500 DA", numeric.price) is None
    assert one(spark, "dans 500 DA", lambda c: numeric.price(c, strict=True)) == 500


@pytest.mark.parametrize("value, expected", [("2,4 GBIT/s", 2400), ("75 Mbit/s", 75), ("0.5 gb/s", 500), ("64 kb/s", 0.064), ("9", 9000), ("10", 10), ("vite", None), ("4.5.6 Mbps", None), (None, None)])
def test_speed(spark, value, expected):
    assert one(spark, value, numeric.speed) == expected


@pytest.mark.parametrize("value, expected", [("un cadre supérieur", "cadres_superieurs"), ("un retraité", "retraites"), ("en activité", "actifs"), ("les ayants leur droit", "ayants_droit"), ("pour tous", "tous"), ("retraités, personnel", "tous"), ("chaque employé", "actifs"), ("visiteur", "autre"), (None, "autre")])
def test_beneficiary(spark, value, expected):
    assert one(spark, value, numeric.beneficiary) == expected


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="aeéèêçÀÖñŁœ xyz", max_size=20), min_size=40, max_size=40))
def test_bare_is_decomposition_without_marks(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "x string").select("x", text.bare(F.col("x")).alias("y")).collect()
    assert all(y == "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)) for x, y in rows)


def test_empty_and_null_texts(spark):
    for f in (text.language, text.search_form, text.words, text.passage_words, text.search_words, text.grams):
        one(spark, "", lambda c, f=f: f(text.words(c)) if f is text.grams else f(c))
        one(spark, None, lambda c, f=f: f(text.words(c)) if f is text.grams else f(c))
    assert one(spark, "", text.words) == []
    assert one(spark, None, text.language) == "fr"


@pytest.mark.parametrize("value, expected", [(725.0, 725), (740.0, 800), (1450.0, 1400), (0.0, 0), (9999.0, 9999)])
def test_nearest_is_within_a_tenth_of_the_value(spark, value, expected):
    assert one(spark, value, lambda c: numeric.nearest(c, numeric.COMMON_PRICES), "double") == expected


@pytest.mark.parametrize("best, second, expected", [(0.8, None, 0.9), (0.7, None, 0.7), (0.2, None, 0.3), (0.8, 0.5, 0.9), (0.8, 0.72, 0.7), (0.6, 0.59, 0.5), (None, None, 0.0)])
def test_confidence(spark, best, second, expected):
    row = spark.createDataFrame([(best, second)], "x double, y double").select(numeric.confidence(F.col("x"), F.col("y")).alias("c")).first()
    assert row.c == pytest.approx(expected)


def test_cosine_of_zeros_is_zero(spark):
    assert one(spark, [0.0, 0.0], lambda c: numeric.cosine(c, c), "array<double>") == 0.0


def test_scores_stay_within_bounds(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 2.0), (1, -1.0), (2, 3.0)], "query_id int, score double")
    for equal, alone in (("half", 0.5), ("floor", 0.0), ("zero", 0.0)):
        got = rows.select("query_id", numeric.min_max(F.col("score"), numeric.per("query_id"), equal).alias("s")).collect()
        assert all(0 <= r.s <= 1 for r in got)
        assert [r.s for r in got if r.query_id == 2] == [alone]
