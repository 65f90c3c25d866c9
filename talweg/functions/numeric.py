
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from talweg.functions.text import either

# Prices (DA) and speeds (Mbps) that offers commonly have.
COMMON_PRICES = (0, 800, 1000, 1100, 1200, 1300, 1400, 1500, 1600, 1680, 1890, 2000, 2100, 2400, 2520, 2600, 3000, 3500, 3600)
COMMON_SPEEDS = (15, 20, 30, 50, 60, 100, 120, 240, 300, 480, 500, 600, 1000, 1200, 1500)


def price(text: Column, strict: bool = False) -> Column:  # T20
    """Dinars as int: free is 0; what follows a time unit is left out (strict: only whole words are units); else null."""
    low = F.lower(text)
    unit = r"\b(?:mois|month|mensuel|an|année)\b.*" if strict else "(?:mois|month|mensuel|an|année).*"
    digits = F.regexp_extract(F.regexp_replace(low, "(?s)" + unit, ""), r"([0-9][0-9\s]*)", 1)
    return F.when(F.contains(low, F.lit("gratuit")), 0).otherwise(F.regexp_replace(digits, r"\s", "").try_cast("int"))


def speed(text: Column) -> Column:  # T21
    """Mbps as double; without a unit, values under 10 are Gbps."""
    low = F.lower(text)
    value = F.replace(F.regexp_extract(low, "([0-9.,]+)", 1), F.lit(","), F.lit(".")).try_cast("double")
    giga, mega, kilo = (either(low, units) for units in (("gbps", "gbit", "gb/s"), ("mbps", "mbit", "mb/s"), ("kbps", "kbit", "kb/s")))
    return F.when(giga, value * 1000).when(mega, value).when(kilo, value / 1000).when(value < 10, value * 1000).otherwise(value)


def beneficiary(text: Column) -> Column:  # T22
    """One of six classes, by the first rule that holds; null and empty are autre."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *parts: either(low, parts)
    return (
        F.when(has("cadres supérieurs", "cadres superieurs", "cadre supérieur"), "cadres_superieurs")
        .when(has("retraité") & ~has("personnel", "actif"), "retraites")
        .when(has("actif", "activité") & ~has("retraité"), "actifs")
        .when(has("ayant") & has("droit"), "ayants_droit")
        .when(has("tous") | (has("personnel") & has("retraité")), "tous")
        .when(has("personnel", "employé", "salarié"), "actifs")
        .otherwise("autre")
    )


def offer_type(text: Column) -> Column:  # T23
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.when(either(up, ("FIBRE", "FTTH")), "FIBRE").when(either(up, ("VDSL",)), "VDSL").when(either(up, ("ADSL",)), "ADSL").when(either(up, ("FIXE", "TELEPHON")), "FIXE").otherwise("AUTRE")


def query_prices(text: Column) -> Column:  # T24
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9][0-9\s]*)\s*da"))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"\s", "").try_cast("int")), lambda x: x.isNotNull())


def query_speeds(text: Column) -> Column:  # T24
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9][0-9.,]*\s*(?:gbps|mbps|gbit|mbit))"))
    return F.filter(F.transform(found, speed), lambda x: x.isNotNull())


def query_numbers(text: Column) -> Column:  # T24
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)")), lambda x: x.try_cast("long"))


def nearest(value: Column, known: tuple[int, ...]) -> Column:  # M4
    """The nearest of the known values if it is within a tenth of the value, else the value; of two as near the smaller."""
    gap = F.array_min(F.array(*(F.struct(F.abs(value - k).alias("gap"), F.lit(float(k)).alias("known")) for k in known)))
    return F.when(gap["gap"] <= 0.1 * value, gap["known"]).otherwise(value.cast("double"))


def dot(a: Column, b: Column) -> Column:  # M1
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, guard: float = 0.0) -> Column:  # M1
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + guard), F.lit(0.0))


def min_max(score: Column, group: WindowSpec, equal: str) -> Column:  # M2, G7
    """Scores of a group scaled to 0..1. equal: what a group of one value gives, `half` (0.5), `floor` (range at least 1e-6) or
    `zero` (0, with the largest as scale if it is the only one)."""
    low, high = F.min(score).over(group), F.max(score).over(group)
    if equal == "half":
        return F.when(high == low, 0.5).otherwise((score - low) / (high - low))
    if equal == "floor":
        return (score - low) / F.greatest(high - low, F.lit(1e-6))
    return (score - low) / F.when(high == low, 1.0).otherwise(high - low)


def numeric_boost(prices: Column, speeds: Column, price_: Column, speed_: Column, free: Column) -> Column:  # R11
    """Factor of a passage: its price equals the first query price that is near (2, or 1.5 within 100 DA), likewise speed
    (1.5 within a tenth of its own), and 1.5 for free passages if 0 is asked for."""
    near_price = F.get(F.filter(prices, lambda p: F.abs(p - price_) <= 100), F.lit(0))
    near_speed = F.get(F.filter(speeds, lambda s: (s == speed_) | (F.abs(s - speed_) <= 0.1 * speed_)), F.lit(0))
    one = F.when(near_price == price_, 2.0).when(near_price.isNotNull(), 1.5).otherwise(1.0)
    two = F.when(near_speed == speed_, 2.0).when(near_speed.isNotNull(), 1.5).otherwise(1.0)
    return one * two * F.when(free & F.exists(prices, lambda p: p == 0), 1.5).otherwise(1.0)


def clamped(boost: Column) -> Column:  # M6
    return 1 + F.least(boost, F.lit(1.0))


def half_even(x: Column, digits: int) -> Column:  # M5
    """A double rounded as its exact binary value demands, halves to even: 2.675, which is a little less, gives 2.67. 0 to 15 digits.

    y = x * 10^digits is the nearest double; what it lacks is found exactly from the halves of x, and decides where y lies in the middle.
    """
    scale = F.lit(float(10**digits))
    y = x * scale
    c = x * 134217729.0  # 2^27 + 1 parts a double into two of 26 bits
    high = c - (c - x)
    low = x - high
    big = float(10**digits) * 134217729.0
    top = big - (big - float(10**digits))
    rest = float(10**digits) - top
    lost = ((high * top - y) + high * rest + low * top) + low * rest
    down = F.floor(y).cast("double")
    part = y - down
    up = (part > 0.5) | ((part == 0.5) & ((lost > 0) | ((lost == 0) & (down % 2 != 0))))
    return F.when(F.abs(y) < float(1 << 51), (down + up.cast("double")) / scale).otherwise(x)


def confidence(best: Column, second: Column) -> Column:  # M7
    """Confidence in a first place: by its score alone, or the mean of that and of what its lead over the second place gives."""

    def level(value: Column, *steps: float) -> Column:
        return chained([(value > step, x) for step, x in zip(steps, (0.9, 0.7, 0.5), strict=True)], 0.3)

    own = level(best, 0.7, 0.5, 0.3)
    return F.when(best.isNull(), 0.0).when(second.isNull(), own).otherwise((own + level(best - second, 0.2, 0.1, 0.05)) / 2)


def chained(pairs: list[tuple[Column, object]], default) -> Column:
    """when(...).when(...)...otherwise(default)."""
    return reduce(lambda out, x: F.when(x[0], x[1]).otherwise(out), reversed(pairs), F.lit(default))


def per(*columns: str) -> WindowSpec:
    return Window.partitionBy(*columns)
