
from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One word character: letters, digits and underscore of any script.
WORD = r"[\p{L}\p{N}_]"
#: White space with the no-break spaces.
SPACE = r"[\s\u00A0\u202F]"
_ARABIC = r"[\u0600-\u06FF\u0750-\u077F]"
_LATIN = r"[a-zA-Z\u00C0-\u00FF]"
_ACCENTED = [c for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) > 1]
_PLAIN = [unicodedata.normalize("NFD", c)[0] for c in _ACCENTED]

# French words that carry no meaning in a search.
STOP_WORDS = [
    "le", "la", "les", "un", "une", "des", "de", "du", "et", "en", "à", "au", "aux", "pour", "sur", "dans", "par", "avec",
    "ce", "cette", "ces", "son", "sa", "ses", "comment", "que", "qui", "quoi", "quel", "quelle", "quels", "quelles", "est",
    "sont", "a", "ont", "faire", "fait", "être", "avoir", "si", "ou", "ne", "pas", "plus", "moins", "très", "bien", "d", "l",
    "qu", "n", "s", "c", "j", "m", "t",
]


def either(column: Column, parts, test=F.contains) -> Column:
    """Whether any of some fixed strings is in a column."""
    return reduce(lambda a, b: a | b, (test(column, F.lit(p)) for p in parts), F.lit(False))


def squeeze(text: Column) -> Column:  # T18
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def language(text: Column) -> Column:  # T1
    """ar, fr or mixed by the share of Arabic among Arabic and Latin letters; without any of them fr."""
    arabic = F.regexp_count(text, F.lit(_ARABIC))
    share = F.try_divide(arabic, arabic + F.regexp_count(text, F.lit(_LATIN)))
    return F.when(share > 0.7, "ar").when(share.isNull() | (share < 0.3), "fr").otherwise("mixed")


def arabic_form(text: Column) -> Column:  # T3
    """Without vowel marks and tatweel, with one form of alef, yeh and heh; letters keep their case."""
    clean = F.regexp_replace(text, r"[\u064B-\u065F\u0670\u0640]", "")
    return squeeze(F.translate(clean, "أإآٱىة", "اااايه"))


def french_form(text: Column) -> Column:  # T4
    """Lower case with accents; everything but word characters, - and ' is a space."""
    return squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s'\-]", " "))


def search_form(text: Column) -> Column:  # T5
    """The form of a text's own language; mixed texts take both."""
    kind = language(text)
    return F.when(kind == "ar", arabic_form(text)).when(kind == "fr", french_form(text)).otherwise(french_form(arabic_form(text)))


def words(text: Column) -> Column:  # T6
    """Words of more than one character, and digits."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({WORD}+)")), lambda w: (F.length(w) > 1) | w.rlike("^[0-9]$"))


def offer_words(text: Column) -> Column:  # T5, T6
    """Words of either script in a text's search form."""
    return words(search_form(text))


def query_parts(text: Column) -> Column:  # T7
    return F.struct(search_form(text).alias("form"), words(search_form(text)).alias("words"), language(text).alias("language"))


def label_form(text: Column) -> Column:  # T8
    return squeeze(F.lower(arabic_form(text)))


def bare(text: Column) -> Column:  # T9
    """Without accents and other combining marks."""
    return F.regexp_replace(F.translate(text, "".join(_ACCENTED), "".join(_PLAIN)), r"\p{M}", "")


def passage_words(text: Column) -> Column:  # T10
    """Bare lower-case words of more than one character."""
    return F.filter(F.split(squeeze(F.regexp_replace(F.lower(bare(text)), r"[^\p{L}\p{N}_\s]", " ")), " "), lambda w: F.length(w) > 1)


def product_words(text: Column) -> Column:  # T11
    """Lower-case words of a-z, digits and some accented letters; every other character parts words."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9éèàçùôîïüâ']+", " "), " "), lambda w: w != "")


def index_words(text: Column) -> Column:  # T13
    return F.regexp_extract_all(F.lower(bare(text)), F.lit(r"([\p{L}\p{N}]+)"))


def search_words(text: Column) -> Column:  # T12, F13
    """Words of three characters that are no stop words; without any, those of two characters."""
    split = F.split(squeeze(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")), " ")
    meaning = F.filter(split, lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*STOP_WORDS))
    return F.when(F.size(meaning) > 0, meaning).otherwise(F.filter(split, lambda w: F.length(w) >= 2))


#: Characters with a compatibility form of their own, by the Unicode data that Python brings along; Hangul syllables keep theirs.
_COMPATIBLE = {c: n for c in map(chr, [*range(0xA0, 0xD800), *range(0xE000, 0x110000)]) if (n := unicodedata.normalize("NFKC", c)) != c}
#: Runs that normalisation may change: such a character, or any with combining marks or conjoining letters behind it.
_LOOSE = r"[\p{M}\u1100-\u11FF]"


def compatible(text: Column) -> Column:
    """NFKC: letters in their composed compatibility forms. Characters with a form of one character are translated in the JVM; texts with others, or with
    combining marks, whose order matters, go through a small Arrow function, and they alone."""
    single = {c: n for c, n in _COMPATIBLE.items() if len(n) == 1}
    loose = F.rlike(text, F.lit(_LOOSE + "|[" + "".join(f"\\x{{{ord(c):X}}}" for c, n in _COMPATIBLE.items() if len(n) > 1) + "]"))
    return F.when(loose, _normalised(F.when(loose, text))).otherwise(F.translate(text, "".join(single), "".join(single.values())))


def _normalised(text: Column) -> Column:
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    return pandas_udf(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x)), "string", PandasUDFType.SCALAR)(text)


def folded(text: Column) -> Column:  # T14
    return squeeze(compatible(F.lower(F.coalesce(text, F.lit("")))))


def title_form(text: Column) -> Column:  # T15
    return F.lower(F.trim(text))


# Replacements in lower-case labels, in the order in which they are made.
REPAIRS = (("ã©", "é"), ("ã¨", "è"), ("ã ", "à"), ("ã®", "î"), ("ã´", "ô"), ("ã¢", "â"), ("ã§", "ç"), ("ãª", "ê"), ("â«", "»"), ("â»", "»"), ("<<", ""), (">>", ""), ("«", ""), ("»", ""), ("-", " "), ("_", " "), ("  ", " "))


def repaired(text: Column) -> Column:  # T16
    return F.regexp_replace(reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), REPAIRS, F.lower(text)), r"^\s+|\s+$", "")


def straight_quotes(text: Column) -> Column:  # T17
    return F.translate(text, "’‘`", "'''")


def grams(tokens: Column, most: int = 3) -> Column:  # T19
    """Runs of one to `most` neighbouring tokens, joined by a space, shorter ones first."""
    size = F.size(tokens)
    out = runs = tokens
    for k in range(2, most + 1):  # outside of lambdas, which would read the tokens again for every place
        left = F.greatest(size - (k - 1), F.lit(0))
        runs = F.zip_with(F.slice(runs, 1, left), F.slice(tokens, k, left), lambda a, b: F.concat_ws(" ", a, b))
        out = F.concat(out, runs)
    return out


def filename_language(name: Column) -> Column:  # T2
    """AR or FR of a file name: Arabic letters, then words, then a mark of its own; FR if nothing tells."""
    low = F.lower(name)
    mark = F.regexp_extract(name, r"(?i)(?<![\p{L}\p{N}_])(AR|FR)(?![\p{L}\p{N}_])", 1)
    return F.when(name.rlike(_ARABIC), "AR").when(either(low, ("arabe", "arabic")), "AR").when(either(low, ("francais", "français", "french")), "FR").when(mark != "", F.upper(mark)).otherwise("FR")


def path_facts(path: Column) -> Column:  # T31
    """category (first folder), filename, stem and extension of a relative path."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.struct(F.element_at(F.split(path, "/"), 1).alias("category"), name.alias("filename"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), ext.alias("ext"))


def quoted(path: Column) -> Column:  # T32
    """Percent-encoded with slashes kept."""
    return F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def content_type(ext: Column) -> Column:  # T33
    return F.when(ext == "pdf", "application/pdf").when(ext == "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document").when(ext == "odt", "application/vnd.oasis.opendocument.text").otherwise("application/octet-stream")


def short_id(*parts: Column) -> Column:  # P15
    return F.substring(F.md5(F.concat_ws("_", *parts).cast("binary")), 1, 12)


def preview(text: Column, most: int = 500) -> Column:  # P16
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def present(value: Column, default: Column) -> Column:  # P1
    """The value unless it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def listed(value: Column) -> Column:  # P2
    return F.coalesce(value, F.array().cast("array<string>"))
