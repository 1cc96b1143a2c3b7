"""Name and address normalisation as column expressions.

Only the Unicode folding (compatibility decomposition and the Latin accent strip) has no built-in and runs as one Arrow
function; all else is built-in expressions. Word boundaries are written as look-arounds on letters, numbers and the
underscore, since combining marks do not belong to words here.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]"

#: Legal forms, in the order in which they are applied. The last can never apply (its words are already
#: shortened), and the one for "sociedade anonima" takes the blank before it along; both are kept as they are.
LEGAL_FORMS = [
    (rf"(?<!{WORD})corporation(?!{WORD})", "corp"),
    (rf"(?<!{WORD})company(?!{WORD})", "co"),
    (rf"(?<!{WORD})private(?!{WORD})", "pvt"),
    (rf"(?<!{WORD})limited(?!{WORD})", "ltd"),
    (rf"(?<!{WORD})incorporated(?!{WORD})", "inc"),
    (rf"(?<={WORD}) sociedades? anonimas?(?!{WORD})", "sa"),
    (rf"(?<!{WORD})gesellschaft mit beschrankter haftung(?!{WORD})", "gmbh"),
    (rf"(?<!{WORD})societe a responsabilite limitee(?!{WORD})", "sarl"),
    (rf"(?<!{WORD})public limited company(?!{WORD})", "plc"),
]

#: Words of addresses and their short forms.
ADDRESS_WORDS = {
    "road": "rd",
    "street": "st",
    "avenue": "ave",
    "boulevard": "blvd",
    "lane": "ln",
    "sector": "sec",
    "strasse": "str",
    "route": "rte",
    "chemin": "chem",
    "numero": "no",
}


def fold_text(text: str | None) -> str:
    """Compatibility-decomposed text; marks go where the letter before them is Latin."""
    if not text:
        return ""
    if text.isascii():
        return text
    out, latin = [], False
    for char in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)):
        if unicodedata.combining(char):
            if not latin:
                out.append(char)
        else:
            latin = "LATIN" in unicodedata.name(char, "")
            out.append(char)
    return "".join(out)


@F.pandas_udf(StringType())
def fold_unicode(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text)


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column) -> Column:
    """Folded, lower-case text of words; punctuation is a blank, all-digit tokens lose leading zeros; null is ''."""
    c = fold_unicode(F.coalesce(c.cast("string"), F.lit("")))
    for old, new in (("&", " and "), ("ß", "ss"), ("ẞ", "SS")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}\s]", " ")
    return _tidy(F.regexp_replace(_tidy(c), rf"(?<!{WORD})0+(\p{{Nd}}+)(?!{WORD})", "$1"))


def shorten_legal_forms(normal: Column) -> Column:
    for pattern, short in LEGAL_FORMS:
        normal = F.regexp_replace(normal, pattern, short)
    return _tidy(normal)


def normalize_business_name(c: Column) -> Column:
    return shorten_legal_forms(normalize_text(c))


def shorten_address_words(normal: Column) -> Column:
    for word, short in ADDRESS_WORDS.items():
        normal = F.regexp_replace(normal, rf"(?<!{WORD}){word}(?!{WORD})", short)
    return _tidy(normal)


def normalize_address(c: Column) -> Column:
    return shorten_address_words(normalize_text(c))


def phonetic_key(name: Column, normalized: bool = False) -> Column:
    """Soundex over all a-z letters of the normalised name; '' if it has none."""
    letters = F.regexp_replace(name if normalized else normalize_text(name), "[^a-z]", "")
    return F.when(letters == "", F.lit("")).otherwise(F.soundex(letters))


def sorted_token_key(name: Column, normalized: bool = False) -> Column:
    """Tokens of the normalised name in code point order; repeated ones stay."""
    # Shortening legal forms again mirrors the definition, which takes any name.
    name = shorten_legal_forms(name) if normalized else normalize_business_name(name)
    return F.array_join(F.array_sort(F.split(name, " ")), " ")


def normalize_records(records: DataFrame) -> DataFrame:
    """Source records (entity_id, business_name, business_address, country) with the four derived columns."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("entity_id", "business_name", "business_address", "country")}
    out = records.select(
        *(c.alias(n) for n, c in text.items()),
        normalize_business_name(F.col("business_name")).alias("normalized_name"),
        normalize_address(F.col("business_address")).alias("normalized_address"),
    )
    return out.select(
        "entity_id", "business_name", "normalized_name", "business_address", "normalized_address",
        phonetic_key(F.col("normalized_name"), normalized=True).alias("phonetic_key"),
        sorted_token_key(F.col("normalized_name"), normalized=True).alias("sorted_token_key"), "country",
    )
