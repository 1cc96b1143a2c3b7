"""Blocking features as column expressions over normalised names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of names that do not tell businesses apart.
NAME_STOP_WORDS = [
    "and", "the", "inc", "corp", "corporation", "llc", "ltd", "limited", "pvt", "private", "co", "company", "services",
    "solutions", "group", "enterprises", "associates", "tech", "technologies", "international", "global", "india", "usa",
    "us", "in", "of", "for",
]

#: Words of addresses that are no blocking keys.
ADDRESS_STOP_WORDS = ["road", "street", "rd", "st", "near", "opposite", "opp", "the", "and", "floor", "no", "number", "india", "usa"]

#: The shorter list of the joined address key.
ADDRESS_KEY_STOP_WORDS = ["road", "street", "rd", "st", "near", "opposite", "opp", "the", "and"]


def _words(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def name_prefix(name: Column, n: int = 3) -> Column:
    return F.substring(name, 1, n)


def address_prefix(address: Column, n: int = 4) -> Column:
    return F.substring(address, 1, n)


def significant_words(name: Column) -> Column:
    """struct(w1, w2): the first two words of three or more characters that are no stop words, else '' (w1: any word)."""
    tokens = F.filter(F.split(F.lower(name), r"\s+"), lambda t: t != "")
    clean = F.transform(tokens, lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_]", ""))
    kept = F.filter(clean, lambda t: (F.length(t) >= 3) & ~F.array_contains(_words(NAME_STOP_WORDS), t))
    first = F.coalesce(F.try_element_at(kept, F.lit(1)), F.try_element_at(clean, F.lit(1)), F.lit(""))
    return F.struct(first.alias("w1"), F.coalesce(F.try_element_at(kept, F.lit(2)), F.lit("")).alias("w2"))


def consonant_skeleton(name: Column, n: int = 6) -> Column:
    """Letters without a, e, i, o, u; equal neighbours merged; the first n."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}]|[aeiou]", ""), r"(.)\1+", "$1"), 1, n)


def _tokens(address: Column, least: int, stop: list[str]) -> Column:
    tokens = F.regexp_extract_all(F.lower(address), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= least) & ~F.array_contains(_words(stop), t))))


def address_tokens(address: Column) -> Column:
    """Distinct tokens of three or more characters that are no stop words, sorted."""
    return _tokens(address, 3, ADDRESS_STOP_WORDS)


def address_token_set_key(address: Column, min_token_len: int = 3) -> Column:
    return F.array_join(_tokens(address, min_token_len, ADDRESS_KEY_STOP_WORDS), "_")


def composite(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def valid_key(key: Column) -> Column:
    """False for keys that are empty or 'nan', or have a blank or 'nan' component."""
    bad = F.exists(F.split(key, "[|]"), lambda p: F.trim(p).isin("", "nan"))
    return ~(key.isin("", "nan") | bad)


def first_character(name: Column) -> Column:
    return F.lower(F.substring(name, 1, 1))


def padded_words(text: Column, analyzer: str = "char_wb") -> Column:
    """The strings whose n-grams count: char_wb: each word, blank-padded; padded: the whole text, blank-padded."""
    if analyzer == "char_wb":
        words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    else:
        words = F.array(F.lower(text))
    return F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def char_ngrams(text: Column, low: int = 1, high: int = 3, analyzer: str = "char_wb") -> Column:
    """All character n-grams with repeats. char_wb: of each blank-padded word; padded: of the whole padded text."""
    padded = padded_words(text, analyzer)

    def of_word(w: Column) -> Column:
        def of_size(n: Column) -> Column:
            # A word shorter than n has one gram: itself. Guarded, since a sequence may run downwards.
            last = F.greatest(F.length(w) - n + 1, F.lit(1))
            return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(w, i, n))

        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: n <= F.greatest(F.length(w), F.lit(low)))
        return F.flatten(F.transform(sizes, of_size))

    return F.flatten(F.transform(padded, of_word))
