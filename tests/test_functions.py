"""Literal cases of normalisation and blocking features, non-Latin text among them."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import features as X
from kinfold.functions import normalize as N


def apply(spark, make, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, make, cases):
    assert apply(spark, make, [a for a, _ in cases]) == [b for _, b in cases]


def test_normalize_text(spark):
    cases = [
        (None, ""), ("", ""), ("Café & Co.", "cafe and co"), ("Straße 007", "strasse 7"), ("000", "0"), ("007a", "007a"), ("A_B", "a b"),
        ("Ａｃｍｅ１２", "acme12"), ("दिल्ली", "दिल्ली"), ("Customer#000000001", "customer 1"), ("  a \t b\n", "a b"), ("दिल्ली मार्ग 0042", "दिल्ली मार्ग 42"),
        ("가", "가"), ("ẞ", "ss"),
    ]
    check(spark, N.normalize_text, cases)


def test_business_names(spark):
    cases = [
        ("Acme Private Limited", "acme pvt ltd"), ("Foo Public Limited Company", "foo public ltd co"), ("Foo Sociedade Anonima", "foosa"),
        ("Foo Sociedades Anonimas", "foosa"), ("Foo Sociedad Anónima", "foo sociedad anonima"), ("Müller Gesellschaft mit beschränkter Haftung", "muller gmbh"),
        ("Société à Responsabilité Limitée", "sarl"), ("Accompany Company", "accompany co"), ("Sociedade Anonima", "sociedade anonima"), ("X Incorporated Corporation", "x inc corp"),
    ]
    check(spark, N.normalize_business_name, cases)


def test_addresses(spark):
    cases = [("12 MG Road, Sector 05", "12 mg rd sec 5"), ("Hauptstraße 3", "hauptstrasse 3"), ("Strasse 3", "str 3"), ("Numéro 4 Rue", "no 4 rue"), ("Street Lane Avenue Boulevard", "st ln ave blvd")]
    check(spark, N.normalize_address, cases)


def test_phonetic_and_sorted_keys(spark):
    cases = [("ashcraft", "A261"), ("pfister", "P236"), ("tymczak", "T522"), ("acme co", "A252"), ("3m company", "M251"), ("दिल्ली", ""), ("", ""), (None, "")]
    check(spark, N.phonetic_key, cases)
    check(spark, N.sorted_token_key, [("Beta Alpha Beta", "alpha beta beta"), ("", ""), (None, "")])


def test_significant_words(spark):
    cases = [("the acme global tools", ("acme", "tools")), ("of co", ("of", "")), ("", ("", "")), ("acme acme", ("acme", "acme")), ("a-b xyz", ("xyz", ""))]
    assert [tuple(x) for x in apply(spark, X.significant_words, [a for a, _ in cases])] == [b for _, b in cases]


def test_skeleton_tokens_and_validity(spark):
    check(spark, X.consonant_skeleton, [("banana", "bn"), ("booking llc", "bknglc"), ("banana booking llc", "bnbkng"), ("", ""), ("aeiou 12", "")])
    check(spark, X.address_tokens, [("12 mg rd near 5th floor no 007a", ["007a", "5th"]), ("", []), ("x_1 x_1 abc", ["abc", "x_1"])])
    check(spark, X.address_token_set_key, [("12 floor street abc", "abc_floor"), ("", "")])
    check(spark, X.valid_key, [("A|", False), ("A|nan", False), ("A| ", False), ("nan", False), ("", False), ("A|b", True), ("x", True)])


def test_char_ngrams(spark):
    check(spark, X.char_ngrams, [("", []), (" ", []), ("ab", [" ", "a", "b", " ", " a", "ab", "b ", " ab", "ab "])])
    check(spark, lambda c: X.char_ngrams(c, analyzer="padded"), [("", [" ", " ", "  "])])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_fold_is_stable(text):
    once = N.fold_text(text)
    assert N.fold_text(once) == once and (not text.isascii() or once == text)


@pytest.mark.parametrize("text", ["Crème brûlée & Söhne 0012", "ÀÉÎ õ ñ ç", "a & b & c"])
def test_normalize_is_idempotent_on_latin(spark, text):
    once = apply(spark, N.normalize_text, [text])
    assert apply(spark, N.normalize_text, once) == once


def test_record_columns(spark):
    df = spark.createDataFrame([("S1-1", None, "1 Road", None, 5)], "entity_id string, business_name string, business_address string, country string, x int")
    out = N.normalize_records(df)
    assert out.columns == ["entity_id", "business_name", "normalized_name", "business_address", "normalized_address", "phonetic_key", "sorted_token_key", "country"]
    assert tuple(out.first()) == ("S1-1", "", "", "1 Road", "1 rd", "", "", "")
