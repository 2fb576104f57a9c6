"""Quantities in common units."""

import pytest
from conftest import rows

from gleaner.operators.units import SpellingMap, common_quantities, decimal_text

SCHEMA = "hit_id long, answer string, formatted string, header string, text string, file_idx string, unit string, rank int"
CASES = [
    # answer, formatted, header, text, file, unit, amount
    ("USD 5.2m", None, None, None, "en", "usd", 520_000_000),
    ("−£ 5", "", None, None, "en", "gbp", -500),
    ("(12.5)", None, "Cash (in thousands of EUR)", "was (12.5).", "en", "eur", -1_250_000),
    ("7,5", "", "Rent (in Tausend EUR)", None, "de", "eur", 750_000),
    ("1.234,5 m²", None, None, None, "de", "cm2", 12_345_000),
    ("5 400 mètres carrés", None, None, None, "fr", "cm2", 54_000_000),
    ("105,88 M€", None, None, None, "fr", "eur", 10_588_000_000),
    ("695,2m", None, None, None, "fr", "cm", 69_520),
    ("281.2 million", None, None, "a penalty of 281.2 million in euros and more", "en", "eur", 28_120_000_000),
    ("60.8", None, None, "it was 60.8 short tons until then", "en", "g", 55_156_832),
    ("160", None, None, "revenue in USD billions was 160 in all", "en", "usd", 16_000_000_000_000),
    ("3", "3 weeks", None, None, "en", "h", 504),
    ("sixty-four (64) weeks", None, None, None, "en", "h", 10_752),
    ("Nine hundred forty-six million us dollars.", None, None, None, "en", "usd", 94_600_000_000),
    ("42-hours", None, None, None, "en", "h", 42),
    ("2 yrs", None, None, None, "en", "month", 24),
    ("6.23 per cent", None, None, None, "en", "bp", 623),
    ("18.8‰", None, None, None, "en", "bp", 188),
    ("1 TJ", None, None, None, "en", "wh", 277_777_778),
    ("12 kilogrms", None, None, None, "en", "g", 12_000),
    ("3 tonns", None, None, None, "en", "g", 3_000_000),
    ("5 TEUR", None, None, None, "de", "eur", 500_000),
    ("293 pounds", None, None, None, "en", "g", 132_903),
]
NO_CASES = [("2017", None, None, "closed (2017)."), ("878 employees", None, None, None), ("Section 7.2", None, None, None), ("18 March 2013", None, None, None), (None, None, "(in EUR)", None), ("", " ", None, "5 kg"), ("across 5", None, None, None), ("6.1", None, None, "was 6.1 across all branches")]


def table(spark, cases):
    return spark.createDataFrame([(i, *c[:5], "x", 1) for i, c in enumerate(cases)], SCHEMA)


def langs(spark):
    return spark.createDataFrame([("en", "en-GB"), ("de", "DE"), ("fr", "fr-CH"), ("en", "en-GB")], "file_idx string, lang string")


def run(spark, df):
    return common_quantities(df, "hit_id", "answer", "formatted", "header", "text", "file_idx", langs(spark))


def test_cases(spark):
    df = table(spark, CASES)
    got = rows(run(spark, df.unionAll(df)))
    assert got == sorted([(i, c[5], c[6]) for i, c in enumerate(CASES)], key=str)


def test_no_cases(spark):
    df = table(spark, [(*c, "en") for c in NO_CASES])
    assert run(spark, df).count() == 0
    assert run(spark, df.limit(0)).count() == 0


def test_missing_keys(spark):
    df = spark.createDataFrame([(None, "5 kg", None, None, None, "en", "x", 1), (7, "1,5 kg", None, None, None, None, "x", 1), (8, "5 kg " + "x" * 100_000, None, None, "y" * 100_000, "?", "x", 1)], SCHEMA)
    assert rows(run(spark, df)) == [(7, "g", 1_500)]


@pytest.mark.parametrize("number, lang, value", [("1,234.5", "en", "1234.5"), ("1.234,5", "de", "1234.5"), ("4 121,9", "fr", "4121.9"), ("12,5", "en", "12.5"), ("1.5", "de", "1.5"), ("1.500", "de", "1500"), ("9,800,000", "en", "9800000")])
def test_number_styles(number, lang, value):
    assert decimal_text(number, lang) == value


def test_spellings():
    spellings = SpellingMap()
    known = lambda s: (m := spellings(s)) and (m.unit, float(m.factor))
    assert known("us$ thsnd") == ("usd", 100_000)
    assert known("millions de francs suisses") == ("chf", 100_000_000)
    assert known("in square kilometers") == ("cm2", 1e10)
    assert known("m") == ("cm", 100) and known("€ m") == ("eur", 100_000_000)
    assert known("kilowat hours") == ("wh", 1000)
    for other in ("tenants", "employees", "claims", "sites", "shares", "section", "", "usd eur"):
        assert spellings(other) is None
    assert spellings("kilogrms", exact=True) is None
