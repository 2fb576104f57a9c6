"""Values in answers: money, percentages, counts, dates, periods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currencies with their symbols; the first currency of a symbol counts.
CURRENCIES: dict[str, list[str]] = {
    "USD": ["$", "＄", "﹩", "dollar", "dollars", "Dollar", "Dollars", "US$", "US＄", "US﹩", "U.S.$", "U.S.＄", "U.S.﹩"],
    "EUR": ["€", "euro", "euros"],
    "GBP": ["GB£", "£", "pound", "pounds", "Pound", "Pounds", "￡", "GB￡", "UKP"],
    "CAD": ["CA$", "CA＄", "＄", "$", "dollar", "dollars", "Dollar", "Dollars", "CA﹩", "﹩"],
    "JPY": ["JP¥", "￥", "JP￥", "¥", "円", "圓"],
    "AUD": ["A$", "A＄", "＄", "$", "dollar", "dollars", "Dollar", "Dollars", "A﹩", "﹩"],
}
# Number words and scales.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = ["hundred", "thousand", "million", "billion", "trillion"]
SCALE_FACTORS = {"hundred": 10**2, "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
# How a scale is abbreviated; the first that fits counts.
SCALE_ENDINGS = [
    ("million", r"(?:millions?|mill?|mm|mn|mln|m)"),
    ("billion", r"(?:billions?|bill?|bn|bln|b)"),
    ("thousand", r"(?:thousands?|thsnd|k)"),
    ("hundred", r"(?:hundreds?|hund)"),
    ("trillion", r"(?:trillions?|trill?|trn|tln|tn|t)"),
]
# The words that tell what an amount counts; the first class with one of its words counts.
UNIT_CLASSES: dict[str, list[str]] = {
    "percent": ["%", "percent", "percentage"],
    "money": ["$", "€", "£", "¥", "dollar", "dollars", "million", "millions", "billion", "billions", "bn", "thousand", "hundred"],
    "area": ["sqft", "sq-ft", "square", "foot", "feet", "ft", "acre", "acres", "sft", "sf", "sq", "gsf", "nsf"],
    "storeys": ["story", "stories", "floor", "floors", "height"],
    "years": ["year", "years", "yr", "yrs"],
    "shares": ["shares"],
}


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def symbol_codes() -> dict[str, str]:
    codes: dict[str, str] = {}
    for code, symbols in CURRENCIES.items():
        for symbol in symbols:
            codes.setdefault(symbol.lower(), code)
    return codes


def currency(text: Column) -> Column:
    """Code of the first currency: a symbol before a number, or a name or code behind one; null if there is none."""
    codes = symbol_codes() | {c.lower(): c for c in CURRENCIES}
    signs = sorted((s for s in codes if not s.isalpha()), key=lambda s: (-len(s), s))
    names = sorted((s for s in codes if s.isalpha()), key=lambda s: (-len(s), s))
    quoted = "|".join(s.replace("$", r"\$").replace(".", r"\.") for s in signs)
    before = F.regexp_extract(F.lower(text), rf"({quoted}|\b(?:{'|'.join(c.lower() for c in CURRENCIES)}))\s?\d", 1)
    behind = F.regexp_extract(F.lower(text), rf"\d[\d.,]*\s?(?:(?:thousand|million|billion|k|m|bn)\s)?({'|'.join(names)})\b", 1)
    found = F.when(before != "", before).otherwise(behind)
    return F.try_element_at(_map(codes), found)


def words_to_int(words: Column) -> Column:
    """Value of an array of lower-case number words (units, tens, scales, 'and'); null if it is empty or holds others."""
    plain = {w: i for i, w in enumerate(UNITS)} | {w: 10 * i for i, w in enumerate(TENS) if w} | {"and": 0}
    value, factor = _map({k: float(v) for k, v in plain.items()}), _map({k: float(v) for k, v in SCALE_FACTORS.items()})
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("part"))

    def step(state: Column, word: Column) -> Column:
        scale = F.try_element_at(factor, word)
        part = F.greatest(state["part"], F.lit(1.0)) * scale
        return (
            F.when(scale.isNull(), F.struct(state["total"].alias("total"), (state["part"] + F.try_element_at(value, word)).alias("part")))
            .when(scale == 100, F.struct(state["total"].alias("total"), part.alias("part")))
            .otherwise(F.struct((state["total"] + part).alias("total"), F.lit(0.0).alias("part")))
        )

    return F.when(F.size(words) > 0, F.aggregate(words, start, step, lambda s: (s["total"] + s["part"]).cast("long")))


def grouped(number: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(number, 0)


def scale_of(text: Column) -> Column:
    """Scale word behind the number: million, billion, thousand, hundred or trillion; null if there is none."""
    lower, found = F.lower(text), None
    for name, ending in SCALE_ENDINGS:
        hit = F.regexp_like(lower, F.lit(rf"\d\s?{ending}\b"))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def unit_class(text: Column) -> Column:
    """What a text's number counts: percent, money, area, storeys, years or shares; null without number or class."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+(?:-\p{L}+)*|[%$€£¥])"), F.lit(1))
    found = F.lit(None).cast("string")
    for name, units in reversed(UNIT_CLASSES.items()):
        found = F.when(F.arrays_overlap(words, F.array(*(F.lit(u) for u in units))), name).otherwise(found)
    return F.when(F.regexp_like(text, F.lit(r"\d")), found)


def context_factor(text: Column) -> Column:
    """What amounts of a text that is "in millions" and the like are multiplied by; 1 if it isn't."""
    lower, found = F.lower(text), None
    for name in ("billion", "million", "thousand", "hundred"):
        hit = F.contains(lower, F.lit(f"in {name}"))
        found = F.when(hit, F.lit(SCALE_FACTORS[name])) if found is None else found.when(hit, F.lit(SCALE_FACTORS[name]))
    return found.otherwise(F.lit(1)).cast("long")


def number_in(text: Column) -> Column:
    """The first number of a text in English style, as double; null if there is none."""
    raw = F.regexp_extract(text, r"(-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)", 1)
    return F.nullif(F.replace(raw, F.lit(","), F.lit("")), F.lit("")).cast("double")


def money_amount(text: Column, context: Column | None = None) -> Column:
    """Number times the scale behind it, else times the scale its context announces."""
    scale = F.try_element_at(_map({k: float(v) for k, v in SCALE_FACTORS.items()}), scale_of(text))
    outer = F.lit(1.0) if context is None else context_factor(context).cast("double")
    return number_in(text) * F.coalesce(scale, outer)


def percentage(text: Column) -> Column:
    """Number before a per cent sign or word; null if there is none."""
    raw = F.regexp_extract(F.lower(text), r"(-?\d+(?:[.,]\d+)?)\s?(?:%|per ?cent\b|pct\b|prozent\b|pour cent\b)", 1)
    return F.nullif(F.replace(raw, F.lit(","), F.lit(".")), F.lit("")).cast("double")


MONTHS = "january february march april may june july august september october november december".split()


def date_in(text: Column) -> Column:
    """A date written as '5 March 2020' or '2020-03-05'; null if there is none."""
    lower = F.lower(text)
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.regexp_extract(lower, rf"\d\s({'|'.join(MONTHS)})\s\d{{4}}", 1))
    day = F.regexp_extract(lower, rf"(\d{{1,2}})\s(?:{'|'.join(MONTHS)})\s\d{{4}}", 1)
    year = F.regexp_extract(lower, rf"\d\s(?:{'|'.join(MONTHS)})\s(\d{{4}})", 1)
    spelled = F.when(month > 0, F.format_string("%s-%02d-%02d", year, month.cast("int"), day.cast("int")))
    iso = F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.coalesce(spelled, iso)


def period(text: Column) -> Column:
    """Count and unit of a period, such as '3 month'; null if there is none."""
    lower = F.lower(text)
    pattern = r"(\d+)[\s-]+(?:calendar )?(hour|day|week|month|year)s?\b"
    count, unit = F.regexp_extract(lower, pattern, 1), F.regexp_extract(lower, pattern, 2)
    return F.when(count != "", F.concat_ws(" ", count, unit))


def parsed_value(answer: Column, answer_type: Column) -> Column:
    """The answer's value by the expected type; the answer itself where the type has no value in it."""
    as_text = lambda c: F.regexp_replace(F.round(c, 4).cast("decimal(30,4)").cast("string"), r"\.?0+$", "")
    return F.coalesce(
        F.when(answer_type == "NUM:money", as_text(money_amount(answer)))
        .when(answer_type == "NUM:perc", as_text(percentage(answer)))
        .when(answer_type == "NUM:count", as_text(number_in(answer)))
        .when(answer_type == "NUM:date", date_in(answer))
        .when(answer_type == "NUM:period", period(answer)),
        answer,
    )


def char_distance(a: Column, b: Column) -> Column:
    """Jaccard distance of the sets of characters."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return 1 - F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _near(word: str, most: float) -> Callable[[Column], Column]:
    return lambda w: char_distance(w, F.lit(word)) < most


def picked_choices(answer: Column, choices: list[str], most: float = 0.25) -> Column:
    """The choices of which every word is close to a word of the answer, sorted and comma-joined; 'Other' if there is none."""
    words = F.filter(F.split(F.lower(answer), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hits = []
    for choice in choices:
        near = F.lit(True)
        for word in choice.lower().split():
            near = near & F.exists(words, _near(word, most))
        hits.append(F.when(near, F.lit(choice)))
    found = F.array_sort(F.filter(F.array(*hits), lambda c: c.isNotNull()))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("Other")
