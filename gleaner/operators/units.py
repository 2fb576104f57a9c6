"""Quantities written in different units, scales and number styles, converted to common units."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import written

# The spellings known beforehand, and what one unit is in the common unit.
UNITS: dict[tuple[str, str], str] = {
    ("usd", "100"): "$ | us$ | usd | dollar | dollars | us dollar | us dollars | us-dollar | us-dollars | dollars américains | dollar américain",
    ("eur", "100"): "€ | eur | euro | euros",
    ("gbp", "100"): "£ | gbp | pound sterling | pounds sterling | pfund sterling | livre sterling | livres sterling | britische pfund | britischen pfund | british pounds",
    ("chf", "100"): "chf | sfr. | sfr | fr. | franken | schweizer franken | swiss franc | swiss francs | francs suisses | franc suisse",
    ("bp", "100"): "% | percent | per cent | pct | prozent | pour cent",
    ("bp", "10"): "‰ | per mille | promille | pour mille",
    ("bp", "1"): "bp | bps | basis point | basis points | basispunkt | basispunkte | point de base | points de base | pdb",
    ("cm2", "10000"): "m² | m2 | sqm | sq m | sq. m. | square metre | square metres | square meters | qm | quadratmeter | mètre carré | mètres carrés",
    ("cm2", "10000000000"): "km² | km2 | square kilometre | square kilometres | square kilometers | quadratkilometer | kilomètres carrés",
    ("cm2", "100000000"): "ha | hectare | hectares | hektar",
    ("cm2", "40468564.224"): "ac | acre | acres",
    ("cm2", "929.0304"): "sf | sqft | sq ft | sq. ft. | square foot | square feet | ft² | ft2",
    ("g", "1000"): "kg | kilo | kilos | kilogram | kilograms | kilogramm | kilogramme | kilogrammes",
    ("g", "1000000"): "t | mt | ton | tons | tonne | tonnes | tonnen | metric ton | metric tons",
    ("g", "1000000000"): "kt | kilotonne | kilotonnes",
    ("g", "907184.74"): "short ton | short tons | us ton | us tons",
    ("g", "453.59237"): "lb | lbs | pound | pounds",
    ("wh", "1000"): "kwh | kilowatt hour | kilowatt hours | kilowatt-hour | kilowatt-hours | kilowattstunde | kilowattstunden",
    ("wh", "1000000"): "mwh | megawatt hour | megawatt hours | megawatt-hours | megawattstunden",
    ("wh", "1000000000"): "gwh | gigawatt hour | gigawatt hours | gigawatt-hours | gigawattstunden",
    ("wh", "277777.7777777778"): "gj | gigajoule | gigajoules",
    ("wh", "277777777.7777777778"): "tj | terajoule | terajoules",
    ("cm", "100"): "m | metre | metres | meter | meters | mètre | mètres",
    ("cm", "100000"): "km | kilometre | kilometres | kilometer | kilometers | kilomètre | kilomètres",
    ("cm", "160934.4"): "mi | mile | miles",
    ("cm", "30.48"): "ft | foot | feet",
    ("h", "1"): "h | hr | hrs | hour | hours | std. | std | stunde | stunden | heure | heures",
    ("h", "24"): "d | day | days | calendar day | calendar days | tag | tage | kalendertag | kalendertage | jour | jours",
    ("h", "168"): "wk | wks | week | weeks | woche | wochen | semaine | semaines",
    ("month", "1"): "mo. | mos. | mo | mos | month | months | calendar month | calendar months | monat | monate | mois",
    ("month", "12"): "yr | yrs | year | years | jahr | jahre | an | ans | année | années",
}
SCALES: dict[str, str] = {
    "1000": "k | thousand | thousands | thsnd | tsd. | tsd | tausend | t€ | millier | milliers",
    "1000000": "m | mm | mn | mln | mio. | mio | million | millions | millionen",
    "1000000000": "bn | bln | billion | billions | mrd. | mrd | md | milliarde | milliarden | milliard | milliards",
}
#: A scale and a currency written together.
GLUED = re.compile(r"^(k|m|md|t)(€|\$|£|eur|usd|gbp|chf)$")
GLUED_SCALE = {"k": "1000", "t": "1000", "m": "1000000", "md": "1000000000"}
MONEY = ("usd", "eur", "gbp", "chf")
#: Words that only connect a unit to its context.
LINKS = {"in", "en", "of", "de", "des", "all", "amounts", "beträge", "montants", "the"}
NUMBER_WORDS: dict[str, int] = {
    w: n
    for n, w in [
        *enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()),
        *zip(range(20, 100, 10), "twenty thirty forty fifty sixty seventy eighty ninety".split(), strict=True),
    ]
}
GAPS = "\u00a0\u202f"
DIGITS = rf"\d{{1,3}}(?:[ {GAPS}'’]\d{{3}})+(?:[.,]\d+)?|\d+(?:[.,]\d+)*"
NUMBER = re.compile(DIGITS)
QUANTITY = re.compile(rf"^(?P<open>\()?\s*(?P<sign>[-−–])?\s*(?P<before>[^\d\s()−–-][^\d()−–-]*?)?\s*(?P<sign2>[-−–])?\s*(?P<number>{DIGITS})\s*-?\s*(?P<after>[^\d\s()][^()]*?)?\s*(?P<close>\))?$")
SPELLED = re.compile(rf"^(?P<words>[A-Za-z -]+?)\s*(?:\(\s*(?P<number>{DIGITS})\s*\))\s*(?P<after>[^\d\s].*)?$")
ENCLOSED = re.compile(r"\(\s*((?:all amounts in|amounts in|beträge in|montants en|in|en)\s[^()]+|[^()]+,\s*in\s\w+)\)", re.IGNORECASE)
OPEN_HINT = re.compile(
    r"\bin ((?:(?:thousands|millions|billions) (?:us dollars|usd|euros?|eur|pounds sterling|gbp|swiss francs|chf))"
    r"|(?:(?:us dollars|usd|euros?|eur|pounds sterling|gbp|swiss francs|chf) (?:thousands|millions|billions)))\b",
    re.IGNORECASE,
)
NUMBER_GOES_ON = re.compile(r"[.,]?\d")
DOTTED_UNIT = re.compile(r"\s?(?:sq|mo|mos|std|mio|mrd|tsd)\.", re.IGNORECASE)
LANGUAGES = {"en": "en", "de": "de", "fr": "fr", "ge": "de", "al": "de", "an": "en"}
CANDIDATE = pa.schema(
    [("id", pa.int64()), ("grp", pa.string()), ("rank", pa.int32()), ("number", pa.string()), ("negative", pa.bool_()), ("enclosed", pa.bool_()), ("spelling", pa.string()), ("exact", pa.bool_())]
)
GRAM = 3
#: So many words beside a number may be its unit.
BESIDE_WORDS = 5
WORDS_BEHIND = re.compile(r"(?:\s*\))?((?:\s*[^\s.;:()]+){0,%d})" % (BESIDE_WORDS + 1))
DOTTED_BEHIND = re.compile(r"((?:\s*(?!\s\()[^\s]+){0,%d})" % (BESIDE_WORDS + 1))
LARGEST = 2**63 - 1
SHARED_SPELLINGS = 100_000
CACHED_SPELLINGS = 100_000


def plain(text: str) -> str:
    """Lower case, single-spaced, without closing full stop (an abbreviation's stays)."""
    return " ".join(text.lower().replace("−", "-").split())


@dataclass(frozen=True)
class Meaning:
    unit: str | None
    factor: Decimal


def _known() -> tuple[dict[str, Meaning], dict[str, Decimal]]:
    units = {a.strip(): Meaning(unit, Decimal(factor)) for (unit, factor), names in UNITS.items() for a in names.split(" | ")}
    scales = {a.strip(): Decimal(factor) for factor, names in SCALES.items() for a in names.split(" | ")}
    return units, scales


class SpellingMap:
    """Maps a unit spelling to its unit and factor; unknown words through an n-gram index and weighted edit distance."""

    def __init__(self) -> None:
        self.units, self.scales = _known()
        self.longest = max(len(a.split()) for a in self.units)
        self.words = {w for a in [*self.units, *self.scales] for w in a.split()} | LINKS
        self.index: dict[str, set[str]] = {}
        for word in self.words:
            if len(word) >= 5:
                for gram in self.grams(word):
                    self.index.setdefault(gram, set()).add(word)

    @staticmethod
    def grams(word: str) -> set[str]:
        padded = f"^{word}$"
        return {padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)}

    @staticmethod
    def distance(a: str, b: str, half: float = 0.5) -> float:
        """Edit distance; a doubled letter, a swapped pair and a changed vowel or accent cost ``half``."""
        vowels = set("aeiouyàâäéèêëîïôöùûü")
        rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            rows[i][0] = float(i)
        for j in range(1, len(b) + 1):
            rows[0][j] = float(j)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                drop = half if i > 1 and a[i - 2] == x else 1.0
                add = half if j > 1 and b[j - 2] == y else 1.0
                change = 0.0 if x == y else half if x in vowels and y in vowels else 1.0
                best = min(rows[i - 1][j] + drop, rows[i][j - 1] + add, rows[i - 1][j - 1] + change)
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                    best = min(best, rows[i - 2][j - 2] + half)
                rows[i][j] = best
        return rows[-1][-1]

    def repair(self, word: str) -> str:
        """The one known word within a sixth of the length, else the word itself."""
        if word in self.words or len(word) < 5 or not word.isalpha():
            return word
        shared: dict[str, int] = {}
        own = self.grams(word)
        for gram in own:
            for known in self.index.get(gram, ()):
                shared[known] = shared.get(known, 0) + 1
        near = sorted(
            (self.distance(word, known), known)
            for known, n in shared.items()
            if abs(len(known) - len(word)) <= 2 and 3 * n >= len(own)
        )
        # a short word may differ in one place, whatever it weighs
        near = [x for x in near if x[0] <= max(1.0, len(word) / 6) and (len(word) > 7 or self.distance(word, x[1], 1.0) <= 1)]
        return near[0][1] if near and (len(near) == 1 or near[0][0] < near[1][0] or near[0][1].rstrip("s") == near[1][1].rstrip("s")) else word

    def __call__(self, spelling: str, exact: bool = False) -> Meaning | None:
        """Unit and factor if every word of the spelling has its place: links, scales, one unit; ``exact`` repairs no words."""
        tokens: list[str] = []
        for raw in re.sub(r"(?<=[€$£%‰])(?=\w)|(?<=\w)(?=[€£%‰])|(?<![su])(?<=\w)(?=\$)", " ", spelling.replace(",", " ")).split():
            if raw not in self.words and raw.rstrip(".") in self.words:
                raw = raw.rstrip(".")
            tokens.append(raw)
        joined = re.sub(r"\b(k|m|md|t) (€|\$|£)$", r"\1\2", " ".join(tokens))
        tokens = joined.split() if exact else [self.repair(t) for t in joined.split()]
        for metre in (False, True):  # m is a scale beside a currency, else a metre
            if meaning := self._parse(tokens, metre):
                return meaning
        return None

    def _parse(self, tokens: list[str], metre: bool) -> Meaning | None:
        unit, factor, scales, i = None, Decimal(1), 0, 0
        while i < len(tokens):
            token = tokens[i]
            if glued := GLUED.match(token):
                if unit or scales:
                    return None
                unit = self.units[glued[2]].unit
                factor *= 100 * Decimal(GLUED_SCALE[glued[1]])
                scales, i = scales + 1, i + 1
                continue
            size = next((n for n in range(min(self.longest, len(tokens) - i), 0, -1) if " ".join(tokens[i : i + n]) in self.units), 0)
            if token in self.scales and size < 2 and not (metre and token == "m") and not (token == "t" and size):
                factor *= self.scales[token]
                scales, i = scales + 1, i + 1
            elif size:
                if unit:
                    return None
                meaning = self.units[" ".join(tokens[i : i + size])]
                unit, factor, i = meaning.unit, factor * meaning.factor, i + size
            elif token in LINKS:
                i += 1
            else:
                return None
        if not unit or scales > 1 or (scales and unit not in MONEY and (unit != "g" or "m" in tokens)):
            return None
        return Meaning(unit, factor)


def words_to_number(words: list[str]) -> int | None:
    """Value of English number words up to the hundreds; None if there are others."""
    total, any_word = 0, False
    for word in words:
        if word == "and" and any_word:
            continue
        if word == "hundred" and any_word:
            total *= 100
        elif word in NUMBER_WORDS:
            total += NUMBER_WORDS[word]
        else:
            return None
        any_word = True
    return total if any_word else None


def leading_words(text: str) -> tuple[int, str] | None:
    """Number and rest of a text that begins with number words."""
    words = text.replace("-", " ").split()
    n = 0
    while n < len(words) and (words[n].lower() in NUMBER_WORDS or words[n].lower() == "hundred" or (n and words[n].lower() == "and")):
        n += 1
    value = words_to_number([w.lower() for w in words[:n]]) if n else None
    return None if value is None else (value, " ".join(words[n:]))


def decimal_text(number: str, lang: str) -> str:
    """A number of the language's style with a decimal point and without separators."""
    number = re.sub(rf"[ {GAPS}'’]", "", number)
    group, point = (",", ".") if lang == "en" else (".", ",")
    if number.count(point) > 1 or (point in number and group in number and number.rindex(group) > number.index(point)):
        group, point = point, group  # only the other style makes sense of it
    if group in number and not re.fullmatch(rf"\d{{1,3}}(?:\{group}\d{{3}})+(?:\{point}\d+)?", number):
        group, point = point, group
    return number.replace(group, "").replace(point, ".")


@dataclass(frozen=True)
class Parsed:
    number: str
    negative: bool
    enclosed: bool
    spelling: str
    spelled: bool = False


def parse_quantity(text: str | None) -> Parsed | None:
    """Number, sign and unit spelling of a short text that is one quantity."""
    if not text:
        return None
    text = text.strip().removesuffix(".").strip() if not re.search(r"\b(?:ft|mo|mos|std|mio|mrd|tsd|sfr|m)\.$", text.strip(), re.IGNORECASE) else text.strip()
    if m := QUANTITY.match(text):
        spelling = plain(f"{m['before'] or ''} {m['after'] or ''}")
        enclosed = bool(m["open"] and m["close"])
        return Parsed(m["number"], bool(m["sign"] or m["sign2"]), enclosed, spelling)
    if m := SPELLED.match(text):
        if words_to_number(m["words"].lower().replace("-", " ").split()) is not None:
            return Parsed(m["number"], False, False, plain(m["after"] or ""))
        return None
    if not any(c.isdigit() for c in text) and (found := leading_words(text)):
        return Parsed(str(found[0]), False, False, plain(found[1]), True)
    return None


def hints(text: str | None) -> list[str]:
    """Unit spellings that a text or heading announces for its numbers."""
    if not text:
        return []
    return [plain(h) for h in [*ENCLOSED.findall(text), *(m[0] if isinstance(m, tuple) else m for m in OPEN_HINT.findall(text))]]


def beside(text: str, number: str) -> list[str]:
    """Spellings of what stands right before and after the number in a text, longest first."""
    found = []
    at = text.find(number)
    while at >= 0:
        end = at + len(number)
        if not (at and (text[at - 1].isdigit() or (text[at - 1] in ".," and at > 1 and text[at - 2].isdigit()))) and not NUMBER_GOES_ON.match(text, end):
            before = re.search(r"([A-Za-z]{0,3}\.?[$€£]?)\s?[-−]?$", text[max(0, at - 8) : at])
            lead = before[1] if before and re.search(r"[$€£]|^(?:[A-Z]{3}|SFr\.)$", before[1]) else ""
            dotted = DOTTED_UNIT.match(text, end)
            rest = (DOTTED_BEHIND if dotted else WORDS_BEHIND).match(text, end)[1].split(" (")[0]
            words = rest.split(",")[0].replace("-", " ", 1).split() if rest.startswith("-") else rest.split(",")[0].split()
            for n in range(min(BESIDE_WORDS, len(words)), 0, -1):
                found.append(plain(f"{lead} {' '.join(words[:n])}"))
            if lead:
                found.append(plain(lead))
        at = text.find(number, end)
    return found


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row the spellings that may be its unit, in order of trust, with number and sign."""
    spellings, cache = SpellingMap(), {}

    def known(spelling: str) -> bool:
        """Without repairs: these are made once for each distinct spelling."""
        if spelling not in cache:
            if len(cache) > CACHED_SPELLINGS:
                cache.clear()
            cache[spelling] = bool(spelling) and spellings(spelling, True) is not None
        return cache[spelling]

    for batch in batches:
        out: tuple[list, ...] = tuple([] for _ in CANDIDATE.names)
        for key, grp, answer, formatted, header, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = [p for p in (parse_quantity(formatted), parse_quantity(answer)) if p]
            if not own:
                continue
            tried = [(p, p.spelling, False) for p in own if p.spelling]
            clear = any(known(p.spelling) for p in own)  # then the surroundings need not be tried
            around, above = ([], []) if clear else (hints(text), hints(header))
            for p in () if clear else sorted(own, key=lambda p: p.spelling != ""):
                if text and not p.spelled:
                    tried += [(p, s, True) for s in beside(text, p.number)]  # running text holds other words
                tried += [(p, f"{p.spelling} {h}".strip(), False) for h in [*around, *above]]
            enclosed = any(p.enclosed for p in own)
            negative = any(p.negative for p in own)
            seen = set()
            for rank, (p, spelling, exact) in enumerate(tried):
                if (spelling, p.number) not in seen:
                    seen.add((spelling, p.number))
                    for column, value in zip(out, (key, grp, rank, p.number, negative, enclosed, spelling, exact), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, CANDIDATE.types, strict=True)], schema=CANDIDATE)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spellings = SpellingMap()
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        found = [(s, e, m.unit, str(m.factor)) for s, e in pairs if (m := spellings(s, e))]
        types = (pa.string(), pa.bool_(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=["spelling", "exact", "unit", "factor"]
        )


def _amounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole numbers of the common unit, rounded half away from zero; null beyond 64 bits."""
    with localcontext(prec=200):
        for batch in batches:
            amounts = []
            for number, lang, factor in zip(*(batch.column(c).to_pylist() for c in ("number", "lang", "factor")), strict=True):
                amount = int((Decimal(decimal_text(number, lang)) * Decimal(factor)).quantize(Decimal(1), ROUND_HALF_UP)) if len(number) <= 100 else LARGEST + 1
                amounts.append(amount if amount <= LARGEST else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "negative", "enclosed", "unit")] + [pa.array(amounts, pa.int64())], names=["id", "negative", "enclosed", "unit", "amount"]
            )


def number_style(lang: Column) -> Column:
    """'en', 'de' or 'fr' of a language tag or name; 'en' if it is none of them."""
    first = F.lower(F.substring(F.trim(lang), 1, 2))
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(known[first], F.lit("en"))


def common_quantities(
    df: DataFrame, id: str, answer: str, formatted: str, header: str, text: str, group: str, langs: DataFrame, units: DataFrame | None = None, salts: int = 16
) -> DataFrame:
    """(id, unit, amount): the quantity of every row that has one, as a whole number of its common unit.

    ``answer`` and ``formatted`` state the same quantity; its unit stands in
    one of them, beside the number in ``text``, or is announced in ``text`` or
    ``header``, in that order. ``langs`` (group, lang) gives the language whose
    number style a ``group`` follows, English if it is missing. Rows without
    number or without known unit give no rows, nor do rows without id; rows
    delivered twice count once; an empty table gives none. Amounts are rounded
    half away from zero, and there is none beyond 64 bits; money in parentheses
    is negative. ``units`` (unit) limits the result to these common units.

    Spellings next to a number or in a heading are collected, the distinct
    ones are mapped to units once, and this dictionary is joined to all rows.
    """
    filled = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    rows = df.where(F.col(id).isNotNull() & (filled(answer) | filled(formatted))).select(
        F.col(id).cast("long").alias("id"), F.col(group).cast("string").alias("grp"), answer, formatted, header, text
    )
    tried = written(rows.mapInArrow(_candidates, "id long, grp string, rank int, number string, negative boolean, enclosed boolean, spelling string, exact boolean"))
    aliases = written(tried.select("spelling", "exact").distinct().mapInArrow(_resolve, "spelling string, exact boolean, unit string, factor string"))
    if units is not None:
        aliases = aliases.join(F.broadcast(units.select("unit").distinct()), "unit", "left_semi")  # as many as there are common units
    small = aliases.count() <= SHARED_SPELLINGS
    mapped = tried.join(F.broadcast(aliases) if small else aliases, ["spelling", "exact"])
    best = mapped.groupBy("id").agg(F.min(F.struct("rank", "number", "negative", "enclosed", "unit", "factor", "grp")).alias("b")).select("id", "b.*")
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    known = langs.select(F.col(group).alias("grp"), number_style(F.col("lang")).alias("lang")).where("grp is not null").groupBy("grp").agg(F.min("lang").alias("lang"))
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    styled = best.withColumn("salt", salt).join(spread, ["grp", "salt"], "left").withColumn("lang", F.coalesce("lang", F.lit("en")))
    valued = styled.select("id", "number", "lang", "negative", "enclosed", "unit", "factor").mapInArrow(
        _amounts, "id long, negative boolean, enclosed boolean, unit string, amount long"
    )
    minus = F.col("negative") | (F.col("enclosed") & F.col("unit").isin(*MONEY))
    signed = F.when(minus, -F.col("amount")).otherwise(F.col("amount"))
    return valued.where("amount is not null").select(F.col("id").cast(df.schema[id].dataType).alias(id), "unit", signed.alias("amount"))
