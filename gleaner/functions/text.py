"""Text expressions. Everything here is a Column over built-in functions, or driver-side text of a request."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that make a sentence a question, and a yes/no question.
QUESTION_WORDS = ["who", "what", "when", "where", "why", "how", "which", "whose", "whom"]
BOOL_QUESTION_WORDS = [
    "is", "isn't", "was", "were", "do", "does", "will", "can", "are", "has", "have", "had", "did", "should", "would", "could", "need", "must", "shall",
]
#: Words without content of their own; a parameter wherever it is used.
STOP_WORDS = (
    "a an and any as at be been but by for from how if in into is it its no not of on or over such than that the their then there these they this to under "
    "was were what when where which who whom whose why will with der die das und oder von zu im in den dem des ein eine le la les des du de et ou un une à au aux"
).split()
QUOTES = "\"'“”‘’"
SEPARATORS = r"[^\p{L}\p{N}]+"


def one_of(column: Column, words: list[str]) -> Column:
    return column.isin(*words)


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, in order; null stays null."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != "")


def padded(words: Column) -> Column:
    """Tokens as a string in which each has its own blanks, so that a phrase is found by its text."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def padded_phrase(words: list[str]) -> str:
    return " " + "  ".join(words) + " "


def phrase_count(padded_text: Column, words: list[str]) -> Column:
    """How often the words follow each other in a padded text."""
    phrase = padded_phrase(words)
    return (F.length(padded_text) - F.length(F.replace(padded_text, F.lit(phrase), F.lit("")))) / len(phrase)


def has_phrase(padded_text: Column, words: list[str]) -> Column:
    return F.coalesce(F.contains(padded_text, F.lit(padded_phrase(words))), F.lit(False))


def has_all(token_array: Column, words: list[str]) -> Column:
    """Every word occurs; false for null text, true for no words."""
    found = F.lit(True)
    for word in words:
        found = found & F.coalesce(F.array_contains(token_array, word), F.lit(False))
    return found


def ngrams(words: Column, n: int) -> Column:
    """Runs of n tokens, joined by blanks; empty if there are fewer."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def bare_words(text: Column) -> Column:
    """Lower-case words between blanks after deleting ASCII punctuation."""
    bare = F.translate(F.lower(text), string.punctuation, "")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def spaced_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")


def _first_of(text: Column, words: list[str]) -> Column:
    parts = spaced_words(text)
    return F.coalesce((F.size(parts) > 1) & one_of(F.get(parts, F.lit(0)), words), F.lit(False))


def is_question(text: Column) -> Column:
    """More than one word, the first of them a question or auxiliary word; what stands before a first bar doesn't count."""
    bar = F.split(text, r"\|")
    behind = F.when(F.size(bar) > 1, F.get(bar, F.lit(1))).otherwise(text)
    return _first_of(behind, QUESTION_WORDS + BOOL_QUESTION_WORDS)


def is_bool_question(text: Column) -> Column:
    return _first_of(text, BOOL_QUESTION_WORDS)


def make_question(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.endswith("?"), trimmed).otherwise(F.concat(trimmed, F.lit("?")))


def remove_question_mark(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\?+$", "")


def without(words: Column, stop: list[str]) -> Column:
    """Words that are no stop words; repetitions stay."""
    return F.filter(words, lambda w: ~one_of(w, stop))


def keyword_text(question: Column, stop: list[str] | None = None) -> Column:
    return F.array_join(without(bare_words(question), (stop or STOP_WORDS) + QUESTION_WORDS + BOOL_QUESTION_WORDS), " ")


def valid_text(text: Column) -> Column:
    """Null becomes empty, blanks around are dropped."""
    return F.trim(F.coalesce(text, F.lit("")))


def plain_quotes(text: Column) -> Column:
    return F.translate(text, "“”‘’", "\"\"''")


def without_quotes(text: Column) -> Column:
    return F.translate(text, QUOTES, "")


def quoted_spans(text: Column) -> Column:
    """What stands between double quotation marks, straight or curly."""
    return F.regexp_extract_all(F.translate(text, "“”", '""'), F.lit('"([^"]+)"'), F.lit(1))


def keywords_of(text: Column, most: int = 5) -> Column:
    """Quoted spans, else words, those of fewer than ``most`` words."""
    spans = quoted_spans(text)
    chosen = F.when(F.size(spans) > 0, spans).otherwise(spaced_words(text))
    return F.filter(chosen, lambda k: F.size(F.split(k, " ")) < most)


def stem(word: Column) -> Column:
    """A light stem: plural and participle endings of words of more than four letters."""
    return F.when(F.length(word) > 4, F.regexp_replace(word, "(?:ings|ing|ies|ed|es|s|en|e)$", "")).otherwise(word)


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(tokens(text), stem))


def _bounded(variant: str) -> str:
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_-])\Q{variant}\E(?![\p{{L}}\p{{N}}_-])"


def canonical_synonyms(text: Column, dictionary: dict[str, list[str]]) -> Column:
    """Every variant replaced by its key, longer variants first; words only as a whole, in any letter case."""
    variants = sorted(((v, key) for key, vs in dictionary.items() for v in vs if v.lower() != key.lower()), key=lambda x: (-len(x[0]), x[0]))
    for variant, key in variants:
        text = F.regexp_replace(text, _bounded(variant), key.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def expanded_synonyms(text: str, dictionary: dict[str, list[str]]) -> tuple[list[str], dict[str, list[str]]]:
    """Variants of a request's text with each member of each dictionary entry found in it, and the entries used."""
    texts, used = [text], {}
    for key, others in sorted(dictionary.items()):
        members = sorted({key, *others}, key=lambda m: (-len(m), m))
        for member in members:
            pattern = re.compile(rf"(?<![\w-]){re.escape(member)}(?![\w-])", re.IGNORECASE)
            if pattern.search(text):
                used[key] = sorted(members)
                texts = [pattern.sub(lambda _, m=m: m, t) for t in texts for m in sorted(members)]
                break
    return list(dict.fromkeys(texts)), used


def synonym_variants(text: Column, key: str, others: list[str]) -> Column:
    """Variants of a column's texts with each member in place of the first member found; the text itself if none is."""
    members = sorted({key, *others}, key=lambda m: (-len(m), m))
    result = F.array(text)
    for member in reversed(members):
        found = F.regexp_like(text, F.lit(_bounded(member)))
        result = F.when(found, F.array(*(F.regexp_replace(text, _bounded(member), m) for m in sorted(members)))).otherwise(result)
    return F.array_distinct(result)


def split_words(text: str) -> list[str]:
    """``tokens`` of a request's text, on the driver."""
    return re.findall(r"[^\W_]+", text.lower())


def before_dash(text: Column) -> Column:
    """A summary question without the prompt behind its first dash."""
    return F.trim(F.get(F.split(text, "-", 2), F.lit(0)))


def is_word_boundary(char: Column) -> Column:
    """No letter, digit, dash or underscore."""
    return ~F.regexp_like(char, F.lit(r"^[\p{L}\p{N}_-]$"))
