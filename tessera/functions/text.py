"""Scalar text functions as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of common items in texts.
COMMON_PATTERNS = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "phone": "1[3-9][0-9]{9}",
    "id_card": "[0-9]{17}[0-9Xx]",
    "measurement": "[0-9]+(?:[.][0-9]+)?(?:mm|cm|m|毫米|厘米|米)",
    "percentage": "[0-9]+(?:[.][0-9]+)?%",
    "date": "[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}[日]?",
    "time": "[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?",
}
#: A full-width mark and its plain form, pairwise.
PUNCTUATION = ("，。；：！？（）【】《》", ",.;:!?()[]<>")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def clean_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\u00a0\\u007f\\u3000]+", " "))


def plain_punctuation(text: Column) -> Column:
    return F.translate(text, *PUNCTUATION)


def drop_numbering(text: Column) -> Column:
    return F.regexp_replace(text, "(?m)^[\\n\\t\\r]*[0-9]+[.、]\\s*", "")


def collapse_separators(text: Column) -> Column:
    """Runs of separators become one, a dot between two letters becomes a full stop."""
    return F.regexp_replace(F.regexp_replace(text, "[,，、]{2,}", "、"), "([A-Za-z])[.]([A-Za-z])", "$1。$2")


def truncate(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix)))


def contains_any(text: Column, keywords: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(k.lower())) for k in keywords), F.lit(False))


def highlight(text: Column, keywords: list[str], before: str = "**", after: str = "**") -> Column:
    return reduce(lambda t, k: F.replace(t, F.lit(k), F.lit(f"{before}{k}{after}")), keywords, text)


def numbers(text: Column) -> Column:
    return all_of(text, "[0-9]+(?:[.][0-9]+)?")


def valid_text(text: Column, least: int = 2, most_special: float = 0.5) -> Column:
    """Long enough, and not mainly made of characters that are neither word characters nor space."""
    special = F.regexp_count(text, F.lit("[^A-Za-z0-9_\\u00c0-\\u024f\\u4e00-\\u9fa5\\s]"))
    return (F.length(F.trim(text)) >= least) & (special / F.greatest(F.length(text), F.lit(1)) <= most_special)


def doubled_punctuation(text: Column) -> Column:
    return text.rlike("[;,，.。]{2}")


def has_digit_or_latin(text: Column) -> Column:
    return text.rlike("[0-9A-Za-z]")


def parse_date(text: Column) -> Column:
    """A dirty date: letters of other scripts go, dashes become slashes, what doesn't parse is null."""
    plain = F.replace(F.regexp_replace(text, "[\\u4e00-\\u9fa5]", ""), F.lit("-"), F.lit("/"))
    return F.try_to_timestamp(F.trim(plain), F.lit("yyyy/M/d H:m:s"))


def expand_range(first: Column, last: Column, prefix: str) -> Column:
    """Numbered parts from first to last, as an array of names; empty if out of order."""
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.concat(F.lit(prefix), i.cast("string")))).otherwise(F.array().cast("array<string>"))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of the distinct character pairs."""
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    both = F.size(F.array_intersect(pairs(a), pairs(b)))
    return 2.0 * both / (F.size(pairs(a)) + F.size(pairs(b)))
