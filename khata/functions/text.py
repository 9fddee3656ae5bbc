"""String expressions shared by the jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\v"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column, words: list[str]) -> Column:
    return any_of([c.contains(w) for w in words])


def matches_any(c: Column, patterns: list[str], flags: str = "i") -> Column:
    """True where one of ``patterns`` is found; one alternation, one pass over the text."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return c.rlike(f"(?{flags}){joined}" if flags else joined)


def has_word(low: Column, words: str) -> Column:
    """One of the ``|``-separated words is in the lower-case text."""
    return contains_any(low, words.split("|"))


def found(text: Column, low: Column, patterns: list[str], words: list[str], flags: str = "i") -> list[Column]:
    """A test per pattern, run only where a word it cannot do without is there.

    Looking for a word costs a fraction of a regular expression, and most texts
    hold none of the words.
    """
    return [has_word(low, w) & text.rlike(f"(?{flags}){p}") for p, w in zip(patterns, words, strict=True)]


def first_match_index(text: Column, low: Column, patterns: list[str], words: list[str]) -> Column:
    """0-based index of the first pattern in list order found in ``text``; null if none is."""
    out = None
    for i, hit in enumerate(found(text, low, patterns, words)):
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out


def captured(low: Column, patterns: list[str], words: list[str]) -> Column:
    """Stripped first group of the first pattern in list order found in a lower-case text.

    Null if none is found. The groups match at least one character, so an empty
    extract means no match.
    """
    return strip(F.coalesce(*[
        F.when(has_word(low, w), F.nullif(F.regexp_extract(low, p, 1), F.lit("")))
        for p, w in zip(patterns, words, strict=True)]))


def file_stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(.)\.[^.]*$", "$1")


def file_extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r".(\.[^.]+)$", 1))


def table_name_of(filename: Column) -> Column:
    """Table name of a file: stem, lower case, blanks and dashes as underscores."""
    return F.translate(F.lower(file_stem(filename)), " -", "__")


def clean_name(raw: Column) -> Column:
    """Column name: lower case, every run of other characters one underscore, none at the ends."""
    lowered = F.lower(strip(raw))
    return F.btrim(F.regexp_replace(lowered, r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def clean_name_py(raw: str) -> str:
    """The same rule for a column name known on the driver."""
    kept = "".join(ch if ch.isalnum() else "_" for ch in raw.strip().lower())
    return "_".join(part for part in kept.split("_") if part)


def month_index_in(text: Column, months: list[str], short: bool) -> Column:
    """1-based first month (calendar order) named in ``text``; null if none is."""
    out = None
    for i, m in enumerate(months, 1):
        hit = text.contains(m[:3]) if short else text.contains(m)
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def json_escape(c: Column, ascii_only: bool = False) -> Column:
    """JSON string body: quotes, backslashes and control characters escaped; ``ascii_only`` also escapes other letters."""
    options = {"writeNonAsciiCharacterAsCodePoint": "true"} if ascii_only else {}
    whole = F.to_json(F.struct(c.alias("v")), options)
    return F.regexp_replace(whole, r'(?s)^\{"v":"(.*)"\}$', "$1")
