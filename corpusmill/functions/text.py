"""Scalar text functions as Column expressions; all of them stay in the JVM.

Patterns are Unicode-aware (``(?U)``) and treat only ``\\n`` as a line end
(``(?d)``), whatever the platform that wrote the file.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A word counts for 1.3 tokens; in integers, tenths of a token per word.
TENTHS_PER_WORD = 13


# Tags and emphasis that a heading loses, in this order.
_EMPHASIS = (
    (r"<[^>]+>", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"(?<!\*)\*([^*]+)\*(?!\*)", "$1"),
    (r"(?<!_)_([^_]+)_(?!_)", "$1"),
    (r"(?U)\s+", " "),
)


def trim_all(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def without_page_markers(c: Column) -> Column:
    return F.regexp_replace(c, r"\{\d+\}-+", "")


def clean_heading(c: Column) -> Column:
    """A heading without tags and emphasis, white space collapsed."""
    for pattern, put in _EMPHASIS:
        c = F.regexp_replace(c, pattern, put)
    return trim_all(c)


def words(c: Column) -> Column:
    """Split at single spaces; empty words do not count."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def approx_tokens(n_words: Column) -> Column:
    """1.3 tokens a word, rounded up."""
    return F.floor((n_words * TENTHS_PER_WORD + 9) / 10).cast("int")


def words_of_tokens(tokens: int) -> int:
    """How many whole words fit a number of tokens."""
    return tokens * 10 // TENTHS_PER_WORD


def prefixed(document: Column, section: Column, body: Column) -> Column:
    """What is indexed: ``document > section``, a blank line, the body."""
    return F.concat(document, F.lit(" > "), section, F.lit("\n\n"), body)


def lower_tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case; the plain analyser.

    A null text has no tokens.
    """
    return F.coalesce(
        F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)),
        F.array().cast("array<string>"),
    )


def tags_from_json(c: Column) -> Column:
    """A JSON list of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def tags_to_json(c: Column) -> Column:
    return F.to_json(F.coalesce(c, F.array().cast("array<string>")))
