"""Parsing of scraped text, as Column expressions only.

Casts are always ``try_cast``: scraped text must never fail a job, whatever the ANSI setting.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace in the Unicode sense. Trimming spaces only would leave no-break spaces and line
# ends, which web pages are full of.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# One number with separators; before and after it no letters but a currency word.
_AROUND = r"[^\p{L}0-9]*(?:(?:vn[dđ]|usd|đ|d)[^\p{L}0-9]*)?"
_MONEY = rf"(?iu)^{_AROUND}([0-9](?:[.,\s\u00a0]?[0-9])*[.,]?){_AROUND}$"
# The guards keep out what Spark alone would accept (1.0d), and spare the cast of plain words:
# a failing try_cast raises and catches an exception per row, some 20 times the cost of a match.
_INTEGER, _LONG = "^[+-]?0*[0-9]{1,10}$", "^[+-]?0*[0-9]{1,19}$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace, no-break spaces included."""
    return F.btrim(text, F.lit(_SPACES))


def remove_chars(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def safe_int(text: Column) -> Column:
    cleaned = strip(text)
    return F.when(cleaned.rlike(_INTEGER), cleaned.try_cast("int"))


def safe_long(text: Column) -> Column:
    cleaned = strip(text)
    return F.when(cleaned.rlike(_LONG), cleaned.try_cast("long"))


def safe_double(text: Column) -> Column:
    cleaned = strip(text)
    return F.when(cleaned.rlike(_NUMBER), cleaned.try_cast("double"))


# The basic character references, the ampersand last, as it starts the others.
BASIC_REFERENCES = (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;|&#x27;", "'"), ("&amp;?", "&"))


def unescape_basic(text: Column) -> Column:
    """Resolve the basic character references; like HTML, some of them without semicolon, too."""
    for pattern, char in BASIC_REFERENCES:
        text = F.regexp_replace(text, pattern, char)
    return text


def contains(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def has_prefix(text: Column, prefix: str) -> Column:
    return F.startswith(text, F.lit(prefix))


def label(key: Column, value: Column) -> Column:
    return F.concat(F.lit("key_"), key, F.lit(": value_"), F.coalesce(value, F.lit("None")))


def normalize_url(url: Column) -> Column:
    """The text before the first question mark."""
    return F.split_part(url, F.lit("?"), F.lit(1))


def money(text: Column) -> Column:
    """Money text to double: without separators, or else from its one number.

    Around that number there may be signs, spaces and a currency word; a text with other words,
    such as a telephone line, or with several numbers, such as a span of prices, is no price.
    """
    plain = safe_double(remove_chars(text, ".,"))
    one = F.regexp_extract(text, _MONEY, 1)
    return F.coalesce(plain, safe_double(remove_chars(one, "., \t\u00a0")))


def discount(text: Column) -> Column:
    """``-25%`` to 25: the first and the last character are dropped."""
    return safe_double(F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0))))


def last_token_int(text: Column) -> Column:
    # With one kind of space, the last token is what follows the last space.
    spaced = strip(F.translate(text, _SPACES, " " * len(_SPACES)))
    return safe_int(F.substring_index(spaced, " ", -1))


def rating_value(text: Column) -> Column:
    """``4.9(123)`` to 4.9."""
    return safe_double(F.substring(text, 1, 3))


def _rating_rest(text: Column) -> Column:
    """``4.9(123)`` to ``123``: everything after the value, without parentheses."""
    return remove_chars(F.substring(text, F.lit(5), F.greatest(F.length(text) - 4, F.lit(0))), "()")


def rating_count(text: Column) -> Column:
    return safe_int(_rating_rest(text))


def rating_count_text(text: Column) -> Column:
    """The count part kept as text (``5.5k reviews``); NULL when there is none."""
    return F.when(F.length(text) > 4, strip(_rating_rest(text)))
