"""Text expressions shared by the checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pattern(regex: str, ignore_case: bool = False) -> str:
    """A fixed pattern with Unicode classes and word boundaries."""
    return ("(?iU)" if ignore_case else "(?U)") + regex


def matches(col: Column, regex: str, ignore_case: bool = False) -> Column:
    return col.rlike(pattern(regex, ignore_case))


_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Whitespace off both ends; a character-set trim, far cheaper than a regex."""
    return F.btrim(col, F.lit(_SPACES))


def blank(col: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(strip(col), F.lit("")) == ""


def left(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def capitalize(col: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 1 << 30)))


def match_key(col: Column) -> Column:
    """Lower case, every run outside a-z and 0-9 to one space."""
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "))


def lookup(mapping: dict, key: Column) -> Column:
    """Small fixed table as a map literal; null when the key is absent."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), key)


def escape_markup(col: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col
