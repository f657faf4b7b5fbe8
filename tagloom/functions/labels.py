"""Readable labels out of field names, URLs and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagloom import lexicon as lx
from tagloom.functions.text import capitalize, left, strip


def title_case(col: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    return F.array_join(F.transform(F.split(col, r"(?<=[^\p{L}])"), capitalize), "")


def field_label(name: Column) -> Column:
    """Type prefix off, camelCase and separators to spaces, acronyms upper."""
    raw = strip(name)
    bare = raw
    for prefix in reversed(lx.FIELD_PREFIXES):
        n = len(prefix)
        fits = F.lower(raw).startswith(prefix) & (F.length(raw) > n)
        bare = F.when(fits, F.substring(raw, n + 1, 1 << 30)).otherwise(bare)
    spaced = F.regexp_replace(bare, "([a-z])([A-Z])", "$1 $2")
    spaced = F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[_\-.]", " "), r"\s+", " "))
    words = F.transform(F.split(spaced, " "), lambda w: F.when(
        F.lower(w).isin(lx.FIELD_ACRONYMS), F.upper(w)).otherwise(capitalize(w)))
    return F.when(spaced == "", title_case(name)).otherwise(F.array_join(words, " "))


def _words_of(segment: Column) -> Column:
    return strip(F.translate(segment, "-_", "  "))


def link_label(url: Column) -> Column:
    """Last telling path segment with its domain, else the domain alone."""
    host = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)
    domain = F.replace(host, F.lit("www."), F.lit(""))
    domain = F.when(domain == "", left(url, 40)).otherwise(domain)
    path = F.regexp_replace(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    path = F.regexp_replace(path, r"[?#].*$|;[^/?#]*(?:[?#].*)?$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = _words_of(F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"(?U)\.\w{2,5}$", ""))
    parent = _words_of(F.try_element_at(parts, F.lit(-2)))

    def telling(slug: Column) -> Column:
        return F.when((slug != "") & ~F.lower(slug).isin(lx.GENERIC_SLUGS), slug)

    slug = F.coalesce(telling(last), telling(parent))
    return (F.when(F.coalesce(url, F.lit("")) == "", F.lit("Link"))
            .when(slug.isNotNull(), F.concat(title_case(slug), F.lit(" — "), domain))
            .otherwise(F.concat(F.lit("Resource on "), domain)))


def file_title(filename: Column) -> Column:
    """File name without extension, separators to spaces, first letters upper."""
    bare = F.regexp_replace(F.regexp_replace(filename, r"(?i)\.pdf$", ""), "[-_]+", " ")
    pieces = F.transform(F.split(bare, "(?<=[^A-Za-z0-9_])"),
                         lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return F.trim(F.array_join(pieces, ""))
