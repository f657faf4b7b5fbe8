"""Web pages as documents: block elements, links, language and title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.text import lookup

BLOCK_TAGS = {
    "h1": "H1", "h2": "H2", "h3": "H3", "h4": "H4", "h5": "H5", "h6": "H6", "p": "P", "li": "LI", "td": "TD",
    "th": "TH", "blockquote": "BlockQuote", "pre": "Code", "caption": "Caption", "figcaption": "Caption", "img": "Figure",
}
NOISE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
# a block start tag with everything up to the next tag that is not inline
BLOCK = (
    r"(?i)<(?:h[1-6]|p|li|td|th|blockquote|pre|caption|figcaption)\b[^>]*>"
    r"[^<]*(?:<(?:/?(?:a|b|i|em|strong|u|span|br|code|small|sub|sup)\b[^>]*)>[^<]*)*|<img\b[^>]*>"
)
LINK = r'(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>'


def _plain(markup: Column) -> Column:
    text = F.regexp_replace(markup, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_nodes(pages: DataFrame) -> DataFrame:
    """One node per block element, in document order."""
    blocks = F.regexp_extract_all(F.regexp_replace("html", NOISE, ""), F.lit(BLOCK), 0)
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(blocks).alias("ord", "block"))
    name = F.lower(F.regexp_extract("block", "^<([a-zA-Z0-9]+)", 1))
    alt = F.regexp_extract("block", '(?i)^<img\\b[^>]*\\balt="([^"]*)"', 1)
    return rows.select(
        "doc_id", F.col("ord").cast("long").alias("ord"), F.concat(F.lit("n"), F.col("ord") + 1).alias("node_id"),
        lookup(BLOCK_TAGS, name).alias("tag"), _plain(F.col("block")).alias("text"),
        F.when((name == "img") & F.col("block").rlike(r'(?i)\balt="'), alt).alias("alt"))


def page_links(pages: DataFrame) -> DataFrame:
    links = F.regexp_extract_all(F.regexp_replace("html", NOISE, ""), F.lit(LINK), 0)
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(links).alias("link_id", "a"))
    return rows.select("doc_id", F.lit(1).alias("page"), F.col("link_id").cast("long").alias("link_id"),
                       F.regexp_extract("a", '(?i)href="([^"]*)"', 1).alias("uri"), _plain(F.col("a")).alias("text"))


def page_docs(pages: DataFrame) -> DataFrame:
    title = _plain(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    lang = F.regexp_extract("html", r'(?i)<html\b[^>]*\blang="([^"]*)"', 1)
    return pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("filename"),
                        F.nullif(title, F.lit("")).alias("title"), F.nullif(lang, F.lit("")).alias("lang"))
