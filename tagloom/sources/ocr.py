"""Scanned pages: recognised words, stored page records, scan detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagloom import lexicon as lx
from tagloom.functions.numbers import half_even
from tagloom.functions.text import strip

PAGE_RECORD = (
    "map<string, struct<elements: array<struct<type: string, text: string, alt: string, bbox_pdf: array<double>>>, "
    "page_w: double, page_h: double>>"
)


def word_blocks(words: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Confident words grouped per block: text in word order, box in points, y flipped."""
    k = 72.0 / lx.OCR_DPI
    kept = words.withColumn("text", strip(F.col("text"))).filter((F.col("text") != "") & (F.col("conf") >= lx.OCR_MIN_CONF))
    return kept.groupBy("doc_id", "page", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda s: s["text"]), " ").alias("text"),
        half_even(F.min("px") * k, 2).alias("x0"), half_even(page_height - F.max(F.col("py") + F.col("ph")) * k, 2).alias("y0"),
        half_even(F.max(F.col("px") + F.col("pw")) * k, 2).alias("x1"), half_even(page_height - F.min("py") * k, 2).alias("y1")
    ).withColumn("tag", F.lit("P"))


def page_records(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """Stored page records as nodes in page order; a figure without alt is decorative."""
    pages = documents.select("doc_id", F.explode(F.from_json(F.col(json_col), PAGE_RECORD)).alias("key", "p"))
    rows = pages.select("doc_id", (F.col("key").cast("int") + 1).alias("page"), F.posexplode("p.elements").alias("pos", "e"))
    figure = F.col("e.type") == "Figure"
    return rows.select(
        "doc_id", "page", "pos", F.col("e.type").alias("tag"), F.col("e.text").alias("text"),
        *[F.get("e.bbox_pdf", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))],
        F.when(figure, F.col("e.alt")).alias("alt"),
        F.when(figure, F.coalesce(F.col("e.alt"), F.lit("")) == "").alias("decorative"))


def scanned_pages(pages: DataFrame, texts: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with images and almost no text, and whether the document has any."""
    keys = ["doc_id", "page"]
    chars = texts.groupBy(*keys).agg(F.sum(F.length(strip(F.coalesce("text", F.lit(""))))).alias("chars"))
    pics = images.groupBy(*keys).agg(F.count(F.lit(1)).alias("images"))
    rows = pages.select(*keys).join(chars, keys, "left").join(pics, keys, "left").select(
        *keys, F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("images", F.lit(0)).alias("images"))
    totals = chars.groupBy("doc_id").agg(F.sum("chars").alias("doc_chars"))
    return rows.join(totals, "doc_id", "left").select(
        *keys, "chars", "images", ((F.col("chars") < lx.SCANNED_PAGE_CHARS) & (F.col("images") > 0)).alias("scanned"),
        (F.coalesce("doc_chars", F.lit(0)) < lx.SCANNED_DOC_CHARS).alias("doc_scanned"))
