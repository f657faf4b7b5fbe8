"""Document-level checks: metadata, fonts, layers, security, reflow, watermarks, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom import lexicon as lx
from tagloom.functions import labels, language as lang
from tagloom.functions.numbers import half_even
from tagloom.functions.rows import with_once
from tagloom.functions.text import blank, escape_markup, left, lookup, matches, strip
from tagloom.operators.contrast import first_n


def _issue_rows(df: DataFrame, keys: list[str], *issues: Column) -> DataFrame:
    """Explode the non-null issue structs of a row."""
    return df.select(*keys, F.inline(F.array_compact(F.array(*issues))))


def _issue(when: Column, **columns: str) -> Column:
    return F.when(when, F.struct(*[F.lit(v).alias(k) for k, v in columns.items()]))


def metadata(docs: DataFrame) -> DataFrame:
    parts = F.transform(F.split("version", r"\."), lambda p: p.try_cast("int"))
    old = F.coalesce(parts < F.array(F.lit(1), F.lit(4)), F.lit(False)) & F.forall(parts, lambda p: p.isNotNull())
    return _issue_rows(
        docs, ["doc_id"],
        _issue(blank(F.col("title")), field="Title", severity="error"),
        _issue(blank(F.col("author")), field="Author", severity="warning"),
        _issue(blank(F.col("subject")), field="Subject", severity="warning"),
        _issue(F.coalesce("lang", F.lit("")) == "", field="Language", severity="error"),
        _issue(old, field="PDF version", severity="info"),
        _issue(blank(F.col("creation_date")), field="CreationDate", severity="info"))


def fonts(fonts: DataFrame) -> DataFrame:
    """One row per (document, font, problem) at its first page."""
    first = fonts.groupBy("doc_id", "font_name").agg(
        F.min(F.when(~F.col("embedded"), F.col("page"))).alias("a"),
        F.min(F.when(~F.col("to_unicode"), F.col("page"))).alias("b"))
    rows = F.array(F.struct(F.lit("not_embedded").alias("issue"), F.col("a").alias("page")),
                   F.struct(F.lit("no_to_unicode").alias("issue"), F.col("b").alias("page")))
    return first.select("doc_id", "font_name", F.inline(rows)).filter(F.col("page").isNotNull()).withColumn(
        "severity", F.lit("error"))


def font_plan(fonts: DataFrame) -> DataFrame:
    """What to do about each font: leave alone, or which families could stand in."""
    per_font = fonts.groupBy("doc_id", "font_name").agg(
        F.bool_and("embedded").alias("embedded"), F.bool_or(F.col("subtype") == "Type0").alias("composite"),
        F.min("page").alias("page"))
    key = F.lower(F.regexp_replace("font_name", "^[^+]*[+]", ""))
    families = lookup({k: "|".join(v) for k, v in lx.FONT_SUBSTITUTES.items()}, F.translate(key, "- ,_", ""))
    action = (F.when(F.col("composite") | F.col("font_name").contains("+"), "skip_composite_or_subset")
              .when(F.col("embedded"), "skip_embedded").when(families.isNotNull(), "substitute").otherwise("no_match"))
    out = per_font.withColumn("action", action)
    return out.select("doc_id", "font_name", "page", "action",
                      F.when(F.col("action") == "substitute", families).alias("families"))


def layers(layers: DataFrame) -> DataFrame:
    name = strip(F.coalesce("name", F.lit("")))
    named = layers.withColumn("layer", name)
    off = named.filter(F.col("layer") != "").groupBy("doc_id", "layer").agg(F.bool_or("off_default").alias("off"))
    rows = named.join(off, ["doc_id", "layer"], "left")
    has = F.col("layer") != ""
    return _issue_rows(
        rows, ["doc_id", "layer_id", "layer"],
        _issue(~has, type="ocg_no_name", severity="warning"),
        _issue(has & F.col("off"), type="ocg_hidden_by_default", severity="warning"),
        _issue(has & (F.col("print_state") == "OFF"), type="ocg_print_off", severity="info"))


def security(docs: DataFrame) -> DataFrame:
    access = ~F.col("encrypted") | F.col("allow_access")
    copy = ~F.col("encrypted") | F.col("allow_extract")
    return docs.select("doc_id", "encrypted", access.alias("accessibility_allowed"), copy.alias("content_copy_allowed"),
                       F.when(~access, "error").when(~copy, "warning").otherwise("ok").alias("severity"))


def xfa(docs: DataFrame) -> DataFrame:
    return docs.filter("has_xfa").select("doc_id", F.lit("xfa_form").alias("type"))


def reflow(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """First over-wide span of each page, and every tightly spaced span."""
    share = (F.col("x1") - F.col("x0")) / F.col("width")
    wide = spans.join(pages.select("doc_id", "page", "width"), ["doc_id", "page"]).filter(
        (F.col("width") > 0) & (share > lx.REFLOW_RATIO))
    first = first_n(wide, ["doc_id", "page"], ["block", "line", "span"], 1).select(
        "doc_id", "page", F.lit("reflow_risk").alias("type"), "span", half_even(share * 100, 0).alias("value"))
    tight = spans.filter((F.col("size") > 0) & (F.col("char_spacing") < lx.TIGHT_SPACING)).select(
        "doc_id", "page", F.lit("letter_spacing").alias("type"), "span", half_even("char_spacing", 2).alias("value"))
    return first.unionByName(tight)


def watermarks(spans: DataFrame, images: DataFrame, paths: DataFrame, pages: DataFrame) -> DataFrame:
    """Images and fills that cover the page, and large watermark words."""
    area = pages.select("doc_id", "page", (F.col("width") * F.col("height")).alias("page_area")).filter(F.col("page_area") > 0)
    covering = (
        images.select("doc_id", "page", F.lit("background_image").alias("type"), F.col("image_id").alias("item"),
                      (F.col("w") * F.col("h")).alias("area"))
        .unionByName(paths.filter("filled").select(
            "doc_id", "page", F.lit("background_fill").alias("type"), F.col("path_id").alias("item"),
            (F.col("w") * F.col("h")).alias("area")))
    )
    # nothing under 60% of a 1 pt page can match, so empty boxes go before the join
    big = covering.filter(F.col("area") > 0).join(area, ["doc_id", "page"]).withColumn(
        "share", F.col("area") / F.col("page_area")).filter(F.col("share") >= lx.PAGE_COVER).select(
        "doc_id", "page", "type", "item", half_even(F.col("share") * 100, 0).alias("value"), F.lit(None).cast("string").alias("text"))
    words = spans.filter((F.col("size") >= lx.WATERMARK_SIZE) & matches(F.col("text"), lx.WATERMARK_WORDS, True)).select(
        "doc_id", "page", F.lit("watermark_text").alias("type"), F.col("span").alias("item"),
        F.col("size").alias("value"), left(strip(F.col("text")), 60).alias("text"))
    return big.unionByName(words)


def role_map(nodes: DataFrame) -> DataFrame:
    """Role-map entries: every non-standard tag a document uses, and what it maps to."""
    used = nodes.filter(F.coalesce("tag", F.lit("")) != "").select("doc_id", "tag").distinct()
    return used.filter(~F.col("tag").isin(lx.STANDARD_TAGS)).select(
        "doc_id", "tag", F.coalesce(lookup(lx.ROLE_MAP, F.col("tag")), F.lit("NonStruct")).alias("maps_to"))


def _first_heading(nodes: DataFrame, tags: list[str], name: str) -> DataFrame:
    t = strip(F.coalesce("text", F.lit("")))
    rows = nodes.filter(F.col("tag").isin(tags)).select("doc_id", "tag", "ord", t.alias("t")).filter(F.col("t") != "")
    return rows.groupBy("doc_id").agg(F.min_by("t", F.struct("tag", "ord")).alias(name))


def titles(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Title from metadata, suggestion, first H1, first deeper heading, or file name."""
    heading = _first_heading(nodes, lx.HEADING_TAGS, "heading")
    given = [F.when(~blank(F.col(c)), strip(F.col(c))) for c in ("title", "suggested_title")]
    return docs.join(heading, "doc_id", "left").select(
        "doc_id", F.coalesce(*given, "heading", labels.file_title(F.col("filename")), F.lit("")).alias("title"),
        F.when(given[0].isNotNull(), "title").when(given[1].isNotNull(), "suggested").when(
            F.col("heading").isNotNull(), "heading").otherwise("filename").alias("origin"))


def metadata_autofill(docs: DataFrame, texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Language from the text and title from the first large span, where missing.

    Texts meet their documents first, so that only those without a language are looked at.
    """
    t = strip(F.coalesce("text", F.lit("")))
    big = spans.filter(F.col("size") >= 16).select("doc_id", t.alias("t"), "page", "block", "line", "span").filter(
        F.col("t") != "").groupBy("doc_id").agg(F.min_by("t", F.struct("page", "block", "line", "span")).alias("auto_title"))
    needs = blank(F.col("lang")) | blank(F.col("title"))
    asked = docs.filter(needs).select("doc_id", "lang", "title").join(big, "doc_id", "left").join(
        texts.select("doc_id", F.col("text").alias("_text")), "doc_id", "left")
    return asked.select(
        "doc_id", F.when(blank(F.col("lang")), F.coalesce(lang.detect_language(F.col("_text")), F.lit("en"))).alias("set_lang"),
        F.when(blank(F.col("title")), F.col("auto_title")).alias("set_title"))


def catalog_defaults(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Catalog entries every accessible file declares, and which of them get written."""
    h1 = _first_heading(nodes, ["H1"], "h1")
    title = F.coalesce(F.when(~blank(F.col("title")), strip(F.col("title"))), F.col("h1"), F.lit("Untitled Document"))
    language = F.coalesce(*[F.when(~blank(F.col(c)), strip(F.col(c))) for c in ("manifest_lang", "lang")], F.lit("en"))
    old = F.transform(F.split("version", r"\."), lambda p: p.try_cast("int")) < F.array(F.lit(1), F.lit(4))
    return docs.join(h1, "doc_id", "left").select(
        "doc_id", F.lit(True).alias("marked"), F.lit(True).alias("display_title"),
        F.when(blank(F.col("lang")), language).otherwise(strip(F.col("lang"))).alias("lang"),
        escape_markup(title).alias("meta_title"), escape_markup(language).alias("meta_lang"),
        F.when(old, F.lit("1.4")).otherwise(F.col("version")).alias("version"),
        blank(F.col("lang")).alias("wrote_lang"), (~F.col("marked")).alias("wrote_marked"),
        (~F.col("display_title")).alias("wrote_display_title"), old.alias("wrote_version"))


def alt_quality(nodes: DataFrame) -> DataFrame:
    """Figures without a useful text alternative."""
    cleaned = F.lower(strip(F.regexp_replace("alt", r"[^\p{L}\p{N}_\s]", "")))
    text = F.col("_cleaned")
    generic = (text == "") | text.isin(lx.GENERIC_ALT) | matches(
        text, "|".join(f"(?:{p})" for p in lx.GENERIC_ALT_PATTERNS), True)
    kind = F.when(F.col("alt").isNull(), "missing").when(blank(F.col("alt")), "empty").when(generic, "generic")
    figures = with_once(nodes.filter(F.col("tag") == "Figure").select("doc_id", "node_id", "page", "alt"), _alt=F.col("alt")).drop("alt").withColumnRenamed("_alt", "alt")
    return with_once(with_once(figures, _cleaned=cleaned), type=kind).filter(F.col("type").isNotNull()).select(
        "doc_id", "node_id", "page", "type", F.when(F.col("type") == "empty", F.lit("")).otherwise(left(F.col("alt"), 120)).alias("alt"))


def alt_placeholder(nodes: DataFrame) -> DataFrame:
    """Figures whose alt is empty or a bare noun get a text that asks for review."""
    alt = F.lower(strip(F.coalesce("alt", F.lit(""))))
    return nodes.filter((F.col("tag") == "Figure") & alt.isin(lx.PLACEHOLDER_ALT)).select(
        "doc_id", "node_id", F.lit(lx.ALT_PLACEHOLDER).alias("alt"))


def review_questions(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Questions for a person: unresolved figures and untitled documents."""
    figures = nodes.filter((F.col("tag") == "Figure") & (F.coalesce("alt", F.lit("")) == "") & ~F.coalesce("decorative", F.lit(False))).select(
        "doc_id", F.lit("image_alt").alias("type"), "node_id", "page")
    untitled = docs.filter(blank(F.col("title"))).select(
        "doc_id", F.lit("title").alias("type"), F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("int").alias("page"))
    return figures.unionByName(untitled)


def tag_routing(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Repair documents that carry real structure, rebuild the others."""
    counts = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    elements = F.when(F.col("has_struct"), F.coalesce("n", F.lit(0))).otherwise(0)
    tagged = F.col("has_struct") & (F.col("elements") >= lx.MIN_STRUCT_ELEMENTS)
    return docs.join(counts, "doc_id", "left").withColumn("elements", elements.cast("long")).select(
        "doc_id", "elements", "marked", tagged.alias("tagged"), F.when(tagged, "repair").otherwise("rebuild").alias("route"),
        F.when(tagged, "preserve").when(~F.col("has_struct"), "no_tree").otherwise("stub").alias("reason"))
