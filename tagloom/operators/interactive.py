"""Links, form fields and annotations."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tagloom import lexicon as lx
from tagloom.functions import labels
from tagloom.functions.geometry import box_level, contains, with_box_cells, with_point_cells
from tagloom.functions.numbers import half_even
from tagloom.functions.text import blank, left, lookup, matches, strip
from tagloom.operators.contrast import first_n


def link_quality(links: DataFrame) -> DataFrame:
    """Visible link text that is generic, a bare URL, or one or two characters.

    The type is a generated column: a filter on a plain one would be pushed below it, and every text judged twice.
    """
    t = strip(F.coalesce("text", F.lit("")))
    norm = F.rtrim(strip(F.lower(F.col("text"))), F.lit(".,;:"))
    generic = reduce(or_, [F.col("_norm").startswith(start) for start in lx.GENERIC_LINK_STARTS], F.col("_norm").isin(lx.GENERIC_LINKS))
    kind = (F.when(generic, "generic")
            .when(matches(F.col("text"), lx.URL_TEXT, True), "url")
            .when(matches(F.col("_norm"), lx.SHORT_LINK), "short"))
    return (
        links.filter(F.coalesce("uri", F.lit("")) != "").withColumns({"_norm": norm, "text": t}).filter(F.col("text") != "")
        .select("*", F.explode(F.array(kind)).alias("type")).filter(F.col("type").isNotNull())
        .select("doc_id", "page", "link_id", "type", left(F.col("text"), 120).alias("text"), left(F.col("uri"), 200).alias("url"))
    )


_LINK_START, _LINK_END = r"^\s*", r"\s*\.?\s*$"


def _nondescriptive(t: Column) -> Column:
    # every pattern has the same ends, so one anchor stands before all of them
    phrases = "|".join(p.removeprefix(_LINK_START).removesuffix(_LINK_END) for p in lx.NONDESCRIPTIVE_LINKS)
    generic = matches(t, f"{_LINK_START}(?:{phrases}){_LINK_END}", True)
    return (F.when(t == "", "empty").when(F.length(t) <= 1, "single_character")
            .when(t.rlike(r"^[^\p{L}\p{Nl}\p{No}_]+$"), "numeric_or_punctuation")
            .when(generic, "generic").when(matches(t, lx.BARE_URL, True), "bare_url")
            .when(matches(t, lx.BARE_DOMAIN, True), "bare_domain"))


def link_text(links: DataFrame) -> DataFrame:
    """Second rule set: text falls back to the annotation, then the URI; one row per (page, text)."""
    own, other = strip(F.coalesce("text", F.lit(""))), F.coalesce("contents", F.lit(""))
    shown = F.when(own != "", own).when(other != "", other).otherwise(left(F.coalesce("uri", F.lit("")), 80))
    # generated, so that no text is judged twice
    judged = links.select("doc_id", "page", "link_id", "uri", shown.alias("text")).select("*", F.explode(F.array(_nondescriptive(strip(F.col("text"))))).alias("reason"))
    bad = judged.filter(F.col("reason").isNotNull()).withColumn("_key", F.lower(F.col("text")))
    return first_n(bad, ["doc_id", "page", "_key"], ["link_id"], 1).select(
        "doc_id", "page", "link_id", "reason", left(F.col("text"), 120).alias("text"), left(F.col("uri"), 200).alias("url"))


def link_labels(links: DataFrame) -> DataFrame:
    return links.select("doc_id", "page", "link_id", "uri", labels.link_label(F.col("uri")).alias("label"))


def field_labels(fields: DataFrame) -> DataFrame:
    """Accessible name to set on each named field, and whether it was missing."""
    required = F.coalesce(F.col("Ff").bitwiseAND(lx.REQUIRED_BIT), F.lit(0)) != 0
    label = F.concat(labels.field_label(F.col("T")), F.when(required, F.lit(" (required)")).otherwise(F.lit("")))
    kind = F.coalesce(lookup(lx.FIELD_TYPES, F.coalesce("FT", F.lit("Tx"))), F.lit("field"))
    return fields.filter(F.col("T").isNotNull()).select(
        "doc_id", "field_id", F.col("T").alias("name"), label.alias("label"), kind.alias("type"),
        required.alias("required"), blank(F.col("TU")).alias("fixed"))


def widget_labels(fields: DataFrame) -> DataFrame:
    """TU then T of the field, then of its parent, else a fixed label."""
    def own(prefix: str) -> Column:
        return F.coalesce(*[F.when(F.col(prefix + k) != "", F.col(prefix + k)) for k in ("TU", "T")])
    parent = fields.select("doc_id", F.col("field_id").alias("parent_id"), F.col("TU").alias("p_TU"), F.col("T").alias("p_T"))
    return fields.join(parent, ["doc_id", "parent_id"], "left").select(
        "doc_id", "field_id", F.coalesce(own(""), own("p_"), F.lit("Form field")).alias("label"))


def radio_groups(nodes: DataFrame, fields: DataFrame) -> DataFrame:
    """Form nodes of radio fields: the first is the group, later ones are members."""
    flags = F.coalesce("Ff", F.lit(0))
    radio = fields.filter(
        (F.col("FT") == "Btn") & (flags.bitwiseAND(lx.RADIO_BIT) != 0) & (flags.bitwiseAND(lx.PUSHBUTTON_BIT) == 0)
        & (F.coalesce("T", F.lit("")) != ""))
    tu = F.when(F.coalesce("TU", F.lit("")) != "", F.col("TU")).otherwise(F.col("T"))
    groups = radio.groupBy("doc_id", F.col("T").alias("field_name")).agg(F.max_by(
        F.struct(tu.alias("tu"), (flags.bitwiseAND(lx.REQUIRED_BIT) != 0).alias("required")), "field_id").alias("g"))
    forms = nodes.filter((F.col("tag") == "Form") & F.col("field_name").isNotNull())
    first = forms.groupBy("doc_id", "field_name").agg(F.min("ord").alias("first_ord"))
    lead = F.col("ord") == F.col("first_ord")
    alt = F.when(lead & (F.coalesce("alt", F.lit("")) == ""), F.col("g.tu")).otherwise(F.col("alt"))
    return forms.join(groups.join(first, ["doc_id", "field_name"]), ["doc_id", "field_name"]).select(
        "doc_id", "node_id", "field_name", lead.alias("radio_group"), (~lead).alias("member"), alt.alias("alt"),
        F.when(lead, F.col("g.required")).alias("required"))


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def _comparable(col: Column) -> Column:
    cleaned = F.regexp_replace(_nfkc(col), r"[^\p{L}\p{N}_\s]", " ")
    return F.lower(F.trim(F.regexp_replace(cleaned, r"\s+", " ")))


def label_in_name(fields: DataFrame, spans: DataFrame) -> DataFrame:
    """Visible text next to a field that its accessible name does not contain.

    What is put together per field is the text inside two small boxes of its page.
    """
    name = F.when(F.coalesce("TU", F.lit("")) != "", F.col("TU")).otherwise(F.col("T"))
    f = fields.filter(F.col("FT").isNotNull()).withColumn("accessible_name", strip(F.coalesce(name, F.lit("")))).filter(
        F.col("accessible_name") != "").select(
        "doc_id", "page", "field_id", F.col("T").alias("field_name"), "accessible_name",
        F.col("x0").alias("fx0"), F.col("y0").alias("fy0"), F.col("x1").alias("fx1"), F.col("y1").alias("fy1"))
    text = strip(F.coalesce("text", F.lit("")))
    s = spans.select("doc_id", "page", "span", text.alias("t"), "y0", "x0", ((F.col("x0") + F.col("x1")) / 2).alias("cx"),
                     ((F.col("y0") + F.col("y1")) / 2).alias("cy")).filter(F.col("t") != "")
    m = lx.LABEL_MARGIN

    def region(number: int, *box: Column) -> Column:
        return F.struct(F.lit(number).alias("region"), *[v.cast("double").alias("r_" + c) for v, c in zip(box, ("x0", "y0", "x1", "y1"))])

    left_of = region(0, F.greatest(F.lit(0.0), F.col("fx0") - m), F.col("fy0") - 4, F.col("fx0") + 4, F.col("fy1") + m)
    above = region(1, F.col("fx0") - 8, F.col("fy1") - 2, F.col("fx1") + 8, F.col("fy1") + 40)
    regions = f.select("doc_id", "page", "field_id", F.inline(F.array(left_of, above)))
    # what encloses all regions of a page, and their levels: a span is shuffled once, and cells are only made of those that may lie in a region
    reach = regions.groupBy("doc_id", "page").agg(
        *[f("r_" + c).alias("p_" + c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))],
        F.collect_set(box_level("r_")).alias("_levels"))
    s = s.join(reach, ["doc_id", "page"]).filter(contains("p_", F.col("cx"), F.col("cy"))).select(
        "doc_id", "page", "span", "t", "y0", "x0", "cx", "cy", "_levels")
    near = with_point_cells(s, F.col("cx"), F.col("cy"), F.col("_levels")).join(with_box_cells(regions, "r_"), ["doc_id", "page", "_cell"]).filter(
        contains("r_", F.col("cx"), F.col("cy"))).select("doc_id", "page", "field_id", "t", "y0", "x0", "span", "region")
    order = F.struct("region", (-F.col("y0")).alias("down"), "x0", "span", "t")
    joined = near.groupBy("doc_id", "field_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(order)), lambda r: r["t"]), " ").alias("all"))
    label = strip(F.col("all"))
    out = f.join(joined.select("doc_id", "field_id", label.alias("visible_label")), ["doc_id", "field_id"]).filter(
        F.length("visible_label") >= lx.LABEL_MIN)
    out = out.withColumns({"_n": _comparable(F.col("accessible_name")), "_l": _comparable(F.col("visible_label"))})
    return out.filter((F.length("_l") >= lx.LABEL_MIN) & ~F.col("_n").contains(F.col("_l"))).select(
        "doc_id", "page", "field_id", "field_name", "accessible_name", "visible_label")


def annotation_descriptions(annots: DataFrame) -> DataFrame:
    """Description to add to annotations that have none."""
    target = (F.when(F.coalesce("uri", F.lit("")) != "", labels.link_label(F.col("uri")))
              .when(F.col("uri").isNull() & F.col("dest").isNotNull(), F.lit("Link within this document")).otherwise(F.lit("Link")))
    named = F.coalesce(lookup(lx.ANNOTATION_LABELS, F.col("subtype")), F.concat("subtype", F.lit(" annotation")))
    text = F.when(F.col("subtype") == "Link", target).otherwise(named)
    return annots.filter(
        ~F.col("subtype").isin("Widget", "Popup") & (F.col("F").bitwiseAND(2) == 0) & blank(F.col("contents"))
    ).select("doc_id", "page", "annot_id", "subtype", left(text, 200).alias("description"))


def needs_contents(annots: DataFrame) -> DataFrame:
    """Visible annotations of the types that must carry a text, and do not."""
    return annots.filter(
        F.col("subtype").isin(lx.NEEDS_CONTENTS) & (F.coalesce("F", F.lit(0)).bitwiseAND(3) == 0) & blank(F.col("contents")))


def annotation_contents(annots: DataFrame) -> DataFrame:
    """Default text for those annotations."""
    named = F.coalesce(lookup(lx.ANNOTATION_CONTENTS_LABELS, F.col("subtype")), F.concat("subtype", F.lit(" annotation")))
    text = (F.when((F.col("subtype") == "Text") & F.col("author").isNotNull(), F.concat(F.lit("Note by "), "author"))
            .when(F.col("subtype").isin("Highlight", "Underline", "StrikeOut", "Squiggly"),
                  F.concat(named, F.lit(" — see surrounding text"))).otherwise(named))
    return needs_contents(annots).select("doc_id", "page", "annot_id", "subtype", text.alias("contents"))


def target_size(annots: DataFrame) -> DataFrame:
    """Widgets and links below the minimum in both dimensions."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return annots.filter(F.col("subtype").isin("Widget", "Link") & (w < lx.TARGET_MIN_PT) & (h < lx.TARGET_MIN_PT)).select(
        "doc_id", "page", "annot_id", F.col("subtype").alias("type"), half_even(w, 1).alias("width_pt"),
        half_even(h, 1).alias("height_pt"), F.lit(lx.TARGET_MIN_PT).alias("min_pt"))
