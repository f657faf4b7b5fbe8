"""Colour checks and repairs on spans, annotations, paths and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom import lexicon as lx
from tagloom.functions import color as c
from tagloom.functions.numbers import half_even
from tagloom.functions.rows import with_once
from tagloom.functions.text import left, strip


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per key. The rank filter lets Spark cut each map task's
    output to ``n`` rows per key before the shuffle, so a hot key stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def _ratio_against_bg(df: DataFrame, fg: str) -> DataFrame:
    lit = with_once(df, _fg=c.packed_luminance(F.col(fg)), _bg=c.packed_luminance(F.col("bg")))
    return with_once(lit, ratio=c.ratio_of(F.col("_fg"), F.col("_bg"))).drop("_fg", "_bg")


def contrast_failures(spans: DataFrame) -> DataFrame:
    """Text below its required contrast."""
    large = (F.col("size") >= lx.LARGE_SIZE) | (
        (F.col("size") >= lx.LARGE_BOLD_SIZE) & (F.col("flags").bitwiseAND(lx.BOLD_BIT) != 0))
    out = (
        spans.withColumn("text", strip(F.col("text")))
        .filter(F.length("text") >= 2)
        .withColumn("required", F.when(large, lx.LARGE_TEXT_RATIO).otherwise(lx.TEXT_RATIO))
    )
    out = _ratio_against_bg(out, "color").filter(F.col("ratio") < F.col("required"))
    return out.select(
        "doc_id", "page", "block", "line", "span", left(F.col("text"), 80).alias("text"),
        c.hex_color(F.col("color")).alias("fg"), c.hex_color(F.col("bg")).alias("bg"),
        half_even("ratio", 2).alias("ratio"), "required")


def background_pick(samples: Column, center: Column, fg: Column) -> Column:
    """Background among sampled packed colours.

    Without a text colour: the lightest sample. With one: drop samples within 40 of it
    and take the farthest; if none is left, the centre sample. Earlier samples win ties.
    """
    def best(candidates: Column, score) -> Column:
        ranked = F.transform(candidates, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("pos"), s.alias("rgb")))
        return F.array_max(ranked)["rgb"]

    away = F.filter(samples, lambda s: c.manhattan(s, fg) >= lx.TEXT_PIXEL_DISTANCE)
    lightest = best(samples, lambda s: c.manhattan(s, F.lit(0)))
    farthest = best(away, lambda s: c.manhattan(s, fg))
    return F.when(fg.isNull(), lightest).when(F.size(away) == 0, center).otherwise(farthest)


def page_image_cover(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Share of each page's area under images, at most 1. Partial sums before the shuffle."""
    area = images.groupBy("doc_id", "page").agg(F.sum(F.col("w") * F.col("h")).alias("area"))
    return pages.join(area, ["doc_id", "page"], "left").select(
        "doc_id", "page", F.when(
            F.col("width") * F.col("height") > 0,
            F.least(F.coalesce("area", F.lit(0.0)) / (F.col("width") * F.col("height")), F.lit(1.0)),
        ).otherwise(0.0).alias("cover"))


def decorative_path(width: Column, height: Column) -> Column:
    """Separator rules, closed frames and near-white strokes (columns w, h, closed, items, color)."""
    w, h, packed = F.col("w"), F.col("h"), F.col("color")
    separator = ((w >= width * 0.7) & (h < 5)) | ((h >= height * 0.7) & (w < 5))
    frame = F.col("closed") & (F.col("items") <= 5) & (F.least(w, h) > 5)
    near_white = F.least(*[F.shiftright(packed, s).bitwiseAND(255) for s in (16, 8, 0)]) >= 230
    return separator | F.coalesce(frame, F.lit(False)) | F.coalesce(near_white, F.lit(False))


def nontext_contrast(annots: DataFrame, paths: DataFrame, pages: DataFrame, images: DataFrame) -> DataFrame:
    """Borders and thin informative lines below 3:1."""
    white = F.lit(0xFFFFFF)

    def low(df: DataFrame) -> DataFrame:
        return _ratio_against_bg(df, "fg").filter(F.col("ratio") < lx.GRAPHIC_RATIO)

    ui = (
        annots.filter(F.col("subtype").isin(lx.BORDER_SUBTYPES) & F.col("stroke").isNotNull())
        .select("doc_id", "page", F.lit(0).alias("kind"), F.col("annot_id").alias("item"),
                F.lit("ui_component").alias("type"), F.col("subtype").alias("component"),
                F.col("stroke").alias("fg"), F.coalesce("bg", white).alias("bg"))
    )
    sizes = pages.join(page_image_cover(images, pages), ["doc_id", "page"]).filter(F.col("cover") <= lx.PAGE_COVER)
    thin = (
        paths.filter(F.col("color").isNotNull() & (F.col("width") > 0) & (F.col("width") <= 3)
                     & (F.greatest("w", "h") >= 10))
        .withColumns({"fg": F.col("color"), "bg": F.coalesce("bg", white)})
    )
    graphic = (
        low(thin).join(sizes.select("doc_id", "page", F.col("width").alias("_pw"), F.col("height").alias("_ph")), ["doc_id", "page"])
        .filter(~decorative_path(F.col("_pw"), F.col("_ph")))
        .select("doc_id", "page", F.lit(1).alias("kind"), F.col("path_id").alias("item"), F.lit("graphic").alias("type"),
                F.format_string("line/path w=%.1fpt", F.col("width")).alias("component"),
                "fg", "bg", "ratio")
    )
    return low(ui).unionByName(graphic).select(
        "doc_id", "page", "type", "component", "item", c.hex_color(F.col("fg")).alias("fg"),
        c.hex_color(F.col("bg")).alias("bg"), half_even("ratio", 2).alias("ratio"),
        F.lit(lx.GRAPHIC_RATIO).alias("required"))


def fill_repairs(fills: DataFrame, required: float = lx.TEXT_RATIO) -> DataFrame:
    """Text fills darkened to pass against white; unknown colour spaces become black."""
    r, g, b, known = c.device_rgb(F.col("space"), F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    rgb = fills.withColumns({"r": r, "g": g, "bl": b, "known": known})
    lum = c.quantized_luminance(F.col("r"), F.col("g"), F.col("bl"), F.lit(1.0))
    needs = ~F.col("known") | (c.white_ratio(lum) < required)
    fixed = F.when(~needs, F.lit(None)).when(~F.col("known"), F.lit(0)).otherwise(
        c.darken_exact(F.col("r"), F.col("g"), F.col("bl"), required))
    return rgb.select("doc_id", "page", "fill_id", c.hex_color(c.pack(F.col("r"), F.col("g"), F.col("bl"))).alias("rgb"),
                      needs.alias("needs_fix"), c.hex_color(fixed.cast("int")).alias("fixed"))


def _colours(*names: str) -> list[Column]:
    return [F.conv(F.substring(n, 2, 6), 16, 10).cast("int") for n in names]


def contrast_repairs(failures: DataFrame) -> DataFrame:
    """Linear darkening of each failing text colour against its own background, row by row: nearly all pairs of colours differ."""
    fg, bg = _colours("fg", "bg")
    out = c.darken_linear(failures, *c.channels(fg), c.packed_luminance(bg))
    return out.select("doc_id", "page", "block", "line", "span", "fg", "bg", c.hex_color(F.col("_fixed")).alias("fixed"))


def graphic_repairs(issues: DataFrame) -> DataFrame:
    """Darkened stroke for each failing graphic, null where the change would be too strong."""
    fg, bg = _colours("fg", "bg")
    out = c.darken_graphic(issues.filter(F.col("type") == "graphic"), *c.channels(fg), c.packed_luminance(bg))
    return out.select("doc_id", "page", "item", "fg", "bg", c.hex_color(F.col("_fixed")).alias("fixed"))


def background_fills(fills: DataFrame) -> DataFrame:
    """Large mid-tone chromatic rectangles behind text."""
    r, g, b, known = c.device_rgb(F.col("space"), F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    rgb = fills.withColumns({"r": r, "g": g, "bl": b, "known": known, "area": F.abs("w") * F.abs("h")})
    gray = (F.col("r") + F.col("g") + F.col("bl")) / 3.0
    chroma = F.greatest(*[F.abs(F.col(x) - gray) for x in ("r", "g", "bl")])
    coloured = rgb.filter(F.col("known") & (F.col("area") >= lx.FILL_MIN_AREA)).withColumn("chroma", chroma).filter(F.col("chroma") > lx.FILL_CHROMA)
    # exploded, so that the powers of a luminance are taken once a row, after what is cheap: a plain column would be put into each comparison
    lum = F.explode(F.array(c.luminance(F.col("r"), F.col("g"), F.col("bl")))).alias("lum")
    return coloured.select("*", lum).filter((F.col("lum") > lx.FILL_DARK) & (F.col("lum") < lx.FILL_LIGHT)).select(
        "doc_id", "page", "fill_id", "area", half_even("lum", 4).alias("lum"), half_even("chroma", 4).alias("chroma"))
