"""Heading checks and repairs. Input: one row per node with doc_id, ord, tag, text, ...

The ordered rules use the two-level scan, so one very long document is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom import lexicon as lx
from tagloom.functions.numbers import half_even
from tagloom.functions.rows import with_once
from tagloom.functions.text import left, lookup, strip
from tagloom.operators import scan


def heading_rows(nodes: DataFrame) -> DataFrame:
    """Heading nodes with their level; a plain H counts as level 1."""
    level = lookup({"H": 1} | {tag: int(tag[1]) for tag in lx.HEADING_TAGS}, F.col("tag"))
    return with_once(nodes.drop("level"), level=level).filter(F.col("level").isNotNull())


def skipped_levels(headings: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Headings more than one level below the heading before them."""
    df = scan.previous(scan.with_chunk(headings, "ord", chunk_rows), ["doc_id"], ["ord"], "level", "prev_level")
    return df.filter(F.col("level") > F.col("prev_level") + 1).drop("_chunk")


def heading_issues(headings: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Skipped levels, plus one row per document whose headings have no level 1."""
    rows = headings.select("doc_id", "ord", "level", "page", "text")
    skips = skipped_levels(rows, chunk_rows).select(
        "doc_id", F.lit("skipped_level").alias("type"), "ord", "level", "prev_level", "page",
        left(F.coalesce("text", F.lit("")), 80).alias("text"))
    missing = (
        headings.groupBy("doc_id").agg(F.min("level").alias("top")).filter(F.col("top") > 1)
        .select("doc_id", F.lit("missing_h1").alias("type"), F.lit(None).cast("long").alias("ord"),
                F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("prev_level"),
                F.lit(None).cast("int").alias("page"), F.lit("").alias("text"))
    )
    return skips.unionByName(missing)


def repair_levels(headings: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """First heading becomes 1; each next one at most one deeper than the repaired one before.

    With i counting headings, c(i) = min(l(i), c(i-1) + 1) is c(i) = i + min over j <= i
    of (l(j) - j): a running minimum, which splits over chunks.
    """
    df = scan.with_chunk(headings, "ord", chunk_rows)
    j = F.col("_j")
    # in the document's first chunk the first heading counts as level 1, whatever it says
    forced = F.when(j == 1, F.lit(1)).otherwise(F.col("level")) - j
    prior = F.col("_n_before")
    df = scan.chunk_scan(
        df, ["doc_id"], ["ord"],
        local=[{"_j": lambda w: F.row_number().over(w)},
               {"_low": lambda w: F.min(F.col("level") - j).over(scan.running(w)),
                "_low_first": lambda w: F.min(forced).over(scan.running(w))}],
        totals={"_n": F.count(F.lit(1)), "_m": F.min(F.col("level") - j), "_m_first": F.min(forced)},
        carry=[{"_n_before": lambda w: F.sum("_n").over(w)},
               {"_t_m": lambda w: F.when(prior.isNull(), F.col("_m_first")).otherwise(F.col("_m") - prior)},
               {"_low_before": lambda w: F.min("_t_m").over(w)}],
        totals_of_local=True,
    )
    # with n headings before the chunk, heading j of it is heading n + j of the document
    n = F.coalesce(prior, F.lit(0))
    low = F.when(prior.isNull(), F.col("_low_first")).otherwise(F.least(F.col("_low") - n, "_low_before"))
    return df.withColumn("new_level", (low + n + j).cast("int")).drop(
        "_chunk", "_j", "_low", "_low_first", "_n_before", "_low_before")


def bookmarks(headings: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Outline: the parent is the nearest earlier heading of a lower level.

    One running "last heading of level k" per level; the parent is the latest of those
    with k below the own level.
    """
    df = scan.with_chunk(headings, "ord", chunk_rows)
    at = {k: F.max(F.when(F.col("level") == k, F.col("ord"))) for k in range(1, 6)}
    df = scan.chunk_scan(
        df, ["doc_id"], ["ord"],
        local=[{f"_p{k}": (lambda w, a=a: a.over(scan.before(w))) for k, a in at.items()}],
        totals={f"_m{k}": a for k, a in at.items()},
        carry=[{f"_q{k}": (lambda w, k=k: F.max(f"_m{k}").over(w)) for k in at}],
    )
    # a heading of level k hides every deeper one before it, so the nearest lower wins
    candidates = [F.when(F.col("level") > k, F.greatest(f"_p{k}", f"_q{k}")) for k in at]
    title = F.when(F.coalesce("text", F.lit("")) == "", F.col("tag")).otherwise(F.col("text"))
    return df.select("doc_id", "ord", "level", F.greatest(*candidates).alias("parent_ord"),
                     left(title, 255).alias("title"), "page", "y1")


def outline_counts(outline: DataFrame) -> DataFrame:
    """Entries and top-level entries per document."""
    return outline.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("bookmarks"), F.count_if(F.col("parent_ord").isNull()).alias("top_level"))


def _nth_size(sizes: DataFrame, keys: list[str], value: str, position: Column, name: str) -> DataFrame:
    """Value at a 0-based ``position`` (an expression over ``total``) of the sorted multiset.

    Counts per distinct value come first, so no group of raw rows is ever sorted.
    """
    from pyspark.sql import Window
    counts = sizes.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys)
    return (
        counts.withColumns({"cum": F.sum("n").over(w), "total": F.sum("n").over(total)})
        .filter(F.col("cum") > position)
        .groupBy(*keys).agg(F.min(value).alias(name), F.first("total").alias("total"))
    )


def lower_third_size(nodes: DataFrame) -> DataFrame:
    """Element n // 3 of the sorted sizes of P nodes, for documents with at least 3."""
    sized = nodes.filter((F.col("tag") == "P") & (F.col("font_size") > 0)).select("doc_id", "font_size")
    return _nth_size(sized, ["doc_id"], "font_size", F.floor(F.col("total") / 3), "body_size").filter(
        F.col("total") >= 3).drop("total")


def mode_size(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent size rounded to 0.5; the smallest wins a tie."""
    half = F.rint(F.col("size") * 2) / 2
    counts = spans.filter(F.col("size") > 0).groupBy(*keys, half.alias("half")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("half", F.struct("n", -F.col("half"))).alias("mode_size"))


def median_size(spans: DataFrame, keys: list[str], floor: float = lx.MIN_BODY_SIZE) -> DataFrame:
    """Median of sizes at or above ``floor``, from per-size counts."""
    sized = spans.filter(F.col("size") >= floor).select(*keys, "size")
    low = _nth_size(sized, keys, "size", F.floor((F.col("total") - 1) / 2), "_lo").drop("total")
    high = _nth_size(sized, keys, "size", F.floor(F.col("total") / 2), "_hi").drop("total")
    return low.join(high, keys).select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias("median_size"))


def promote_headings(nodes: DataFrame) -> DataFrame:
    """Large short paragraphs become H1-H3 in documents that have no heading at all."""
    keys = ["doc_id"]
    has_heading = nodes.groupBy(*keys).agg(
        F.bool_or(F.col("tag").isin(lx.HEADING_TAGS)).alias("has_heading")).filter(~F.col("has_heading")).select(*keys)
    text = strip(F.coalesce("text", F.lit("")))
    p = (
        nodes.filter((F.col("tag") == "P") & (F.col("font_size") > 0))
        .filter((text != "") & (F.length(text) <= 120))
        .join(has_heading, keys, "left_semi").join(lower_third_size(nodes), keys)
        .withColumn("ratio", F.col("font_size") / F.col("body_size")).filter(F.col("ratio") >= 1.15)
    )
    first = p.filter(F.col("ratio") >= 1.5).groupBy(*keys).agg(F.min("ord").alias("h1_ord"))
    out = p.join(first, keys, "left")
    tag = (F.when(F.col("ord") == F.col("h1_ord"), "H1").when(F.col("ratio") >= 1.3, "H2").otherwise("H3"))
    return out.select("doc_id", "ord", "node_id", tag.alias("new_tag"), half_even("ratio", 4).alias("ratio"))


def heuristic_tags(spans: DataFrame) -> DataFrame:
    """Tags from font size when layout analysis is not available.

    A block is split at bold label lines; each segment gets its text, mean size, box and
    tag. Body size is the document's modal size.
    """
    from pyspark.sql import Window
    body = mode_size(spans, ["doc_id"])
    word = strip(F.coalesce("text", F.lit("")))
    spans = spans.withColumns({"_w": word})
    line_keys = ["doc_id", "page", "block", "line"]
    text_of = F.concat_ws(" ", F.expr("transform(array_sort(collect_list(CASE WHEN _w <> '' THEN struct(span, _w) END)), s -> s._w)"))
    lines = spans.groupBy(*line_keys).agg(
        text_of.alias("text"), F.sum(F.when(F.col("size") > 0, F.col("size"))).alias("size_sum"),
        F.count_if(F.col("size") > 0).alias("size_n"),
        F.avg((F.col("flags").bitwiseAND(lx.BOLD_BIT) != 0).cast("int")).alias("bold"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    words = F.size(F.split(F.col("text"), r"\s+"))
    label = (F.col("bold") >= 0.75) & (F.col("text") != "") & (words <= 4) & ~F.col("text").endswith(".")
    # segment number inside a block: a label line starts one, and so does the line after it
    w = Window.partitionBy("doc_id", "page", "block").orderBy("line")
    lines = lines.withColumn("label", label)
    starts = F.col("label") | F.coalesce(F.lag("label").over(w), F.lit(False))
    lines = lines.withColumn("_start", starts.cast("int"))
    lines = lines.withColumn("segment", F.sum("_start").over(scan.running(w)).cast("int"))
    segments = lines.groupBy("doc_id", "page", "block", "segment").agg(
        F.concat_ws(" ", F.expr("transform(array_sort(collect_list(CASE WHEN text <> '' THEN struct(line, text) END)), s -> s.text)")).alias("text"),
        (F.sum("size_sum") / F.sum("size_n")).alias("mean_size"), F.bool_or("label").alias("label"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    out = segments.filter(F.col("text") != "").join(body, "doc_id", "left").withColumn(
        "ratio", F.coalesce("mean_size", "mode_size") / F.coalesce("mode_size", F.lit(12.0)))
    tag = (F.when(F.col("ratio") >= 1.6, "H1").when(F.col("ratio") >= 1.3, "H2")
           .when((F.col("ratio") >= 1.15) | F.col("label"), "H3").otherwise("P"))
    return out.select("doc_id", "page", "block", "segment", tag.alias("tag"), "text",
                      half_even("mean_size", 4).alias("mean_size"), "x0", "y0", "x1", "y1")
