"""Layout rules: captions, running headers, hidden text, footnotes, contents lists, nested
lists, swatches, marked content, islands, hit tests, coverage.

Box joins use (document, page, band) as the equality key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import isfinite

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tagloom import lexicon as lx
from tagloom.functions import color as c, geometry as g
from tagloom.functions.numbers import half_even
from tagloom.functions.text import blank, left, lookup, matches, pattern, strip
from tagloom.operators import scan
from tagloom.operators.contrast import first_n
from tagloom.operators.headings import median_size
from tagloom.session import cut_lineage, stored

PAGE = ["doc_id", "page"]
#: Figures and captions of a page that one task walks, a few hundred bytes each.
PAGE_BOXES = 1 << 19


# --- captions ----------------------------------------------------------------

def _caption_boxes(nodes: DataFrame) -> DataFrame:
    """Figures and what may be their captions: page, ord, is_figure, lower and upper edge."""
    figure = F.col("tag") == "Figure"
    caption = F.col("tag").isin("P", "Span", "Caption") & matches(strip(F.coalesce("text", F.lit(""))), lx.CAPTION, True)
    return nodes.filter(F.col("y0").isNotNull() & (figure | caption)).select(
        *PAGE, "ord", figure.alias("is_figure"), F.least("y0", "y1").alias("low"), F.greatest("y0", "y1").alias("high"))


def _box_gaps(boxes: DataFrame) -> DataFrame:
    def edges(df: DataFrame, name: str, below: str, above: str) -> DataFrame:
        sides = df.select(*PAGE, F.col("ord").alias(name), F.posexplode(F.array(below, above)).alias("side", name + "_y"))
        # edges beyond any page, infinite ones too, share the outermost bands
        return sides.withColumn("_b", g.band_of(F.least(F.greatest(F.col(name + "_y"), F.lit(-1e18)), F.lit(1e18)), lx.CAPTION_GAP))

    # caption top against figure bottom, caption bottom against figure top
    f = edges(boxes.filter("is_figure"), "fig", "low", "high")
    f = f.withColumn("_band", F.explode(F.sequence(F.col("_b") - 1, F.col("_b") + 1))).drop("_b")
    t = edges(boxes.filter("NOT is_figure"), "cap", "high", "low").withColumnRenamed("_b", "_band")
    gap = F.abs(F.col("fig_y") - F.col("cap_y"))
    return f.join(t, [*PAGE, "side", "_band"]).withColumn("gap", gap).filter(F.col("gap") <= lx.CAPTION_GAP).groupBy(
        *PAGE, "fig", "cap").agg(F.min("gap").alias("gap"))


def caption_gaps(nodes: DataFrame) -> DataFrame:
    """Figure and caption candidates of a page at most 40 pt apart, with their gap."""
    return _box_gaps(_caption_boxes(nodes))


def _close_held(pairs: DataFrame) -> DataFrame:
    """One round: figures ask for their nearest caption, which is closed to all later than the earliest that asks."""
    nearest = F.min(F.struct("gap", "cap")).over(Window.partitionBy(*PAGE, "fig"))
    asking = pairs.withColumn("_asks", nearest["cap"] == F.col("cap"))
    holder = F.min(F.when(F.col("_asks"), F.col("fig"))).over(Window.partitionBy(*PAGE, "cap"))
    return asking.withColumn("_holder", holder).filter(F.col("_holder").isNull() | (F.col("fig") <= F.col("_holder"))).select(
        *PAGE, "fig", "cap", "gap")


def _in_rounds(boxes: DataFrame, rounds: int) -> DataFrame:
    """Captions of figures by pairs, for pages no task should hold.

    Every figure asks for the nearest caption still open to it, a caption keeps the earliest figure that
    asks, and is closed to all later ones. What the earliest figures hold when nothing closes any more is what they would take one
    after the other. Rounds are as many as the longest row of figures that push each other on, not as there are figures;
    so many ``rounds`` run before their result is stored and counted.
    """
    pairs = cut_lineage(_box_gaps(boxes).select(*PAGE, "fig", "cap", "gap"))
    left = pairs.count()
    while left:
        for _ in range(rounds):
            pairs = _close_held(pairs)
        pairs, before = cut_lineage(pairs), left
        left = pairs.count()
        if left == before:
            break
    return pairs.groupBy(*PAGE, "fig").agg(F.min(F.struct("gap", "cap")).alias("_best")).select(*PAGE, "fig", "_best.cap", "_best.gap")


class _OpenEdges:
    """Caption edges of a page in the order (y, cap); those of taken captions are skipped in both directions."""

    def __init__(self, edges: list[tuple]):
        self.edges = sorted(e for e in edges if isfinite(e[0]))
        self.ys = [y for y, _ in self.edges]
        self.up = list(range(len(self.edges) + 1))
        self.down = list(range(len(self.edges) + 1))
        self.places: dict = {}
        for i, (_, cap) in enumerate(self.edges):
            self.places.setdefault(cap, []).append(i)

    @staticmethod
    def _open(links: list[int], i: int) -> int:
        end = i
        while links[end] != end:
            end = links[end]
        while links[i] != end:
            links[i], i = end, links[i]
        return end

    def take(self, cap) -> None:
        for i in self.places.get(cap, ()):
            self.up[i] = i + 1
            self.down[i + 1] = i

    def nearest(self, y: float, reach: float) -> Iterator[tuple]:
        """(gap, cap) of the open edges nearest to ``y`` on either side; of one height, the smallest cap."""
        i, best = self._open(self.up, bisect_left(self.ys, y)), reach
        while i < len(self.ys) and self.ys[i] - y <= best:
            best = self.ys[i] - y
            yield best, self.edges[i][1]
            i = self._open(self.up, bisect_right(self.ys, self.ys[i]))
        # down[i] stands for the edge before i
        i, best = self._open(self.down, bisect_left(self.ys, y)), reach
        while i > 0 and y - self.ys[i - 1] <= best:
            best, first = y - self.ys[i - 1], bisect_left(self.ys, self.ys[i - 1])
            yield best, self.edges[self._open(self.up, first)][1]
            i = self._open(self.down, first)


def _page_captions(rows: list[tuple]) -> Iterator[tuple]:
    """(fig, cap, gap) of the boxes (ord, is_figure, low, high) of one page, each figure taking the nearest caption left."""
    figures: dict = {}
    for place, is_figure, low, high in rows:
        if is_figure:
            figures.setdefault(place, []).append((low, high))
    captions = [r for r in rows if not r[1]]
    tops, bottoms = _OpenEdges([(r[3], r[0]) for r in captions]), _OpenEdges([(r[2], r[0]) for r in captions])
    for fig in sorted(figures):
        near = [n for low, high in figures[fig] for side, y in ((tops, low), (bottoms, high)) if isfinite(y)
                for n in side.nearest(y, lx.CAPTION_GAP)]
        if near:
            gap, cap = min(near)
            tops.take(cap)
            bottoms.take(cap)
            yield fig, cap, gap


def _by_pages(boxes: DataFrame) -> DataFrame:
    """Captions of figures page by page: each box is shuffled once, a task holds one page at a time."""
    kind = boxes.schema
    names = {"doc_id": "doc_id", "page": "page", "fig": "ord", "cap": "ord", "gap": "low"}
    schema = StructType([StructField(name, kind[of].dataType) for name, of in names.items()])
    arrow = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, rows, done = None, [], []
        for batch in batches:
            for doc, number, *box in zip(*[column.to_pylist() for column in batch.columns]):
                if (doc, number) != page:
                    if rows:
                        done += [(*page, *found) for found in _page_captions(rows)]
                    page, rows = (doc, number), []
                rows.append(box)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)
                done = []
        if rows:
            done = [(*page, *found) for found in _page_captions(rows)]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)

    return boxes.repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(walk, schema)


def link_captions(nodes: DataFrame, rounds: int = 4, page_boxes: int = PAGE_BOXES) -> DataFrame:
    """One caption per figure, nearest first, figures in reading order.

    Pages of at most ``page_boxes`` figures and captions are walked, figure by figure, in time that does not grow with
    their pairs; on longer ones figures and captions find each other in ``rounds`` over all pairs. Both give the same.
    """
    boxes = _caption_boxes(nodes).dropna(subset=[*PAGE, "ord"])
    crowded = cut_lineage(boxes.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > page_boxes).select(*PAGE))
    if crowded.isEmpty():
        return _by_pages(boxes)
    few = F.broadcast(crowded)
    return _by_pages(boxes.join(few, PAGE, "left_anti")).unionByName(_in_rounds(boxes.join(few, PAGE, "left_semi"), rounds))


def adopt_captions(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Captions of a pair table (doc_id, fig, cap as ord) move under their figures."""
    owner = nodes.select("doc_id", F.col("ord").alias("fig"), F.col("node_id").alias("_figure"))
    moves = pairs.join(owner, ["doc_id", "fig"]).select("doc_id", F.col("cap").alias("ord"), "_figure")
    out = nodes.join(moves, ["doc_id", "ord"], "left")
    return out.withColumns({
        "parent_id": F.coalesce("_figure", "parent_id"),
        "tag": F.when(F.col("_figure").isNotNull(), F.lit("Caption")).otherwise(F.col("tag"))}).drop("_figure")


# --- running headers and hidden text -------------------------------------------

def running_headers(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Margin text repeated in a document, digits aside."""
    many = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= lx.MIN_REPEATS).select("doc_id")
    size = pages.join(many, "doc_id", "left_semi").select(*PAGE, "height")
    text = strip(F.coalesce("text", F.lit("")))
    mid = F.col("height") - (F.col("y0") + F.col("y1")) / 2
    zone = F.when(mid < F.col("height") * lx.MARGIN_FRACTION, "top").when(
        mid > F.col("height") * (1.0 - lx.MARGIN_FRACTION), "bottom")
    norm = strip(F.regexp_replace("text", r"(?U)\d+", "#"))
    rows = spans.withColumn("text", text).filter(F.col("text") != "").join(size, PAGE).withColumns({
        "zone": zone, "row_y": F.rint(mid / lx.ROW_TOLERANCE) * lx.ROW_TOLERANCE,
        "norm": F.when(norm == "", F.lit("#")).otherwise(norm)}).filter(F.col("zone").isNotNull())
    # counted and looked up again: the spans of the margins are found once
    rows = stored(rows.select(*PAGE, "span", "zone", "row_y", "norm", "x0", "y0", "x1", "y1"), "margin-spans")
    keys = ["doc_id", "zone", "row_y", "norm"]
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= lx.MIN_REPEATS).select(*keys)
    return rows.join(repeated, keys, "left_semi").select(*PAGE, "span", "zone", "row_y", "norm", "x0", "y0", "x1", "y1")


def header_artifacts(nodes: DataFrame, zones: DataFrame) -> DataFrame:
    """Nodes whose centre lies in a running header or footer box."""
    boxes = g.with_box_cells(g.prefixed(zones, "z_", *PAGE).distinct(), "z_", lx.BOX_TOLERANCE)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    centres = g.with_point_cells(nodes.select(*PAGE, "node_id", cx.alias("_x"), cy.alias("_y")), F.col("_x"), F.col("_y"))
    inside = centres.join(boxes, [*PAGE, "_cell"]).filter(g.contains("z_", F.col("_x"), F.col("_y"), lx.BOX_TOLERANCE))
    return nodes.join(inside.select(*PAGE, "node_id").distinct(), [*PAGE, "node_id"], "left_semi")


def invisible_spans(spans: DataFrame) -> DataFrame:
    """White or tiny text."""
    white = F.least(*[F.shiftright("color", s).bitwiseAND(255) for s in (16, 8, 0)]) > 245
    return spans.filter(F.coalesce(white, F.lit(False)) | ((F.col("size") > 0) & (F.col("size") < 2)))


def drop_invisible(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """Leaf nodes mostly covered by one invisible span are dropped; containers stay.

    A box that covers more than half of another holds its centre, so centres are joined with boxes.
    """
    hidden = g.with_box_cells(g.prefixed(invisible_spans(spans), "h_", *PAGE).distinct(), "h_")
    leaf = F.col("tag").isin(lx.LEAF_TAGS) & F.col("x0").isNotNull()
    n = g.with_point_cells(nodes.filter(leaf).select(*PAGE, "node_id", "x0", "y0", "x1", "y1"),
                           (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    gone = n.join(hidden, [*PAGE, "_cell"]).filter(g.cover("", "h_") >= lx.HIDDEN_COVER).select("doc_id", "node_id").distinct()
    return nodes.join(gone, ["doc_id", "node_id"], "left_anti")


# --- footnotes -------------------------------------------------------------------

def footnotes(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Superscript markers above the footnote zone with the note that carries the marker."""
    marker = pattern(lx.FOOTNOTE_MARKER)
    sized = spans.withColumn("t", strip(F.coalesce("text", F.lit(""))))
    low = pages.select(*PAGE, (F.col("height") * (1 - lx.FOOTNOTE_ZONE)).alias("zone_top"))
    line = ["doc_id", "page", "block", "line"]
    line_size = spans.filter(F.col("size") > 0).groupBy(*line).agg(F.median("size").alias("line_size"))
    limit = F.least(F.col("median_size") * lx.SUPERSCRIPT_RATIO, F.col("line_size") * lx.LINE_RATIO)
    refs = (
        sized.filter((F.col("t") != "") & (F.col("size") > 0)).withColumn("marker", F.regexp_extract("t", marker, 1))
        .filter(F.col("marker") != "").join(median_size(spans, PAGE), PAGE).join(line_size, line).join(low, PAGE)
        .filter((F.col("size") < limit) & (F.col("y0") >= F.col("zone_top")))
        .select(*PAGE, "span", "marker", F.col("y1").alias("ref_y"))
    )
    blocks = spans.groupBy(*PAGE, "block").agg(F.min("y0").alias("by0"), F.max("y1").alias("note_y"), F.min("line").alias("line"))
    blocks = blocks.join(low, PAGE).filter(F.col("by0") <= F.col("zone_top"))
    first_line = spans.join(blocks, line).groupBy(*PAGE, "block", "note_y").agg(strip(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "")).alias("t"))
    bodies = first_line.withColumn("marker", F.regexp_extract("t", marker, 1)).filter(F.col("marker") != "").groupBy(
        *PAGE, "marker").agg(F.max_by(F.struct("block", "note_y"), "block").alias("n"))
    return refs.join(bodies, [*PAGE, "marker"]).select(
        *PAGE, "span", "marker", "ref_y", F.col("n.block").alias("block"), F.col("n.note_y").alias("note_y"))


# --- runs and lists ---------------------------------------------------------------

def contents_runs(nodes: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Runs of at least three contents lines, empty nodes between them ignored.

    The last node that is neither empty nor a contents line names the run it precedes.
    """
    t = strip(F.coalesce("text", F.lit("")))
    item = matches(t, lx.TOC_LINE)
    header = matches(t, lx.TOC_HEADER, True) & F.col("tag").isin("P", "H1", "H2", "H3", "Caption")
    rows = nodes.select("doc_id", "node_id", "ord", (item & (t != "")).alias("item"), header.alias("header"), (t == "").alias("empty"))
    rows = scan.with_chunk(rows, "ord", chunk_rows)
    stop = F.max(F.when(~F.col("item") & ~F.col("empty"), F.struct("ord", "node_id", "header")))
    rows = scan.chunk_scan(
        rows, ["doc_id"], ["ord"],
        local=[{"_own": lambda w: stop.over(scan.running(w))}],
        totals={"_stop": stop},
        carry=[{"_prior": lambda w: F.max("_stop").over(w)}])
    rows = rows.filter("item").withColumn("after", F.coalesce("_own", "_prior"))
    runs = rows.groupBy("doc_id", "after").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "node_id")).alias("first")).filter(F.col("n") >= lx.TOC_MIN_RUN)
    base = F.when(F.coalesce(F.col("after.header"), F.lit(False)), F.col("after.node_id")).otherwise(F.col("first.node_id"))
    runs = runs.select("doc_id", F.coalesce(F.col("after.ord"), F.lit(-1)).alias("_after"), F.concat(base, F.lit("_toc")).alias("toc_id"))
    return rows.withColumn("_after", F.coalesce(F.col("after.ord"), F.lit(-1))).join(runs, ["doc_id", "_after"]).select(
        "doc_id", "node_id", "ord", "toc_id", F.lit("TOCI").alias("new_tag"))


def nest_lists(items: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Indented items, and bullets that follow them, go under the last plain item.

    A run of sub-items opens at an indented child and closes at a child that is neither
    indented nor bulleted. What a chunk inherits is whether a run is open and which item
    was last; both outcomes are computed per chunk and the summaries choose.
    """
    keys = ["doc_id", "list_id"]
    base = items.filter(F.col("x0").isNotNull()).groupBy(*keys).agg(F.min_by("x0", "ord").alias("base"))
    rows = items.join(base, keys)
    indented = F.coalesce(F.col("x0") - F.col("base") >= lx.LIST_INDENT, F.lit(False))
    bullet = F.col("tag").isin("P", "LI") & matches(strip(F.coalesce("text", F.lit(""))), lx.BULLET, True)
    rows = scan.with_chunk(rows.select(*keys, "node_id", "ord", "tag", indented.alias("ind"), bullet.alias("bul")), "ord", chunk_rows)
    stops = F.max(F.when(~F.col("ind") & ~F.col("bul"), F.col("ord")))
    opens = F.max(F.when(F.col("ind"), F.col("ord")))
    running_open = F.coalesce(F.col("_open") > F.coalesce("_stop", F.lit(-1)), F.lit(False))
    closed_in = F.col("ind") | (F.col("bul") & running_open)
    open_in = F.col("ind") | (F.col("bul") & (running_open | F.col("_stop").isNull()))
    plain = F.col("tag").isin("LI", "L")
    last_c = F.max(F.when(~closed_in & plain, F.col("ord")))
    last_o = F.max(F.when(~open_in & plain, F.col("ord")))
    inherits = F.coalesce(F.col("_open_in") > F.coalesce("_stop_in", F.lit(-1)), F.lit(False))
    rows = scan.chunk_scan(
        rows, keys, ["ord"],
        local=[{"_stop": lambda w: stops.over(scan.running(w)), "_open": lambda w: opens.over(scan.running(w))},
               {"_last_c": lambda w: last_c.over(scan.running(w)), "_last_o": lambda w: last_o.over(scan.running(w))}],
        totals={"_s": stops, "_o": opens, "_lc": last_c, "_lo": last_o},
        carry=[{"_stop_in": lambda w: F.max("_s").over(w), "_open_in": lambda w: F.max("_o").over(w)},
               {"_t_last": lambda w: F.when(inherits, F.col("_lo")).otherwise(F.col("_lc"))},
               {"_last_in": lambda w: F.max("_t_last").over(w)}],
        totals_of_local=True)
    nested = F.when(inherits, open_in).otherwise(closed_in)
    last = F.coalesce(F.when(inherits, F.col("_last_o")).otherwise(F.col("_last_c")), "_last_in")
    return rows.select(
        *keys, "node_id", "ord", nested.alias("nested"),
        F.when(nested & (F.col("tag") == "P"), F.lit("LI")).otherwise(F.col("tag")).alias("new_tag"),
        F.when(nested, last).alias("parent_ord"))


def nested_list_tree(nodes: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """The node table with sub-items moved into lists of their own, same columns.

    Every list of a document, at whatever depth, is looked at: the sub-items of an item get one new L node, named after
    the item, which stands in the item's LBody, or in the item where it has none; paragraphs among them become
    items. Sub-items before any item stay where they are. ``ord`` is doubled, so that a new list fits in before its first
    item: existing nodes have odd numbers, new ones even numbers.
    """
    lists = nodes.filter(F.col("tag") == "L").select("doc_id", F.col("node_id").alias("list_id"))
    items = nodes.withColumnRenamed("parent_id", "list_id").join(lists, ["doc_id", "list_id"], "left_semi")
    nested = nest_lists(items.select("doc_id", "list_id", "node_id", "ord", "tag", "x0", "text"), chunk_rows).filter("nested")
    owner = items.select("doc_id", F.col("ord").alias("parent_ord"), F.col("node_id").alias("_item"))
    moved = nested.join(owner, ["doc_id", "parent_ord"], "left").select("doc_id", "ord", "new_tag", "_item")
    bodies = nodes.filter(F.col("tag") == "LBody").groupBy("doc_id", F.col("parent_id").alias("_item")).agg(F.min_by("node_id", "ord").alias("_body"))
    name = F.concat("_item", F.lit("_sublist"))
    out = nodes.join(moved, ["doc_id", "ord"], "left").withColumns({
        "tag": F.coalesce("new_tag", "tag"), "parent_id": F.coalesce(name, "parent_id"), "ord": F.col("ord") * 2 + 1}).select(*nodes.columns)
    first = moved.filter("_item IS NOT NULL").groupBy("doc_id", "_item").agg(F.min("ord").alias("ord")).join(bodies, ["doc_id", "_item"], "left")
    # page and box are those of the first sub-item
    taken = {"node_id": name, "parent_id": F.coalesce("_body", "_item"), "tag": F.lit("L"), "ord": F.col("ord") * 2}
    from_first = {"doc_id", "page", "x0", "y0", "x1", "y1"}
    place = nodes.select("doc_id", "ord", *[c for c in nodes.columns if c in from_first - {"doc_id"}])
    made = first.join(place, ["doc_id", "ord"]).select(*[
        (taken[f.name] if f.name in taken else F.col(f.name) if f.name in from_first else F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema])
    return out.unionByName(made)


def split_list_labels(items: DataFrame) -> DataFrame:
    """Items with a marker become a label and a body node."""
    text = F.coalesce("text", F.lit(""))
    label = strip(F.regexp_extract(text, pattern(lx.BULLET, True), 0))
    rows = items.filter(F.col("tag") == "LI").withColumns({"_t": text, "_l": label}).filter((F.col("_l") != "") & F.col("_t").startswith(F.col("_l")))
    body = F.ltrim(F.expr("substring(_t, length(_l) + 1)"))
    return rows.select("doc_id", F.col("node_id").alias("parent_id"), F.inline(F.array(
        F.struct(F.concat("node_id", F.lit("_lbl")).alias("node_id"), F.lit("Lbl").alias("tag"), F.col("_l").alias("text")),
        F.struct(F.concat("node_id", F.lit("_lbody")).alias("node_id"), F.lit("LBody").alias("tag"), body.alias("text")))))


def _swatch_starts(cur: Column, prev: Column) -> Column:
    return (F.abs(cur["down"] - prev["down"]) > lx.SWATCH_BAND) | (cur["x"] - (prev["x"] + prev["w"]) > lx.SWATCH_GAP)


def _page_clusters(rows: DataFrame) -> DataFrame:
    """``cluster``, the number of the run a shape belongs to: one shuffle by page serves this and the counts after it."""
    order = Window.partitionBy(*PAGE).orderBy("down", "x", "fill_id")
    shape = F.struct("down", "x", "w")
    opens = F.when(_swatch_starts(shape, F.lag(shape).over(order)), 1).otherwise(0)
    return rows.withColumn("_opens", opens).withColumn("cluster", F.sum("_opens").over(scan.running(order))).drop("_opens")


def _swatch_counts(rows: DataFrame, *first: Column) -> DataFrame:
    """Shapes and colours per cluster; per colour first, so no distinct set is built for a large cluster."""
    colours = rows.groupBy(*PAGE, "cluster", "r", "g", "bl").agg(F.count(F.lit(1)).alias("n"), *first)
    return colours.groupBy(*PAGE, "cluster").agg(F.sum("n").alias("swatches"), F.count(F.lit(1)).alias("colors"), *[F.min("_at").alias("_at") for _ in first]).filter(
        (F.col("swatches") >= lx.SWATCH_MIN) & (F.col("colors") >= lx.SWATCH_MIN))


def swatch_clusters(fills: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Rows of small coloured shapes with at least three colours: a likely legend.

    A page of at most ``chunk_rows`` small shapes is sorted by one task; only longer ones are cut into chunks, by count.
    """
    area = F.col("w") * F.col("h")
    small = fills.filter(
        area.between(lx.SWATCH_MIN_AREA, lx.SWATCH_MAX_AREA)
        & (F.col("w") / F.greatest("h", F.lit(0.1)) <= lx.SWATCH_ASPECT) & (F.col("h") / F.greatest("w", F.lit(0.1)) <= lx.SWATCH_ASPECT))
    r, gr, b, _ = c.device_rgb(F.col("space"), F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    rows = small.select(*PAGE, (-F.col("y")).alias("down"), "x", "fill_id", "w",
                        *[half_even(v, 2).alias(n) for v, n in ((r, "r"), (gr, "g"), (b, "bl"))])
    crowded = cut_lineage(small.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk_rows).select(*PAGE))
    few = None if crowded.isEmpty() else F.broadcast(crowded)
    paged = rows if few is None else rows.join(few, PAGE, "left_anti")
    at = F.min(F.struct("down", "x", "fill_id")).alias("_at")
    out = _swatch_counts(_page_clusters(paged), at).select(*PAGE, F.col("_at.fill_id").alias("first_fill"), "swatches", "colors")
    if few is None:
        return out
    cut = scan.with_count_chunk(rows.join(few, PAGE, "left_semi"), [*PAGE, "down", "x", "fill_id"], chunk_rows)
    runs = scan.islands(cut, PAGE, ["down", "x", "fill_id"], F.struct("down", "x", "w"), _swatch_starts, "cluster")
    return out.unionByName(_swatch_counts(runs).select(*PAGE, F.col("cluster.fill_id").alias("first_fill"), "swatches", "colors"))


# --- marked content and structure ------------------------------------------------

def orphan_mcids(stream: DataFrame, tree: DataFrame) -> DataFrame:
    """Marked content in the stream that no structure element refers to."""
    return stream.filter(F.col("tag") != "Artifact").join(tree, [*PAGE, "mcid"], "left_anti").select(*PAGE, "mcid")


def artifact_conflicts(stream: DataFrame, tree: DataFrame) -> DataFrame:
    """Content marked as artifact that the tree refers to, with the tag to use."""
    marked = stream.filter(F.col("tag") == "Artifact").select(*PAGE, "mcid")
    return marked.join(tree.select(*PAGE, "mcid", F.col("tag").alias("use_tag")), [*PAGE, "mcid"])


def node_texts(stream: DataFrame, tree: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Text of each structure node from its marked content, in order; figures use alt."""
    parts = tree.select(*PAGE, "mcid", "node_id", "pos").join(stream.select(*PAGE, "mcid", "text"), [*PAGE, "mcid"], "left")
    out = parts.groupBy(*PAGE, "node_id").agg(strip(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "mcid", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), " ")).alias("text"))
    if nodes is None:
        return out
    alt = nodes.filter((F.col("tag") == "Figure") & (F.coalesce("alt", F.lit("")) != "")).select("doc_id", "node_id", "alt")
    return out.join(alt, ["doc_id", "node_id"], "left").select(*PAGE, "node_id", F.coalesce("alt", "text").alias("text"))


def unmarked_content(ops: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Painting operators outside any marked content; nesting never falls below zero.

    Depth is the running sum less its running minimum below zero.
    """
    delta = F.when(F.col("op").isin("BDC", "BMC"), 1).when(F.col("op") == "EMC", -1).otherwise(0)
    rows = scan.with_count_chunk(ops.withColumn("_d", delta), [*PAGE, "seq", "sub"], chunk_rows)
    rows = scan.chunk_scan(
        rows, PAGE, ["seq", "sub"],
        local=[{"_s": lambda w: F.sum("_d").over(scan.running(w))}, {"_m": lambda w: F.min("_s").over(scan.running(w))}],
        totals={"_sum": F.sum("_d"), "_min": F.min("_s")},
        carry=[{"_sum_in": lambda w: F.coalesce(F.sum("_sum").over(w), F.lit(0))},
               {"_t_min": lambda w: F.col("_sum_in") + F.col("_min")},
               {"_min_in": lambda w: F.min("_t_min").over(w)}],
        totals_of_local=True)
    floor = F.least(F.lit(0), F.col("_sum_in") + F.col("_m"), "_min_in")
    depth = F.col("_sum_in") + F.col("_s") - floor
    return rows.filter(F.col("op").isin(lx.PAINT_OPS) & (depth == 0)).select(*PAGE, "seq", "sub", "op")


def topmost_ancestors(tree: DataFrame) -> DataFrame:
    """(doc_id, node_id, top): the last existing ancestor of every node.

    Pointer doubling: each round every unfinished node jumps to its pointer's pointer, so
    depth d takes log2(d) joins, and finished nodes leave the join. As long as a finite chain
    is open, a round finishes its next nodes; a round that finishes none has only nodes in or
    below a cycle left, and those are their own top.
    """
    known = tree.select("doc_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("_known"))
    hop = tree.join(known, ["doc_id", "parent_id"], "left")
    state = cut_lineage(hop.select("doc_id", "node_id", F.when(F.col("_known"), F.col("parent_id")).alias("up")))
    done = state.filter(F.col("up").isNull()).select("doc_id", "node_id", F.col("node_id").alias("top"))
    todo = state.filter(F.col("up").isNotNull())
    left_over = todo.count()
    while left_over:
        ends = done.select("doc_id", F.col("node_id").alias("up"), "top")
        jumps = todo.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("next"))
        moved = cut_lineage(todo.join(ends, ["doc_id", "up"], "left").join(jumps, ["doc_id", "up"], "left").select(
            "doc_id", "node_id", "top", F.col("next").alias("up")))
        done = done.unionByName(moved.filter(F.col("top").isNotNull()).select("doc_id", "node_id", "top"))
        todo = moved.filter(F.col("top").isNull()).select("doc_id", "node_id", "up")
        before, left_over = left_over, todo.count()
        if left_over == before:
            return done.unionByName(todo.select("doc_id", "node_id", F.col("node_id").alias("top")))
    return done


def structure_islands(tree: DataFrame, root_tag: str = "Document") -> DataFrame:
    """Subtrees the root does not reach: their topmost node, its wrapper and their size."""
    tops = topmost_ancestors(tree)
    roots = tree.filter(F.col("parent_id").isNull() & (F.col("tag") == root_tag)).select("doc_id", F.col("node_id").alias("top"))
    sizes = tops.join(roots, ["doc_id", "top"], "left_anti").groupBy("doc_id", "top").agg(F.count(F.lit(1)).alias("size"))
    tag = tree.select("doc_id", F.col("node_id").alias("top"), "tag")
    return sizes.join(tag, ["doc_id", "top"]).select(
        "doc_id", "top", "tag", lookup(lx.ISLAND_WRAPPERS, F.col("tag")).alias("wrapper"), "size")


def hit_test(points: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Smallest node box around each point (x0, y0) of a page; null marks an artifact."""
    boxes = g.with_box_cells(g.prefixed(nodes.filter(F.col("x0").isNotNull()), "n_", *PAGE, "node_id", "ord", "decorative"), "n_", lx.BOX_TOLERANCE)
    p = g.with_point_cells(points.select(*PAGE, key, "x0", "y0"), F.col("x0"), F.col("y0"))
    inside = g.contains("n_", F.col("x0"), F.col("y0"), lx.BOX_TOLERANCE)
    hits = p.join(boxes, [*PAGE, "_cell"]).filter(inside).groupBy(*PAGE, key).agg(
        F.min_by(F.struct("node_id", "decorative"), F.struct(g.area("n_"), "ord")).alias("n"))
    return points.select(*PAGE, key).join(hits, [*PAGE, key], "left").select(
        *PAGE, key, F.when(~F.coalesce(F.col("n.decorative"), F.lit(False)), F.col("n.node_id")).alias("node_id"))


def empty_elements(nodes: DataFrame) -> DataFrame:
    """Nodes with no text, alt or children that are not artifacts or decoration."""
    parents = nodes.filter(F.col("parent_id").isNotNull()).select("doc_id", F.col("parent_id").alias("node_id")).distinct()
    bare = nodes.filter(
        blank(F.col("text")) & blank(F.col("alt")) & (F.col("tag") != "Artifact")
        & ~F.coalesce("artifact", F.lit(False)) & ~F.coalesce("decorative", F.lit(False)))
    return bare.join(parents, ["doc_id", "node_id"], "left_anti").select("doc_id", "node_id", "tag", "page")


def coverage(pages: DataFrame, spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pages with text but no structure, and the share of pages that are covered."""
    texted = spans.filter(~blank(F.col("text"))).select(*PAGE).distinct()
    orphans = texted.join(nodes.select(*PAGE).distinct(), PAGE, "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    totals = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    empty = empty_elements(nodes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("empty_elements"))
    n = F.coalesce("n", F.lit(0))
    pct = F.greatest(F.lit(0.0), half_even(100 * (1 - n / F.greatest("pages", F.lit(1))), 0))
    return totals.join(orphans, "doc_id", "left").join(empty, "doc_id", "left").select(
        "doc_id", "pages", n.alias("orphaned_pages"), pct.cast("int").alias("coverage_pct"),
        F.coalesce("empty_elements", F.lit(0)).alias("empty_elements"))


def graphical_pages(elements: DataFrame) -> DataFrame:
    """Scanned pages that are sparse labels rather than text collapse to one figure.

    The alt text shows 300 characters; each element adds at least two, so the first 151
    elements of a page are all it needs.
    """
    t = strip(F.coalesce("text", F.lit("")))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    facts = elements.groupBy(*PAGE).agg(
        F.bool_or(F.col("type").isin(lx.HEADING_TAGS)).alias("headed"), F.count(F.lit(1)).alias("n"),
        F.avg(words).alias("mean_words"), F.avg((words <= 3).cast("int")).alias("short"))
    pick = facts.filter(~F.col("headed") & (F.col("n") >= 5) & (F.col("mean_words") < 4) & (F.col("short") >= 0.7)).select(*PAGE, "n")
    shown = first_n(elements.select(*PAGE, "pos", t.alias("t")).filter(F.col("t") != "").join(pick, PAGE, "left_semi"), PAGE, ["pos"], 151)
    labels = shown.groupBy(*PAGE).agg(left(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]), " "), 300).alias("labels"))
    alt = F.coalesce(F.concat(F.lit("Scanned graphical page containing the following text labels: "), "labels"),
                     F.lit("Scanned graphical page (map, diagram, or technical drawing)"))
    return pick.join(labels, PAGE, "left").select(*PAGE, "n", F.lit("Figure").alias("tag"), alt.alias("alt"))


def text_previews(nodes: DataFrame, width: int | None = 60, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Own text or alt, else that of the first descendant that has one; ``width`` None shows all.

    In pre-order that descendant is the next node with a text, provided no node up to it is as
    high as the asking one. Cutting the order after every node with a text leaves runs in which
    both are one look ahead, whatever the depth of the tree.
    """
    def filled(col: Column) -> Column:
        return F.when(~blank(col), strip(col))
    own = F.when(F.coalesce("text", F.lit("")) != "", filled(F.col("text"))).otherwise(filled(F.col("alt")))
    base = nodes.select("doc_id", "node_id", "depth", "ord", (own if width is None else left(own, width)).alias("own"))
    has = F.col("own").isNotNull().cast("long")
    runs = scan.running_sum(scan.with_chunk(base, "ord", chunk_rows), ["doc_id"], ["ord"], has, "_texts")
    runs = runs.withColumn("_run", F.col("_texts") - has)
    ahead = Window.partitionBy("doc_id", "_run").orderBy(F.col("ord").desc())
    later = ahead.rowsBetween(Window.unboundedPreceding, -1)
    found = runs.withColumns({"_next": F.first("own").over(later), "_least": F.min("depth").over(later)})
    below = F.when(F.col("_least") > F.col("depth"), F.col("_next"))
    return found.select("doc_id", "node_id", "ord", F.coalesce("own", below, F.lit("")).alias("preview"))


def figure_numbers(nodes: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Figures numbered in document order."""
    figures = scan.with_chunk(nodes.filter(F.col("tag") == "Figure").select("doc_id", "node_id", "ord", "alt"), "ord", chunk_rows)
    return scan.rank_in_order(figures, ["doc_id"], ["ord"], "figure_no").drop("_chunk")


def duplicate_ids(nodes: DataFrame, id_col: str) -> DataFrame:
    """Elements whose id an earlier element of the document already has."""
    first = nodes.groupBy("doc_id", id_col).agg(F.min("ord").alias("first_ord"))
    return nodes.join(first, ["doc_id", id_col]).filter(F.col("ord") > F.col("first_ord")).select("doc_id", "node_id", id_col, "first_ord")
