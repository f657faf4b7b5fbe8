"""Table structure: header proposals, scopes, grids, issues, rectangular normalisation.

Input cells: doc_id, table_id, row, col, cell_id, row_span, col_span, tag, text, scope,
headers; cells of a row follow (col, cell_id). Row and table facts come from partial
aggregates, never from collecting a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tagloom.functions.text import left, strip
from tagloom.operators import scan
from tagloom.operators.contrast import first_n

TABLE = ["doc_id", "table_id"]
ROW = [*TABLE, "row"]


def _span(name: str):
    return F.greatest(F.coalesce(F.col(name), F.lit(1)), F.lit(1))


def grid_slots(cells: DataFrame) -> DataFrame:
    """Every grid position with the cell that owns it: the first one that covers it."""
    out = cells.select(
        *TABLE, F.explode(F.sequence("row", F.col("row") + _span("row_span") - 1)).alias("r"), "row", "col", "cell_id", "col_span")
    out = out.select(*TABLE, "r", F.explode(F.sequence("col", F.col("col") + _span("col_span") - 1)).alias("c"), "row", "col", "cell_id")
    first = F.min(F.struct("row", "col", "cell_id")).alias("owner")
    return out.groupBy(*TABLE, "r", "c").agg(first).select(
        *TABLE, "r", "c", F.col("owner.cell_id").alias("cell_id"), F.col("owner.row").alias("row"), F.col("owner.col").alias("col"))


def table_summary(cells: DataFrame, slots: DataFrame, row_headers: bool = False) -> DataFrame:
    """Size, proposed headers, spans, and uncovered positions of each table."""
    shape = cells.groupBy(*TABLE).agg(
        F.max(F.col("row") + _span("row_span") - 1).alias("n_rows"), F.max(F.col("col") + _span("col_span") - 1).alias("n_cols"),
        F.bool_or((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("has_spans"))
    covered = slots.groupBy(*TABLE).agg(
        F.count(F.lit(1)).alias("covered"), F.count_if(F.col("r") == 1).alias("top"), F.count_if(F.col("c") == 1).alias("side"))
    side = F.when(F.col("n_cols") > 1, F.col("side")).otherwise(0) if row_headers else F.lit(0)
    by_side = (F.col("n_cols") > 1) if row_headers else F.lit(False)
    return shape.join(covered, TABLE).select(
        *TABLE, "n_rows", "n_cols", (F.col("top") + side).alias("headers_proposed"),
        (F.col("has_spans") | by_side).alias("complex"),
        (F.col("n_rows").cast("long") * F.col("n_cols") - F.col("covered")).alias("uncovered"))


def _edge_slots(cells: DataFrame, along: str, span: str, edge: str) -> DataFrame:
    """Owners of the first row's (or first column's) positions. Spans only run down and
    right, so only cells that start on that edge can cover it."""
    out = cells.filter(F.col(edge) == 1).select(
        *TABLE, F.explode(F.sequence(F.col(along), F.col(along) + _span(span) - 1)).alias("pos"), "row", "col", "cell_id")
    return out.groupBy(*TABLE, "pos").agg(F.min(F.struct("row", "col", "cell_id")).alias("o")).select(
        *TABLE, "pos", F.col("o.cell_id").alias("cell_id"), F.col("o.row").alias("row"), F.col("o.col").alias("col"))


def header_ids(cells: DataFrame, row_headers: bool = False) -> DataFrame:
    """Header flags and scopes by position, and for data cells of complex tables the ids
    of the headers above (over the column span) and to the left (over the row span)."""
    facts = cells.groupBy(*TABLE).agg(
        F.max(F.col("col") + _span("col_span") - 1).alias("n_cols"),
        F.bool_or((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("has_spans"))
    wide = F.col("n_cols") > 1 if row_headers else F.lit(False)
    facts = facts.select(*TABLE, "n_cols", (F.col("has_spans") | wide).alias("complex"))
    top = _edge_slots(cells, "col", "col_span", "row")
    marks = top.select(*TABLE, "cell_id", F.lit(True).alias("top"), F.lit(False).alias("side"))
    if row_headers:
        side = _edge_slots(cells, "row", "row_span", "col")
        marks = marks.unionByName(side.select(*TABLE, "cell_id", F.lit(False).alias("top"), F.lit(True).alias("side")))
    marks = marks.groupBy(*TABLE, "cell_id").agg(F.bool_or("top").alias("top"), F.bool_or("side").alias("side"))
    flagged = cells.join(facts, TABLE).join(marks, [*TABLE, "cell_id"], "left")
    is_top = F.coalesce("top", F.lit(False))
    is_side = F.coalesce("side", F.lit(False)) & (F.col("n_cols") > 1)
    hid = F.concat(F.lit("t"), "table_id", F.lit("r"), "row", F.lit("c"), "col")
    flagged = flagged.select(
        *TABLE, "cell_id", "row", "col", "row_span", "col_span", "n_cols", "complex", (is_top | is_side).alias("header"),
        F.when(is_top | is_side, F.lit("TH")).otherwise(F.col("tag")).alias("tag"),
        F.when(is_top & is_side, "Both").when(is_top, "Column").when(is_side, "Row").alias("scope"),
        F.when((is_top | is_side) & F.col("complex"), hid).alias("header_id"))

    data = flagged.filter(~F.col("header") & F.col("complex"))
    over = data.select(*TABLE, "cell_id", F.lit(0).alias("k"), F.explode(
        F.sequence("col", F.col("col") + _span("col_span") - 1)).alias("pos")).join(
        top.select(*TABLE, "pos", hid.alias("hid")), [*TABLE, "pos"])
    if row_headers:
        left_of = data.filter(F.col("n_cols") > 1).select(*TABLE, "cell_id", F.lit(1).alias("k"), F.explode(
            F.sequence("row", F.col("row") + _span("row_span") - 1)).alias("pos")).join(
            side.select(*TABLE, "pos", hid.alias("hid")), [*TABLE, "pos"])
        over = over.unionByName(left_of)
    # a cell has few headers (its spans), so its list is small whatever the table's size
    first = F.array_sort(F.collect_list(F.struct("k", "pos", "hid")))
    lists = over.groupBy(*TABLE, "cell_id").agg(F.array_join(F.array_distinct(F.transform(first, lambda s: s["hid"])), " ").alias("headers"))
    return flagged.join(lists, [*TABLE, "cell_id"], "left").select(
        *TABLE, "cell_id", "row", "col", "tag", "scope", "header_id", "headers")


def row_facts(cells: DataFrame) -> DataFrame:
    """Per row: first cell, header and digit flags, cell count."""
    digit = F.coalesce(F.col("text"), F.lit("")).rlike(r"^\s*\p{Nd}")
    return cells.groupBy(*ROW).agg(
        F.min(F.struct("col", "cell_id", "tag")).alias("head"), F.bool_or(F.col("tag") == "TH").alias("any_th"),
        F.bool_or(digit).alias("any_digit"), F.count(F.lit(1)).alias("n_cells"))


def promote_first_rows(cells: DataFrame) -> DataFrame:
    """TDs of a headerless first row become TH, unless a cell there starts with a digit."""
    first = row_facts(cells).groupBy(*TABLE).agg(F.min(F.struct("row", "any_th", "any_digit")).alias("f"))
    ok = first.filter(~F.col("f.any_th") & ~F.col("f.any_digit")).select(*TABLE, F.col("f.row").alias("row"))
    return cells.filter(F.col("tag") == "TD").join(ok, ROW, "left_semi").select(
        *TABLE, "row", "col", "cell_id", F.lit("TH").alias("tag"), F.lit("Column").alias("scope"))


def assign_scope(cells: DataFrame, only_missing: bool = False) -> DataFrame:
    """Scope of every TH from where headers stand in its table.

    ``only_missing`` leaves existing scopes alone and uses the plain positional rule:
    corner Both, first row Column, anything else Row.
    """
    rows = row_facts(cells)
    first = rows.groupBy(*TABLE).agg(F.min(F.struct("row", "any_th")).alias("f"))
    rows = rows.join(first.select(*TABLE, F.col("f.row").alias("first_row"), F.col("f.any_th").alias("col_h")), TABLE)
    side = rows.groupBy(*TABLE).agg(F.bool_or(
        (F.col("row") > F.col("first_row")) & (F.col("head.tag") == "TH")).alias("row_h"))
    facts = rows.join(side, TABLE).select(*ROW, "first_row", "col_h", "row_h", F.col("head.cell_id").alias("head_id"),
                                          F.col("head.col").alias("head_col"))
    th = cells.filter(F.col("tag") == "TH")
    if only_missing:
        th = th.filter(F.coalesce("scope", F.lit("")) == "")
    at = th.select(*ROW, "col", "cell_id").join(facts, ROW)
    top = F.col("row") == F.col("first_row")
    lead = (F.col("cell_id") == F.col("head_id")) & (F.col("col") == F.col("head_col"))
    if only_missing:
        scope = F.when(top & lead, "Both").when(top, "Column").otherwise("Row")
    else:
        scope = (F.when(top & lead & F.col("col_h") & F.col("row_h"), "Both").when(top & F.col("col_h"), "Column")
                 .when(lead & F.col("row_h"), "Row").otherwise("Column"))
    return at.select(*TABLE, "row", "col", "cell_id", scope.alias("scope"))


def table_issues(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Missing headers, scopes, header references and captions, one row per problem."""
    rows = row_facts(cells)
    counts = cells.groupBy(*TABLE).agg(
        F.count_if((F.col("tag") == "TH") & (F.coalesce("scope", F.lit("")) == "")).alias("no_scope"),
        F.count_if((F.col("tag") == "TD") & (F.coalesce("headers", F.lit("")) == "")).alias("no_headers"),
        F.bool_or(F.col("tag") == "TH").alias("any_th"))
    shape = rows.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_cells").alias("n_cols"))
    top_two = first_n(rows, TABLE, ["row"], 2).groupBy(*TABLE).agg(
        F.min(F.struct("row", "any_th")).alias("a"), F.max(F.struct("row", F.col("head.tag").alias("tag"))).alias("b"))
    facts = counts.join(shape, TABLE).join(top_two, TABLE).join(tables.select(*TABLE, "page", "has_caption"), TABLE, "left")
    big = (F.col("n_rows") >= 2) & (F.col("n_cols") >= 2)
    is_complex = F.col("a.any_th") & (F.col("b.row") > F.col("a.row")) & (F.col("b.tag") == "TH")

    def issue(when, kind, count):
        return F.when(when, F.struct(F.lit(kind).alias("type"), count.cast("long").alias("count")))

    none = F.lit(None)
    return facts.select(*TABLE, "page", F.inline(F.array_compact(F.array(
        issue(~F.col("any_th") & big, "missing_headers", none),
        issue(F.col("no_scope") > 0, "th_missing_scope", F.col("no_scope")),
        issue(is_complex & (F.col("no_headers") > 0), "complex_table_missing_headers_attr", F.col("no_headers")),
        issue(~F.coalesce("has_caption", F.lit(False)) & big, "missing_caption", none)))))


def apply_decisions(cells: DataFrame, decisions: DataFrame, layout_tables: DataFrame) -> DataFrame:
    """Reviewed header flags and scopes over the cells; layout tables become artifacts."""
    out = cells.join(decisions, [*ROW, "col"], "left").join(layout_tables.select(*TABLE, F.lit(True).alias("_layout")), TABLE, "left")
    layout = F.coalesce("_layout", F.lit(False))
    header = F.coalesce("is_header", F.lit(False)) & ~layout
    return out.select(
        *TABLE, "row", "col", "cell_id", F.when(header, F.lit("TH")).otherwise(F.col("tag")).alias("tag"),
        F.when(~layout & F.col("new_scope").isNotNull(), F.col("new_scope")).otherwise(F.col("scope")).alias("scope"),
        F.when(layout, "Artifact").otherwise("Table").alias("table_tag"))


def table_snippets(cells: DataFrame, tables: DataFrame, rows: int = 3, width: int = 40) -> DataFrame:
    """First rows with text of tables that have at least three rows and no summary."""
    open_tables = tables.filter(F.coalesce("summary", F.lit("")) == "").select(*TABLE)
    text = left(strip(F.coalesce("text", F.lit(""))), width)
    body = cells.join(open_tables, TABLE, "left_semi").select(*ROW, "col", "cell_id", text.alias("t"))
    per_row = body.groupBy(*ROW).agg(F.bool_or(F.col("t") != "").alias("has_text"))
    enough = per_row.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rows).select(*TABLE)
    head = first_n(per_row.filter("has_text").join(enough, TABLE, "left_semi"), TABLE, ["row"], rows).select(*ROW)
    lines = body.filter(F.col("t") != "").join(head, ROW, "left_semi").groupBy(*ROW).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("col", "cell_id", "t"))), lambda s: s["t"]), " | ").alias("line"))
    return lines.groupBy(*TABLE).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("row", "line"))), lambda s: s["line"]), "\n").alias("snippet"))


# --- normalisation -----------------------------------------------------------

_PLACED = "doc_id long, table_id long, row int, covered int, reach int, first_col int"


def _place_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Place cells of sorted rows left to right around columns held by earlier row spans.

    Keeps only the held columns of the current segment between rows and batches, so a
    segment of any length streams through.
    """
    segment = None
    held: dict[int, int] = {}
    current: tuple | None = None
    covered: set[int] = set()
    col = first = 0
    done: list[tuple] = []

    def close() -> None:
        done.append((*current, len(covered), max(covered) + 1 if covered else 0, first))

    for batch in batches:
        for doc, table, seg, row, row_span, col_span in zip(
                batch["doc_id"], batch["table_id"], batch["segment"], batch["row"], batch["row_span"], batch["col_span"]):
            if (doc, table, row) != current:
                if current is not None:
                    close()
                    passed = row - current[2]
                    held = {c: n - passed for c, n in held.items() if n > passed}
                if (doc, table, seg) != segment:
                    segment, held = (doc, table, seg), {}
                current, covered, col, first = (doc, table, row), set(held), 0, -1
            while col in covered:
                col += 1
            if first < 0:
                first = col
            for c in range(col, col + col_span):
                covered.add(c)
                if row_span > 1:
                    held[c] = row_span
            col += col_span
        if done:
            yield pd.DataFrame(done, columns=["doc_id", "table_id", "row", "covered", "reach", "first_col"])
            done = []
    if current is not None:
        close()
        yield pd.DataFrame(done, columns=["doc_id", "table_id", "row", "covered", "reach", "first_col"])


def row_segments(cells: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Rows cut wherever no row span crosses; ``segment`` is the first row of a piece.

    Rows on either side of a cut do not influence each other, so a table is placed in
    as many independent pieces as its spans allow. A row opens a piece when every
    earlier span has ended; spans of earlier chunks only raise that threshold, so the
    latest opening seen inside the chunk counts if it lies beyond them.
    """
    rows = cells.groupBy(*ROW).agg(F.max("row_span").alias("down"), F.sum("col_span").cast("int").alias("across"))
    rows = scan.with_chunk(rows.withColumn("_end", F.col("row") + F.col("down") - 1), "row", chunk_rows)
    opens = F.when(F.col("_seen").isNull() | (F.col("_seen") < F.col("row")), F.col("row"))
    beyond = F.col("_held").isNull() | (F.col("_open") > F.col("_held"))
    rows = scan.chunk_scan(
        rows, TABLE, ["row"],
        local=[{"_seen": lambda w: F.max("_end").over(scan.before(w))},
               {"_start": lambda w: F.max(opens).over(scan.running(w))}],
        totals={"_reach": F.max("_end"), "_open": F.max(opens)},
        carry=[{"_held": lambda w: F.max("_reach").over(w)},
               {"_t_open": lambda w: F.when(beyond, F.col("_open"))},
               {"_prior": lambda w: F.last("_t_open", ignorenulls=True).over(w)}],
        totals_of_local=True,
    )
    inside = F.col("_held").isNull() | (F.col("_start") > F.col("_held"))
    return rows.select(*ROW, "down", "across", F.when(inside, F.col("_start")).otherwise(F.col("_prior")).alias("segment"))


def normalize_tables(cells: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Columns each row covers, the table's width, cells to pad, scopes to add.

    Rows that no row span touches are a sum; only the others are placed cell by cell,
    streamed in row order per segment.
    """
    known = F.col("tag").isin("TD", "TH")
    cells = cells.withColumns({
        "row_span": F.when(known, _span("row_span")).otherwise(1), "col_span": F.when(known, _span("col_span")).otherwise(1)})
    rows = row_segments(cells, chunk_rows)
    alone = (F.col("segment") == F.col("row")) & (F.col("down") == 1)
    plain = rows.filter(alone).select(
        *ROW, F.col("across").alias("covered"), F.col("across").alias("reach"), F.lit(0).alias("first_col"))
    spanned = cells.join(rows.filter(~alone).select(*ROW, "segment"), ROW).select(
        *TABLE, "segment", "row", "col", "cell_id", "row_span", "col_span")
    placed = spanned.repartition(*TABLE, "segment").sortWithinPartitions(*TABLE, "segment", "row", "col", "cell_id").mapInPandas(
        _place_rows, _PLACED)
    rows_placed = plain.unionByName(placed)
    width = rows_placed.groupBy(*TABLE).agg(F.max("reach").alias("width"), F.min("row").alias("first_row"))
    th = cells.groupBy(*ROW).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(~known).alias("wrapped"),
        F.count_if((F.col("tag") == "TH") & F.col("scope").isNull()).alias("scoped"),
        F.min(F.struct("col", "cell_id", "tag", "scope")).alias("head"))
    lead = (F.col("head.tag") == "TH") & F.col("head.scope").isNull() & (F.col("first_col") == 0) & (F.col("row") > F.col("first_row"))
    return rows_placed.join(width, TABLE).join(th, ROW).select(
        *ROW, "n_cells", "covered", "width", (F.col("width") - F.col("covered")).alias("padding"), "wrapped", "scoped",
        lead.cast("int").alias("row_scopes"))
