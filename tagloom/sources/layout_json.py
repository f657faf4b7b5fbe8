"""Layout JSON and stored manifests as flat nodes.

A tree of any shape has no fixed struct type, so a walk over Arrow batches takes whole documents apart
and appends their nodes, in pre-order, to columns; everything after that is expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagloom import lexicon as lx

NODE_ROW = (
    "node_id string, parent_id string, depth int, ord long, type string, own_tag string, level string, page int, "
    "x0 double, y0 double, x1 double, y1 double, row int, col int, row_span int, col_span int, font_size double, "
    "text string, alt string, decorative boolean"
)
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_FIELDS = [(name, _ARROW[kind]) for name, kind in (field.split() for field in NODE_ROW.split(", "))]
#: Nodes to a batch that goes back; a document may fill several.
_BATCH_NODES = 1 << 15


def _first(element: dict, *names: str):
    for name in names:
        if element.get(name) is not None:
            return element[name]
    return None


def _number(value, kind):
    """A number of the given kind, null for anything that is none."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    try:
        number = kind(float(value))
        return number if abs(number) < 2 ** 31 or kind is float else None
    except (ValueError, OverflowError):
        return None


def _string(value):
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _children(element, *names: str) -> list[dict]:
    found = _first(element, *names) if isinstance(element, dict) else None
    return [e for e in found if isinstance(e, dict)] if isinstance(found, list) else []


def walk(text: str | None) -> Iterator[tuple]:
    """The nodes of one JSON document in pre-order; keys are accepted under several names.

    Values of an unexpected kind become null, children that are no objects are skipped, a
    document that is no object has no nodes. Any depth is walked.
    """
    try:
        root = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return
    count = 0
    stack = [(e, None, 0) for e in reversed(_children(root, "kids", "nodes"))]
    while stack:
        element, parent, depth = stack.pop()
        count += 1
        node_id = element.get("id") if isinstance(element.get("id"), str) else f"n{count}"
        box = _first(element, "bounding box", "bbox")
        box = [_number(v, float) for v in box] if isinstance(box, list) and len(box) == 4 else [None] * 4
        kind = element.get("type")
        kind = kind.lower() if isinstance(kind, str) else ""
        decorative = element.get("decorative")
        yield (node_id, parent, depth, count - 1, kind or None,
               _string(_first(element, "pdfua_tag", "tag")), _string(_first(element, "heading level")), _number(_first(element, "page number", "page"), int) or 1, *box,
               _number(_first(element, "row number", "row"), int), _number(_first(element, "column number", "col"), int),
               _number(_first(element, "row span", "rowSpan"), int), _number(_first(element, "column span", "colSpan"), int),
               _number(_first(element, "font size"), float), _string(_first(element, "content", "text")), _string(element.get("alt")),
               decorative if isinstance(decorative, bool) else None)
        children = _children(element, "rows", "cells", "kids", "children")
        if kind == "table" and isinstance(element.get("rows"), list):
            children = [{**row, "type": "table row"} for row in children]
        stack.extend((child, node_id, depth + 1) for child in reversed(children))


def _walk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, json) to batches of nodes, column by column."""
    for batch in batches:
        ids, owners, rows = batch.column(0), [], []

        def nodes() -> pa.RecordBatch:
            columns = [pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), _FIELDS)]
            out = pa.RecordBatch.from_arrays([ids.take(pa.array(owners)), *columns], ["doc_id", *(name for name, _ in _FIELDS)])
            owners.clear()
            rows.clear()
            return out

        for at, text in enumerate(batch.column(1).to_pylist()):
            for node in walk(text):
                owners.append(at)
                rows.append(node)
                if len(rows) == _BATCH_NODES:
                    yield nodes()
        if rows:
            yield nodes()


def usable(text: Column) -> Column:
    """Whether a text is JSON with an object at its root."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def tag_of(kind: Column, own: Column, level: Column) -> Column:
    """Heading level clamped to 1..6 (a bad one is 1), else the given tag, else by type, else P."""
    number = F.coalesce(level.try_cast("int"), F.lit(1))
    heading = F.concat(F.lit("H"), F.greatest(F.lit(1), F.least(F.lit(6), number)))
    by_type = F.try_element_at(F.create_map(*[F.lit(v) for pair in lx.TYPE_TAGS.items() for v in pair]), kind)
    return F.when(kind == "heading", heading).when(kind == "table row", F.lit("TR")).otherwise(
        F.coalesce(F.when(own != "", own), by_type, F.lit("P")))


def flatten(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """Nodes of every document of a (doc_id, json) table, with tags and defaults resolved."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", json_col).mapInArrow(_walk_batches, f"doc_id {kind}, {NODE_ROW}")
    tag = tag_of(F.col("type"), F.col("own_tag"), F.col("level"))
    figure, cell = F.col("tag") == "Figure", F.col("type") == "table cell"
    return rows.withColumn("tag", tag).select(
        "doc_id", "node_id", "parent_id", "depth", "ord", "tag", "page", "x0", "y0", "x1", "y1", "row", "col",
        F.when(cell, F.coalesce("row_span", F.lit(1))).alias("row_span"), F.when(cell, F.coalesce("col_span", F.lit(1))).alias("col_span"),
        F.when(cell, F.lit(False)).alias("header"), "text", "alt",
        F.when(figure, F.coalesce("decorative", F.lit(False))).alias("decorative"), "font_size")


def split_rejects(documents: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """Parsable documents, and a rejects table for the others: a bad file never stops a batch."""
    ok = usable(F.col(json_col))
    good = documents.filter(ok)
    bad = documents.filter(~ok).select("doc_id", F.lit("invalid_json").alias("error"), F.octet_length(json_col).cast("long").alias("bytes"))
    return good, bad


def batch_results(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """One line per input: done or the reason it was set aside."""
    ok = usable(F.col(json_col))
    return documents.select("doc_id", ok.alias("ok"), F.when(~ok, F.lit("invalid_json")).alias("error"))


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per document; the file name is the document's."""
    return spark.read.option("wholetext", True).text(path).select(
        F.xxhash64(F.input_file_name()).alias("doc_id"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"),
        F.col("value").alias("json"))


def suggested_titles(documents: DataFrame, nodes: DataFrame, json_col: str = "json") -> DataFrame:
    """The element flagged as the document title, else the first H1 with text."""
    flagged = F.expr(
        f"try_element_at(filter(from_json({json_col}, 'kids array<struct<type: string, level: string, content: string>>').kids, "
        "e -> e.type = 'heading' AND lower(e.level) = 'doctitle'), 1).content")
    text = F.trim(F.coalesce("text", F.lit("")))
    h1 = nodes.filter((F.col("tag") == "H1") & (text != "")).groupBy("doc_id").agg(F.min_by(text, "ord").alias("h1"))
    return documents.select("doc_id", flagged.alias("flagged")).join(h1, "doc_id", "left").select(
        "doc_id", F.coalesce("flagged", "h1").alias("suggested_title"))
