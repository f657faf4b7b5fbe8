"""Table schemas. Boxes are four flat double columns (x0, y0, x1, y1), origin
bottom-left unless a table says otherwise, so scans can prune and compare them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BOX = "x0 double, y0 double, x1 double, y1 double"

DOCS = (
    "doc_id long, filename string, title string, suggested_title string, author string, "
    "subject string, lang string, version string, creation_date string, page_count int, "
    "marked boolean, display_title boolean, has_struct boolean, encrypted boolean, "
    "allow_access boolean, allow_extract boolean, has_xfa boolean"
)
PAGES = "doc_id long, page int, width double, height double"
NODES = (
    "doc_id long, node_id string, parent_id string, depth int, ord long, tag string, page int, "
    f"{BOX}, text string, alt string, decorative boolean, artifact boolean, "
    "font_size double, language string, field_name string"
)
CELLS = (
    "doc_id long, table_id long, row int, col int, cell_id long, row_span int, col_span int, "
    "tag string, text string, scope string, headers string"
)
SPANS = (
    "doc_id long, page int, block long, line int, span int, text string, size double, color int, "
    f"bg int, flags int, char_spacing double, {BOX}"
)
LINKS = f"doc_id long, page int, link_id long, uri string, text string, contents string, {BOX}"
FIELDS = f"doc_id long, page int, field_id long, T string, TU string, FT string, Ff int, parent_id long, {BOX}"
ANNOTS = (
    "doc_id long, page int, annot_id long, subtype string, F int, contents string, author string, "
    f"uri string, dest string, stroke int, bg int, {BOX}"
)
FONTS = "doc_id long, page int, font_name string, subtype string, embedded boolean, to_unicode boolean"
LAYERS = "doc_id long, name string, off_default boolean, print_state string"
RULES = (
    "doc_id long, specification string, clause string, test_number int, status string, "
    "description string, passed_checks long, failed_checks long"
)

FINDING_COLUMNS = (
    "doc_id", "check", "type", "severity", "wcag", "page", "ord", "text", "detail", "metric", "required",
)
_FINDING_TYPES = {
    "doc_id": "long", "check": "string", "type": "string", "severity": "string", "wcag": "string",
    "page": "int", "ord": "long", "text": "string", "detail": "string", "metric": "double",
    "required": "double",
}


def as_findings(df: DataFrame, check: str, wcag: str, **columns: Column | str) -> DataFrame:
    """Project any check result onto the one finding row.

    ``columns`` maps finding column -> expression or existing column name; columns
    not given are null.
    """
    given = {"check": F.lit(check), "wcag": F.lit(wcag), "doc_id": F.col("doc_id")}
    for name, value in columns.items():
        given[name] = F.col(value) if isinstance(value, str) else value
    return df.select(*[
        given.get(name, F.lit(None)).cast(_FINDING_TYPES[name]).alias(name) for name in FINDING_COLUMNS
    ])
