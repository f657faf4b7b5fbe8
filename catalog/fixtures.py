"""Fixture views over the driver tables (see FIXTURES.md): integer arithmetic, CASE
and phrase lists only, the same rows in Spark and in DuckDB. Whole tables, no filters
except where a row's absence is the point (the structure side of marked content).
"""

from __future__ import annotations

from catalog.dialect import pick

SPAN_TEXTS = [
    "Annual accessibility report", "x", "", "Page 12 of 40", "CONFIDENTIAL draft", "1. See the appendix",
    "2", "* provisional figures", "Section overview", "Do not copy", "a) second marker", "12",
    "Contact the service desk", "3", "†", "Total revenue 2023",
]
LINK_TEXTS = [
    "Click here", "here", "Read more.", "Annual report 2023", "https://example.org/a/b", "www.example.org/x",
    "5", "42", "--", "", "go", "Download", "this page", "More information;", "find out more about us", "a",
    "Terms of service", "info", "This link.", "for details see the annex",
]
ALT_TEXTS = [
    None, "", "  ", "image", "Figure 3", "img_001", "IMG1234", "Bar chart of sales by region", "Logo!",
    "photo 12", "page 4.", "p12345", "Slide 9", "Graph of revenue by year", "alt text", "Map of the campus",
]
PHRASES = [
    "See the chart on the left side of the page", "Figure 1: results", "Fig. 2 comparison of means",
    "Table 3: summary", "Press the round button to continue", "Click the red button to submit the form",
    "Select the larger icon at the bottom of the screen", "Refer to figure 7 for the full process",
    "Rotate the page to landscape before printing", "Listen for the beep before you answer",
    "x = y + 2", "∑ a_i ≤ ∫ f", "(2.3)", "\\frac{a}{b} + c", "a^2 + b^2 over many plain words here",
    "• first point of the list", "1. numbered point", "Это предложение написано по русски",
    "这是一个用中文写的句子，用来检查语言标记是否存在", "هذه جملة مكتوبة باللغة العربية",
    "한국어로 작성된 문장입니다 확인하세요", "   ", "", "The NASA team met the EU and WHO groups",
    "U.S. rules, e.g. those of the E.U., apply to NASA", "Ελληνικά γράμματα για δοκιμή", "IEEE and NASA and WHO/EU",
]
TAGS = [
    "H1", "P", "P", "H3", "Figure", "P", "LI", "P", "Caption", "H2", "P", "P", "Figure", "LI", "P", "H4",
    "Span", "P", "Form", "Lbl", "CustomNote", "Footnote", "Link",
]
CLAUSES = [
    ("7.1", 3), ("7.1", 5), ("7.1", 1), ("7.2", 1), ("7.2", 2), ("7.3", 1), ("7.3", 3), ("7.5", 1),
    ("7.18.1", 1), ("7.21", 4), ("6.4", 2), ("7.4", 1), ("9.9", 1), ("7.19", 1),
]
SUBTYPES = [
    "Text", "Highlight", "Underline", "Squiggly", "StrikeOut", "FreeText", "Stamp", "Ink", "Square", "Circle",
    "Line", "Polygon", "PolyLine", "FileAttachment", "Popup", "Widget", "Link", "Caret", "Sound",
]
URIS = [
    "https://www.example.org/guides/pdf-accessibility.html", "https://example.org/docs/index.html",
    "http://data.example.net/", "https://example.com/wcag_2_2/understanding-ada.pdf", "", None,
    "https://www.example.org/info", "https://example.org/reports/2023/annual-report", "mailto-free text",
]
FONT_NAMES = [
    "Helvetica", "Arial-BoldMT", "ABCDEF+Calibri", "Times New Roman", "Wingdings", "Courier-Bold",
    "CorporateSans", "Georgia,Italic", "Verdana", "GHIJKL+CorporateSans", "Symbol",
]
FIELD_NAMES = [
    "txt_firstName", "date_of_birth", "cb_agree_terms", "emailAddress", "ssn", "rb_group.one", "field-3",
    "btn_", "postalZip code", "tbCity", "dd_country", "applicant_id",
]
CELL_TEXTS = ["Criterion", "1.1.1", "Status", " 2024", "", "Level", "pass", "A longer cell text that goes past forty characters", "n/a"]
OPS = ["BDC", "Tj", "EMC", "re", "f", "BMC", "TJ", "EMC", "Do", "q", "EMC", "S"]


def _box(x0: str, y0: str, w: str, h: str) -> str:
    return (f"CAST({x0} AS DOUBLE) AS x0, CAST({y0} AS DOUBLE) AS y0, "
            f"CAST({x0} + {w} AS DOUBLE) AS x1, CAST({y0} + {h} AS DOUBLE) AS y1")


_Q = "CAST(l_quantity AS INT)"
# unique with the document and page; the quantity separates repeated (order, line, part, supplier) rows
_ID = "((l_orderkey * 1000000 + l_partkey) * 64 + CAST(l_quantity AS INT))"


def spans(d) -> str:
    return f"""SELECT l_suppkey AS doc_id, l_linenumber AS page, l_orderkey % 12 AS block,
  CAST(l_partkey % 3 AS INT) AS line, {_ID} AS span,
  {pick(d, SPAN_TEXTS, "l_partkey + l_orderkey")} AS text,
  CAST(CASE WHEN l_partkey % 5 = 0 THEN 5 ELSE 6 + {_Q} % 36 END AS DOUBLE) / 2e0 + 2e0 * (l_partkey % 8) AS size,
  CAST(CASE WHEN l_partkey % 37 = 0 THEN 16777215 ELSE (l_partkey * 7919 + l_suppkey * 104729) % 16777216 END AS INT) AS color,
  CAST(CASE WHEN l_suppkey % 3 = 0 THEN (l_partkey * 31337) % 16777216 ELSE 16777215 END AS INT) AS bg,
  CAST(16 * (l_partkey % 2) AS INT) AS flags,
  CAST(l_orderkey % 7 - 4 AS DOUBLE) / 4e0 AS char_spacing,
  {_box("20 + (l_orderkey % 9) * 50", "740 - (l_orderkey % 12) * 62 - (l_partkey % 3) * 16", f"10 + {_Q} * 11", "12")}
FROM {d.table("lineitem")}"""


def samples(d) -> str:
    """Four sampled background pixels per span, as packed colours in columns s0..s3."""
    return f"""SELECT doc_id, page, span, color, CASE WHEN page % 5 = 0 THEN NULL ELSE color END AS fg,
  CAST((color + 10) % 16777216 AS INT) AS s0, bg AS s1,
  CAST((color * 3 + 77) % 16777216 AS INT) AS s2, CAST(CASE WHEN page % 4 = 0 THEN color ELSE bg END AS INT) AS s3
FROM ({spans(d)}) s"""


def page_sizes(d) -> str:
    return f"""SELECT DISTINCT l_suppkey AS doc_id, l_linenumber AS page, 612e0 AS width,
  CAST(792 + 10 * (l_linenumber % 2) AS DOUBLE) AS height FROM {d.table("lineitem")}"""


def images(d) -> str:
    return f"""SELECT l_suppkey AS doc_id, l_linenumber AS page, {_ID} AS image_id,
  CAST(CASE WHEN l_partkey % 211 = 0 THEN 10 ELSE l_orderkey % 500 END AS DOUBLE) AS x,
  CAST(CASE WHEN l_partkey % 211 = 0 THEN 10 ELSE l_orderkey % 700 END AS DOUBLE) AS y,
  CAST(CASE WHEN l_partkey % 211 = 0 THEN 560 ELSE 5 + {_Q} % 20 END AS DOUBLE) AS w,
  CAST(CASE WHEN l_partkey % 211 = 0 THEN 700 ELSE 5 + l_partkey % 20 END AS DOUBLE) AS h
FROM {d.table("lineitem")}"""


def paths(d) -> str:
    return f"""SELECT l_suppkey AS doc_id, l_linenumber AS page, {_ID} AS path_id,
  CAST(l_orderkey % 500 AS DOUBLE) AS x, CAST(l_orderkey % 700 AS DOUBLE) AS y,
  CAST(CASE WHEN l_partkey % 9 = 0 THEN 590 ELSE {_Q} * 3 END AS DOUBLE) AS w,
  CAST(CASE WHEN l_partkey % 83 = 0 THEN 780 ELSE l_partkey % 40 END AS DOUBLE) AS h,
  CAST(CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 16711422
    ELSE (l_partkey * 7919 + l_orderkey * 31) % 16777216 END AS INT) AS color,
  CAST(CASE WHEN l_orderkey % 4 = 0 THEN (l_partkey * 31337) % 16777216 ELSE 16777215 END AS INT) AS bg,
  CAST({_Q} % 9 AS DOUBLE) / 2e0 AS width, l_orderkey % 3 = 0 AS closed, CAST(1 + l_partkey % 9 AS INT) AS items,
  l_orderkey % 2 = 0 AS filled
FROM {d.table("lineitem")}"""


def fills(d) -> str:
    return f"""SELECT l_suppkey AS doc_id, l_linenumber AS page, {_ID} AS fill_id,
  CAST(20 + (l_orderkey % 14) * 40 AS DOUBLE) AS x, CAST(700 - (l_partkey % 30) * 20 AS DOUBLE) AS y,
  CAST(2 + {_Q} AS DOUBLE) AS w, CAST(2 + l_partkey % 60 AS DOUBLE) AS h,
  {pick(d, ["rgb", "gray", "cmyk", "icc", "rgb"], "l_orderkey")} AS space,
  CAST(l_partkey % 21 AS DOUBLE) / 20e0 AS a, CAST(l_orderkey % 21 AS DOUBLE) / 20e0 AS b,
  CAST({_Q} % 21 AS DOUBLE) / 20e0 AS c, CAST(l_suppkey % 11 AS DOUBLE) / 10e0 AS d
FROM {d.table("lineitem")}"""


def annots(d) -> str:
    return f"""SELECT l_suppkey AS doc_id, l_linenumber AS page, {_ID} AS annot_id,
  {pick(d, SUBTYPES, "l_partkey + l_orderkey")} AS subtype, CAST(l_partkey % 4 AS INT) AS F,
  {pick(d, [None, "", "  ", "Reviewed note", None], "l_orderkey")} AS contents,
  {pick(d, [None, "A. Reader", "B. Editor"], "l_partkey")} AS author,
  {pick(d, URIS, "l_partkey + 2 * l_orderkey")} AS uri,
  {pick(d, [None, "page2", None], "l_orderkey")} AS dest,
  CAST(CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE (l_partkey * 7919 + l_orderkey) % 16777216 END AS INT) AS stroke,
  CAST(CASE WHEN l_partkey % 10 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN (l_partkey * 31337) % 16777216
    ELSE 16777215 END AS INT) AS bg,
  {_box("l_orderkey % 500", "l_orderkey % 700", f"{_Q} / 2e0 + 0.24e0", "(l_partkey % 50) * 0.75e0")}
FROM {d.table("lineitem")}"""


def links(d) -> str:
    return f"""SELECT l_suppkey AS doc_id, l_linenumber AS page, {_ID} AS link_id,
  {pick(d, URIS, "l_partkey")} AS uri, {pick(d, LINK_TEXTS, "l_partkey + l_orderkey")} AS text,
  {pick(d, [None, "", "Help centre", "here"], "l_orderkey")} AS contents,
  {_box("l_orderkey % 500", "l_orderkey % 700", _Q, "12")}
FROM {d.table("lineitem")}"""


def fields(d) -> str:
    return f"""SELECT {d.idiv("p_partkey", 4)} AS doc_id, CAST(1 + p_partkey % 4 AS INT) AS page, p_partkey AS field_id,
  CASE WHEN p_partkey % 3 = 0 THEN concat('txt_', replace(p_name, ' ', '_')) WHEN p_partkey % 17 = 1 THEN ''
    ELSE {pick(d, FIELD_NAMES, "p_size")} END AS T,
  {pick(d, [None, "", "First name", "Date of birth (required)", None], "p_partkey")} AS TU,
  {pick(d, ["Tx", "Btn", "Ch", "Sig", "Btn", None], "p_partkey")} AS FT,
  CAST(CASE WHEN p_partkey % 6 = 1 THEN 32768 WHEN p_partkey % 6 = 4 THEN 98304 ELSE 0 END + 2 * (p_size % 2) AS INT) AS Ff,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey - p_partkey % 4 END AS parent_id,
  {_box("140 + (p_partkey % 5) * 60", "80 + (p_partkey % 11) * 60", "80", "14")}
FROM {d.table("part")}"""


def fonts(d) -> str:
    return f"""SELECT l_suppkey AS doc_id, l_linenumber AS page, {pick(d, FONT_NAMES, "l_partkey + l_orderkey")} AS font_name,
  {pick(d, ["TrueType", "Type1", "Type0", "TrueType"], "l_partkey + l_orderkey")} AS subtype,
  l_partkey % 3 = 0 AS embedded, l_orderkey % 4 <> 0 AS to_unicode
FROM {d.table("lineitem")}"""


def layers(d) -> str:
    return f"""SELECT c_custkey % 997 AS doc_id, {pick(d, ["Base", "", "Notes", "  ", "Print marks"], "c_custkey")} AS name,
  c_nationkey % 3 = 0 AS off_default, {pick(d, [None, "OFF", "ON"], "c_nationkey")} AS print_state, c_custkey AS layer_id
FROM {d.table("customer")}"""


def docs(d) -> str:
    return f"""SELECT doc_id, concat('quarterly-report_', CAST(doc_id AS VARCHAR(20)), '.PDF') AS filename,
  {pick(d, [None, "Quarterly report", "", "  Budget 2024 ", "Untitled Document"], "doc_id")} AS title,
  {pick(d, [None, "Suggested title", " "], "doc_id")} AS suggested_title,
  {pick(d, ["Finance office", None, " "], "doc_id")} AS author, {pick(d, [None, "Budget"], "n_chars")} AS subject,
  CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN concat(upper(lang), '-XX') ELSE lang END AS lang,
  {pick(d, ["en", None, "fr-FR", ""], "n_chars")} AS manifest_lang,
  {pick(d, ["1.3", "1.4", "1.7", "2.0", "1.2"], "doc_id")} AS version,
  {pick(d, [None, "D:20240101"], "doc_id")} AS creation_date, CAST(1 + n_chars % 40 AS INT) AS page_count,
  doc_id % 3 <> 0 AS marked, doc_id % 4 <> 0 AS display_title, doc_id % 5 <> 0 AS has_struct, n_chars % 3 = 0 AS encrypted,
  n_chars % 2 = 0 AS allow_access, n_chars % 5 <> 0 AS allow_extract, n_chars % 11 = 0 AS has_xfa,
  doc_id % 7 <> 0 AS has_ua_id, n_chars, lang AS true_lang
FROM {d.table("documents")}"""


def lines(d) -> str:
    return f"""SELECT doc_id, lang, ord, line AS text FROM {d.explode_lines(d.table("documents"), "text")} e"""


def nodes(d) -> str:
    k = "(doc_id * 13 + ord * 7 + n)"
    phrase = pick(d, PHRASES, "doc_id + ord * 5")
    return f"""SELECT doc_id, concat('n', CAST(ord AS VARCHAR(20))) AS node_id,
  CASE WHEN ord % 10 = 0 THEN NULL WHEN ord % 10 < 5 THEN concat('n', CAST(ord - ord % 10 AS VARCHAR(20)))
    ELSE concat('n', CAST(ord - ord % 10 + 4 AS VARCHAR(20))) END AS parent_id,
  CAST(CASE WHEN ord % 10 = 0 THEN 0 WHEN ord % 10 < 5 THEN 1 ELSE 2 END AS INT) AS depth,
  ord, {pick(d, TAGS, k)} AS tag, CAST(1 + {d.idiv("ord", 3)} AS INT) AS page,
  {_box(f"20 + ({k} % 9) * 50", f"740 - ({k} % 12) * 62", "40 + n % 300", f"14 + ({k} % 3) * 20")},
  CASE WHEN {k} % 3 = 0 THEN {phrase} ELSE line END AS text,
  CASE WHEN {pick(d, TAGS, k)} IN ('Figure', 'Form') THEN {pick(d, ALT_TEXTS, "doc_id + ord * 3")} END AS alt,
  {k} % 19 = 0 AS decorative, {k} % 29 = 0 AS artifact,
  CAST(8 + (n * 7 + ord) % 12 AS DOUBLE) + CASE WHEN ord % 4 = 0 THEN 0.5e0 ELSE 0e0 END AS font_size,
  CASE WHEN {k} % 31 = 0 THEN 'fr' END AS language,
  CASE WHEN {pick(d, TAGS, k)} = 'Form' THEN {pick(d, FIELD_NAMES, "doc_id + ord")} END AS field_name,
  lang AS doc_lang
FROM (SELECT doc_id, lang, ord, line, CAST(length(line) AS BIGINT) AS n
      FROM {d.explode_lines(d.table("documents"), "text")} e0) e"""


def headings(d) -> str:
    return f"""SELECT doc_id, ord, CAST(1 + (length(line) + ord) % 6 AS INT) AS level,
  concat('H', CAST(1 + (length(line) + ord) % 6 AS VARCHAR(2))) AS tag, CAST(1 + {d.idiv("ord", 3)} AS INT) AS page,
  line AS text, CAST(700 - length(line) % 600 AS DOUBLE) AS y1
FROM {d.explode_lines(d.table("documents"), "text")} e"""


def toc_nodes(d) -> str:
    run = f"(doc_id + {d.idiv('ord', 5)}) % 3"
    return f"""SELECT doc_id, concat('n', CAST(ord AS VARCHAR(20))) AS node_id, ord,
  CASE WHEN {run} = 0 AND ord % 5 = 0 THEN 'H2' ELSE 'P' END AS tag, CAST(1 + {d.idiv("ord", 12)} AS INT) AS page,
  CASE WHEN {run} = 0 AND ord % 5 = 0 AND doc_id % 2 = 0 THEN 'Table of Contents'
       WHEN {run} = 0 AND (doc_id + ord) % 4 = 3 THEN '  '
       WHEN {run} = 0 THEN concat('Chapter ', CAST(ord AS VARCHAR(20)), ' ..... ', CAST(length(line) % 900 AS VARCHAR(20)))
       ELSE line END AS text
FROM {d.explode_lines(d.table("documents"), "text")} e"""


def list_items(d) -> str:
    return f"""SELECT doc_id, concat('L', CAST({d.idiv("ord", 8)} AS VARCHAR(20))) AS list_id,
  concat('n', CAST(ord AS VARCHAR(20))) AS node_id, ord,
  {pick(d, ["LI", "P", "LI", "LI", "P"], "doc_id + ord")} AS tag,
  CAST(CASE WHEN (doc_id * 3 + ord * length(line)) % 13 = 0 THEN NULL
    ELSE 50 + 9 * ((doc_id + ord * 5 + length(line)) % 4) END AS DOUBLE) AS x0,
  CASE WHEN (ord + length(line)) % 3 = 0 THEN concat({pick(d, ["• ", "1. ", "a) ", "iv. ", "- "], "ord")}, line) ELSE line END AS text
FROM {d.explode_lines(d.table("documents"), "text")} e"""


def list_tree(d) -> str:
    """The lists of ``list_items`` as nodes: every list, its items, and a body in every second LI."""
    items = list_items(d)
    return f"""SELECT doc_id, list_id AS node_id, {d.lit(None)} AS parent_id, min(ord) * 3 AS ord, 'L' AS tag, CAST(NULL AS DOUBLE) AS x0, {d.lit(None)} AS text FROM ({items}) a GROUP BY doc_id, list_id
UNION ALL SELECT doc_id, node_id, list_id, ord * 3 + 1, tag, x0, text FROM ({items}) b
UNION ALL SELECT doc_id, concat(node_id, 'b'), node_id, ord * 3 + 2, 'LBody', CAST(NULL AS DOUBLE), text FROM ({items}) c WHERE tag = 'LI' AND ord % 2 = 0"""


def cells(d) -> str:
    return f"""SELECT {d.idiv("l_partkey", 2)} AS doc_id, l_partkey AS table_id, l_linenumber AS row,
  CAST(1 + l_suppkey % 4 AS INT) AS col, (l_orderkey * 1000000 + l_suppkey) * 64 + CAST(l_quantity AS INT) AS cell_id,
  CAST(CASE WHEN l_orderkey % 17 = 0 THEN 2 ELSE 1 END AS INT) AS row_span,
  CAST(CASE WHEN l_orderkey % 13 = 0 THEN 2 ELSE 1 END AS INT) AS col_span,
  CASE WHEN l_partkey % 5 = 0 THEN 'TD' WHEN l_linenumber = 1 AND l_partkey % 3 = 0 THEN 'TH'
       WHEN l_suppkey % 4 = 0 AND l_partkey % 7 = 0 THEN 'TH' WHEN l_orderkey % 19 = 0 THEN 'TH' ELSE 'TD' END AS tag,
  CASE WHEN l_linenumber = 1 AND l_partkey % 2 = 0 THEN {pick(d, ["Criterion", "Level", "Status", ""], "l_orderkey")}
    ELSE {pick(d, CELL_TEXTS, "l_orderkey + l_suppkey")} END AS text,
  {pick(d, [None, "Row", None, "Column", ""], "l_orderkey")} AS scope,
  {pick(d, [None, "h1", ""], "l_orderkey + l_partkey")} AS headers
FROM {d.table("lineitem")}"""


def tables(d) -> str:
    return f"""SELECT p_partkey AS table_id, {d.idiv("p_partkey", 2)} AS doc_id, CAST(1 + p_partkey % 9 AS INT) AS page,
  p_partkey % 3 = 0 AS has_caption, p_partkey % 11 = 0 AS is_layout, {pick(d, [None, "Summary of results", ""], "p_partkey")} AS summary
FROM {d.table("part")}"""


def decisions(d) -> str:
    """A reviewer's header decisions by (table, row, column)."""
    return f"""SELECT {d.idiv("l_partkey", 2)} AS doc_id, l_partkey AS table_id, l_linenumber AS row, CAST(1 + l_suppkey % 4 AS INT) AS col,
  max(l_orderkey) % 3 = 0 AS is_header, CASE WHEN min(l_orderkey) % 4 = 0 THEN 'Row' WHEN min(l_orderkey) % 4 = 1 THEN 'Column' END AS new_scope
FROM {d.table("lineitem")} GROUP BY l_partkey, l_linenumber, 1 + l_suppkey % 4"""


def rules(d) -> str:
    clause = pick(d, [c for c, _ in CLAUSES], "l_suppkey + l_partkey")
    test = pick(d, [str(t) for _, t in CLAUSES], "l_suppkey + l_partkey")
    return f"""SELECT l_orderkey AS doc_id, 'PDF/UA-1' AS specification, {clause} AS clause, CAST({test} AS INT) AS test_number,
  CASE WHEN l_returnflag = 'A' THEN 'passed' ELSE 'failed' END AS status,
  concat('Requirement ', {clause}, ' of the standard & its <notes>') AS description,
  l_partkey % 50 AS passed_checks, CAST(l_quantity AS BIGINT) AS failed_checks, l_partkey AS rule_id,
  l_linenumber AS line_no
FROM {d.table("lineitem")}"""


def runs(d) -> str:
    """One processing run per order: the per-file result the benchmark aggregates."""
    return f"""SELECT o_orderkey AS doc_id, concat('file', CAST(o_orderkey AS VARCHAR(20)), '.pdf') AS file,
  CAST(o_custkey % 20 AS INT) AS pages, CAST(o_orderkey % 90 AS BIGINT) AS nodes,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderstatus = 'F' THEN 'repair' ELSE 'rebuild' END AS mode,
  o_orderstatus = 'P' AS compliant, o_custkey % 13 = 0 AS validation_failed,
  CAST(o_custkey % 7 AS INT) AS form_total, CAST(floor(o_totalprice) AS BIGINT) % 60 AS failed_in,
  o_custkey % 60 AS failed_out, (o_orderkey * 7 + o_custkey) % 50 AS failed_rebuild, o_custkey % 5 AS failed_rules,
  CASE WHEN o_orderkey % 23 = 0 THEN 'timeout' END AS error,
  CASE WHEN o_orderkey % 23 = 0 THEN {pick(d, ["scan", "repair", "record"], "o_custkey")} END AS stage,
  CAST(o_orderkey % 3001 AS DOUBLE) / 10e0 AS seconds, o_custkey % 9 = 0 AS fonts_embedded,
  {pick(d, [None, "No further fixes possible", "PDF/UA-1 Compliant after iteration 1"], "o_custkey")} AS note
FROM {d.table("orders")}"""


def stream_mcids(d) -> str:
    return f"""SELECT l_suppkey AS doc_id, l_linenumber AS page, {_ID} AS mcid,
  {pick(d, ["P", "Span", "Artifact", "H1", "P"], "l_partkey")} AS tag, {pick(d, SPAN_TEXTS, "l_orderkey")} AS text
FROM {d.table("lineitem")}"""


def tree_mcids(d) -> str:
    return f"""SELECT l_suppkey AS doc_id, l_linenumber AS page, {_ID} AS mcid,
  {pick(d, ["P", "LBody", "H2"], "l_partkey")} AS tag,
  concat('e', CAST({d.idiv("l_orderkey", 4)} AS VARCHAR(20))) AS node_id, l_orderkey % 4 AS pos
FROM {d.table("lineitem")} WHERE l_returnflag <> 'R'"""


def stream_ops(d) -> str:
    return f"""SELECT l_suppkey AS doc_id, l_linenumber AS page, l_orderkey AS seq, l_partkey AS sub,
  {pick(d, OPS, "l_partkey + l_orderkey")} AS op
FROM {d.table("lineitem")}"""


def words(d) -> str:
    """Recognised word tokens of scanned pages: one per word of a conversation turn."""
    return f"""SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page, {d.idiv("ord", 9)} AS block, ord AS word_no,
  line AS text, CAST((length(line) * 17 + ord * 3) % 100 AS INT) AS conf,
  CAST(40 + (ord % 9) * 90 AS DOUBLE) AS px, CAST(30 + {d.idiv("ord", 9)} * 25 AS DOUBLE) AS py,
  CAST(length(line) * 11 AS DOUBLE) AS pw, CAST(20 + ord % 5 AS DOUBLE) AS ph
FROM {d.explode_lines(d.table("conversations"), "text", " ")} e"""


def fixes(d) -> str:
    """A reviewer's corrections, one per node."""
    return f"""SELECT doc_id, ord AS fix_id, {pick(d, ["retag", "set_alt", "retag", "set_title", "retag", "resize"], "doc_id + ord")} AS action,
  CASE WHEN ord % 3 = 0 THEN concat('  ', text, '!?') WHEN ord % 3 = 1 THEN substr(text, 1, 24) ELSE text END AS target_text,
  {pick(d, ["H1", "H2", "P", "Table", "Caption"], "doc_id + ord * 3")} AS new_tag, ord % 4 AS figure_number,
  {pick(d, ["A new description", " ", "Map of sites"], "ord")} AS new_alt, {pick(d, ["New title", "", "  Report "], "ord + doc_id")} AS new_title
FROM ({nodes(d)}) n"""


def answers(d) -> str:
    """Review answers for figures."""
    return f"""SELECT doc_id, node_id, ord % 3 = 0 AS decorative, {pick(d, ["A bridge", "", " Two people "], "doc_id + ord")} AS value
FROM ({nodes(d)}) n WHERE tag = 'Figure'"""


def order_requests(d) -> str:
    """Headings first, the last of them in front."""
    return f"""SELECT doc_id, page, node_id, 1000000 - ord AS pos FROM ({nodes(d)}) n WHERE tag IN ('H1', 'H2', 'H3', 'H4')"""


def verdicts(d) -> str:
    """Visual review items with a verdict."""
    return f"""SELECT event_id AS item_id, user_id AS doc_id, {pick(d, ["looks_good", "needs_human", "likely_problem", "other"], "event_id")} AS verdict
FROM {d.table("events")}"""


def figures(d) -> str:
    """Dense pages of figures, captions and paragraphs with boxes."""
    return f"""SELECT l_suppkey AS doc_id, l_linenumber AS page, {_ID} AS ord, concat('n', CAST({_ID} AS VARCHAR(20))) AS node_id,
  CAST(NULL AS VARCHAR(20)) AS parent_id, CASE WHEN l_partkey % 3 = 0 THEN 'Figure' ELSE 'P' END AS tag,
  {pick(d, ["Figure 1: results", "Body text of the page", "Fig. 2 comparison", "Table 3: summary", "Another paragraph", "chart 4 shows"], "l_orderkey")} AS text,
  {_box("20 + (l_orderkey % 9) * 50", "(l_orderkey * 37 + l_partkey * 11) % 700", f"60 + {_Q}", f"10 + {_Q} % 40")}
FROM {d.table("lineitem")}"""


def reports(d) -> str:
    """A validator's XML report per order: three rules, some failed, under either root name."""
    def rule(i: int) -> str:
        clause = pick(d, [c for c, _ in CLAUSES], f"o_orderkey + {i}")
        test = pick(d, [str(t) for _, t in CLAUSES], f"o_orderkey + {i}")
        return (f"""'<rule specification="PDF/UA-1" clause="', {clause}, '" testNumber="', {test}, '" status="',
   CASE WHEN (o_custkey + {i}) % 3 = 0 THEN 'passed' ELSE 'failed' END, '" passedChecks="', CAST(o_custkey % 40 AS VARCHAR(20)),
   '" failedChecks="', CAST((o_orderkey + {i}) % 90 AS VARCHAR(20)), '"><description> Rule {i} of <![CDATA[a & b]]> </description>',
   repeat('<check status="failed"><context>root/page[{i}]</context></check>', CAST((o_orderkey + {i}) % 8 AS INT)), '</rule>'""")
    root = "CASE WHEN o_orderkey % 2 = 0 THEN 'validationReport' ELSE 'validationResult' END"
    return f"""SELECT o_orderkey AS doc_id, o_custkey, concat('<report><buildInformation><releaseDetails id="core" version="1.26.2"/></buildInformation><jobs><job><', {root},
   ' flavour="PDFUA_1" isCompliant="', CASE WHEN o_custkey % 5 = 0 THEN 'true' ELSE 'false' END, '"><details passedRules="', CAST(o_custkey % 90 AS VARCHAR(20)),
   '" failedRules="2" passedChecks="900" failedChecks="', CAST(o_orderkey % 70 AS VARCHAR(20)), '">', {", ".join(rule(i) for i in range(3))},
   '</details></', {root}, '></job></jobs></report>') AS xml
FROM {d.table("orders")}"""


def elements(d) -> str:
    """Recognised elements of scanned pages."""
    return f"""SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page, ord AS pos,
  CASE WHEN (conv_id + turn) % 5 = 0 AND ord = 0 THEN 'H1' WHEN ord % 11 = 7 THEN 'Figure' ELSE 'P' END AS type,
  CASE WHEN turn % 2 = 0 THEN line WHEN ord % 3 = 0 THEN concat(line, ' with four more words') ELSE line END AS text
FROM {d.explode_lines(d.table("conversations"), "text", " ")} e"""


def tree(d) -> str:
    """Structure tree with a root per document; some parents do not exist."""
    return f"""SELECT doc_id, node_id, CASE WHEN (doc_id + ord) % 23 = 0 THEN 'gone' WHEN parent_id IS NULL THEN 'root' ELSE parent_id END AS parent_id,
  ord + 1 AS ord, tag FROM ({nodes(d)}) n
UNION ALL SELECT doc_id, 'root', NULL, CAST(0 AS BIGINT), 'Document' FROM {d.table("documents")}"""


VIEWS = {f.__name__: f for f in (
    spans, samples, page_sizes, images, paths, fills, annots, links, fields, fonts, layers, docs, lines, nodes,
    headings, toc_nodes, list_items, list_tree, cells, tables, decisions, rules, runs, stream_mcids, tree_mcids, stream_ops, words, elements, tree, figures, reports, fixes, answers, order_requests, verdicts,
)}
