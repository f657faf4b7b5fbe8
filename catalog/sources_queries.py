"""Source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.dialect import Duck, oracle, table, view
from catalog.forms_queries import map_sql
from catalog.fixtures import CLAUSES
from catalog.text_queries import strip_sql
from tagloom.functions.text import strip
from tagloom.session import shared_dir
from tagloom.sources import intake, layout_json, ocr, text, validator, web

_lit = Duck().lit

# Layout JSON of each document: its lines as headings, paragraphs, lists, tables and images.
_LAYOUT = r"""SELECT doc_id, to_json(named_struct('file name', concat('d', doc_id, '.pdf'), 'number of pages', size(l), 'kids', transform(l, (x, i) -> named_struct(
  'type', element_at(array('heading', 'Paragraph', 'list', 'table', 'image'), 1 + (i + length(x)) % 5),
  'pdfua_tag', CASE (i + length(x)) % 5 WHEN 1 THEN 'P' WHEN 4 THEN 'Figure' END,
  'level', CASE WHEN i = 0 AND (i + length(x)) % 5 = 0 AND doc_id % 2 = 0 THEN 'Doctitle' END,
  'heading level', CASE WHEN (i + length(x)) % 5 = 0 THEN CASE WHEN length(x) % 9 = 8 THEN 'n/a' ELSE CAST(length(x) % 9 AS STRING) END END,
  'page number', 1 + i div 3, 'bounding box', array(10D, 20D, 10D + length(x) % 90, 40D),
  'font size', CASE WHEN (i + length(x)) % 5 = 1 THEN 9D + length(x) % 5 END,
  'content', CASE WHEN (i + length(x)) % 5 < 2 THEN x END,
  'kids', CASE WHEN (i + length(x)) % 5 = 2 THEN array(named_struct('type', 'list item', 'page number', 1 + i div 3, 'content', left(x, 20)),
     named_struct('type', 'list item', 'page number', 1 + i div 3, 'content', substring(x, 21))) END,
  'rows', CASE WHEN (i + length(x)) % 5 = 3 THEN array(named_struct('type', 'table row', 'row number', 1, 'page number', 1 + i div 3, 'cells', array(
     named_struct('type', 'table cell', 'pdfua_tag', 'TD', 'row number', 1, 'column number', 1, 'column span', CAST(NULL AS INT), 'page number', 1 + i div 3,
       'kids', array(named_struct('type', 'paragraph', 'page number', 1 + i div 3, 'content', left(x, 20)))),
     named_struct('type', 'table cell', 'pdfua_tag', 'TD', 'row number', 1, 'column number', 2, 'column span', 2, 'page number', 1 + i div 3,
       'kids', array(named_struct('type', 'paragraph', 'page number', 1 + i div 3, 'content', substring(x, 21))))))) END)))) AS json
FROM (SELECT doc_id, split(text, '\\n') AS l FROM {documents})"""


def _layouts(s, p):
    return s.sql(_LAYOUT, documents=table(s, p, "documents"))


def _broken(s, p):
    """Every seventh document is cut short, is a list, or has values of the wrong kinds."""
    kind = F.col("doc_id") % 7
    cut = (F.when(kind == 3, F.expr("left(json, length(json) div 2)")).when(kind == 5, F.lit("[]"))
           .when(kind == 6, F.lit('{"kids": ["x", {"type": "heading", "heading level": [2], "page number": "iv", "bounding box": "none", "kids": 7}]}'))
           .otherwise(F.col("json")))
    return _layouts(s, p).withColumn("json", cut)


_MANIFEST = r"""SELECT doc_id, to_json(named_struct('version', '1.0', 'source', named_struct('filename', concat('d', doc_id), 'pageCount', size(l)),
  'document', named_struct('title', CASE WHEN doc_id % 2 = 0 THEN source END, 'language', lang), 'nodes', transform(l, (x, i) -> named_struct('id', concat('m', i), 'tag',
  CASE WHEN i % 3 = 0 THEN 'H2' ELSE 'P' END, 'page', 1 + i div 3, 'text', x, 'children', CASE WHEN i % 4 = 1 THEN array(named_struct('id', concat('m', i, 'c'),
  'tag', 'Span', 'page', 1 + i div 3, 'text', left(x, 9))) END)))) AS json FROM (SELECT doc_id, source, lang, split(text, '\\n') AS l FROM {documents})"""

_RECORDS = r"""SELECT doc_id, to_json(map_from_entries(transform(sequence(0, (size(l) - 1) div 5), p -> struct(CAST(p AS STRING), named_struct('elements',
  transform(slice(l, p * 5 + 1, 5), (x, i) -> named_struct('type', CASE WHEN (i + length(x)) % 4 = 0 THEN 'Figure' ELSE 'P' END, 'text', x,
  'alt', CASE WHEN length(x) % 2 = 0 THEN left(x, 12) ELSE '' END, 'bbox_pdf', array(1D, 2D, 3D, 4D + i))), 'page_w', 612D, 'page_h', 792D))))) AS json
FROM (SELECT doc_id, split(text, '\\n') AS l FROM {documents})"""


def _manifest_docs(s, p):
    schema = "version string, source struct<filename: string, pageCount: int>, document struct<title: string, language: string>"
    m = F.from_json("json", schema)
    return s.sql(_MANIFEST, documents=table(s, p, "documents")).select("doc_id", m.alias("m")).select(
        "doc_id", "m.version", "m.source.filename", F.col("m.source.pageCount").alias("page_count"), "m.document.title", F.col("m.document.language").alias("lang"))


def _guard(s, p):
    docs = table(s, p, "documents").select("doc_id", F.octet_length("text").cast("long").alias("length"))
    return text.size_guard(docs, "length", 2000)


_REPORT_FILES = 40


def _validator_files(s, p):
    """The rules of all reports in a few long report files, written and read back."""
    path = shared_dir(s, "validator-files")
    part = (F.col("doc_id") % _REPORT_FILES).alias("file")
    reports = view(s, p, "reports")
    rules = reports.select(part, F.col("doc_id").alias("place"), F.explode(F.regexp_extract_all("xml", F.lit("(?s)<rule .*?</rule>"), F.lit(0))).alias("value"))
    files = reports.select(part).distinct()  # every report has rules, which need not be cut out again for this
    head = F.concat(F.lit('<?xml version="1.0"?><report><jobs><job><validationReport flavour="PDFUA_1" isCompliant="'), (F.col("file") % 2 == 0).cast("string"),
                    F.lit('"><details passedRules="'), "file", F.lit('" failedRules="3" passedChecks="4" failedChecks="5">'))
    tail = F.lit("</details></validationReport></job></jobs></report>")
    ends = F.array(*[F.struct(F.lit(place).cast("long").alias("place"), text.alias("value")) for place, text in ((-1, head), (1 << 60, tail))])
    lines = rules.unionByName(files.select("file", F.inline(ends)))
    lines.repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(path)
    number = F.regexp_extract("path", "file=([0-9]+)/", 1).cast("long").alias("file")
    return validator.validated_files(s, path).select(
        number, "clause", "test_number", "description", "passed_checks", "failed_checks", F.size("contexts").alias("contexts"), "compliant", "flavour", "passed_rules", "all_failed_checks")


def _intake(s, p):
    """Every document a file of its own; those over 2000 bytes are not opened."""
    path = shared_dir(s, "intake")
    intake.write_files(table(s, p, "documents").select(F.col("doc_id").alias("name"), "text"), path)
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: strip(x) != ""))
    doc_id = F.regexp_extract("path", "file=(-?[0-9]+)-[0-9]+", 1).try_cast("long")
    return intake.judged_paths(s, path, 2000).select(doc_id.alias("doc_id"), "length", "error", F.when(F.col("error").isNull(), lines).alias("lines"))


QUERIES = {
    "validator_files": _validator_files,
    "intake_files": _intake,
    "pages_nodes": lambda s, p: web.page_nodes(table(s, p, "pages")),
    "pages_links": lambda s, p: web.page_links(table(s, p, "pages")),
    "pages_docs": lambda s, p: web.page_docs(table(s, p, "pages")),
    "text_nodes": lambda s, p: text.text_nodes(table(s, p, "documents")),
    "turn_nodes": lambda s, p: text.turn_nodes(table(s, p, "conversations")),
    "validator_report": lambda s, p: validator.failed_rules(view(s, p, "reports")),
    "validations": lambda s, p: validator.validations(view(s, p, "reports")),
    "layout_nodes": lambda s, p: layout_json.flatten(_layouts(s, p)),
    "layout_titles": lambda s, p: layout_json.suggested_titles(_layouts(s, p), layout_json.flatten(_layouts(s, p))),
    "batch_results": lambda s, p: layout_json.batch_results(_broken(s, p)),
    "batch_nodes": lambda s, p: layout_json.flatten(layout_json.split_rejects(_broken(s, p))[0]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes")),
    "manifest_nodes": lambda s, p: layout_json.flatten(s.sql(_MANIFEST, documents=table(s, p, "documents"))).select(
        "doc_id", "node_id", "parent_id", "depth", "ord", "tag", "page", "text"),
    "manifest_docs": _manifest_docs,
    "ocr_blocks": lambda s, p: ocr.word_blocks(view(s, p, "words")),
    "ocr_elements": lambda s, p: ocr.page_records(s.sql(_RECORDS, documents=table(s, p, "documents"))),
    "scan_pages": lambda s, p: ocr.scanned_pages(view(s, p, "page_sizes"), view(s, p, "nodes"), view(s, p, "images")),
    "size_guard": _guard,
}


def plain_sql(c: str) -> str:
    t = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{ent}', '{ch}')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


_CLEAN = f"regexp_replace(html, {_lit(web.NOISE)}, '', 'g')"
_LINES = "ln AS (SELECT d.*, u.o - 1 AS i, u.x AS x, length(u.x) AS n FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(x, o))"
_k = "(i + n) % 5"
# nodes of each line in pre-order: (line kind, position, parent position, depth, tag, row, col, row_span, col_span, header, text, decorative)
_SHAPE = " UNION ALL ".join([
    "SELECT 0 k, 0 j, NULL pj, 0 dp, NULL tg, NULL r, NULL c, NULL cs, 'x' t", "SELECT 1, 0, NULL, 0, 'P', NULL, NULL, NULL, 'x'",
    "SELECT 2, 0, NULL, 0, 'L', NULL, NULL, NULL, '-'", "SELECT 2, 1, 0, 1, 'LI', NULL, NULL, NULL, 'l'", "SELECT 2, 2, 0, 1, 'LI', NULL, NULL, NULL, 'r'",
    "SELECT 3, 0, NULL, 0, 'Table', NULL, NULL, NULL, '-'", "SELECT 3, 1, 0, 1, 'TR', 1, NULL, NULL, '-'",
    "SELECT 3, 2, 1, 2, 'TD', 1, 1, 1, '-'", "SELECT 3, 3, 2, 3, 'P', NULL, NULL, NULL, 'l'",
    "SELECT 3, 4, 1, 2, 'TD', 1, 2, 2, '-'", "SELECT 3, 5, 4, 3, 'P', NULL, NULL, NULL, 'r'", "SELECT 4, 0, NULL, 0, 'Figure', NULL, NULL, NULL, '-'"])
_NODES = f"""{_LINES}, shp AS ({_SHAPE}),
 base AS (SELECT *, coalesce(sum(CASE {_k} WHEN 2 THEN 3 WHEN 3 THEN 6 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ln),
 nd AS (SELECT doc_id, 'n' || CAST(b + j + 1 AS BIGINT) AS node_id, 'n' || CAST(b + pj + 1 AS BIGINT) AS parent_id, CAST(dp AS INT) AS depth, CAST(b + j AS BIGINT) AS ord,
  CASE WHEN k = 0 THEN 'H' || CASE WHEN n % 9 = 8 THEN 1 ELSE greatest(1, least(6, n % 9)) END ELSE tg END AS tag, CAST(1 + i // 3 AS INT) AS page,
  CASE WHEN j = 0 THEN 10e0 END AS x0, CASE WHEN j = 0 THEN 20e0 END AS y0, CASE WHEN j = 0 THEN 10e0 + n % 90 END AS x1, CASE WHEN j = 0 THEN 40e0 END AS y1,
  CAST(r AS INT) AS row, CAST(c AS INT) AS col, CASE WHEN cs IS NOT NULL THEN 1 END AS row_span, CAST(cs AS INT) AS col_span,
  CASE WHEN cs IS NOT NULL THEN false END AS header, CASE t WHEN 'x' THEN x WHEN 'l' THEN left(x, 20) WHEN 'r' THEN substr(x, 21) END AS text,
  CAST(NULL AS VARCHAR) AS alt, CASE WHEN k = 4 THEN false END AS decorative, CASE WHEN k = 1 THEN 9e0 + n % 5 END AS font_size
  FROM base JOIN shp ON k = {_k})"""
_RULES = " UNION ALL ".join(
    "SELECT o_orderkey AS doc_id, {i} AS i, {c} AS clause, {t} AS test_number, o_custkey % 40 AS pc, (o_orderkey + {i}) % 90 AS fc, (o_orderkey + {i}) % 8 AS nc FROM orders WHERE (o_custkey + {i}) % 3 <> 0".format(
        i=i, c="['" + "','".join(c for c, _ in CLAUSES) + f"'][1 + (o_orderkey + {i}) % {len(CLAUSES)}]",
        t="[" + ",".join(str(t) for _, t in CLAUSES) + f"][1 + (o_orderkey + {i}) % {len(CLAUSES)}]") for i in range(3))
ORACLES = {
    "pages_nodes": f"""WITH b AS (SELECT page_id AS doc_id, u.x AS block, u.o - 1 AS ord FROM pages, unnest(regexp_extract_all({_CLEAN}, {_lit(web.BLOCK)}, 0)) WITH ORDINALITY AS u(x, o)),
 n AS (SELECT *, lower(regexp_extract(block, '^<([a-zA-Z0-9]+)', 1)) AS nm FROM b)
SELECT doc_id, ord, 'n' || (ord + 1) AS node_id, {map_sql(web.BLOCK_TAGS, 'nm')} AS tag, {plain_sql('block')} AS text,
  CASE WHEN nm = 'img' AND regexp_matches(block, '\\balt="', 'i') THEN regexp_extract(block, '\\balt="([^"]*)"', 1, 'i') END AS alt FROM n""",
    "pages_links": f"""SELECT page_id AS doc_id, 1 AS page, u.o - 1 AS link_id, regexp_extract(u.x, 'href="([^"]*)"', 1, 'i') AS uri, {plain_sql('u.x')} AS text
FROM pages, unnest(regexp_extract_all({_CLEAN}, {_lit(web.LINK)}, 0)) WITH ORDINALITY AS u(x, o)""",
    "pages_docs": f"""SELECT page_id AS doc_id, url AS filename, nullif({plain_sql("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")}, '') AS title,
  nullif(regexp_extract(html, '<html\\b[^>]*\\blang="([^"]*)"', 1, 'i'), '') AS lang FROM pages""",
    "text_nodes": f"WITH {_LINES} SELECT doc_id, i AS ord, 'P' AS tag, {strip_sql('x')} AS text FROM ln WHERE {strip_sql('x')} <> ''",
    "turn_nodes": "SELECT conv_id AS doc_id, turn AS ord, 'n' || turn AS node_id, CASE WHEN role = 'user' THEN 'H2' ELSE 'P' END AS tag, text FROM conversations",
    "validator_report": f"""WITH r AS ({_RULES}) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY clause, test_number) AS INT) AS position, 'PDF/UA-1' AS specification,
  clause, test_number, 'failed' AS status, 'Rule ' || i || ' of a & b' AS description, pc AS passed_checks, fc AS failed_checks,
  coalesce(array_to_string(list_transform(range(nc), lambda z: 'root/page[' || i || ']'), '|'), '') AS contexts FROM r""",
    "validator_files": f"""WITH r AS ({_RULES}) SELECT doc_id % {_REPORT_FILES} AS file, clause, test_number, 'Rule ' || i || ' of a & b' AS description, pc AS passed_checks, fc AS failed_checks,
  CAST(nc AS INTEGER) AS contexts, doc_id % {_REPORT_FILES} % 2 = 0 AS compliant, 'PDFUA_1' AS flavour, doc_id % {_REPORT_FILES} AS passed_rules, CAST(5 AS BIGINT) AS all_failed_checks FROM r""",
    "intake_files": f"""SELECT doc_id, strlen(text) + 1 AS length, CASE WHEN strlen(text) >= 2000 THEN 'too_long' END AS error,
  CASE WHEN strlen(text) < 2000 THEN CAST(len(list_filter(string_split(text, chr(10)), lambda x: {strip_sql('x')} <> '')) AS INTEGER) END AS lines FROM documents""",
    "validations": """SELECT o_orderkey AS doc_id, o_custkey % 5 = 0 AS compliant, 'PDFUA_1' AS flavour, o_custkey % 90 AS passed_rules, CAST(2 AS BIGINT) AS failed_rules,
  CAST(900 AS BIGINT) AS passed_checks, o_orderkey % 70 AS failed_checks, CAST(NULL AS VARCHAR) AS validation_error FROM orders""",
    "layout_nodes": f"WITH {_NODES} SELECT * FROM nd",
    "layout_titles": f"""WITH {_NODES}, h AS (SELECT doc_id, arg_min(trim(text), ord) AS h1 FROM nd WHERE tag = 'H1' AND trim(text) <> '' GROUP BY 1)
SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 AND d.n % 5 = 0 THEN d.x END, h1) AS suggested_title FROM (SELECT * FROM ln WHERE i = 0) d LEFT JOIN h USING (doc_id)""",
    "batch_results": "SELECT doc_id, doc_id % 7 NOT IN (3, 5) AS ok, CASE WHEN doc_id % 7 IN (3, 5) THEN 'invalid_json' END AS error FROM documents",
    "batch_nodes": f"WITH {_NODES} SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN 1 ELSE count(*) END AS nodes FROM nd WHERE doc_id % 7 NOT IN (3, 5) GROUP BY 1",
    "manifest_nodes": f"""WITH {_LINES}, b AS (SELECT *, i + coalesce(sum(CASE WHEN i % 4 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM ln)
SELECT doc_id, 'm' || i AS node_id, NULL AS parent_id, 0 AS depth, CAST(o AS BIGINT) AS ord, CASE WHEN i % 3 = 0 THEN 'H2' ELSE 'P' END AS tag, CAST(1 + i // 3 AS INT) AS page, x AS text FROM b
UNION ALL SELECT doc_id, 'm' || i || 'c', 'm' || i, 1, CAST(o + 1 AS BIGINT), 'Span', CAST(1 + i // 3 AS INT), left(x, 9) FROM b WHERE i % 4 = 1""",
    "manifest_docs": """SELECT doc_id, '1.0' AS version, 'd' || doc_id AS filename, CAST(len(string_split(text, chr(10))) AS INT) AS page_count,
  CASE WHEN doc_id % 2 = 0 THEN source END AS title, lang FROM documents""",
    "ocr_blocks": oracle("words", f"""SELECT doc_id, page, block, string_agg({strip_sql('text')}, ' ' ORDER BY word_no) AS text, round_even(min(px) * 0.24e0, 2) AS x0, round_even(792e0 - max(py + ph) * 0.24e0, 2) AS y0,
  round_even(max(px + pw) * 0.24e0, 2) AS x1, round_even(792e0 - min(py) * 0.24e0, 2) AS y1, 'P' AS tag FROM fx_words WHERE conf >= 30 AND {strip_sql('text')} <> '' GROUP BY 1, 2, 3"""),
    "ocr_elements": f"""WITH {_LINES}, e AS (SELECT doc_id, CAST(1 + i // 5 AS INT) AS page, CAST(i % 5 AS INT) AS pos, n, x, (i % 5 + n) % 4 = 0 AS fig FROM ln)
SELECT doc_id, page, pos, CASE WHEN fig THEN 'Figure' ELSE 'P' END AS tag, x AS text, 1e0 AS x0, 2e0 AS y0, 3e0 AS x1, 4e0 + pos AS y1,
  CASE WHEN fig THEN CASE WHEN n % 2 = 0 THEN left(x, 12) ELSE '' END END AS alt, CASE WHEN fig THEN n % 2 = 1 OR n = 0 END AS decorative FROM e""",
    "scan_pages": oracle("page_sizes nodes images", f"""WITH c AS (SELECT doc_id, page, CAST(sum(length({strip_sql("coalesce(text, '')")})) AS BIGINT) AS chars FROM fx_nodes GROUP BY 1, 2),
 i AS (SELECT doc_id, page, count(*) AS images FROM fx_images GROUP BY 1, 2), d AS (SELECT doc_id, sum(chars) AS dc FROM c GROUP BY 1)
SELECT p.doc_id, p.page, coalesce(chars, 0) AS chars, coalesce(images, 0) AS images, coalesce(chars, 0) < 20 AND coalesce(images, 0) > 0 AS scanned, coalesce(dc, 0) < 50 AS doc_scanned
FROM fx_page_sizes p LEFT JOIN c ON c.doc_id = p.doc_id AND c.page = p.page LEFT JOIN i ON i.doc_id = p.doc_id AND i.page = p.page LEFT JOIN d ON d.doc_id = p.doc_id"""),
    "size_guard": "SELECT doc_id, strlen(text) AS length, strlen(text) <= 2000 AS accepted FROM documents",
}
