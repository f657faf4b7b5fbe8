"""Table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.dialect import oracle, view
from catalog.text_queries import strip_sql
from tagloom.operators import tables as op


def _cells(s, p):
    return view(s, p, "cells")


def _layout(s, p):
    return view(s, p, "tables").filter("is_layout")


QUERIES = {
    "table_headers": lambda s, p: op.table_summary(_cells(s, p), op.grid_slots(_cells(s, p)), row_headers=True),
    "table_header_ids": lambda s, p: op.header_ids(_cells(s, p), row_headers=True),
    "table_promote": lambda s, p: op.promote_first_rows(_cells(s, p)),
    "table_scope": lambda s, p: op.assign_scope(_cells(s, p)),
    "table_scope_repair": lambda s, p: op.assign_scope(_cells(s, p), only_missing=True),
    "table_issues": lambda s, p: op.table_issues(_cells(s, p), view(s, p, "tables")),
    "table_normalize": lambda s, p: op.normalize_tables(_cells(s, p)),
    "table_normalize_plain": lambda s, p: op.normalize_tables(_cells(s, p).withColumn("row_span", F.lit(1))),
    "table_decisions": lambda s, p: op.apply_decisions(_cells(s, p), view(s, p, "decisions"), _layout(s, p)),
    "table_snippet": lambda s, p: op.table_snippets(_cells(s, p), view(s, p, "tables")),
}

_SLOTS = """sl AS (SELECT doc_id, table_id, r, c, arg_min({col_id}, (row, col, cell_id)) AS cell_id FROM
   (SELECT *, unnest(range(col, col + col_span)) AS c FROM (SELECT *, unnest(range(row, row + row_span)) AS r FROM fx_cells)) GROUP BY 1, 2, 3, 4),
 sh AS (SELECT doc_id, table_id, CAST(max(row + row_span - 1) AS INT) AS n_rows, CAST(max(col + col_span - 1) AS INT) AS n_cols,
   bool_or(row_span > 1 OR col_span > 1) AS sp FROM fx_cells GROUP BY 1, 2)""".replace("{col_id}", "cell_id")
_ROWS = """rw AS (SELECT doc_id, table_id, row, arg_min(tag, (col, cell_id)) AS head_tag, arg_min(cell_id, (col, cell_id)) AS head_id, bool_or(tag = 'TH') AS any_th,
   bool_or(regexp_matches(coalesce(text, ''), '^\\s*\\p{Nd}')) AS any_digit, count(*) AS n FROM fx_cells GROUP BY 1, 2, 3),
 rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_id ORDER BY row) AS i FROM rw)"""
_TB = """tb AS (SELECT doc_id, table_id, bool_or(i = 1 AND any_th) AS col_h, bool_or(i > 1 AND head_tag = 'TH') AS row_h FROM rk GROUP BY 1, 2)"""

ORACLES = {
    "table_headers": oracle("cells", f"""WITH {_SLOTS}, k AS (SELECT doc_id, table_id, count(*) AS cv, count(*) FILTER (WHERE r = 1) AS t, count(*) FILTER (WHERE c = 1) AS s FROM sl GROUP BY 1, 2)
SELECT doc_id, table_id, n_rows, n_cols, t + CASE WHEN n_cols > 1 THEN s ELSE 0 END AS headers_proposed, sp OR n_cols > 1 AS complex,
  CAST(n_rows AS BIGINT) * n_cols - cv AS uncovered FROM sh JOIN k USING (doc_id, table_id)"""),
    "table_header_ids": oracle("cells", f"""WITH {_SLOTS},
 own AS (SELECT s.doc_id, s.table_id, s.r, s.c, s.cell_id, x.row, x.col, 't' || s.table_id || 'r' || x.row || 'c' || x.col AS hid FROM sl s JOIN fx_cells x USING (doc_id, table_id, cell_id)),
 mk AS (SELECT doc_id, table_id, cell_id, bool_or(r = 1) AS top, bool_or(c = 1 AND n_cols > 1) AS side FROM own JOIN sh USING (doc_id, table_id) GROUP BY 1, 2, 3),
 fl AS (SELECT x.*, n_cols, coalesce(top, false) AS top, coalesce(side, false) AS side, sp OR n_cols > 1 AS cx FROM fx_cells x JOIN sh USING (doc_id, table_id) LEFT JOIN mk USING (doc_id, table_id, cell_id)),
 dt AS (SELECT * FROM fl WHERE NOT top AND NOT side AND cx),
 rf AS (SELECT d.doc_id, d.table_id, d.cell_id, 0 AS k, o.c AS pos, hid FROM dt d JOIN own o ON o.doc_id = d.doc_id AND o.table_id = d.table_id AND o.r = 1 AND o.c BETWEEN d.col AND d.col + d.col_span - 1
   UNION ALL SELECT d.doc_id, d.table_id, d.cell_id, 1, o.r, hid FROM dt d JOIN own o ON o.doc_id = d.doc_id AND o.table_id = d.table_id AND o.c = 1 AND o.r BETWEEN d.row AND d.row + d.row_span - 1 WHERE d.n_cols > 1),
 ds AS (SELECT doc_id, table_id, cell_id, hid, min(k * 100000 + pos) AS a0 FROM rf GROUP BY 1, 2, 3, 4),
 ls AS (SELECT doc_id, table_id, cell_id, string_agg(hid, ' ' ORDER BY a0, hid) AS headers FROM ds GROUP BY 1, 2, 3)
SELECT doc_id, table_id, cell_id, row, col, CASE WHEN top OR side THEN 'TH' ELSE tag END AS tag, CASE WHEN top AND side THEN 'Both' WHEN top THEN 'Column' WHEN side THEN 'Row' END AS scope,
  CASE WHEN (top OR side) AND cx THEN 't' || table_id || 'r' || row || 'c' || col END AS header_id, ls.headers AS headers FROM fl LEFT JOIN ls USING (doc_id, table_id, cell_id)"""),
    "table_promote": oracle("cells", f"""WITH {_ROWS} SELECT x.doc_id, x.table_id, x.row, x.col, x.cell_id, 'TH' AS tag, 'Column' AS scope FROM fx_cells x
  JOIN rk ON rk.doc_id = x.doc_id AND rk.table_id = x.table_id AND rk.row = x.row WHERE i = 1 AND NOT any_th AND NOT any_digit AND x.tag = 'TD'"""),
    "table_scope": oracle("cells", f"""WITH {_ROWS}, {_TB} SELECT doc_id, table_id, x.row, x.col, x.cell_id, CASE WHEN i = 1 AND head_id = cell_id AND col_h AND row_h THEN 'Both'
  WHEN i = 1 AND col_h THEN 'Column' WHEN head_id = cell_id AND row_h THEN 'Row' ELSE 'Column' END AS scope
  FROM fx_cells x JOIN rk USING (doc_id, table_id, row) JOIN tb USING (doc_id, table_id) WHERE x.tag = 'TH'"""),
    "table_scope_repair": oracle("cells", f"""WITH {_ROWS} SELECT doc_id, table_id, x.row, x.col, x.cell_id, CASE WHEN i = 1 AND head_id = cell_id THEN 'Both' WHEN i = 1 THEN 'Column' ELSE 'Row' END AS scope
  FROM fx_cells x JOIN rk USING (doc_id, table_id, row) WHERE x.tag = 'TH' AND coalesce(scope, '') = ''"""),
    "table_issues": oracle("cells tables", f"""WITH {_ROWS},
 ct AS (SELECT doc_id, table_id, count(*) FILTER (WHERE tag = 'TH' AND coalesce(scope, '') = '') AS ns, count(*) FILTER (WHERE tag = 'TD' AND coalesce(headers, '') = '') AS nh, bool_or(tag = 'TH') AS th FROM fx_cells GROUP BY 1, 2),
 sp AS (SELECT doc_id, table_id, count(*) >= 2 AND max(n) >= 2 AS big, bool_or(i = 1 AND any_th) AND bool_or(i = 2 AND head_tag = 'TH') AS cx FROM rk GROUP BY 1, 2),
 f AS (SELECT * FROM ct JOIN sp USING (doc_id, table_id) LEFT JOIN fx_tables USING (doc_id, table_id))
SELECT doc_id, table_id, page, 'missing_headers' AS type, CAST(NULL AS BIGINT) AS count FROM f WHERE NOT th AND big
UNION ALL SELECT doc_id, table_id, page, 'th_missing_scope', ns FROM f WHERE ns > 0
UNION ALL SELECT doc_id, table_id, page, 'complex_table_missing_headers_attr', nh FROM f WHERE cx AND nh > 0
UNION ALL SELECT doc_id, table_id, page, 'missing_caption', NULL FROM f WHERE NOT coalesce(has_caption, false) AND big"""),
    # cells one after the other: columns held by spans (with their last row), columns covered in this row, next column
    "table_normalize": oracle("cells", """WITH RECURSIVE q AS (SELECT *, CASE WHEN tag IN ('TD', 'TH') THEN greatest(coalesce(row_span, 1), 1) ELSE 1 END AS rs, CASE WHEN tag IN ('TD', 'TH') THEN greatest(coalesce(col_span, 1), 1) ELSE 1 END AS cs,
   row_number() OVER (PARTITION BY doc_id, table_id ORDER BY row, col, cell_id) AS k FROM fx_cells),
 p AS (SELECT doc_id, table_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS row, CAST([] AS STRUCT(c BIGINT, e BIGINT)[]) AS held, CAST([] AS BIGINT[]) AS cov, CAST(0 AS BIGINT) AS nxt, CAST(-1 AS BIGINT) AS fc
   FROM (SELECT DISTINCT doc_id, table_id FROM fx_cells)
   UNION ALL SELECT doc_id, table_id, k, row, CASE WHEN rs > 1 THEN list_concat(list_filter(held, lambda h: NOT (h['c'] >= slot AND h['c'] < slot + cs)), list_transform(range(slot, slot + cs), lambda c: {'c': c, 'e': CAST(row + rs - 1 AS BIGINT)})) ELSE held END,
     list_distinct(list_concat(cov, range(slot, slot + cs))), slot + cs, CASE WHEN fc < 0 THEN slot ELSE fc END FROM (
     SELECT *, list_min(list_filter(range(nxt, nxt + len(cov) + 1), lambda c: NOT list_contains(cov, c))) AS slot FROM (
       SELECT q.doc_id, q.table_id, q.k, CAST(q.row AS BIGINT) AS row, q.rs, q.cs, p.held, CASE WHEN q.row = p.row THEN p.cov ELSE list_distinct(list_transform(list_filter(p.held, lambda h: h['e'] >= q.row), lambda h: h['c'])) END AS cov,
         CASE WHEN q.row = p.row THEN p.nxt ELSE 0 END AS nxt, CASE WHEN q.row = p.row THEN p.fc ELSE -1 END AS fc
       FROM p JOIN q ON q.doc_id = p.doc_id AND q.table_id = p.table_id AND q.k = p.k + 1))),
 e AS (SELECT doc_id, table_id, row, arg_max(CAST(len(cov) AS INT), k) AS covered, arg_max(CAST(list_max(cov) + 1 AS INT), k) AS reach, arg_max(fc, k) AS fc FROM p WHERE k > 0 GROUP BY 1, 2, 3),
 r AS (SELECT doc_id, table_id, row, count(*) AS n_cells, count(*) FILTER (WHERE tag NOT IN ('TD', 'TH')) AS wrapped, count(*) FILTER (WHERE tag = 'TH' AND scope IS NULL) AS scoped,
   arg_min(tag, (col, cell_id)) AS ht, arg_min(coalesce(scope, '-'), (col, cell_id)) AS hs FROM fx_cells GROUP BY 1, 2, 3),
 w AS (SELECT r.*, covered, fc, max(reach) OVER (PARTITION BY doc_id, table_id) AS width, min(row) OVER (PARTITION BY doc_id, table_id) AS fr FROM r JOIN e USING (doc_id, table_id, row))
SELECT doc_id, table_id, row, n_cells, covered, width, width - covered AS padding, wrapped, scoped, CAST(ht = 'TH' AND hs = '-' AND fc = 0 AND row > fr AS INT) AS row_scopes FROM w"""),
    "table_normalize_plain": oracle("cells", """WITH r AS (SELECT doc_id, table_id, row, count(*) AS n_cells, CAST(sum(col_span) AS INT) AS covered, count(*) FILTER (WHERE tag = 'TH' AND scope IS NULL) AS scoped,
   arg_min(tag, (col, cell_id)) AS ht, arg_min(coalesce(scope, '-'), (col, cell_id)) AS hs FROM fx_cells GROUP BY 1, 2, 3),
 w AS (SELECT *, max(covered) OVER (PARTITION BY doc_id, table_id) AS width, min(row) OVER (PARTITION BY doc_id, table_id) AS fr FROM r)
SELECT doc_id, table_id, row, n_cells, covered, width, width - covered AS padding, CAST(0 AS BIGINT) AS wrapped, scoped, CAST(ht = 'TH' AND hs = '-' AND row > fr AS INT) AS row_scopes FROM w"""),
    "table_decisions": oracle("cells decisions tables", """SELECT x.doc_id, x.table_id, x.row, x.col, x.cell_id, CASE WHEN d.is_header AND NOT coalesce(t.is_layout, false) THEN 'TH' ELSE x.tag END AS tag,
  CASE WHEN d.new_scope IS NOT NULL AND NOT coalesce(t.is_layout, false) THEN d.new_scope ELSE x.scope END AS scope, CASE WHEN t.is_layout THEN 'Artifact' ELSE 'Table' END AS table_tag
FROM fx_cells x LEFT JOIN fx_decisions d ON d.doc_id = x.doc_id AND d.table_id = x.table_id AND d.row = x.row AND d.col = x.col
LEFT JOIN fx_tables t ON t.doc_id = x.doc_id AND t.table_id = x.table_id"""),
    "table_snippet": oracle("cells tables", f"""WITH b AS (SELECT x.*, substr({strip_sql("coalesce(text, '')")}, 1, 40) AS t FROM fx_cells x JOIN fx_tables y USING (doc_id, table_id) WHERE coalesce(summary, '') = ''),
 r AS (SELECT doc_id, table_id, row, string_agg(t, ' | ' ORDER BY col, cell_id) FILTER (WHERE t <> '') AS line, count(*) OVER (PARTITION BY doc_id, table_id) AS n FROM b GROUP BY 1, 2, 3),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_id ORDER BY row) AS i FROM r WHERE line IS NOT NULL AND n >= 3)
SELECT doc_id, table_id, string_agg(line, chr(10) ORDER BY row) AS snippet FROM k WHERE i <= 3 GROUP BY 1, 2"""),
}
