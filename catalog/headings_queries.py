"""Heading queries."""

from __future__ import annotations

from catalog.dialect import oracle, view
from tagloom.operators import headings as op


def _body(spark, sf):
    spans = view(spark, sf, "spans")
    page = ["doc_id", "page"]
    return op.median_size(spans, page).join(op.mode_size(spans, page), page, "full")


QUERIES = {
    "heading_issues": lambda s, p: op.heading_issues(view(s, p, "headings")),
    "heading_repair": lambda s, p: op.repair_levels(view(s, p, "headings")).select("doc_id", "ord", "level", "new_level"),
    "bookmarks": lambda s, p: op.bookmarks(view(s, p, "headings")),
    "bookmark_counts": lambda s, p: op.outline_counts(op.bookmarks(view(s, p, "headings"))),
    "heading_promote": lambda s, p: op.promote_headings(view(s, p, "nodes")),
    "body_size": _body,
    "body_size_lower_third": lambda s, p: op.lower_third_size(view(s, p, "nodes")),
    "heuristic_tags": lambda s, p: op.heuristic_tags(view(s, p, "spans")),
}

_PARENT = """p AS (SELECT h.doc_id, h.ord, h.level, max(e.ord) AS parent_ord, h.text, h.tag, h.page, h.y1
  FROM fx_headings h LEFT JOIN fx_headings e ON e.doc_id = h.doc_id AND e.ord < h.ord AND e.level < h.level
  GROUP BY h.doc_id, h.ord, h.level, h.text, h.tag, h.page, h.y1)"""
ORACLES = {
    "heading_issues": oracle("headings", """WITH l AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM fx_headings)
SELECT doc_id, 'skipped_level' AS type, ord, level, prev AS prev_level, page, substr(text, 1, 80) AS text FROM l WHERE level > prev + 1
UNION ALL SELECT doc_id, 'missing_h1', NULL, NULL, NULL, NULL, '' FROM fx_headings GROUP BY doc_id HAVING min(level) > 1"""),
    "heading_repair": oracle("headings", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM fx_headings)
SELECT doc_id, ord, level, CAST(i + min(CASE WHEN i = 1 THEN 1 ELSE level END - i) OVER (PARTITION BY doc_id ORDER BY ord
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS new_level FROM n"""),
    "bookmarks": oracle("headings", f"""WITH {_PARENT} SELECT doc_id, ord, level, parent_ord,
  substr(CASE WHEN text = '' THEN tag ELSE text END, 1, 255) AS title, page, y1 FROM p"""),
    "bookmark_counts": oracle("headings", f"""WITH {_PARENT} SELECT doc_id, count(*) AS bookmarks,
  count(*) FILTER (WHERE parent_ord IS NULL) AS top_level FROM p GROUP BY doc_id"""),
    "body_size_lower_third": oracle("nodes", """WITH r AS (SELECT doc_id, font_size, row_number() OVER (PARTITION BY doc_id ORDER BY font_size) - 1 AS i,
  count(*) OVER (PARTITION BY doc_id) AS n FROM fx_nodes WHERE tag = 'P' AND font_size > 0)
SELECT doc_id, font_size AS body_size FROM r WHERE n >= 3 AND i = n // 3"""),
    "heading_promote": oracle("nodes", """WITH hh AS (SELECT doc_id FROM fx_nodes GROUP BY doc_id HAVING NOT bool_or(tag IN ('H1','H2','H3','H4','H5','H6'))),
 r AS (SELECT doc_id, font_size, row_number() OVER (PARTITION BY doc_id ORDER BY font_size) - 1 AS i,
  count(*) OVER (PARTITION BY doc_id) AS n FROM fx_nodes WHERE tag = 'P' AND font_size > 0),
 b AS (SELECT doc_id, font_size AS body FROM r WHERE n >= 3 AND i = n // 3),
 p AS (SELECT x.*, font_size / body AS ratio FROM fx_nodes x JOIN hh USING (doc_id) JOIN b USING (doc_id)
  WHERE tag = 'P' AND font_size > 0 AND trim(text) <> '' AND length(trim(text)) <= 120),
 m AS (SELECT *, min(CASE WHEN ratio >= 1.5 THEN ord END) OVER (PARTITION BY doc_id) AS h1 FROM p)
SELECT doc_id, ord, node_id, CASE WHEN ord = h1 THEN 'H1' WHEN ratio >= 1.3 THEN 'H2' ELSE 'H3' END AS new_tag,
  round_even(ratio, 4) AS ratio FROM m WHERE ratio >= 1.15"""),
    "body_size": oracle("spans", """WITH m AS (SELECT doc_id, page, median(size) AS median_size FROM fx_spans WHERE size >= 4 GROUP BY 1, 2),
 c AS (SELECT doc_id, page, round_even(size * 2, 0) / 2 AS half, count(*) AS n FROM fx_spans WHERE size > 0 GROUP BY 1, 2, 3),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, half) AS rn FROM c)
SELECT doc_id, page, median_size, half AS mode_size FROM m FULL JOIN (SELECT * FROM k WHERE rn = 1) USING (doc_id, page)"""),
    "heuristic_tags": oracle("spans", """WITH c AS (SELECT doc_id, round_even(size * 2, 0) / 2 AS half, count(*) AS n FROM fx_spans WHERE size > 0 GROUP BY 1, 2),
 body AS (SELECT doc_id, half AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, half) AS rn FROM c) WHERE rn = 1),
 ln AS (SELECT doc_id, page, block, line, coalesce(string_agg(trim(text), ' ' ORDER BY span) FILTER (WHERE trim(text) <> ''), '') AS text,
   avg(CASE WHEN flags & 16 <> 0 THEN 1e0 ELSE 0e0 END) AS bold, sum(size) FILTER (WHERE size > 0) AS ss, count(*) FILTER (WHERE size > 0) AS sn,
   min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM fx_spans GROUP BY 1, 2, 3, 4),
 lb AS (SELECT *, bold >= 0.75 AND text <> '' AND len(string_split_regex(text, '\\s+')) <= 4 AND NOT ends_with(text, '.') AS label FROM ln),
 st AS (SELECT *, CASE WHEN label OR coalesce(lag(label) OVER (PARTITION BY doc_id, page, block ORDER BY line), false) THEN 1 ELSE 0 END AS s FROM lb),
 sg AS (SELECT *, CAST(sum(s) OVER (PARTITION BY doc_id, page, block ORDER BY line ROWS UNBOUNDED PRECEDING) AS INT) AS segment FROM st),
 g AS (SELECT doc_id, page, block, segment, coalesce(string_agg(text, ' ' ORDER BY line) FILTER (WHERE text <> ''), '') AS text,
   sum(ss) / sum(sn) AS mean_size, bool_or(label) AS label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM sg GROUP BY 1, 2, 3, 4)
SELECT g.doc_id, page, block, segment, CASE WHEN mean_size / body >= 1.6 THEN 'H1' WHEN mean_size / body >= 1.3 THEN 'H2'
   WHEN mean_size / body >= 1.15 OR label THEN 'H3' ELSE 'P' END AS tag, text, round_even(mean_size, 4) AS mean_size, x0, y0, x1, y1
FROM g JOIN body USING (doc_id) WHERE text <> ''"""),
}
