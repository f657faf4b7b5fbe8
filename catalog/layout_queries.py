"""Layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.dialect import Duck, oracle, view
from catalog.document_queries import blank_sql
from catalog.forms_queries import map_sql
from catalog.text_queries import _in, strip_sql
from tagloom import lexicon as lx
from tagloom.functions import geometry as g
from tagloom.operators import layout as op

_lit = Duck().lit


def _headers(s, p):
    return op.running_headers(view(s, p, "spans"), view(s, p, "page_sizes"))


def _flip(s, p):
    spans, pages = view(s, p, "spans"), view(s, p, "page_sizes")
    y0, y1 = g.flip(F.col("y0"), F.col("y1"), F.col("height"))
    return spans.join(pages, ["doc_id", "page"]).select("doc_id", "page", "span", y0.alias("top_y0"), y1.alias("top_y1"))


def _fractions(s, p):
    """Boxes given as page fractions, from the sizes of spans."""
    spans, pages = view(s, p, "spans"), view(s, p, "page_sizes")
    fr = [F.col("x0") / 400.0 - 0.1, F.col("y0") / 700.0 - 0.05, F.col("x1") / 400.0, F.col("y1") / 700.0]
    box = g.fraction_box(*fr, F.col("width"), F.col("height"))
    return spans.join(pages, ["doc_id", "page"]).select("doc_id", "page", "span", *[b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"))])


QUERIES = {
    "caption_gaps": lambda s, p: op.caption_gaps(view(s, p, "figures")),
    "captions": lambda s, p: op.link_captions(view(s, p, "figures")),
    "caption_pairs": lambda s, p: op.adopt_captions(
        view(s, p, "figures"), op.link_captions(view(s, p, "figures"))).select("doc_id", "node_id", "parent_id", "tag"),
    "running_headers": _headers,
    "header_artifacts": lambda s, p: op.header_artifacts(view(s, p, "nodes"), _headers(s, p)).select("doc_id", "node_id", "page"),
    "invisible_spans": lambda s, p: op.invisible_spans(view(s, p, "spans")).select("doc_id", "page", "span", "color", "size"),
    "invisible_drop": lambda s, p: op.drop_invisible(view(s, p, "nodes"), view(s, p, "spans")).select("doc_id", "node_id", "tag"),
    "footnotes": lambda s, p: op.footnotes(view(s, p, "spans"), view(s, p, "page_sizes")),
    "toc": lambda s, p: op.contents_runs(view(s, p, "toc_nodes")),
    "nested_lists": lambda s, p: op.nest_lists(view(s, p, "list_items")),
    "nested_list_tree": lambda s, p: op.nested_list_tree(view(s, p, "list_tree")),
    "list_labels": lambda s, p: op.split_list_labels(view(s, p, "list_items")),
    "swatches": lambda s, p: op.swatch_clusters(view(s, p, "fills")),
    "orphan_mcids": lambda s, p: op.orphan_mcids(view(s, p, "stream_mcids"), view(s, p, "tree_mcids")),
    "artifact_conflicts": lambda s, p: op.artifact_conflicts(view(s, p, "stream_mcids"), view(s, p, "tree_mcids")),
    "node_text": lambda s, p: op.node_texts(view(s, p, "stream_mcids"), view(s, p, "tree_mcids")),
    "unmarked_content": lambda s, p: op.unmarked_content(view(s, p, "stream_ops")),
    "islands": lambda s, p: op.structure_islands(view(s, p, "tree")),
    "hit_test": lambda s, p: op.hit_test(view(s, p, "spans"), view(s, p, "nodes"), "span"),
    "image_hit_test": lambda s, p: op.hit_test(
        view(s, p, "images").withColumnsRenamed({"x": "x0", "y": "y0"}), view(s, p, "nodes").filter("tag = 'Figure'"), "image_id"),
    "empty_elements": lambda s, p: op.empty_elements(view(s, p, "nodes")),
    "coverage": lambda s, p: op.coverage(view(s, p, "page_sizes"), view(s, p, "spans"), view(s, p, "nodes")),
    "graphical_pages": lambda s, p: op.graphical_pages(view(s, p, "elements")),
    "text_preview": lambda s, p: op.text_previews(view(s, p, "nodes")),
    "figure_numbers": lambda s, p: op.figure_numbers(view(s, p, "nodes")),
    "duplicate_ids": lambda s, p: op.duplicate_ids(
        view(s, p, "nodes").withColumn("elem_id", F.concat(F.lit("id"), F.col("ord") % 7)), "elem_id"),
    "box_flip": _flip,
    "fraction_boxes": _fractions,
    "node_counts": lambda s, p: view(s, p, "nodes").groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes")),
}

_GAPS = f"""f AS (SELECT doc_id, page, ord AS fig, y0, y1 FROM fx_figures WHERE tag = 'Figure'),
 c AS (SELECT doc_id, page, ord AS cap, y0, y1 FROM fx_figures WHERE tag IN ('P', 'Span', 'Caption') AND regexp_matches({strip_sql("coalesce(text, '')")}, {_lit(lx.CAPTION)}, 'i')),
 gp AS (SELECT f.doc_id, f.page, fig, cap, least(abs(f.y0 - c.y1), abs(c.y0 - f.y1)) AS gap FROM f JOIN c ON f.doc_id = c.doc_id AND f.page = c.page)"""
_HEAD = f"""many AS (SELECT doc_id FROM fx_page_sizes GROUP BY 1 HAVING count(*) >= 2),
 sp AS (SELECT s.*, {strip_sql("coalesce(s.text, '')")} AS t, height, height - (y0 + y1) / 2 AS m FROM fx_spans s JOIN fx_page_sizes p ON s.doc_id = p.doc_id AND s.page = p.page WHERE s.doc_id IN (SELECT doc_id FROM many)),
 zn AS (SELECT *, CASE WHEN m < height * 0.1e0 THEN 'top' WHEN m > height * 0.9e0 THEN 'bottom' END AS zone, round_even(m / 6e0, 0) * 6e0 AS row_y,
   coalesce(nullif({strip_sql("regexp_replace(t, '[0-9]+', '#', 'g')")}, ''), '#') AS norm FROM sp WHERE t <> ''),
 hd AS (SELECT *, count(*) OVER (PARTITION BY doc_id, zone, row_y, norm) AS n FROM zn WHERE zone IS NOT NULL),
 hz AS (SELECT doc_id, page, span, zone, row_y, norm, x0, y0, x1, y1 FROM hd WHERE n >= 2)"""
_INV = "((color >> 16) & 255 > 245 AND (color >> 8) & 255 > 245 AND color & 255 > 245) OR (size > 0 AND size < 2)"
_BUL = f"regexp_matches({strip_sql("coalesce(text, '')")}, {_lit(lx.BULLET)}, 'i')"
_RGB = """CASE space WHEN 'rgb' THEN {x} WHEN 'gray' THEN a WHEN 'cmyk' THEN (1 - {x}) * (1 - d) ELSE 0e0 END"""


def _hit(points: str, key: str, px: str, py: str, where: str = "") -> str:
    return f"""WITH h AS (SELECT p.doc_id, p.page, p.{key}, n.node_id, n.decorative, row_number() OVER (PARTITION BY p.doc_id, p.page, p.{key}
   ORDER BY abs((n.x1 - n.x0) * (n.y1 - n.y0)), n.ord) AS rn FROM {points} p JOIN fx_nodes n ON n.doc_id = p.doc_id AND n.page = p.page
   AND p.{px} BETWEEN n.x0 - 4 AND n.x1 + 4 AND p.{py} BETWEEN n.y0 - 4 AND n.y1 + 4 {where})
SELECT p.doc_id, p.page, p.{key}, CASE WHEN NOT h.decorative THEN h.node_id END AS node_id FROM {points} p
LEFT JOIN h ON h.rn = 1 AND h.doc_id = p.doc_id AND h.page = p.page AND h.{key} = p.{key}"""


_EMPTY = f"""em AS (SELECT doc_id, node_id, tag, page FROM fx_nodes n WHERE {blank_sql('text')} AND {blank_sql('alt')} AND NOT artifact AND NOT decorative
   AND NOT EXISTS (SELECT 1 FROM fx_nodes k WHERE k.doc_id = n.doc_id AND k.parent_id = n.node_id))"""
# figures of a page one after the other, each with its captions nearest first and those already taken
_LINKS = f"""{_GAPS}, fq AS (SELECT doc_id, page, fig, list(cap ORDER BY gap, cap) AS caps, row_number() OVER (PARTITION BY doc_id, page ORDER BY fig) AS k FROM gp WHERE gap <= 40 GROUP BY 1, 2, 3),
 lk AS (SELECT doc_id, page, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS fig, CAST(NULL AS BIGINT) AS cap FROM (SELECT DISTINCT doc_id, page FROM fq)
   UNION ALL SELECT doc_id, page, k, CASE WHEN c IS NULL THEN taken ELSE list_append(taken, c) END, fig, c FROM (
     SELECT q.doc_id, q.page, q.k, l.taken, q.fig, list_filter(q.caps, lambda x: NOT list_contains(l.taken, x))[1] AS c FROM lk l JOIN fq q ON q.doc_id = l.doc_id AND q.page = l.page AND q.k = l.k + 1)),
 ln AS (SELECT gp.* FROM lk JOIN gp ON gp.doc_id = lk.doc_id AND gp.page = lk.page AND gp.fig = lk.fig AND gp.cap = lk.cap)"""
_NESTED = f"""WITH b AS (SELECT doc_id, list_id, arg_min(x0, ord) AS base FROM fx_list_items WHERE x0 IS NOT NULL GROUP BY 1, 2),
 a AS (SELECT x.*, coalesce(x0 - base >= 12, false) AS ind, tag IN ('P', 'LI') AND {_BUL} AS bul FROM fx_list_items x JOIN b USING (doc_id, list_id)),
 s AS (SELECT *, max(CASE WHEN NOT ind AND NOT bul THEN ord END) OVER w AS st, max(CASE WHEN ind THEN ord END) OVER w AS op FROM a WINDOW w AS (PARTITION BY doc_id, list_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
 n AS (SELECT *, ind OR (bul AND coalesce(op > coalesce(st, -1), false)) AS nested FROM s)
SELECT doc_id, list_id, node_id, ord, nested, CASE WHEN nested AND tag = 'P' THEN 'LI' ELSE tag END AS new_tag,
  CASE WHEN nested THEN max(CASE WHEN NOT nested AND tag IN ('LI', 'L') THEN ord END) OVER (PARTITION BY doc_id, list_id ORDER BY ord ROWS UNBOUNDED PRECEDING) END AS parent_ord FROM n"""

ORACLES = {
    "captions": oracle("figures", f"WITH RECURSIVE {_LINKS} SELECT doc_id, page, fig, cap, gap FROM ln"),
    "caption_pairs": oracle("figures", f"""WITH RECURSIVE {_LINKS} SELECT n.doc_id, n.node_id, coalesce(o.node_id, n.parent_id) AS parent_id, CASE WHEN o.node_id IS NOT NULL THEN 'Caption' ELSE n.tag END AS tag
FROM fx_figures n LEFT JOIN ln ON ln.doc_id = n.doc_id AND ln.cap = n.ord LEFT JOIN fx_figures o ON o.doc_id = n.doc_id AND o.ord = ln.fig"""),
    "caption_gaps": oracle("figures", f"WITH {_GAPS} SELECT doc_id, page, fig, cap, gap FROM gp WHERE gap <= 40"),
    "running_headers": oracle("spans page_sizes", f"WITH {_HEAD} SELECT * FROM hz"),
    "header_artifacts": oracle("spans page_sizes nodes", f"""WITH {_HEAD} SELECT doc_id, node_id, page FROM fx_nodes n WHERE EXISTS (SELECT 1 FROM hz z WHERE z.doc_id = n.doc_id AND z.page = n.page
   AND (n.x0 + n.x1) / 2 BETWEEN z.x0 - 4 AND z.x1 + 4 AND (n.y0 + n.y1) / 2 BETWEEN z.y0 - 4 AND z.y1 + 4)"""),
    "invisible_spans": oracle("spans", f"SELECT doc_id, page, span, color, size FROM fx_spans WHERE {_INV}"),
    "invisible_drop": oracle("spans nodes", f"""WITH iv AS (SELECT * FROM fx_spans WHERE {_INV}) SELECT doc_id, node_id, tag FROM fx_nodes n WHERE NOT (tag IN {_in(lx.LEAF_TAGS)} AND EXISTS (
   SELECT 1 FROM iv h WHERE h.doc_id = n.doc_id AND h.page = n.page AND least(n.x1, h.x1) > greatest(n.x0, h.x0) AND least(n.y1, h.y1) > greatest(n.y0, h.y0)
   AND (least(n.x1, h.x1) - greatest(n.x0, h.x0)) * (least(n.y1, h.y1) - greatest(n.y0, h.y0)) / greatest(abs((n.x1 - n.x0) * (n.y1 - n.y0)), 1e-6) >= 0.6))"""),
    "footnotes": oracle("spans page_sizes", f"""WITH md AS (SELECT doc_id, page, median(size) AS med FROM fx_spans WHERE size >= 4 GROUP BY 1, 2),
 ls AS (SELECT doc_id, page, block, line, median(size) AS ls FROM fx_spans WHERE size > 0 GROUP BY 1, 2, 3, 4),
 sp AS (SELECT s.*, regexp_extract({strip_sql("coalesce(s.text, '')")}, {_lit(lx.FOOTNOTE_MARKER)}, 1) AS marker, med, ls, height FROM fx_spans s JOIN md USING (doc_id, page) JOIN ls USING (doc_id, page, block, line) JOIN fx_page_sizes USING (doc_id, page)),
 rf AS (SELECT * FROM sp WHERE marker <> '' AND size > 0 AND size < least(med * 0.65e0, ls * 0.8e0) AND y0 >= height * (1 - 0.8e0)),
 bk AS (SELECT doc_id, page, block, min(y0) AS by0, max(y1) AS note_y, min(line) AS line FROM fx_spans GROUP BY 1, 2, 3),
 fl AS (SELECT b.doc_id, b.page, b.block, note_y, regexp_extract({strip_sql("string_agg(s.text, '' ORDER BY s.span)")}, {_lit(lx.FOOTNOTE_MARKER)}, 1) AS marker FROM bk b JOIN fx_page_sizes p ON p.doc_id = b.doc_id AND p.page = b.page
   JOIN fx_spans s ON s.doc_id = b.doc_id AND s.page = b.page AND s.block = b.block AND s.line = b.line WHERE by0 <= height * (1 - 0.8e0) GROUP BY 1, 2, 3, 4),
 bd AS (SELECT doc_id, page, marker, max(block) AS block, arg_max(note_y, block) AS note_y FROM fl WHERE marker <> '' GROUP BY 1, 2, 3)
SELECT rf.doc_id, rf.page, rf.span, rf.marker, rf.y1 AS ref_y, bd.block, bd.note_y FROM rf JOIN bd ON bd.doc_id = rf.doc_id AND bd.page = rf.page AND bd.marker = rf.marker"""),
    "toc": oracle("toc_nodes", f"""WITH k AS (SELECT *, {strip_sql("coalesce(text, '')")} AS t FROM fx_toc_nodes),
 i AS (SELECT *, t <> '' AND regexp_matches(t, {_lit(lx.TOC_LINE)}) AS item, regexp_matches(t, {_lit(lx.TOC_HEADER)}, 'i') AND tag IN ('P','H1','H2','H3','Caption') AS hd FROM k),
 r AS (SELECT *, max(CASE WHEN NOT item AND t <> '' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS stop FROM i),
 q AS (SELECT doc_id, stop, min(ord) AS f, count(*) AS n FROM r WHERE item GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT r.doc_id, r.node_id, r.ord, coalesce(CASE WHEN s.hd THEN s.node_id END, b.node_id) || '_toc' AS toc_id, 'TOCI' AS new_tag FROM r JOIN q ON q.doc_id = r.doc_id AND q.stop IS NOT DISTINCT FROM r.stop
 LEFT JOIN i s ON s.doc_id = q.doc_id AND s.ord = q.stop JOIN i b ON b.doc_id = q.doc_id AND b.ord = q.f WHERE r.item"""),
    "nested_lists": oracle("list_items", _NESTED),
    "nested_list_tree": oracle("list_items list_tree", f"""WITH nl AS ({_NESTED}), mv AS (SELECT nl.*, li.node_id AS item, li.node_id || CASE WHEN li.tag = 'LI' AND li.ord % 2 = 0 THEN 'b' ELSE '' END AS host
   FROM nl LEFT JOIN fx_list_items li ON li.doc_id = nl.doc_id AND li.ord = nl.parent_ord WHERE nested)
SELECT t.doc_id, t.node_id, CASE WHEN item IS NOT NULL THEN item || '_sublist' ELSE t.parent_id END AS parent_id, t.ord * 2 + 1 AS ord, coalesce(new_tag, t.tag) AS tag, t.x0, t.text
FROM fx_list_tree t LEFT JOIN mv ON mv.doc_id = t.doc_id AND mv.node_id = t.node_id UNION ALL
SELECT doc_id, item || '_sublist', host, min(ord) * 6 + 2, 'L', (SELECT x0 FROM fx_list_items f WHERE f.doc_id = mv.doc_id AND f.ord = min(mv.ord)), NULL FROM mv WHERE item IS NOT NULL GROUP BY doc_id, item, host"""),
    "list_labels": oracle("list_items", f"""WITH a AS (SELECT doc_id, node_id, coalesce(text, '') AS t, {strip_sql(f"regexp_extract(coalesce(text, ''), {_lit(lx.BULLET)}, 0, 'i')")} AS l FROM fx_list_items WHERE tag = 'LI'),
 k AS (SELECT * FROM a WHERE l <> '' AND starts_with(t, l))
SELECT doc_id, node_id AS parent_id, node_id || '_lbl' AS node_id, 'Lbl' AS tag, l AS text FROM k UNION ALL SELECT doc_id, node_id, node_id || '_lbody', 'LBody', ltrim(substr(t, length(l) + 1)) FROM k"""),
    "swatches": oracle("fills", f"""WITH s AS (SELECT *, -y AS dn, round_even({_RGB.format(x='a')}, 2) AS r, round_even({_RGB.format(x='b')}, 2) AS g, round_even({_RGB.format(x='c')}, 2) AS bl FROM fx_fills
   WHERE w * h BETWEEN 9 AND 3600 AND w / greatest(h, 0.1) <= 8 AND h / greatest(w, 0.1) <= 8),
 l AS (SELECT *, lag(y) OVER o AS py, lag(x + w) OVER o AS px FROM s WINDOW o AS (PARTITION BY doc_id, page ORDER BY dn, x, fill_id)),
 c AS (SELECT *, sum(CASE WHEN py IS NULL OR abs(y - py) > 6 OR x - px > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY dn, x, fill_id ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT doc_id, page, arg_min(fill_id, (dn, x, fill_id)) AS first_fill, CAST(count(*) AS BIGINT) AS swatches, count(DISTINCT (r, g, bl)) AS colors FROM c GROUP BY doc_id, page, k
  HAVING count(*) >= 3 AND count(DISTINCT (r, g, bl)) >= 3"""),
    "orphan_mcids": oracle("stream_mcids tree_mcids", """SELECT doc_id, page, mcid FROM fx_stream_mcids s WHERE tag <> 'Artifact' AND NOT EXISTS (SELECT 1 FROM fx_tree_mcids t WHERE t.doc_id = s.doc_id AND t.page = s.page AND t.mcid = s.mcid)"""),
    "artifact_conflicts": oracle("stream_mcids tree_mcids", """SELECT s.doc_id, s.page, s.mcid, t.tag AS use_tag FROM fx_stream_mcids s JOIN fx_tree_mcids t ON t.doc_id = s.doc_id AND t.page = s.page AND t.mcid = s.mcid WHERE s.tag = 'Artifact'"""),
    "node_text": oracle("stream_mcids tree_mcids", f"""SELECT t.doc_id, t.page, node_id, {strip_sql("string_agg(coalesce(s.text, ''), ' ' ORDER BY pos, t.mcid)")} AS text FROM fx_tree_mcids t LEFT JOIN fx_stream_mcids s ON t.doc_id = s.doc_id AND t.page = s.page AND t.mcid = s.mcid GROUP BY 1, 2, 3"""),
    "unmarked_content": oracle("stream_ops", f"""WITH d AS (SELECT *, sum(CASE WHEN op IN ('BDC', 'BMC') THEN 1 WHEN op = 'EMC' THEN -1 ELSE 0 END) OVER w AS s FROM fx_stream_ops WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq, sub ROWS UNBOUNDED PRECEDING)),
 m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id, page ORDER BY seq, sub ROWS UNBOUNDED PRECEDING)) AS depth FROM d)
SELECT doc_id, page, seq, sub, op FROM m WHERE depth = 0 AND op IN ('Tj', 'TJ', 'S', 'f', 'Do')"""),
    "islands": oracle("tree", f"""WITH RECURSIVE t AS MATERIALIZED (SELECT * FROM fx_tree), top AS (SELECT a.doc_id, a.node_id, a.node_id AS top FROM t a LEFT JOIN t b ON b.doc_id = a.doc_id AND b.node_id = a.parent_id WHERE b.node_id IS NULL
   UNION ALL SELECT t.doc_id, t.node_id, top.top FROM t JOIN top ON top.doc_id = t.doc_id AND top.node_id = t.parent_id)
SELECT top.doc_id, top.top, t.tag, {map_sql(lx.ISLAND_WRAPPERS, 't.tag')} AS wrapper, count(*) AS size FROM top JOIN t ON t.doc_id = top.doc_id AND t.node_id = top.top
WHERE NOT (t.parent_id IS NULL AND t.tag = 'Document') GROUP BY 1, 2, 3, 4"""),
    "hit_test": oracle("spans nodes", _hit("fx_spans", "span", "x0", "y0")),
    "image_hit_test": oracle("images nodes", _hit("fx_images", "image_id", "x", "y", "AND n.tag = 'Figure'")),
    "empty_elements": oracle("nodes", f"WITH {_EMPTY} SELECT * FROM em"),
    "coverage": oracle("page_sizes spans nodes", f"""WITH {_EMPTY}, tx AS (SELECT DISTINCT doc_id, page FROM fx_spans WHERE NOT {blank_sql('text')}),
 orf AS (SELECT doc_id, count(*) AS n FROM tx WHERE NOT EXISTS (SELECT 1 FROM fx_nodes k WHERE k.doc_id = tx.doc_id AND k.page = tx.page) GROUP BY 1),
 tot AS (SELECT doc_id, count(*) AS pages FROM fx_page_sizes GROUP BY 1), e AS (SELECT doc_id, count(*) AS n FROM em GROUP BY 1)
SELECT tot.doc_id, pages, coalesce(orf.n, 0) AS orphaned_pages, CAST(greatest(0, round_even(100e0 * (1 - coalesce(orf.n, 0) / greatest(pages, 1)), 0)) AS INT) AS coverage_pct,
  coalesce(e.n, 0) AS empty_elements FROM tot LEFT JOIN orf USING (doc_id) LEFT JOIN e USING (doc_id)"""),
    "graphical_pages": oracle("elements", f"""WITH w AS (SELECT *, {strip_sql("coalesce(text, '')")} AS t, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM fx_elements)
SELECT doc_id, page, count(*) AS n, 'Figure' AS tag, CASE WHEN count(*) FILTER (WHERE t <> '') = 0 THEN 'Scanned graphical page (map, diagram, or technical drawing)' ELSE
  'Scanned graphical page containing the following text labels: ' || substr(string_agg(t, ' ' ORDER BY pos) FILTER (WHERE t <> ''), 1, 300) END AS alt
FROM w GROUP BY doc_id, page HAVING NOT bool_or(type IN {_in(lx.HEADING_TAGS)}) AND count(*) >= 5 AND avg(n) < 4 AND avg(CASE WHEN n <= 3 THEN 1 ELSE 0 END) >= 0.7"""),
    "text_preview": oracle("nodes", f"""WITH RECURSIVE o AS MATERIALIZED (SELECT doc_id, node_id, parent_id, ord, substr({strip_sql("CASE WHEN coalesce(text, '') <> '' THEN text ELSE coalesce(alt, '') END")}, 1, 60) AS t FROM fx_nodes),
 d AS (SELECT doc_id, node_id AS anc, node_id, ord, t FROM o UNION ALL SELECT d.doc_id, d.anc, o.node_id, o.ord, o.t FROM d JOIN o ON o.doc_id = d.doc_id AND o.parent_id = d.node_id)
SELECT o.doc_id, o.node_id, o.ord, coalesce(p.t, '') AS preview FROM o LEFT JOIN (SELECT doc_id, anc, arg_min(t, ord) AS t FROM d WHERE t <> '' GROUP BY 1, 2) p ON p.doc_id = o.doc_id AND p.anc = o.node_id"""),
    "figure_numbers": oracle("nodes", "SELECT doc_id, node_id, ord, alt, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS figure_no FROM fx_nodes WHERE tag = 'Figure'"),
    "duplicate_ids": oracle("nodes", """WITH d AS (SELECT doc_id, node_id, 'id' || (ord % 7) AS elem_id, ord, min(ord) OVER (PARTITION BY doc_id, ord % 7) AS first_ord FROM fx_nodes)
SELECT doc_id, node_id, elem_id, first_ord FROM d WHERE ord > first_ord"""),
    "box_flip": oracle("spans page_sizes", "SELECT doc_id, page, span, height - y1 AS top_y0, height - y0 AS top_y1 FROM fx_spans JOIN fx_page_sizes USING (doc_id, page)"),
    "fraction_boxes": oracle("spans page_sizes", """WITH f AS (SELECT s.doc_id, s.page, span, width, height, greatest(0, least(1, x0 / 400e0 - 0.1e0)) AS a, greatest(0, least(1, y0 / 700e0 - 0.05e0)) AS b,
   greatest(0, least(1, x1 / 400e0)) AS c, greatest(0, least(1, y1 / 700e0)) AS d FROM fx_spans s JOIN fx_page_sizes p ON p.doc_id = s.doc_id AND p.page = s.page)
SELECT doc_id, page, span, round_even(a * width, 2) AS x0, round_even((1e0 - d) * height, 2) AS y0, round_even(c * width, 2) AS x1, round_even((1e0 - b) * height, 2) AS y1 FROM f"""),
    "node_counts": oracle("nodes", "SELECT doc_id, count(*) AS nodes FROM fx_nodes GROUP BY doc_id"),
}
