"""Repair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.dialect import oracle, view
from catalog.document_queries import blank_sql
from catalog.forms_queries import map_sql
from catalog.tables_queries import _ROWS
from catalog.text_queries import _in, strip_sql
from tagloom import lexicon as lx
from tagloom.operators import document as doc
from tagloom.operators import repair as op


def _ids(s, p):
    return view(s, p, "nodes").select("doc_id", "node_id", F.concat(F.lit("id"), F.col("ord") % 7).alias("elem_id"), "ord")


def _order_nodes(s, p):
    return view(s, p, "nodes").withColumn("is_element", F.col("tag") != "Span")


def _requests(s, p):
    return view(s, p, "order_requests")


def _auto(s, p):
    return op.auto_repairs(view(s, p, "rules"), view(s, p, "docs"), view(s, p, "nodes"), view(s, p, "annots"))


def _clauses(s, p):
    return op.clause_repairs(view(s, p, "rules"), view(s, p, "docs"), view(s, p, "nodes"), view(s, p, "cells"), view(s, p, "annots"), _ids(s, p))


def _round(s, p):
    nodes = view(s, p, "nodes")
    return op.round_trip_checks(view(s, p, "docs"), nodes, nodes.filter(~F.col("artifact")))


def _validation(s, p, failed, *more):
    return view(s, p, "runs").select("doc_id", F.col(failed).alias("failed_checks"), *more)


def _repaired(name):
    return lambda s, p: op.REPAIRS[name](view(s, p, name), view(s, p, "rules"))


QUERIES = {
    **{f"repaired_{name}": _repaired(name) for name in op.REPAIRS},
    "best_of": lambda s, p: op.best_of(_validation(s, p, "failed_out", "mode", "compliant", "validation_failed"), _validation(s, p, "failed_rebuild")),
    "regression_guard": lambda s, p: op.regression_guard(_validation(s, p, "failed_in"), _validation(s, p, "failed_out")),
    "record_merge": lambda s, p: op.merge_records(view(s, p, "runs"), doc.fonts(view(s, p, "fonts"))),
    "patch_nodes": lambda s, p: op.patch(view(s, p, "nodes").select("doc_id", "node_id", "tag", "alt", "decorative"),
                                         op.answers_as_patch(view(s, p, "answers")), ["doc_id", "node_id"]),
    "metadata_patch": lambda s, p: op.patch_metadata(
        view(s, p, "docs"), view(s, p, "docs").select("doc_id", F.col("suggested_title").alias("title"), F.col("manifest_lang").alias("lang"),
                                                      F.col("subject").alias("author"), F.col("author").alias("subject"))),
    "reading_order": lambda s, p: op.reading_order(view(s, p, "nodes")),
    "reorder": lambda s, p: op.reorder(_order_nodes(s, p), _requests(s, p).select("doc_id", "node_id", "pos")),
    "page_reorder": lambda s, p: op.reorder_pages(view(s, p, "nodes"), _requests(s, p)),
    "apply_fixes": lambda s, p: op.apply_fixes(view(s, p, "nodes"), view(s, p, "fixes")),
    "corrected_nodes": lambda s, p: op.corrected(view(s, p, "nodes"), view(s, p, "fixes"))[0].select("doc_id", "node_id", "ord", "tag", "alt"),
    "corrections_log": lambda s, p: op.corrected(view(s, p, "nodes"), view(s, p, "fixes"))[1],
    "catalog_repair": _auto,
    "clause_repair": _clauses,
    "fix_tally": lambda s, p: op.fix_tally(_clauses(s, p)),
    "fixpoint": lambda s, p: op.fix_until_stable(view(s, p, "docs"), view(s, p, "nodes")),
    "doc_digest": lambda s, p: op.digests(view(s, p, "docs"), view(s, p, "nodes")),
    "round_trip": lambda s, p: _round(s, p),
    "round_trip_summary": lambda s, p: op.round_trip_summary(_round(s, p)),
}

_FC = """fc AS (SELECT doc_id, bool_or(clause = '7.1' AND test_number = 3) AS a, bool_or(clause = '7.1' AND test_number = 5) AS b, bool_or(clause = '7.2' AND test_number = 1) AS c,
   bool_or(clause = '7.3' AND test_number = 3) AS d, bool_or(starts_with(clause, '7.1')) AS f1, bool_or(starts_with(clause, '7.2') OR (clause = '7.1' AND test_number = 2)) AS f2,
   bool_or(starts_with(clause, '7.3')) AS f3, bool_or(starts_with(clause, '7.4') OR starts_with(clause, '7.5')) AS f45, bool_or(starts_with(clause, '7.18')) AS f18
   FROM fx_rules WHERE status = 'failed' GROUP BY 1),
 ap AS (SELECT doc_id, count(DISTINCT page) AS n FROM fx_annots GROUP BY 1)"""
_CLAUSE = f"""{_FC}, al AS (SELECT doc_id, count(*) AS n FROM fx_nodes WHERE tag IN ('Figure', 'Formula') AND {blank_sql('alt')} GROUP BY 1),
 sc AS (SELECT doc_id, count(*) AS n FROM fx_cells WHERE tag = 'TH' AND scope IS NULL GROUP BY 1), co AS (SELECT doc_id, count(*) AS n FROM fx_annots WHERE contents IS NULL GROUP BY 1),
 du AS (SELECT doc_id, count(*) - count(DISTINCT ord % 7) AS n FROM fx_nodes GROUP BY 1),
 x AS (SELECT d.*, fc.* EXCLUDE (doc_id), ap.n AS tabs, al.n AS alts, sc.n AS scs, co.n AS cos, du.n AS dus FROM fx_docs d JOIN fc USING (doc_id) LEFT JOIN ap USING (doc_id)
   LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id) LEFT JOIN co USING (doc_id) LEFT JOIN du USING (doc_id)),
 lg AS (SELECT doc_id, 'tab_order' AS repair, tabs AS n FROM x WHERE tabs > 0 UNION ALL SELECT doc_id, 'marked', 1 FROM x WHERE f1 AND NOT marked
   UNION ALL SELECT doc_id, 'display_title', 1 FROM x WHERE f1 AND NOT display_title UNION ALL SELECT doc_id, 'lang', 1 FROM x WHERE f2 AND {blank_sql('lang')}
   UNION ALL SELECT doc_id, 'figure_alt', alts FROM x WHERE f3 AND alts > 0 UNION ALL SELECT doc_id, 'th_scope', scs FROM x WHERE f45 AND scs > 0
   UNION ALL SELECT doc_id, 'annotation_contents', cos FROM x WHERE f18 AND cos > 0 UNION ALL SELECT doc_id, 'duplicate_ids', dus FROM x WHERE dus > 0)"""
_LABEL = f"coalesce({map_sql(lx.ORDER_LABELS, 'tag')}, 'Other')"
_SHOWN = f"CASE WHEN coalesce(alt, '') <> '' THEN alt ELSE {strip_sql(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} END"
_KEY = "trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"
_RT = f"""hw AS (SELECT doc_id, count(*) FILTER (WHERE tag IN {_in(lx.HEADING_TAGS)}) AS wh, count(*) FILTER (WHERE tag IN {_in(lx.HEADING_TAGS)} AND NOT artifact) AS gh,
   count(*) FILTER (WHERE tag = 'Figure' AND {blank_sql('alt')} AND NOT artifact) AS bare FROM fx_nodes GROUP BY 1),
 z AS (SELECT d.*, coalesce(wh, 0) AS wh, coalesce(gh, 0) AS gh, coalesce(bare, 0) AS bare, lower({strip_sql("coalesce(lang, '')")}) AS lg, lower({strip_sql("coalesce(manifest_lang, '')")}) AS ml,
   {strip_sql("coalesce(title, '')")} AS tt FROM fx_docs d LEFT JOIN hw USING (doc_id)),
 rt AS (SELECT doc_id, 'RT-1' AS check, 'error' AS severity, lg <> '' AS passed FROM z UNION ALL SELECT doc_id, 'RT-2', 'error', marked FROM z UNION ALL SELECT doc_id, 'RT-3', 'warning', display_title FROM z
   UNION ALL SELECT doc_id, 'RT-4', 'error', has_ua_id FROM z UNION ALL SELECT doc_id, 'RT-5', 'warning', tt <> '' AND tt <> 'Untitled Document' FROM z UNION ALL SELECT doc_id, 'RT-6', 'error', has_struct FROM z
   UNION ALL SELECT doc_id, 'RT-7', 'error', bare = 0 FROM z WHERE has_struct UNION ALL SELECT doc_id, 'RT-8', 'warning', wh = 0 OR gh >= wh * 0.8e0 FROM z WHERE has_struct
   UNION ALL SELECT doc_id, 'RT-9', 'warning', ml = '' OR lg = '' OR starts_with(lg, substr(ml, 1, 2)) FROM z WHERE has_struct)"""
_RTV = "docs nodes"
_FIXES = f"""e AS (SELECT doc_id, node_id, tag, {_KEY.format(c='text')} AS k FROM fx_nodes),
 r AS (SELECT *, {_KEY.format(c='target_text')} AS t FROM fx_fixes WHERE action = 'retag'), v AS (SELECT * FROM r WHERE new_tag IN {_in(lx.ALLOWED_RETAGS)} AND length(t) >= 3),
 m AS (SELECT v.doc_id, v.fix_id, v.new_tag, count(*) FILTER (WHERE k = t) AS ne, count(k) AS np, arg_min(node_id, node_id) FILTER (WHERE k = t) AS eid, arg_min(tag, node_id) FILTER (WHERE k = t) AS etag,
   min(node_id) AS pid, arg_min(tag, node_id) AS ptag FROM v LEFT JOIN (SELECT * FROM e WHERE length(k) >= 3) e ON e.doc_id = v.doc_id AND (starts_with(k, t) OR starts_with(t, k)) GROUP BY 1, 2, 3),
 q AS (SELECT *, CASE WHEN ne > 0 THEN ne ELSE np END AS n, CASE WHEN ne > 0 THEN eid ELSE pid END AS nid, CASE WHEN ne > 0 THEN etag ELSE ptag END AS tg FROM m),
 o AS (SELECT *, coalesce(lag(new_tag) OVER (PARTITION BY doc_id, nid ORDER BY fix_id), tg) AS bt FROM q WHERE n = 1),
 fg AS (SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS fno FROM fx_nodes WHERE tag = 'Figure'),
 al AS (SELECT f.doc_id, f.fix_id, fg.node_id, {strip_sql("coalesce(new_alt, '')")} AS v FROM fx_fixes f LEFT JOIN fg ON fg.doc_id = f.doc_id AND fg.fno = f.figure_number WHERE action = 'set_alt'),
 u AS (SELECT doc_id, fix_id, nid AS node_id, CASE WHEN bt = new_tag THEN 'already tagged ' || new_tag END AS why, new_tag AS value FROM o
   UNION ALL SELECT doc_id, fix_id, NULL, n || ' elements matched, need exactly 1', NULL FROM q WHERE n <> 1
   UNION ALL SELECT doc_id, fix_id, NULL, 'invalid retag parameters', NULL FROM r WHERE NOT (new_tag IN {_in(lx.ALLOWED_RETAGS)} AND length(t) >= 3)
   UNION ALL SELECT doc_id, fix_id, CASE WHEN v <> '' THEN node_id END, CASE WHEN node_id IS NULL OR v = '' THEN 'figure not found or empty alt' END, CASE WHEN node_id IS NOT NULL AND v <> '' THEN v END FROM al
   UNION ALL SELECT doc_id, fix_id, NULL, CASE WHEN {strip_sql("coalesce(new_title, '')")} = '' THEN 'empty title' END, nullif({strip_sql("coalesce(new_title, '')")}, '') FROM fx_fixes WHERE action = 'set_title'
   UNION ALL SELECT doc_id, fix_id, NULL, 'unknown action ' || action, NULL FROM fx_fixes WHERE action NOT IN ('retag', 'set_alt', 'set_title'))"""
_CORRECTED = """dn AS (SELECT u.*, why IS NULL AS applied, f.action FROM u JOIN fx_fixes f USING (doc_id, fix_id)),
 lt AS (SELECT doc_id, node_id, arg_max(value, fix_id) FILTER (action = 'retag') AS nt, arg_max(value, fix_id) FILTER (action = 'set_alt') AS na FROM dn WHERE applied AND node_id IS NOT NULL GROUP BY 1, 2),
 ch AS (SELECT n.doc_id, n.node_id, n.ord, coalesce(nt, tag) AS tag, coalesce(na, alt) AS alt FROM fx_nodes n LEFT JOIN lt USING (doc_id, node_id)),
 hd AS (SELECT doc_id, ord, CAST(substr(tag, 2, 1) AS INT) AS level, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM ch
   WHERE regexp_full_match(tag, 'H[1-6]') AND doc_id IN (SELECT doc_id FROM dn WHERE applied AND action = 'retag')),
 hl AS (SELECT *, i + min(CASE WHEN i = 1 THEN 1 ELSE level END - i) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS nl FROM hd)"""

ORACLES = {
    "best_of": oracle("runs", """WITH r AS (SELECT *, NOT compliant AND coalesce(mode, 'rebuild') = 'repair' AND NOT validation_failed AND failed_rebuild < failed_out AS w FROM fx_runs)
SELECT doc_id, CASE WHEN w THEN 'rebuild' ELSE coalesce(mode, 'rebuild') END AS mode, w AS rebuild_used, CASE WHEN w THEN failed_rebuild ELSE failed_out END AS failed_checks FROM r"""),
    "regression_guard": oracle("runs", """SELECT doc_id, failed_out > failed_in AS triggered, CASE WHEN failed_out > failed_in THEN failed_in END AS input_failed,
  CASE WHEN failed_out > failed_in THEN failed_out END AS rejected_failed, least(failed_in, failed_out) AS failed_checks FROM fx_runs"""),
    "record_merge": oracle("runs fonts", """WITH i AS (SELECT doc_id, font_name FROM fx_fonts WHERE NOT embedded GROUP BY 1, 2 UNION ALL SELECT doc_id, font_name FROM fx_fonts WHERE NOT to_unicode GROUP BY 1, 2),
 n AS (SELECT doc_id, count(*) AS n FROM i GROUP BY 1)
SELECT doc_id, compliant OR coalesce(contains(lower(note), 'compliant'), false) AS compliant, CASE WHEN fonts_embedded THEN 0 ELSE coalesce(n, 0) END AS font_errors FROM fx_runs LEFT JOIN n USING (doc_id)"""),
    "patch_nodes": oracle("nodes answers", f"""WITH a AS (SELECT doc_id, node_id, CASE WHEN decorative THEN '' ELSE {strip_sql('value')} END AS alt, decorative FROM fx_answers WHERE decorative OR {strip_sql('value')} <> '')
SELECT n.doc_id, n.node_id, tag, coalesce(a.alt, n.alt) AS alt, coalesce(a.decorative, n.decorative) AS decorative FROM fx_nodes n LEFT JOIN a ON a.doc_id = n.doc_id AND a.node_id = n.node_id"""),
    "metadata_patch": oracle("docs", """SELECT doc_id, coalesce(nullif(suggested_title, ''), title) AS title, coalesce(nullif(subject, ''), author) AS author, coalesce(nullif(author, ''), subject) AS subject,
  coalesce(nullif(manifest_lang, ''), lang) AS lang, CASE WHEN coalesce(suggested_title, '') <> '' THEN 'Title,' ELSE '' END || CASE WHEN coalesce(subject, '') <> '' THEN 'Author,' ELSE '' END ||
  CASE WHEN coalesce(author, '') <> '' THEN 'Subject,' ELSE '' END || CASE WHEN coalesce(manifest_lang, '') <> '' THEN 'Lang,' ELSE '' END || 'ViewerPreferences.DisplayDocTitle' AS patched FROM fx_docs"""),
    "reading_order": oracle("nodes", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i FROM fx_nodes WHERE parent_id IS NULL),
 k AS (SELECT doc_id, parent_id, count(*) AS n FROM fx_nodes GROUP BY 1, 2)
SELECT t.doc_id, 'e' || i AS id, t.node_id, {_LABEL} AS type, tag, substr({_SHOWN}, 1, 80) AS preview, coalesce(k.n, 0) AS children FROM t LEFT JOIN k ON k.doc_id = t.doc_id AND k.parent_id = t.node_id"""),
    "reorder": oracle("nodes order_requests", """WITH e AS (SELECT n.doc_id, n.node_id, n.ord, r.pos FROM fx_nodes n LEFT JOIN fx_order_requests r ON r.doc_id = n.doc_id AND r.node_id = n.node_id WHERE n.tag <> 'Span'),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY pos IS NULL, coalesce(pos, ord), ord) AS t FROM e)
SELECT a.doc_id, a.node_id, a.ord AS old_ord, b.ord AS new_ord, a.ord <> b.ord AS moved FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.s = a.t"""),
    "page_reorder": oracle("nodes order_requests", """WITH pg AS (SELECT DISTINCT doc_id, page FROM fx_order_requests),
 x AS (SELECT n.doc_id, n.node_id, n.ord, r.pos, CASE WHEN pg.page IS NULL THEN n.ord ELSE min(n.ord) OVER (PARTITION BY n.doc_id, n.page) END AS a FROM fx_nodes n LEFT JOIN pg ON pg.doc_id = n.doc_id AND pg.page = n.page
   LEFT JOIN fx_order_requests r ON r.doc_id = n.doc_id AND r.node_id = n.node_id)
SELECT doc_id, node_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY a, pos IS NULL, coalesce(pos, ord), ord) AS rank FROM x"""),
    "apply_fixes": oracle("nodes fixes", f"WITH {_FIXES} SELECT *, why IS NULL AS applied FROM u"),
    "corrected_nodes": oracle("nodes fixes", f"""WITH {_FIXES}, {_CORRECTED}
SELECT ch.doc_id, ch.node_id, ch.ord, CASE WHEN nl <> level THEN 'H' || nl ELSE ch.tag END AS tag, ch.alt FROM ch LEFT JOIN hl USING (doc_id, ord)"""),
    "corrections_log": oracle("nodes fixes", f"""WITH {_FIXES}, {_CORRECTED}
SELECT doc_id, fix_id, action, node_id, applied, why, value FROM dn
UNION ALL SELECT doc_id, NULL, 'heading_levels', NULL, true, NULL, CAST(count(*) AS VARCHAR) FROM hl WHERE nl <> level GROUP BY doc_id"""),
    "catalog_repair": oracle("rules docs nodes annots", f"""WITH {_FC}, fe AS (SELECT DISTINCT doc_id, 1 AS e FROM fx_nodes WHERE tag = 'Figure' AND alt IS NOT NULL AND {blank_sql('alt')}),
 x AS (SELECT * FROM fx_docs JOIN fc USING (doc_id) LEFT JOIN fe USING (doc_id) LEFT JOIN ap USING (doc_id))
SELECT doc_id, 'marked' AS repair, CAST(1 AS BIGINT) AS n FROM x WHERE a AND NOT marked UNION ALL SELECT doc_id, 'display_title', 1 FROM x WHERE b AND NOT display_title
UNION ALL SELECT doc_id, 'lang', 1 FROM x WHERE c AND {blank_sql('lang')} UNION ALL SELECT doc_id, 'figure_alt', 1 FROM x WHERE d AND e = 1 UNION ALL SELECT doc_id, 'tab_order', n FROM x WHERE n > 0"""),
    "clause_repair": oracle("rules docs nodes cells annots", f"WITH {_CLAUSE} SELECT * FROM lg"),
    "fix_tally": oracle("rules docs nodes cells annots", f"""WITH {_CLAUSE} SELECT doc_id, repair AS step, CAST(sum(n) AS BIGINT) AS fixes FROM lg GROUP BY 1, 2
UNION ALL SELECT doc_id, 'total', CAST(sum(n) AS BIGINT) FROM lg GROUP BY 1"""),
    "fixpoint": oracle("docs nodes", f"""WITH al AS (SELECT doc_id, count(*) FILTER (WHERE alt IS NOT NULL) AS e, count(*) FILTER (WHERE alt IS NULL) AS m FROM fx_nodes WHERE tag = 'Figure' AND {blank_sql('alt')} GROUP BY 1),
 x AS (SELECT doc_id, has_struct AS s, CAST(NOT marked AS BIGINT) + CAST(NOT display_title AS BIGINT) + CAST({blank_sql('lang')} AS BIGINT) + coalesce(e, 0) AS e, coalesce(m, 0) AS mf,
   coalesce(m, 0) + CASE WHEN coalesce(m, 0) > 0 OR false THEN (SELECT count(*) FROM fx_nodes n WHERE n.doc_id = d.doc_id AND n.tag = 'Formula' AND {blank_sql('n.alt')}) ELSE 0 END AS m FROM fx_docs d LEFT JOIN al USING (doc_id))
SELECT doc_id, s AS compliant, CAST(CASE WHEN s THEN CASE WHEN mf > 0 THEN 2 WHEN e > 0 THEN 1 ELSE 0 END ELSE CASE WHEN m > 0 THEN 3 ELSE 2 END END AS INT) AS rounds,
  CAST(e + m AS BIGINT) AS fixes, NOT s AS open FROM x"""),
    "repaired_docs": oracle("rules docs", f"""WITH {_FC.split(",\n ap AS")[0]} SELECT d.* REPLACE (d.marked OR coalesce(f1, false) AS marked, d.display_title OR coalesce(f1, false) AS display_title,
  CASE WHEN coalesce(f2, false) AND {blank_sql('d.lang')} THEN 'en' ELSE d.lang END AS lang) FROM fx_docs d LEFT JOIN fc USING (doc_id)"""),
    "repaired_nodes": oracle("rules nodes", f"""WITH {_FC.split(",\n ap AS")[0]} SELECT n.* REPLACE (CASE WHEN f3 AND tag IN ('Figure', 'Formula') AND {blank_sql('alt')} THEN 'Image' ELSE alt END AS alt)
FROM fx_nodes n LEFT JOIN fc USING (doc_id)"""),
    "repaired_annots": oracle("rules annots", f"""WITH {_FC.split(",\n ap AS")[0]} SELECT a.* REPLACE (CASE WHEN f18 AND contents IS NULL THEN coalesce(uri, ' ') ELSE contents END AS contents)
FROM fx_annots a LEFT JOIN fc USING (doc_id)"""),
    "repaired_cells": oracle("rules cells", f"""WITH {_FC.split(",\n ap AS")[0]}, {_ROWS} SELECT x.* REPLACE (CASE WHEN f45 AND x.tag = 'TH' AND coalesce(scope, '') = ''
  THEN CASE WHEN i = 1 AND head_id = cell_id THEN 'Both' WHEN i = 1 THEN 'Column' ELSE 'Row' END ELSE scope END AS scope)
FROM fx_cells x JOIN rk USING (doc_id, table_id, row) LEFT JOIN fc ON fc.doc_id = x.doc_id"""),
    "doc_digest": oracle("docs nodes", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM fx_nodes WHERE parent_id IS NULL),
 te AS (SELECT doc_id, string_agg({_LABEL} || ': ' || substr({_SHOWN}, 1, 120), chr(10) ORDER BY ord) AS elements FROM t WHERE i <= 150 GROUP BY 1),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM fx_nodes WHERE tag = 'Figure'),
 fa AS (SELECT doc_id, string_agg(CASE WHEN coalesce(alt, '') = '' THEN '(NO ALT)' ELSE alt END, chr(10) ORDER BY ord) AS figure_alts FROM f WHERE i <= 40 GROUP BY 1)
SELECT d.doc_id, nullif(title, '') AS title, nullif(lang, '') AS lang, elements, figure_alts FROM fx_docs d LEFT JOIN te USING (doc_id) LEFT JOIN fa USING (doc_id)"""),
    "round_trip": oracle(_RTV, f"WITH {_RT} SELECT * FROM rt"),
    "round_trip_summary": oracle(_RTV, f"""WITH {_RT} SELECT doc_id, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, count(*) FILTER (WHERE NOT passed AND severity = 'error') AS errors,
  CAST(least(40, sum(CASE WHEN passed THEN 0 WHEN severity = 'error' THEN 10 ELSE 3 END)) AS BIGINT) AS penalty FROM rt GROUP BY 1"""),
}
