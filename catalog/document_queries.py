"""Document queries."""

from __future__ import annotations

from catalog.dialect import Duck, oracle, table, view
from catalog.forms_queries import map_sql
from catalog.text_queries import _in, detect_sql, strip_sql
from tagloom import lexicon as lx
from tagloom.operators import document as op

_lit = Duck().lit


def blank_sql(c: str) -> str:
    return f"(coalesce({strip_sql(c)}, '') = '')"


def nz(c: str) -> str:
    return f"nullif({strip_sql(c)}, '')"


_OLD = "(list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) < [1, 4])"
_FAMS = {k: "|".join(v) for k, v in lx.FONT_SUBSTITUTES.items()}
_FILE = ("array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(filename, '(?i)\\.pdf$', ''), '[-_]+', ' ', 'g'), "
         "'[^A-Za-z0-9_]|[A-Za-z0-9_]+'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '')")
_ALTC = f"lower({strip_sql(chr(114) + 'egexp_replace(alt, ' + chr(39) + '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')})"
_GENALT = "|".join(f"(?:{p})" for p in lx.GENERIC_ALT_PATTERNS)


def esc(c: str) -> str:
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{ch}', '{ent}')"
    return c


def head_sql(tags) -> str:
    return f"SELECT doc_id, arg_min({strip_sql('text')}, (tag, ord)) AS h FROM fx_nodes WHERE tag IN {_in(tags)} AND {strip_sql('text')} <> '' GROUP BY doc_id"


QUERIES = {
    "metadata": lambda s, p: op.metadata(view(s, p, "docs")),
    "fonts": lambda s, p: op.fonts(view(s, p, "fonts")),
    "font_plan": lambda s, p: op.font_plan(view(s, p, "fonts")),
    "layers": lambda s, p: op.layers(view(s, p, "layers")),
    "security": lambda s, p: op.security(view(s, p, "docs")),
    "xfa": lambda s, p: op.xfa(view(s, p, "docs")),
    "reflow": lambda s, p: op.reflow(view(s, p, "spans"), view(s, p, "page_sizes")),
    "watermarks": lambda s, p: op.watermarks(view(s, p, "spans"), view(s, p, "images"), view(s, p, "paths"), view(s, p, "page_sizes")),
    "role_map": lambda s, p: op.role_map(view(s, p, "nodes")),
    "titles": lambda s, p: op.titles(view(s, p, "docs"), view(s, p, "nodes")),
    "metadata_autofill": lambda s, p: op.metadata_autofill(view(s, p, "docs"), table(s, p, "documents"), view(s, p, "spans")),
    "catalog_defaults": lambda s, p: op.catalog_defaults(view(s, p, "docs"), view(s, p, "nodes")),
    "alt_quality": lambda s, p: op.alt_quality(view(s, p, "nodes")),
    "alt_placeholder": lambda s, p: op.alt_placeholder(view(s, p, "nodes")),
    "review_questions": lambda s, p: op.review_questions(view(s, p, "nodes"), view(s, p, "docs")),
    "tag_routing": lambda s, p: op.tag_routing(view(s, p, "docs"), view(s, p, "nodes")),
}
ORACLES = {
    "metadata": oracle("docs", f"""SELECT doc_id, 'Title' AS field, 'error' AS severity FROM fx_docs WHERE {blank_sql('title')}
UNION ALL SELECT doc_id, 'Author', 'warning' FROM fx_docs WHERE {blank_sql('author')} UNION ALL SELECT doc_id, 'Subject', 'warning' FROM fx_docs WHERE {blank_sql('subject')}
UNION ALL SELECT doc_id, 'Language', 'error' FROM fx_docs WHERE coalesce(lang, '') = '' UNION ALL SELECT doc_id, 'PDF version', 'info' FROM fx_docs WHERE {_OLD}
UNION ALL SELECT doc_id, 'CreationDate', 'info' FROM fx_docs WHERE {blank_sql('creation_date')}"""),
    "fonts": oracle("fonts", """SELECT doc_id, font_name, 'not_embedded' AS issue, min(page) AS page, 'error' AS severity FROM fx_fonts WHERE NOT embedded GROUP BY 1, 2
UNION ALL SELECT doc_id, font_name, 'no_to_unicode', min(page), 'error' FROM fx_fonts WHERE NOT to_unicode GROUP BY 1, 2"""),
    "font_plan": oracle("fonts", f"""WITH f AS (SELECT doc_id, font_name, bool_and(embedded) AS e, bool_or(subtype = 'Type0') AS c, min(page) AS page FROM fx_fonts GROUP BY 1, 2),
 g AS (SELECT *, {map_sql(_FAMS, "translate(lower(regexp_replace(font_name, '^[^+]*[+]', '')), '- ,_', '')")} AS fam FROM f),
 a AS (SELECT *, CASE WHEN c OR contains(font_name, '+') THEN 'skip_composite_or_subset' WHEN e THEN 'skip_embedded' WHEN fam IS NOT NULL THEN 'substitute' ELSE 'no_match' END AS action FROM g)
SELECT doc_id, font_name, page, action, CASE WHEN action = 'substitute' THEN fam END AS families FROM a"""),
    "layers": oracle("layers", f"""WITH l AS (SELECT *, {strip_sql("coalesce(name, '')")} AS layer FROM fx_layers),
 o AS (SELECT *, bool_or(off_default) OVER (PARTITION BY doc_id, layer) AS off FROM l)
SELECT doc_id, layer_id, layer, 'ocg_no_name' AS type, 'warning' AS severity FROM o WHERE layer = ''
UNION ALL SELECT doc_id, layer_id, layer, 'ocg_hidden_by_default', 'warning' FROM o WHERE layer <> '' AND off
UNION ALL SELECT doc_id, layer_id, layer, 'ocg_print_off', 'info' FROM o WHERE layer <> '' AND print_state = 'OFF'"""),
    "security": oracle("docs", """SELECT doc_id, encrypted, NOT encrypted OR allow_access AS accessibility_allowed, NOT encrypted OR allow_extract AS content_copy_allowed,
  CASE WHEN encrypted AND NOT allow_access THEN 'error' WHEN encrypted AND NOT allow_extract THEN 'warning' ELSE 'ok' END AS severity FROM fx_docs"""),
    "xfa": oracle("docs", "SELECT doc_id, 'xfa_form' AS type FROM fx_docs WHERE has_xfa"),
    "reflow": oracle("spans page_sizes", """WITH w AS (SELECT s.doc_id, s.page, s.span, (x1 - x0) / width AS sh, row_number() OVER (PARTITION BY s.doc_id, s.page ORDER BY block, line, span) AS rn
   FROM fx_spans s JOIN fx_page_sizes p ON s.doc_id = p.doc_id AND s.page = p.page WHERE (x1 - x0) / width > 0.85)
SELECT doc_id, page, 'reflow_risk' AS type, span, round_even(sh * 100, 0) AS value FROM w WHERE rn = 1
UNION ALL SELECT doc_id, page, 'letter_spacing', span, round_even(char_spacing, 2) FROM fx_spans WHERE size > 0 AND char_spacing < -0.5"""),
    "watermarks": oracle("spans images paths page_sizes", f"""WITH c AS (SELECT doc_id, page, 'background_image' AS type, image_id AS item, w * h AS a FROM fx_images
   UNION ALL SELECT doc_id, page, 'background_fill', path_id, w * h FROM fx_paths WHERE filled)
SELECT c.doc_id, c.page, type, item, round_even(a / (width * height) * 100, 0) AS value, NULL AS text FROM c JOIN fx_page_sizes p ON c.doc_id = p.doc_id AND c.page = p.page
  WHERE a / (width * height) >= 0.6
UNION ALL SELECT doc_id, page, 'watermark_text', span, size, substr({strip_sql('text')}, 1, 60) FROM fx_spans WHERE size >= 36 AND regexp_matches(text, {_lit(lx.WATERMARK_WORDS)}, 'i')"""),
    "role_map": oracle("nodes", f"""SELECT DISTINCT doc_id, tag, coalesce({map_sql(lx.ROLE_MAP, 'tag')}, 'NonStruct') AS maps_to FROM fx_nodes WHERE tag NOT IN {_in(lx.STANDARD_TAGS)}"""),
    "titles": oracle("docs nodes", f"""WITH h AS ({head_sql(lx.HEADING_TAGS)})
SELECT d.doc_id, coalesce({nz('title')}, {nz('suggested_title')}, h, trim({_FILE}), '') AS title,
  CASE WHEN {nz('title')} IS NOT NULL THEN 'title' WHEN {nz('suggested_title')} IS NOT NULL THEN 'suggested' WHEN h IS NOT NULL THEN 'heading' ELSE 'filename' END AS origin
FROM fx_docs d LEFT JOIN h USING (doc_id)"""),
    "metadata_autofill": oracle("docs spans", f"""WITH b AS (SELECT doc_id, arg_min({strip_sql('text')}, (page, block, line, span)) AS t FROM fx_spans WHERE size >= 16 AND {strip_sql('text')} <> '' GROUP BY doc_id),
 g AS (SELECT doc_id, coalesce({detect_sql('text')}, 'en') AS l FROM documents)
SELECT d.doc_id, CASE WHEN {blank_sql('lang')} THEN coalesce(g.l, 'en') END AS set_lang, CASE WHEN {blank_sql('title')} THEN b.t END AS set_title
FROM fx_docs d LEFT JOIN g USING (doc_id) LEFT JOIN b USING (doc_id) WHERE {blank_sql('lang')} OR {blank_sql('title')}"""),
    "catalog_defaults": oracle("docs nodes", f"""WITH h AS ({head_sql(['H1'])}), x AS (SELECT d.*, coalesce({nz('title')}, h, 'Untitled Document') AS t,
   coalesce({nz('manifest_lang')}, {nz('lang')}, 'en') AS l FROM fx_docs d LEFT JOIN h USING (doc_id))
SELECT doc_id, true AS marked, true AS display_title, CASE WHEN {blank_sql('lang')} THEN l ELSE {strip_sql('lang')} END AS lang, {esc('t')} AS meta_title, {esc('l')} AS meta_lang,
  CASE WHEN {_OLD} THEN '1.4' ELSE version END AS version, {blank_sql('lang')} AS wrote_lang, NOT marked AS wrote_marked, NOT display_title AS wrote_display_title, {_OLD} AS wrote_version FROM x"""),
    "alt_quality": oracle("nodes", f"""WITH k AS (SELECT *, CASE WHEN alt IS NULL THEN 'missing' WHEN {blank_sql('alt')} THEN 'empty'
   WHEN {_ALTC} = '' OR {_ALTC} IN {_in(lx.GENERIC_ALT)} OR regexp_matches({_ALTC}, {_lit(_GENALT)}, 'i') THEN 'generic' END AS type FROM fx_nodes WHERE tag = 'Figure')
SELECT doc_id, node_id, page, type, CASE WHEN type = 'empty' THEN '' ELSE substr(alt, 1, 120) END AS alt FROM k WHERE type IS NOT NULL"""),
    "alt_placeholder": oracle("nodes", f"""SELECT doc_id, node_id, {_lit(lx.ALT_PLACEHOLDER)} AS alt FROM fx_nodes WHERE tag = 'Figure' AND lower({strip_sql("coalesce(alt, '')")}) IN {_in(lx.PLACEHOLDER_ALT)}"""),
    "review_questions": oracle("nodes docs", f"""SELECT doc_id, 'image_alt' AS type, node_id, page FROM fx_nodes WHERE tag = 'Figure' AND coalesce(alt, '') = '' AND NOT decorative
UNION ALL SELECT doc_id, 'title', NULL, NULL FROM fx_docs WHERE {blank_sql('title')}"""),
    "tag_routing": oracle("docs nodes", """WITH n AS (SELECT doc_id, count(*) AS n FROM fx_nodes GROUP BY 1),
 e AS (SELECT d.*, CAST(CASE WHEN has_struct THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS elements FROM fx_docs d LEFT JOIN n USING (doc_id))
SELECT doc_id, elements, marked, has_struct AND elements >= 5 AS tagged, CASE WHEN has_struct AND elements >= 5 THEN 'repair' ELSE 'rebuild' END AS route,
  CASE WHEN has_struct AND elements >= 5 THEN 'preserve' WHEN NOT has_struct THEN 'no_tree' ELSE 'stub' END AS reason FROM e"""),
}
