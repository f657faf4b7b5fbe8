"""Link, form and annotation queries."""

from __future__ import annotations

from catalog.dialect import Duck, oracle, view
from catalog.text_queries import _in, strip_sql
from tagloom import lexicon as lx
from tagloom.operators import interactive as op

_lit = Duck().lit


def title_sql(c: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({c}, '[^\\p{{L}}]|\\p{{L}}+'), "
            f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')")


def map_sql(mapping: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in mapping.items()) + " END"


def link_label_sql(u: str) -> str:
    host = f"replace(regexp_extract({u}, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?//([^/?#]*)', 1), 'www.', '')"
    domain = f"CASE WHEN {host} = '' THEN substr({u}, 1, 40) ELSE {host} END"
    path = (f"regexp_replace(regexp_replace({u}, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?(?://[^/?#]*)?', ''), "
            f"'[?#].*$|;[^/?#]*(?:[?#].*)?$', '')")
    parts = f"list_filter(string_split({path}, '/'), lambda p: p <> '')"
    last = strip_sql(f"translate(regexp_replace({parts}[-1], '\\.\\w{{2,5}}$', ''), '-_', '  ')")
    parent = strip_sql(f"translate({parts}[-2], '-_', '  ')")

    def telling(s):
        return f"CASE WHEN {s} <> '' AND lower({s}) NOT IN {_in(lx.GENERIC_SLUGS)} THEN {s} END"
    slug = f"coalesce({telling(last)}, {telling(parent)})"
    return (f"CASE WHEN coalesce({u}, '') = '' THEN 'Link' WHEN {slug} IS NOT NULL THEN {title_sql(slug)} || ' — ' || {domain} "
            f"ELSE 'Resource on ' || {domain} END")


_PREFIX = "CASE " + " ".join(
    f"WHEN starts_with(lower(r), '{p}') AND length(r) > {len(p)} THEN substr(r, {len(p) + 1})" for p in lx.FIELD_PREFIXES) + " ELSE r END"
_GENERIC = "|".join(f"(?:{p})" for p in lx.NONDESCRIPTIVE_LINKS)
_NAMED = f"coalesce({map_sql(lx.ANNOTATION_LABELS, 'subtype')}, subtype || ' annotation')"
_NAMED2 = f"coalesce({map_sql(lx.ANNOTATION_CONTENTS_LABELS, 'subtype')}, subtype || ' annotation')"
_NEED = f"subtype IN {_in(lx.NEEDS_CONTENTS)} AND F & 3 = 0 AND coalesce({strip_sql('contents')}, '') = ''"

QUERIES = {
    "link_quality": lambda s, p: op.link_quality(view(s, p, "links")),
    "link_text": lambda s, p: op.link_text(view(s, p, "links")),
    "link_labels": lambda s, p: op.link_labels(view(s, p, "links")),
    "field_labels": lambda s, p: op.field_labels(view(s, p, "fields")),
    "widget_labels": lambda s, p: op.widget_labels(view(s, p, "fields")),
    "radio_groups": lambda s, p: op.radio_groups(view(s, p, "nodes"), view(s, p, "fields")),
    "label_in_name": lambda s, p: op.label_in_name(view(s, p, "fields"), view(s, p, "spans")),
    "annotation_descriptions": lambda s, p: op.annotation_descriptions(view(s, p, "annots")),
    "annotation_contents": lambda s, p: op.annotation_contents(view(s, p, "annots")),
    "annotation_needs_description": lambda s, p: op.needs_contents(view(s, p, "annots")).select("doc_id", "page", "annot_id", "subtype"),
    "target_size": lambda s, p: op.target_size(view(s, p, "annots")),
}
ORACLES = {
    "link_quality": oracle("links", f"""WITH n AS (SELECT *, {strip_sql("coalesce(text, '')")} AS t, rtrim({strip_sql('lower(text)')}, '.,;:') AS nm FROM fx_links
   WHERE coalesce(uri, '') <> ''),
 k AS (SELECT *, CASE WHEN nm IN {_in(lx.GENERIC_LINKS)} OR {' OR '.join(f"starts_with(nm, '{x}')" for x in lx.GENERIC_LINK_STARTS)} THEN 'generic'
   WHEN regexp_matches(t, {_lit(lx.URL_TEXT)}, 'i') THEN 'url' WHEN regexp_matches(nm, {_lit(lx.SHORT_LINK)}) THEN 'short' END AS type FROM n WHERE t <> '')
SELECT doc_id, page, link_id, type, substr(t, 1, 120) AS text, substr(uri, 1, 200) AS url FROM k WHERE type IS NOT NULL"""),
    "link_text": oracle("links", f"""WITH n AS (SELECT doc_id, page, link_id, uri, CASE WHEN {strip_sql("coalesce(text, '')")} <> '' THEN {strip_sql('text')}
   WHEN coalesce(contents, '') <> '' THEN contents ELSE substr(coalesce(uri, ''), 1, 80) END AS text FROM fx_links),
 s AS (SELECT *, {strip_sql('text')} AS t FROM n),
 k AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN length(t) <= 1 THEN 'single_character'
   WHEN regexp_matches(t, '^[^\\p{{L}}\\p{{Nl}}\\p{{No}}_]+$') THEN 'numeric_or_punctuation' WHEN regexp_matches(t, {_lit(_GENERIC)}, 'i') THEN 'generic'
   WHEN regexp_matches(t, {_lit(lx.BARE_URL)}, 'i') THEN 'bare_url' WHEN regexp_matches(t, {_lit(lx.BARE_DOMAIN)}, 'i') THEN 'bare_domain' END AS reason FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, lower(text) ORDER BY link_id) AS rn FROM k WHERE reason IS NOT NULL)
SELECT doc_id, page, link_id, reason, substr(text, 1, 120) AS text, substr(uri, 1, 200) AS url FROM r WHERE rn = 1"""),
    "link_labels": oracle("links", f"SELECT doc_id, page, link_id, uri, {link_label_sql('uri')} AS label FROM fx_links"),
    "field_labels": oracle("fields", f"""WITH a AS (SELECT *, {strip_sql('T')} AS r FROM fx_fields WHERE T IS NOT NULL),
 b AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace({_PREFIX}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_\\-.]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM a)
SELECT doc_id, field_id, T AS name, CASE WHEN s = '' THEN {title_sql('T')} ELSE array_to_string(list_transform(string_split(s, ' '), lambda w:
   CASE WHEN lower(w) IN {_in(lx.FIELD_ACRONYMS)} THEN upper(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') END
   || CASE WHEN Ff & 2 <> 0 THEN ' (required)' ELSE '' END AS label, coalesce({map_sql(lx.FIELD_TYPES, "coalesce(FT, 'Tx')")}, 'field') AS type,
  Ff & 2 <> 0 AS required, coalesce({strip_sql('TU')}, '') = '' AS fixed FROM b"""),
    "widget_labels": oracle("fields", """SELECT f.doc_id, f.field_id, coalesce(nullif(f.TU, ''), nullif(f.T, ''), nullif(g.TU, ''), nullif(g.T, ''), 'Form field') AS label
FROM fx_fields f LEFT JOIN fx_fields g ON f.doc_id = g.doc_id AND f.parent_id = g.field_id"""),
    "radio_groups": oracle("nodes fields", """WITH g AS (SELECT doc_id, T AS field_name, arg_max(coalesce(nullif(TU, ''), T), field_id) AS tu, arg_max(Ff & 2 <> 0, field_id) AS req
   FROM fx_fields WHERE FT = 'Btn' AND Ff & 32768 <> 0 AND Ff & 65536 = 0 AND T <> '' GROUP BY 1, 2),
 f AS (SELECT n.*, row_number() OVER (PARTITION BY n.doc_id, n.field_name ORDER BY ord) = 1 AS lead, tu, req FROM fx_nodes n JOIN g USING (doc_id, field_name) WHERE tag = 'Form')
SELECT doc_id, node_id, field_name, lead AS radio_group, NOT lead AS member, CASE WHEN lead AND coalesce(alt, '') = '' THEN tu ELSE alt END AS alt,
  CASE WHEN lead THEN req END AS required FROM f"""),
    "label_in_name": oracle("fields spans", f"""WITH f AS (SELECT doc_id, page, field_id, T AS field_name, {strip_sql("coalesce(nullif(TU, ''), T, '')")} AS accessible_name, x0 AS fx0, y0 AS fy0, x1 AS fx1, y1 AS fy1
   FROM fx_fields WHERE FT IS NOT NULL),
 s AS (SELECT doc_id, page, span, {strip_sql('text')} AS t, y0, x0, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM fx_spans),
 p AS (SELECT f.*, t, y0, x0, span, cx BETWEEN greatest(0, fx0 - 120) AND fx0 + 4 AND cy BETWEEN fy0 - 4 AND fy1 + 120 AS l,
   cx BETWEEN fx0 - 8 AND fx1 + 8 AND cy BETWEEN fy1 - 2 AND fy1 + 40 AS a FROM f JOIN s USING (doc_id, page) WHERE t <> '' AND accessible_name <> ''),
 u AS (SELECT *, 0 AS region FROM p WHERE l UNION ALL SELECT *, 1 FROM p WHERE a),
 g AS (SELECT doc_id, page, field_id, field_name, accessible_name, string_agg(t, ' ' ORDER BY region, -y0, x0, span) AS al FROM u GROUP BY ALL),
 v AS (SELECT *, {strip_sql('al')} AS visible_label FROM g),
 w AS (SELECT *, {" , ".join(f"lower(trim(regexp_replace(regexp_replace({c}, '[^{chr(92)}p{{L}}{chr(92)}p{{N}}_{chr(92)}s]', ' ', 'g'), '{chr(92)}s+', ' ', 'g'))) AS {a}" for c, a in (("accessible_name", "nn"), ("visible_label", "ll")))} FROM v)
SELECT doc_id, page, field_id, field_name, accessible_name, visible_label FROM w WHERE length(visible_label) >= 2 AND length(ll) >= 2 AND NOT contains(nn, ll)"""),
    "annotation_descriptions": oracle("annots", f"""SELECT doc_id, page, annot_id, subtype, substr(CASE WHEN subtype = 'Link' THEN
   CASE WHEN coalesce(uri, '') <> '' THEN {link_label_sql('uri')} WHEN uri IS NULL AND dest IS NOT NULL THEN 'Link within this document' ELSE 'Link' END
   ELSE {_NAMED} END, 1, 200) AS description FROM fx_annots WHERE subtype NOT IN ('Widget', 'Popup') AND F & 2 = 0 AND coalesce({strip_sql('contents')}, '') = ''"""),
    "annotation_contents": oracle("annots", f"""SELECT doc_id, page, annot_id, subtype, CASE WHEN subtype = 'Text' AND author IS NOT NULL THEN 'Note by ' || author
   WHEN subtype IN ('Highlight', 'Underline', 'StrikeOut', 'Squiggly') THEN {_NAMED2} || ' — see surrounding text' ELSE {_NAMED2} END AS contents FROM fx_annots WHERE {_NEED}"""),
    "annotation_needs_description": oracle("annots", f"SELECT doc_id, page, annot_id, subtype FROM fx_annots WHERE {_NEED}"),
    "target_size": oracle("annots", """SELECT doc_id, page, annot_id, subtype AS type, round_even(x1 - x0, 1) AS width_pt, round_even(y1 - y0, 1) AS height_pt, 18e0 AS min_pt
FROM fx_annots WHERE subtype IN ('Widget', 'Link') AND x1 - x0 < 18 AND y1 - y0 < 18"""),
}
