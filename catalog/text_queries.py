"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.dialect import Duck, oracle, table, view
from tagloom import lexicon as lx
from tagloom.functions import language as lang
from tagloom.operators import prose as op

_lit = Duck().lit


def _in(values) -> str:
    return "(" + ", ".join(_lit(v) for v in values) + ")"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def script_sql(t: str) -> str:
    arms = " ".join(f"WHEN len(regexp_extract_all({t}, '{r}')) > greatest(3, length({t}) * 0.25) THEN '{c}'" for c, r in lx.SCRIPT_LANGS)
    return f"CASE {arms} END"


def profile_sql(t: str) -> str:
    """Best stop-word language of ``t`` as an expression over its word list."""
    words = f"string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}_]+')"
    n = {k: f"len(list_filter({words}, lambda w: w IN {_in(v)}))" for k, v in lx.STOP_WORDS.items()}
    arms = []
    langs = list(n)
    for i, k in enumerate(langs):
        later = [f"{n[k]} >= {n[o]}" for o in langs[i + 1:]]
        earlier = [f"{n[k]} > {n[o]}" for o in langs[:i]]
        arms.append(f"WHEN {' AND '.join([n[k] + ' > 0', *earlier, *later])} THEN '{k}'")
    return f"CASE {' '.join(arms)} END"


def detect_sql(t: str) -> str:
    s = strip_sql(t)
    return f"CASE WHEN length({s}) >= 8 THEN coalesce({script_sql(s)}, {profile_sql(s)}) END"


def mismatch_sql(t: str, doc: str) -> str:
    arms = []
    for name, rng, expected in lx.SCRIPT_NAMES:
        skip = "".join(f" AND NOT starts_with(lower(coalesce({doc}, '')), '{e}')" for e in expected)
        arms.append(f"WHEN regexp_matches({t}, '{rng}'){skip} THEN '{name}'")
    return f"CASE {' '.join(arms)} END"


def primary_sql(c: str) -> str:
    return f"string_split(replace(lower({strip_sql(c)}), '_', '-'), '-')[1]"


FORMULA_SQL = (
    "(t <> '' AND (regexp_matches(t, {latex}, 'i') OR len(regexp_extract_all(t, {sym})) >= 2 "
    "OR regexp_matches(t, {eq}) OR (length(t) <= 80 AND regexp_matches(t, {inl}) "
    "AND len(list_filter(string_split_regex(t, '\\s+'), lambda w: regexp_matches(w, '^\\p{{L}}{{3,}}$'))) < 3)))"
).format(latex=_lit(lx.LATEX), sym=_lit(lx.MATH_SYMBOLS), eq=_lit(lx.EQUATION_NUMBER), inl=_lit(lx.INLINE_MATH))

_SENS = " UNION ALL ".join(
    f"SELECT *, {i} AS k, '{n}' AS type, {strip_sql(f'regexp_extract(text, {_lit(p)}, 0, {_lit(chr(105))})')} AS m FROM t"
    for i, (n, p) in enumerate(lx.SENSORY_PATTERNS))
_DOCLANG = f"""miss AS (SELECT doc_id FROM fx_docs WHERE coalesce({strip_sql('lang')}, '') = ''),
 parts AS (SELECT doc_id, ord, {strip_sql("coalesce(text, '')")} AS t FROM fx_nodes),
 smp AS (SELECT doc_id, string_agg(t, ' ' ORDER BY ord) AS t FROM parts JOIN miss USING (doc_id) WHERE t <> '' GROUP BY doc_id),
 dl AS (SELECT d.doc_id, CASE WHEN coalesce({strip_sql('lang')}, '') = '' THEN coalesce({detect_sql('smp.t')}, 'en') ELSE lang END AS lang,
   coalesce({strip_sql('lang')}, '') = '' AS was_set FROM fx_docs d LEFT JOIN smp USING (doc_id))"""


def _nodes(s, p):
    return view(s, p, "nodes")


QUERIES = {
    "abbreviations": lambda s, p: op.abbreviations(_nodes(s, p)),
    "top_abbreviations": lambda s, p: op.top_abbreviations(op.abbreviations(_nodes(s, p))),
    "reading_level": lambda s, p: op.reading_level(table(s, p, "documents").select("doc_id", "text")),
    "sensory": lambda s, p: op.sensory(_nodes(s, p)),
    "formulas": lambda s, p: op.tag_formulas(_nodes(s, p)).filter(F.col("tag") == "Formula").select("doc_id", "node_id", "tag", "alt"),
    "script_language": lambda s, p: _nodes(s, p).select("doc_id", "node_id", lang.script_language(F.col("text")).alias("script_lang")),
    "language_issues": lambda s, p: op.language_issues(_nodes(s, p), view(s, p, "docs")),
    "language_profile": lambda s, p: op.node_languages(_nodes(s, p), view(s, p, "docs")),
    "language_repair": lambda s, p: op.language_repairs(_nodes(s, p), view(s, p, "docs")),
    "document_language": lambda s, p: op.document_language(_nodes(s, p), view(s, p, "docs")),
}

# RE2 word boundaries know ASCII only: accented letters become '_' so both engines agree
_MASKED = "regexp_replace(text, '[\\x{C0}-\\x{24F}\\x{370}-\\x{1FFF}\\x{3040}-\\x{D7FF}]', '_', 'g')"
_ABBREV = f"""t AS (SELECT doc_id, unnest(regexp_extract_all({_MASKED}, {_lit(lx.ACRONYM)}, 1)) AS abbreviation, 'acronym' AS type FROM fx_nodes
 UNION ALL SELECT doc_id, lower(unnest(regexp_extract_all({_MASKED}, {_lit(lx.DOTTED)}, 1))), 'dotted' FROM fx_nodes),
 c AS (SELECT doc_id, abbreviation, type, count(*) AS count FROM t WHERE (type = 'acronym' AND abbreviation NOT IN {_in(lx.ABBREVIATION_STOP)})
   OR (type = 'dotted' AND length(abbreviation) >= 3 AND contains(abbreviation, '.')) GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
ORACLES = {
    "abbreviations": oracle("nodes", f"WITH {_ABBREV} SELECT * FROM c"),
    "top_abbreviations": oracle("nodes", f"""WITH {_ABBREV} SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, abbreviation, type) AS INT) AS rank FROM c"""),
    "reading_level": r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[a-zA-Z]+$')) AS ws,
   len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(x, '\s+', '', 'g') <> '')) AS s FROM documents),
 y AS (SELECT doc_id, len(ws) AS n, s, list_sum(list_transform(ws, lambda x: greatest(1, len(regexp_extract_all(regexp_replace(lower(x), 'e$', ''), '[aeiouy]+'))))) AS syl FROM w),
 r AS (SELECT *, n >= 50 AND s >= 5 AS ok, n / s AS wps, syl / n AS spw FROM y),
 g AS (SELECT *, CASE WHEN ok THEN greatest(0e0, round_even(0.39e0 * wps + 11.8e0 * spw - 15.59e0, 1)) END AS grade FROM r)
SELECT doc_id, CAST(n AS INT) AS words, CAST(s AS INT) AS sentences, grade AS grade_level,
  CASE WHEN ok THEN greatest(0e0, least(100e0, round_even(206.835e0 - 1.015e0 * wps - 84.6e0 * spw, 1))) END AS ease,
  CASE WHEN ok THEN round_even(wps, 1) END AS words_per_sentence, CASE WHEN ok THEN round_even(spw, 2) END AS syllables_per_word,
  CASE WHEN grade <= 6 THEN 'good' WHEN grade <= 8 THEN 'ok' WHEN grade <= 12 THEN 'warning' WHEN grade > 12 THEN 'concern' END AS severity FROM g""",
    "sensory": oracle("nodes", f"""WITH t AS (SELECT doc_id, page, ord, 0 AS src, alt AS text FROM fx_nodes WHERE length(alt) >= 20
   UNION ALL SELECT doc_id, page, ord, 1, text FROM fx_nodes WHERE length(text) >= 20), h AS ({_SENS}),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, lower(m) ORDER BY ord, src, k) AS rn FROM h WHERE m <> '')
SELECT doc_id, page, ord, type, substr(text, 1, 120) AS text, substr(m, 1, 80) AS match FROM r WHERE rn = 1"""),
    "formulas": oracle("nodes", f"""WITH n AS (SELECT *, {strip_sql("coalesce(text, '')")} AS t FROM fx_nodes)
SELECT doc_id, node_id, 'Formula' AS tag, CASE WHEN coalesce(alt, '') = '' THEN 'Mathematical expression: ' ||
  CASE WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 77) || '…' END ELSE alt END AS alt FROM n WHERE tag IN {_in(lx.FORMULA_TAGS)} AND {FORMULA_SQL}"""),
    "script_language": oracle("nodes", f"SELECT doc_id, node_id, {script_sql('text')} AS script_lang FROM fx_nodes"),
    "language_issues": oracle("nodes docs", f"""WITH u AS (SELECT n.doc_id, page, ord, tag, {strip_sql('text')} AS t, d.lang FROM fx_nodes n JOIN fx_docs d USING (doc_id)
   WHERE tag IN {_in(lx.LANGUAGE_CHECK_TAGS)} AND language IS NULL),
 v AS (SELECT *, {mismatch_sql('t', 'lang')} AS script FROM u WHERE length(t) >= 15),
 x AS (SELECT *, CASE WHEN script IS NULL AND lang IS NOT NULL THEN {detect_sql('t')} END AS other FROM v),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, lower(t) ORDER BY ord) AS rn FROM x
   WHERE script IS NOT NULL OR (other IS NOT NULL AND NOT starts_with(lower(lang), other)))
SELECT doc_id, 'suspected_language_change' AS type, page, ord, tag, substr(t, 1, 100) AS text, coalesce(script, other) AS detected FROM r WHERE rn = 1
UNION ALL SELECT doc_id, 'missing_doc_lang', NULL, NULL, NULL, NULL, NULL FROM fx_docs WHERE lang IS NULL"""),
    "language_profile": oracle("nodes docs", f"""WITH r AS (SELECT n.doc_id, node_id, ord, {detect_sql('text')} AS language,
   {primary_sql("coalesce(d.lang, 'en')")} AS base FROM fx_nodes n JOIN fx_docs d USING (doc_id)
   WHERE tag IN {_in(lx.NODE_LANGUAGE_TAGS)} AND length({strip_sql("coalesce(text, '')")}) >= 40)
SELECT doc_id, node_id, ord, language FROM r WHERE language <> base"""),
    "document_language": oracle("nodes docs", f"WITH {_DOCLANG} SELECT * FROM dl"),
    "language_repair": oracle("nodes docs", f"""WITH {_DOCLANG},
 r AS (SELECT n.doc_id, node_id, ord, {detect_sql('text')} AS language, {primary_sql('dl.lang')} AS base
   FROM fx_nodes n JOIN dl USING (doc_id) WHERE tag IN {_in(lx.LANGUAGE_REPAIR_TAGS)} AND coalesce({strip_sql('language')}, '') = '')
SELECT doc_id, node_id, ord, language FROM r WHERE language <> base"""),
}
