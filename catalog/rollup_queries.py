"""Rollup and report queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F

from catalog import colour_queries, document_queries, forms_queries, layout_queries, repair_queries, tables_queries, text_queries
from catalog.dialect import Duck, oracle, table, view
from catalog.document_queries import blank_sql
from catalog.forms_queries import map_sql
from catalog.text_queries import _in, strip_sql
from tagloom import lexicon as lx
from tagloom.operators import layout
from tagloom.operators import repair as rp
from tagloom.plans import audit as op
from tagloom.plans import repair_sequence
from tagloom.session import shared_dir
from tagloom.streaming import records

_lit = Duck().lit


class FixtureTables(Mapping):
    """The audit's tables as fixture views."""

    names = {"pages": "page_sizes"}
    given = {"texts": "documents"}

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    def __getitem__(self, name):
        if name in self.given:
            return table(self.spark, self.sf, self.given[name])
        return view(self.spark, self.sf, self.names.get(name, name))

    def __iter__(self):
        return iter(("spans", "annots", "paths", "pages", "images", "links", "nodes", "cells", "tables", "docs", "fills", "fonts", "layers", "fields", "texts"))

    def __len__(self):
        return 15


def _record(s, p):
    return op.conformance(op.finding_counts(FixtureTables(s, p)))


def _sink(s, p):
    """Findings written by check and read back, as one JSON record per document."""
    path = shared_dir(s, "findings")
    op.write_findings(op.findings(FixtureTables(s, p)), path)
    return op.records_as_json(op.conformance(op.counted(s.read.parquet(path))))


def _bench(s, p):
    names = op.BENCH_CHECKS
    return op.bench_rows(view(s, p, "runs"), op.conformance(op.finding_counts(FixtureTables(s, p), names), names))


def _scores(s, p):
    t = FixtureTables(s, p)
    names = ["contrast", "link_quality", "nontext_contrast", "font", "metadata", "headings", "label_name"]
    nodes = t["nodes"]
    trip = rp.round_trip_summary(rp.round_trip_checks(t["docs"], nodes, nodes.filter(~F.col("artifact"))))
    return op.scores(op.checklist(nodes, t["docs"], t["cells"]), op.conformance(op.finding_counts(t, names), names), view(s, p, "runs"),
                     layout.coverage(t["pages"], t["spans"], nodes), trip)


def _written_report(s, p):
    """Whole reports, written as lines and read back."""
    path = shared_dir(s, "report")
    op.write_report_lines(op.report_lines(op.findings(FixtureTables(s, p)), view(s, p, "rules"), view(s, p, "docs")), path)
    return op.read_report_lines(s, path)


#: The tables that the checks read.
AUDITED = ["spans", "annots", "paths", "pages", "images", "links", "nodes", "cells", "tables", "docs", "fills", "fonts", "layers", "fields", "texts"]


def _streamed_record(s, p):
    """All documents arrive in two batches, those with odd ids a second time; the record after both."""
    arriving = shared_dir(s, "arriving")
    ids = table(s, p, "documents").select("doc_id")
    for part in (ids, ids.filter(F.col("doc_id") % 2 == 1)):
        part.coalesce(1).write.mode("append").parquet(arriving)
    stream = s.readStream.schema("doc_id long").option("maxFilesPerTrigger", 1).parquet(arriving)
    known = FixtureTables(s, p)
    sink = shared_dir(s, "counts")
    records.audit_arrivals(stream, {name: known[name] for name in AUDITED}, sink, shared_dir(s, "stream-state")).awaitTermination()
    return records.record(s, sink)


QUERIES = {
    "conformance": _record,
    "findings_sink": _sink,
    "corpus_rollup": lambda s, p: op.check_rollup(op.finding_counts(FixtureTables(s, p))),
    "bench_rows": _bench,
    "scoreboard": lambda s, p: op.scoreboard(_bench(s, p)),
    "score": _scores,
    "grades": lambda s, p: _scores(s, p).join(view(s, p, "docs").select("doc_id", "has_struct"), "doc_id").select(
        "doc_id", "score", op.grade(F.col("score"), F.col("has_struct")).alias("grade")),
    "signals": lambda s, p: op.signals(view(s, p, "nodes"), view(s, p, "docs"), op.conformance(
        op.finding_counts(FixtureTables(s, p), op.SIGNAL_CHECKS), op.SIGNAL_CHECKS)),
    "clause_frequency": lambda s, p: op.clause_frequency(view(s, p, "rules")),
    "top_clauses": lambda s, p: op.clause_frequency(view(s, p, "rules")).orderBy(F.col("docs").desc(), "clause"),
    "slowest": lambda s, p: op.slowest(view(s, p, "runs")),
    "rule_explain": lambda s, p: op.explain_rules(view(s, p, "rules")),
    "verdict_counts": lambda s, p: op.verdict_counts(view(s, p, "verdicts")),
    "report_sections": lambda s, p: op.report_sections(op.findings(FixtureTables(s, p)), view(s, p, "rules")),
    "report_written": _written_report,
    "stream_record": _streamed_record,
    "pass_fail_table": lambda s, p: op.pass_fail_table(_record(s, p), view(s, p, "runs"), view(s, p, "docs")),
    "nonstandard_tags": lambda s, p: view(s, p, "nodes").select("tag").distinct().exceptAll(
        s.createDataFrame([(t,) for t in lx.STANDARD_TAGS], "tag string")),
    "requested_existing": lambda s, p: view(s, p, "order_requests").select("doc_id", "node_id").join(
        view(s, p, "nodes"), ["doc_id", "node_id"], "left_semi"),
    "repair_sequence": lambda s, p: repair_sequence.repaired_nodes(view(s, p, "nodes"), view(s, p, "spans"), view(s, p, "page_sizes"), view(s, p, "docs")).select(
        "doc_id", "node_id", "parent_id", "tag", "artifact", "language", "alt"),
}

_HEAD_NODES = """hn AS (SELECT doc_id, ord, CAST(substr(tag, 2, 1) AS INT) AS level, page, text FROM fx_nodes WHERE tag IN ('H1', 'H2', 'H3', 'H4', 'H5', 'H6')),
 hl AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM hn)"""
# oracle rows per check: (doc_id, chk, severity)
_PARTS = {
    "contrast": (colour_queries.ORACLES["contrast_failures"], "'error'"), "nontext_contrast": (colour_queries.ORACLES["nontext_contrast"], "'error'"),
    "font": (document_queries.ORACLES["fonts"], "severity"), "alt": (document_queries.ORACLES["alt_quality"], "'error'"),
    "headings": (oracle("nodes", f"WITH {_HEAD_NODES} SELECT doc_id FROM hl WHERE level > prev + 1 UNION ALL SELECT doc_id FROM hn GROUP BY doc_id HAVING min(level) > 1"), "'warning'"),
    "link_text": (forms_queries.ORACLES["link_text"], "'error'"), "table_structure": (tables_queries.ORACLES["table_issues"], "'error'"),
    "language": (text_queries.ORACLES["language_issues"], "'warning'"), "metadata": (document_queries.ORACLES["metadata"], "severity"),
    "color_only": (layout_queries.ORACLES["swatches"], "'warning'"), "target_size": (forms_queries.ORACLES["target_size"], "'error'"),
    "link_quality": (forms_queries.ORACLES["link_quality"], "'error'"), "sensory": (text_queries.ORACLES["sensory"], "'warning'"),
    "reflow": (document_queries.ORACLES["reflow"], "'warning'"), "ocg": (document_queries.ORACLES["layers"], "severity"),
    "label_name": (forms_queries.ORACLES["label_in_name"], "'warning'"),
    "watermark": (document_queries.ORACLES["watermarks"], "'warning'"), "abbreviation": (text_queries.ORACLES["abbreviations"], "'info'"),
    "reading_level": (f"SELECT * FROM ({text_queries.ORACLES['reading_level']}) WHERE severity IN ('warning', 'concern')", "severity"),
    "xfa": (document_queries.ORACLES["xfa"], "'error'"), "security": (f"SELECT * FROM ({document_queries.ORACLES['security']}) WHERE severity <> 'ok'", "severity"),
    "coverage": (f"SELECT * FROM ({layout_queries.ORACLES['coverage']}) WHERE orphaned_pages > 0", "'error'"),
    "annotation": (forms_queries.ORACLES["annotation_contents"], "'error'"),
}


def _found(names) -> str:
    return "f AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS chk, {_PARTS[n][1]} AS severity FROM ({_PARTS[n][0]})" for n in names) + ")"


def _rec(names) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE chk = '{n}') AS {n}" for n in names)
    return (f"{_found(names)}, rec AS (SELECT doc_id, {counts}, count(*) FILTER (WHERE chk = 'font' AND severity = 'error') AS font_errors, "
            "count(*) FILTER (WHERE chk = 'metadata' AND severity = 'error') AS metadata_errors, count(*) AS total FROM f GROUP BY doc_id)")


_B = op.BENCH_CHECKS
_BENCH = f"""{_rec(_B)}, br AS (SELECT r.doc_id, file, pages, nodes, pages > 0 AND nodes / nullif(pages, 0) < 2 AS likely_scan, compliant, NOT validation_failed AS validated, failed_rules,
   coalesce(mode, 'rebuild') AS mode, failed_out > failed_in AS guard, form_total > 0 AS form, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _B)}, stage, error, seconds FROM fx_runs r LEFT JOIN rec USING (doc_id))"""
_TOT = {"corpus": "true", "errored": "error IS NOT NULL", "full_auto_pass": "error IS NULL AND compliant AND validated AND NOT guard",
        "verified_not_compliant": "error IS NULL AND NOT compliant AND validated", "unverified": "error IS NULL AND NOT validated", "guard_fired": "error IS NULL AND guard"}
_BOARD = " UNION ALL ".join(
    [f"SELECT 'total' AS section, '{k}' AS key, count(*) FILTER (WHERE {c}) AS docs, count(*) FILTER (WHERE {c}) AS value FROM br" for k, c in _TOT.items()]
    + [f"SELECT 'checker', '{c}', count(*) FILTER (WHERE error IS NULL AND {c} > 0), CAST(coalesce(sum({c}) FILTER (WHERE error IS NULL), 0) AS BIGINT) FROM br HAVING count(*) FILTER (WHERE error IS NULL AND {c} > 0) > 0" for c in _B]
    + ["SELECT 'mode', mode || CASE WHEN likely_scan THEN '+scan' ELSE '' END || CASE WHEN form THEN '+form' ELSE '' END, count(*), count(*) FILTER (WHERE compliant) FROM br WHERE error IS NULL GROUP BY 2"])
_SN = ["contrast", "link_quality", "nontext_contrast", "font", "metadata", "headings", "label_name"]
_SCORE = f"""{_rec(_SN)}, {_HEAD_NODES},
 hs AS (SELECT doc_id, count(*) AS h, count(*) FILTER (WHERE level > prev + 1) AS skips FROM hl GROUP BY 1),
 fg AS (SELECT doc_id, count(*) AS figs, count(*) FILTER (WHERE NOT decorative AND {blank_sql('alt')}) AS opn FROM fx_nodes WHERE tag = 'Figure' GROUP BY 1),
 tc AS (SELECT doc_id, count(*) AS tabs, count(*) FILTER (WHERE NOT th) AS bare FROM (SELECT doc_id, table_id, bool_or(tag = 'TH') AS th FROM fx_cells GROUP BY 1, 2) GROUP BY 1),
 cv AS ({layout_queries.ORACLES["coverage"]}), rs AS ({repair_queries.ORACLES["round_trip_summary"]}),
 x AS (SELECT d.doc_id, has_struct, NOT {blank_sql('title')} AS t, NOT {blank_sql('lang')} AS l, coalesce(figs, 0) AS figs, coalesce(opn, 0) AS opn, coalesce(tabs, 0) AS tabs, coalesce(bare, 0) AS bare,
   coalesce(h, 0) AS h, coalesce(skips, 0) AS skips, coalesce(contrast, 0) AS nc, coalesce(link_quality, 0) AS nl, coalesce(nontext_contrast, 0) AS nn, coalesce(font_errors, 0) AS nf, coalesce(metadata_errors, 0) AS nm,
   coalesce(headings, 0) AS nh, coalesce(label_name, 0) AS nln, coalesce(orphaned_pages, 0) AS np, coalesce(errors, 0) AS nr, coalesce(compliant, false) AS ok, NOT coalesce(validation_failed, false) AS known, coalesce(failed_rules, 0) AS fr
   FROM fx_docs d LEFT JOIN rec USING (doc_id) LEFT JOIN hs USING (doc_id) LEFT JOIN fg USING (doc_id) LEFT JOIN tc USING (doc_id) LEFT JOIN cv USING (doc_id) LEFT JOIN rs USING (doc_id) LEFT JOIN fx_runs USING (doc_id)),
 k AS (SELECT *, CAST(floor((CAST(t AS INT) + CAST(l AS INT) + CAST(figs > 0 AND opn = 0 AS INT) + CAST(tabs > 0 AND bare = 0 AS INT) + CAST(h > 0 AS INT) + CAST(h > 0 AND skips = 0 AS INT) + CAST(nc = 0 AS INT)) * 100e0
   / (4 + CAST(figs > 0 AS INT) + CAST(tabs > 0 AS INT) + CAST(h > 0 AS INT)) + 0.5e0) AS INT) AS ck FROM x),
 sc AS (SELECT *, CAST(CASE WHEN ok AND nc = 0 AND nl = 0 THEN 100 ELSE greatest(0, least(ck, CASE WHEN nc > 0 THEN 85 ELSE 100 END, CASE WHEN NOT ok AND fr > 0 THEN 94 ELSE 100 END, CASE WHEN NOT known THEN 90 ELSE 100 END,
   CASE WHEN nf > 0 THEN 80 ELSE 100 END, CASE WHEN np > 0 THEN 80 ELSE 100 END, CASE WHEN nm > 0 THEN 90 ELSE 100 END, CASE WHEN nr > 0 THEN 80 ELSE 100 END)
   - least(nl * 3, 10) - least(nf * 5, 20) - least(nn * 2, 10) - least(np * 5, 15) - least(nm * 3, 9) - least(nr * 8, 25)) END AS INT) AS score FROM k)"""
_SV = "docs nodes cells runs"
_ESC = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _section(name, sql, page, kind, text, detail) -> str:
    return (f"SELECT doc_id, '{name}' AS section, printf('%09d', coalesce({page}, 0)) || chr(31) || coalesce({kind}, '') || chr(31) || coalesce({text}, '') || chr(31) || coalesce({detail}, '') AS k, "
            f"coalesce(CAST({page} AS VARCHAR), '') || ' | ' || coalesce({kind}, '') || ' | ' || substr(coalesce({text}, ''), 1, 60) AS line FROM ({sql})")


_NO = "CAST(NULL AS INT)"
_SECTIONS = " UNION ALL ".join([
    _section("contrast", _PARTS["contrast"][0], "page", "'text_contrast'", "text", "fg || ' on ' || bg"), _section("font", _PARTS["font"][0], "page", "issue", "font_name", "NULL"),
    _section("alt", _PARTS["alt"][0], "page", "type", "alt", "NULL"), _section("link_quality", _PARTS["link_quality"][0], "page", "type", "text", "url"),
    _section("metadata", _PARTS["metadata"][0], _NO, "field", "NULL", "NULL"), _section("ocg", _PARTS["ocg"][0], _NO, "type", "layer", "NULL"),
    _section("nontext_contrast", _PARTS["nontext_contrast"][0], "page", "type", "component", "fg || ' on ' || bg"),
    _section("headings", oracle("nodes", f"WITH {_HEAD_NODES} SELECT doc_id, 'skipped_level' AS type, page, text FROM hl WHERE level > prev + 1 UNION ALL "
             "SELECT doc_id, 'missing_h1', CAST(NULL AS INT), NULL FROM hn GROUP BY doc_id HAVING min(level) > 1"), "page", "type", "text", "NULL"),
    _section("link_text", _PARTS["link_text"][0], "page", "reason", "text", "url"),
    _section("table_structure", _PARTS["table_structure"][0], "page", "type", "NULL", "CAST(table_id AS VARCHAR)"),
    _section("language", _PARTS["language"][0], "page", "type", "text", "detected"), _section("color_only", _PARTS["color_only"][0], "page", "'swatches'", "NULL", "NULL"),
    _section("target_size", _PARTS["target_size"][0], "page", "type", "NULL", "NULL"), _section("sensory", _PARTS["sensory"][0], "page", "type", "text", "match"),
    _section("reflow", _PARTS["reflow"][0], "page", "type", "NULL", "NULL"),
    _section("label_name", _PARTS["label_name"][0], "page", "'label_not_in_name'", "visible_label", "accessible_name"),
    _section("watermark", _PARTS["watermark"][0], "page", "type", "text", "NULL"), _section("abbreviation", _PARTS["abbreviation"][0], _NO, "type", "abbreviation", "NULL"),
    _section("reading_level", _PARTS["reading_level"][0], _NO, "'reading_level'", "NULL", "NULL"), _section("xfa", _PARTS["xfa"][0], _NO, "type", "NULL", "NULL"),
    _section("security", _PARTS["security"][0], _NO, "'permissions'", "NULL", "NULL"),
    _section("coverage", _PARTS["coverage"][0], _NO, "'pages_without_structure'", "NULL", "NULL"),
    _section("annotation", _PARTS["annotation"][0], "page", "subtype", "contents", "NULL")])
_NOTE = {k: v for k, v in lx.CLAUSE_NOTES.items()}
_KEY = "clause || '-' || test_number"


def _note(i: int) -> str:
    m = {k: v[i] for k, v in _NOTE.items()}
    return _noted(m, lx.CLAUSE_FALLBACK[i])


def _noted(m: dict, fallback: str) -> str:
    return f"coalesce({map_sql(m, _KEY)}, {map_sql(m, 'clause')}, {_lit(fallback)})"


_LINES = [
    ("Document title", "coalesce(title, '')", "true"), ("Document language", f"CASE WHEN {blank_sql('lang')} THEN 'Not set' ELSE lang END", f"NOT {blank_sql('lang')} AND lang <> 'Not set'"),
    ("Automated verification ran to completion", "CASE WHEN known THEN 'Yes' ELSE 'No' END", "known"),
    ("Validator compliant", "CASE WHEN known THEN CASE WHEN ok THEN 'Yes' ELSE 'No' END ELSE 'Unknown' END", "ok AND known"),
    ("MarkInfo /Marked", "CASE WHEN marked THEN 'Set' ELSE 'Not set' END", "marked"),
    ("ViewerPreferences /DisplayDocTitle", "CASE WHEN display_title THEN 'Set' ELSE 'Not set' END", "display_title"),
    ("XFA form detected (inaccessible)", "CASE WHEN has_xfa THEN 'Yes' ELSE 'No' END", "NOT has_xfa"),
    ("Validator failed rules", "CAST(fr AS VARCHAR)", "fr = 0")]
_COUNT_LINES = [
    ("Contrast issues remaining", "contrast"), ("Non-text contrast issues (WCAG 1.4.11)", "nontext_contrast"), ("Images with alt text issues (WCAG 1.1.1)", "alt"),
    ("Color-only pattern warnings (WCAG 1.4.1)", "color_only"), ("Heading structure issues (WCAG 1.3.1 / 2.4.6)", "headings"), ("Sensory-only reference warnings (WCAG 1.3.3)", "sensory"),
    ("Label in Name issues (WCAG 2.5.3)", "label_name"), ("Non-descriptive link text (WCAG 2.4.4)", "link_text"), ("Link quality issues", "link_quality"),
    ("Table structure issues (WCAG 1.3.1)", "table_structure"), ("Language tagging issues (WCAG 3.1.1 / 3.1.2)", "language"), ("Target size issues (WCAG 2.5.8)", "target_size"),
    ("Font issues (embedding / ToUnicode)", "font"), ("Reflow / text-spacing issues (WCAG 1.4.10/1.4.12)", "reflow"), ("Metadata issues (WCAG 4.1 / PDF/UA)", "metadata"),
    ("Optional content layer issues (PDF/UA 7.11)", "ocg"), ("Watermark or background candidates", "watermark"),
    ("Unexpanded abbreviations (WCAG 3.1.4)", "abbreviation"), ("Reading level warnings (WCAG 3.1.5)", "reading_level"), ("XFA findings", "xfa"),
    ("Security restrictions (PDF/UA 7.16)", "security"), ("Pages without structure", "coverage"), ("Annotations without description (PDF/UA 7.18)", "annotation")]
_ALL = list(op.CHECKS)
_LINED = f"""s AS ({_SECTIONS}), u AS (SELECT doc_id, 'rule_failures' AS section, clause AS k1, test_number AS k2, line_no AS k3, rule_id AS k4, '' AS k, clause || ' | ' || substr(description, 1, 120) AS line
   FROM fx_rules WHERE status = 'failed' UNION ALL SELECT doc_id, section, '', 0, 0, 0, k, line FROM s),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY k1, k2, k3, k4, k) AS rn FROM u)"""

ORACLES = {
    "conformance": oracle("", f"WITH {_rec(_ALL)} SELECT * FROM rec"),
    "stream_record": oracle("", f"WITH {_rec(_ALL)} SELECT * FROM rec WHERE doc_id IN (SELECT doc_id FROM documents)"),
    "findings_sink": oracle("", f"""WITH {_rec(_ALL)} SELECT doc_id, '{{' || {" || ',' || ".join(f"'{chr(34)}{c}{chr(34)}:' || {c}" for c in [*_ALL, "font_errors", "metadata_errors", "total"])} || '}}' AS record FROM rec"""),
    "corpus_rollup": oracle("", f"""WITH {_found(_ALL)} SELECT chk AS "check", severity, count(*) AS findings FROM f GROUP BY ROLLUP (chk, severity)"""),
    "bench_rows": oracle("runs", f"WITH {_BENCH} SELECT * FROM br"),
    "scoreboard": oracle("runs", f"WITH {_BENCH} {_BOARD}"),
    "score": oracle(_SV, f"""WITH {_SCORE} SELECT doc_id, ck AS checklist, score, known AND ok AND score = 100 AND nc = 0 AND nl = 0 AND nh = 0 AND nln = 0 AND nm = 0 AND nf = 0 AS passed FROM sc"""),
    "grades": oracle(_SV, f"""WITH {_SCORE}, g AS (SELECT doc_id, score, CASE WHEN has_struct THEN score ELSE least(score, 30) END AS s FROM sc)
SELECT doc_id, score, CASE WHEN s >= 95 THEN 'A+' WHEN s >= 85 THEN 'A' WHEN s >= 70 THEN 'B' WHEN s >= 50 THEN 'C' WHEN s >= 30 THEN 'D' ELSE 'F' END AS grade FROM g"""),
    "signals": oracle("nodes docs", f"""WITH {_rec(op.SIGNAL_CHECKS)}, c AS (SELECT doc_id, count(*) AS total_nodes, count(*) FILTER (WHERE starts_with(tag, 'H')) AS headings, count(*) FILTER (WHERE tag = 'P') AS paragraphs, count(*) FILTER (WHERE tag = 'Table') AS tables,
   count(*) FILTER (WHERE tag IN ('L', 'LI')) AS lists, count(*) FILTER (WHERE tag IN ('Figure', 'Image')) AS figures,
   count(*) FILTER (WHERE tag IN ('Figure', 'Image') AND {strip_sql("coalesce(alt, '')")} NOT IN ('', 'image', 'figure')) AS figures_with_alt, count(*) FILTER (WHERE tag = 'Link') AS links FROM fx_nodes GROUP BY 1)
SELECT c.*, NOT {blank_sql('title')} AS has_title, NOT {blank_sql('lang')} AS has_lang, has_struct AS tagged, page_count,
  CAST(CASE WHEN figures > 0 THEN round_even(100e0 * figures_with_alt / figures, 0) ELSE 100 END AS BIGINT) AS alt_coverage,
  {", ".join(f"coalesce(rec.{c}, 0) AS {c}_issues" for c in op.SIGNAL_CHECKS)} FROM c LEFT JOIN fx_docs USING (doc_id) LEFT JOIN rec USING (doc_id)"""),
    "clause_frequency": oracle("rules", """SELECT clause || '-' || test_number AS clause, count(*) AS docs, CAST(sum(failed_checks) AS BIGINT) AS checks, min(substr(description, 1, 90)) AS description FROM fx_rules WHERE status = 'failed' GROUP BY 1"""),
    "top_clauses": oracle("rules", """SELECT clause || '-' || test_number AS clause, count(*) AS docs, CAST(sum(failed_checks) AS BIGINT) AS checks, min(substr(description, 1, 90)) AS description FROM fx_rules WHERE status = 'failed' GROUP BY 1 ORDER BY docs DESC, 1"""),
    "slowest": oracle("runs", "SELECT doc_id, file, seconds FROM fx_runs WHERE error IS NULL ORDER BY seconds DESC, doc_id LIMIT 3"),
    "rule_explain": oracle("rules", f"SELECT doc_id, rule_id, line_no, clause, test_number, {_note(0)} AS plain_title, {_noted({k: op.explanation(v) for k, v in _NOTE.items()}, op.explanation(lx.CLAUSE_FALLBACK))} AS plain_explanation, {_note(1)} AS plain_hint FROM fx_rules WHERE status = 'failed'"),
    "verdict_counts": oracle("verdicts", """SELECT doc_id, count(*) FILTER (WHERE verdict = 'looks_good') AS looks_good, count(*) FILTER (WHERE verdict = 'needs_human') AS needs_human,
  count(*) FILTER (WHERE verdict = 'likely_problem') AS likely_problem FROM fx_verdicts GROUP BY 1"""),
    "report_sections": oracle("rules", f"""WITH {_LINED}
SELECT doc_id, section, count(*) AS n, string_agg({_ESC.format(c='line')}, chr(10) ORDER BY rn) AS body FROM n GROUP BY 1, 2"""),
    "report_written": oracle("rules docs", f"""WITH {_LINED}, c AS (SELECT doc_id, section, count(*) AS n FROM n GROUP BY 1, 2),
 t AS (SELECT d.doc_id, coalesce(sum(c.n) FILTER (section <> 'rule_failures'), 0) AS f, coalesce(sum(c.n) FILTER (section = 'rule_failures'), 0) AS r,
   count(*) FILTER (section <> 'rule_failures') AS k FROM fx_docs d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, '' AS section, CAST(i AS BIGINT) AS number, [concat('Findings: ', f), concat('Checks with findings: ', k), concat('Failed rules: ', r),
   concat('Verdict: ', CASE WHEN f + r = 0 THEN 'pass' WHEN r = 0 THEN 'needs work' ELSE 'fail' END)][i + 1] AS line FROM t, range(4) AS g(i)
UNION ALL SELECT doc_id, section, 0, section || ': ' || n FROM c SEMI JOIN fx_docs USING (doc_id)
UNION ALL SELECT doc_id, section, rn, {_ESC.format(c='line')} FROM n SEMI JOIN fx_docs USING (doc_id)"""),
    "pass_fail_table": oracle("docs runs", f"""WITH {_rec(_ALL)}, x AS (SELECT d.doc_id, title, lang, has_xfa, marked, display_title, NOT coalesce(validation_failed, true) AS known, coalesce(compliant, false) AS ok, coalesce(failed_rules, 0) AS fr,
   {", ".join(f"coalesce({c}, 0) AS n_{c}" for _, c in _COUNT_LINES)} FROM fx_docs d LEFT JOIN rec USING (doc_id) LEFT JOIN fx_runs USING (doc_id))
""" + " UNION ALL ".join([f"SELECT doc_id, {_lit(a)} AS label, {b} AS value, {c} AS pass FROM x" for a, b, c in _LINES]
                         + [f"SELECT doc_id, {_lit(a)}, CAST(n_{c} AS VARCHAR), n_{c} = 0 FROM x" for a, c in _COUNT_LINES])),
    "nonstandard_tags": oracle("nodes", f"SELECT DISTINCT tag FROM fx_nodes WHERE tag NOT IN {_in(lx.STANDARD_TAGS)}"),
    "requested_existing": oracle("nodes order_requests", "SELECT doc_id, node_id FROM fx_order_requests r WHERE EXISTS (SELECT 1 FROM fx_nodes n WHERE n.doc_id = r.doc_id AND n.node_id = r.node_id)"),
}
