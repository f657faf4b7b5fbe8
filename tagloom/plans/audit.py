"""The audit: every check as findings, the per-document record, scores and corpus rollups.

``tables`` is any mapping from table name to DataFrame (schemas in tagloom.schema).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tagloom import lexicon as lx
from tagloom.functions.numbers import half_even
from tagloom.functions.text import blank, escape_markup, left, strip
from tagloom.operators import contrast, document, headings, interactive, layout, prose, tables as tb
from tagloom.operators.contrast import first_n
from tagloom.schema import as_findings
from tagloom.session import known_ids, stored

Tables = Mapping[str, DataFrame]


def _contrast(t: Tables) -> DataFrame:
    return as_findings(contrast.contrast_failures(t["spans"]), "contrast", "1.4.3", type=F.lit("text_contrast"), severity=F.lit("error"),
                       page="page", text="text", detail=F.concat_ws(" on ", "fg", "bg"), metric="ratio", required="required")


def _nontext(t: Tables) -> DataFrame:
    df = contrast.nontext_contrast(t["annots"], t["paths"], t["pages"], t["images"])
    return as_findings(df, "nontext_contrast", "1.4.11", type="type", severity=F.lit("error"), page="page", text="component",
                       detail=F.concat_ws(" on ", "fg", "bg"), metric="ratio", required="required")


def _link_quality(t: Tables) -> DataFrame:
    return as_findings(interactive.link_quality(t["links"]), "link_quality", "2.4.4", type="type", severity=F.lit("error"),
                       page="page", text="text", detail="url")


def _link_text(t: Tables) -> DataFrame:
    return as_findings(interactive.link_text(t["links"]), "link_text", "2.4.4", type="reason", severity=F.lit("error"),
                       page="page", text="text", detail="url")


def _alt(t: Tables) -> DataFrame:
    return as_findings(document.alt_quality(t["nodes"]), "alt", "1.1.1", type="type", severity=F.lit("error"), page="page", text="alt")


def _headings(t: Tables) -> DataFrame:
    df = headings.heading_issues(headings.heading_rows(t["nodes"]))
    return as_findings(df, "headings", "1.3.1", type="type", severity=F.lit("warning"), page="page", ord="ord", text="text",
                       metric="level", required="prev_level")


def _tables(t: Tables) -> DataFrame:
    return as_findings(tb.table_issues(t["cells"], t["tables"]), "table_structure", "1.3.1", type="type", severity=F.lit("error"),
                       page="page", detail=F.col("table_id").cast("string"), metric="count")


def _language(t: Tables) -> DataFrame:
    return as_findings(prose.language_issues(t["nodes"], t["docs"]), "language", "3.1.2", type="type", severity=F.lit("warning"),
                       page="page", ord="ord", text="text", detail="detected")


def _metadata(t: Tables) -> DataFrame:
    return as_findings(document.metadata(t["docs"]), "metadata", "2.4.2", type="field", severity="severity")


def _color_only(t: Tables) -> DataFrame:
    return as_findings(layout.swatch_clusters(t["fills"]), "color_only", "1.4.1", type=F.lit("swatches"), severity=F.lit("warning"),
                       page="page", metric="swatches", required="colors")


def _target(t: Tables) -> DataFrame:
    return as_findings(interactive.target_size(t["annots"]), "target_size", "2.5.8", type="type", severity=F.lit("error"), page="page",
                       metric=F.least("width_pt", "height_pt"), required="min_pt")


def _fonts(t: Tables) -> DataFrame:
    return as_findings(document.fonts(t["fonts"]), "font", "7.21", type="issue", severity="severity", page="page", text="font_name")


def _sensory(t: Tables) -> DataFrame:
    return as_findings(prose.sensory(t["nodes"]), "sensory", "1.3.3", type="type", severity=F.lit("warning"), page="page", ord="ord",
                       text="text", detail="match")


def _reflow(t: Tables) -> DataFrame:
    return as_findings(document.reflow(t["spans"], t["pages"]), "reflow", "1.4.10", type="type", severity=F.lit("warning"), page="page", metric="value")


def _ocg(t: Tables) -> DataFrame:
    return as_findings(document.layers(t["layers"]), "ocg", "7.11", type="type", severity="severity", text="layer")


def _label_name(t: Tables) -> DataFrame:
    return as_findings(interactive.label_in_name(t["fields"], t["spans"]), "label_name", "2.5.3", type=F.lit("label_not_in_name"),
                       severity=F.lit("warning"), page="page", text="visible_label", detail="accessible_name")


def _watermarks(t: Tables) -> DataFrame:
    df = document.watermarks(t["spans"], t["images"], t["paths"], t["pages"])
    return as_findings(df, "watermark", "1.4.3", type="type", severity=F.lit("warning"), page="page", text="text", metric="value")


def _abbreviations(t: Tables) -> DataFrame:
    return as_findings(prose.abbreviations(t["nodes"]), "abbreviation", "3.1.4", type="type", severity=F.lit("info"), text="abbreviation", metric="count")


def _reading_level(t: Tables) -> DataFrame:
    df = prose.reading_level(t["texts"]).filter(F.col("severity").isin("warning", "concern"))
    return as_findings(df, "reading_level", "3.1.5", type=F.lit("reading_level"), severity="severity", metric="grade_level")


def _xfa(t: Tables) -> DataFrame:
    return as_findings(document.xfa(t["docs"]), "xfa", "7.15", type="type", severity=F.lit("error"))


def _security(t: Tables) -> DataFrame:
    df = document.security(t["docs"]).filter(F.col("severity") != "ok")
    return as_findings(df, "security", "7.16", type=F.lit("permissions"), severity="severity")


def _coverage(t: Tables) -> DataFrame:
    df = layout.coverage(t["pages"], t["spans"], t["nodes"]).filter(F.col("orphaned_pages") > 0)
    return as_findings(df, "coverage", "1.3.1", type=F.lit("pages_without_structure"), severity=F.lit("error"),
                       metric="orphaned_pages", required="pages")


def _annotations(t: Tables) -> DataFrame:
    return as_findings(interactive.annotation_contents(t["annots"]), "annotation", "7.18.1", type="subtype", severity=F.lit("error"), page="page",
                       text="contents")


# the registry: add a check by adding a function that returns findings
CHECKS: dict[str, Callable[[Tables], DataFrame]] = {
    "contrast": _contrast, "nontext_contrast": _nontext, "font": _fonts, "alt": _alt, "headings": _headings, "link_text": _link_text,
    "table_structure": _tables, "language": _language, "metadata": _metadata, "color_only": _color_only, "target_size": _target,
    "link_quality": _link_quality, "sensory": _sensory, "reflow": _reflow, "ocg": _ocg, "label_name": _label_name,
    "watermark": _watermarks, "abbreviation": _abbreviations, "reading_level": _reading_level, "xfa": _xfa, "security": _security,
    "coverage": _coverage, "annotation": _annotations,
}


def findings(tables: Tables, checks: list[str] | None = None) -> DataFrame:
    """All findings of the named checks as one table."""
    return reduce(DataFrame.unionByName, [CHECKS[c](tables) for c in (checks or CHECKS)])


def finding_counts(tables: Tables, checks: list[str] | None = None) -> DataFrame:
    """(doc_id, check, severity, n) of the named checks: each is counted before they meet, so the
    texts of findings that are only counted are never shuffled."""
    return reduce(DataFrame.unionByName, [counted(CHECKS[c](tables)) for c in (checks or CHECKS)])


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "check", "severity").agg(F.count(F.lit(1)).alias("n"))


def write_findings(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Findings partitioned by check, so a later read of one check touches only its files; texts repeat, so they are packed well."""
    rows.write.mode(mode).option("compression", "zstd").partitionBy("check").parquet(path)


def conformance(counts: DataFrame, checks: list[str] | None = None) -> DataFrame:
    """One record per document, from ``finding_counts``: findings and errors per check."""
    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    is_error = F.col("severity") == "error"
    return counts.groupBy("doc_id").agg(
        *[total(F.col("check") == n).alias(n) for n in (checks or list(CHECKS))],
        total((F.col("check") == "font") & is_error).alias("font_errors"),
        total((F.col("check") == "metadata") & is_error).alias("metadata_errors"),
        F.sum("n").alias("total"))


def records_as_json(record: DataFrame) -> DataFrame:
    """The record of each document as one JSON text."""
    return record.select("doc_id", F.to_json(F.struct(*[c for c in record.columns if c != "doc_id"])).alias("record"))


def check_rollup(counts: DataFrame) -> DataFrame:
    """Findings by check and severity, with subtotals, from ``finding_counts``."""
    return counts.rollup("check", "severity").agg(F.sum("n").alias("findings"))


# --- signals and scores ----------------------------------------------------------

SIGNAL_CHECKS = ["contrast", "alt", "headings", "link_text", "table_structure", "language", "color_only", "target_size", "nontext_contrast", "label_name"]


def signals(nodes: DataFrame, docs: DataFrame, record: DataFrame) -> DataFrame:
    """Counts by tag, coverage figures and findings per check of each document."""
    figure = F.col("tag").isin("Figure", "Image")
    counts = nodes.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count_if(F.col("tag").startswith("H")).alias("headings"),
        F.count_if(F.col("tag") == "P").alias("paragraphs"), F.count_if(F.col("tag") == "Table").alias("tables"),
        F.count_if(F.col("tag").isin("L", "LI")).alias("lists"), F.count_if(figure).alias("figures"),
        F.count_if(figure & ~strip(F.coalesce("alt", F.lit(""))).isin("", "image", "figure")).alias("figures_with_alt"),
        F.count_if(F.col("tag") == "Link").alias("links"))
    pct = F.when(F.col("figures") > 0, half_even(100.0 * F.col("figures_with_alt") / F.col("figures"), 0)).otherwise(100.0)
    return counts.join(docs.select("doc_id", (~blank(F.col("title"))).alias("has_title"), (~blank(F.col("lang"))).alias("has_lang"),
                                   F.col("has_struct").alias("tagged"), "page_count"), "doc_id", "left").withColumn(
        "alt_coverage", pct.cast("long")).join(record.select("doc_id", *[F.col(c).alias(f"{c}_issues") for c in SIGNAL_CHECKS]), "doc_id", "left").fillna(
        0, [f"{c}_issues" for c in SIGNAL_CHECKS])


def checklist(nodes: DataFrame, docs: DataFrame, cells: DataFrame) -> DataFrame:
    """The checks a person can still influence, as applicable / passed flags per document."""
    level = headings.heading_rows(nodes.filter(F.col("tag").isin(lx.HEADING_TAGS)))
    heads = level.groupBy("doc_id").agg(F.count(F.lit(1)).alias("h"))
    skips = headings.skipped_levels(level.select("doc_id", "ord", "level")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("skips"))
    figures = nodes.filter(F.col("tag") == "Figure").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("figs"), F.count_if(~(F.coalesce("decorative", F.lit(False)) | ~blank(F.col("alt")))).alias("open_figs"))
    grids = cells.groupBy("doc_id", "table_id").agg(F.bool_or(F.col("tag") == "TH").alias("th")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("tabs"), F.count_if(~F.col("th")).alias("bare_tabs"))
    d = docs.select("doc_id", "title", "lang")
    for part in (heads, skips, figures, grids):
        d = d.join(part, "doc_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("h", "skips", "figs", "open_figs", "tabs", "bare_tabs")}
    return d.select(
        "doc_id", (~blank(F.col("title"))).alias("title_ok"), (~blank(F.col("lang"))).alias("language_ok"),
        (n["figs"] > 0).alias("alt_applies"), (n["open_figs"] == 0).alias("alt_ok"), (n["tabs"] > 0).alias("tables_apply"),
        (n["bare_tabs"] == 0).alias("tables_ok"), (n["h"] > 0).alias("bookmarks_ok"), (n["skips"] == 0).alias("order_ok"))


def checklist_score(c: DataFrame, contrast_ok: Column) -> Column:
    """Share of applicable checks that pass, 0..100, halves rounded up."""
    def one(ok: Column, applies: Column = F.lit(True)) -> tuple[Column, Column]:
        return (ok & applies).cast("int"), applies.cast("int")
    rows = [one(F.col("title_ok")), one(F.col("language_ok")), one(F.col("alt_ok"), F.col("alt_applies")),
            one(F.col("tables_ok"), F.col("tables_apply")), one(F.col("bookmarks_ok")),
            one(F.col("order_ok"), F.col("bookmarks_ok")), one(contrast_ok)]
    passed = reduce(lambda a, b: a + b, [p for p, _ in rows])
    applies = reduce(lambda a, b: a + b, [a for _, a in rows])
    return F.floor(passed * 100.0 / applies + 0.5).cast("int")


def scores(c: DataFrame, record: DataFrame, runs: DataFrame, coverage: DataFrame, round_trip: DataFrame) -> DataFrame:
    """Checklist score, composite score with caps and penalties, grade and pass flag."""
    counts = record.select("doc_id", "contrast", "link_quality", "nontext_contrast", "font_errors", "metadata_errors", "headings", "label_name")
    rows = c.join(counts, "doc_id", "left").join(runs.select("doc_id", "compliant", "validation_failed", "failed_rules"), "doc_id", "left").join(
        coverage.select("doc_id", "orphaned_pages"), "doc_id", "left").join(round_trip.select("doc_id", F.col("errors").alias("rt_errors")), "doc_id", "left")
    n = {k: F.coalesce(v, F.lit(0)) for k, v in {
        "contrast": "contrast", "link": "link_quality", "nontext": "nontext_contrast", "font": "font_errors", "metadata": "metadata_errors",
        "orphaned": "orphaned_pages", "round_trip": "rt_errors"}.items()}
    compliant, known = F.coalesce("compliant", F.lit(False)), ~F.coalesce("validation_failed", F.lit(False))
    rows = rows.withColumn("checklist", checklist_score(rows, n["contrast"] == 0))
    gates = {"contrast": n["contrast"] > 0, "noncompliant": ~compliant & (F.coalesce("failed_rules", F.lit(0)) > 0), "unverified": ~known,
             "font": n["font"] > 0, "orphaned": n["orphaned"] > 0, "metadata": n["metadata"] > 0, "round_trip": n["round_trip"] > 0}
    base = F.least("checklist", *[F.when(g, F.lit(lx.SCORE_CAPS[k])).otherwise(100) for k, g in gates.items()])
    penalty = reduce(lambda a, b: a + b, [F.least(n[k] * each, F.lit(top)) for k, (each, top) in lx.PENALTIES.items()])
    clean = compliant & (n["contrast"] == 0) & (n["link"] == 0)
    score = F.when(clean, 100).otherwise(F.greatest(base - penalty, F.lit(0))).cast("int")
    rows = rows.withColumn("score", score)
    passed = (known & compliant & (F.col("score") == 100) & (n["contrast"] == 0) & (n["link"] == 0) & (F.coalesce("headings", F.lit(0)) == 0)
              & (F.coalesce("label_name", F.lit(0)) == 0) & (n["metadata"] == 0) & (n["font"] == 0))
    return rows.select("doc_id", "checklist", "score", passed.alias("passed"))


def grade(score: Column, tagged: Column) -> Column:
    """Letter band; without any structure the score counts as at most 30."""
    s = F.when(tagged, score).otherwise(F.least(score, F.lit(30)))
    out = F.when(s >= lx.GRADE_BANDS[0][0], lx.GRADE_BANDS[0][1])
    for low, letter in lx.GRADE_BANDS[1:]:
        out = out.when(s >= low, letter)
    return out.otherwise("F")


# --- corpus ---------------------------------------------------------------------

BENCH_CHECKS = ["contrast", "nontext_contrast", "font", "alt", "headings", "link_text", "table_structure", "language", "metadata", "color_only", "target_size"]


def bench_rows(runs: DataFrame, record: DataFrame) -> DataFrame:
    """Per-file result with the checker counts beside it."""
    mode = F.coalesce("mode", F.lit("rebuild"))
    scan = F.coalesce((F.col("pages") > 0) & (F.coalesce("nodes", F.lit(0)) / F.nullif("pages", F.lit(0)) < 2), F.lit(False))
    return runs.join(record.select("doc_id", *BENCH_CHECKS), "doc_id", "left").select(
        "doc_id", "file", "pages", "nodes", scan.alias("likely_scan"), "compliant", (~F.col("validation_failed")).alias("validated"),
        "failed_rules", mode.alias("mode"), (F.col("failed_out") > F.col("failed_in")).alias("guard"), (F.col("form_total") > 0).alias("form"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in BENCH_CHECKS], "stage", "error", "seconds")


def scoreboard(rows: DataFrame) -> DataFrame:
    """Corpus totals, results by mode, and checker totals as (section, key, docs, value)."""
    ok = F.col("error").isNull()
    measures = {
        "corpus": F.lit(True), "errored": ~ok, "full_auto_pass": ok & F.col("compliant") & F.col("validated") & ~F.col("guard"),
        "verified_not_compliant": ok & ~F.col("compliant") & F.col("validated"), "unverified": ok & ~F.col("validated"),
        "guard_fired": ok & F.col("guard")}
    one = rows.agg(*[F.count_if(c).alias(k) for k, c in measures.items()],
                   *[F.count_if(ok & (F.col(c) > 0)).alias(f"d_{c}") for c in BENCH_CHECKS],
                   *[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(f"i_{c}") for c in BENCH_CHECKS])
    lines = [F.struct(F.lit("total").alias("section"), F.lit(k).alias("key"), F.col(k).alias("docs"), F.col(k).alias("value")) for k in measures]
    lines += [F.struct(F.lit("checker").alias("section"), F.lit(c).alias("key"), F.col(f"d_{c}").alias("docs"), F.col(f"i_{c}").alias("value"))
              for c in BENCH_CHECKS]
    totals = one.select(F.inline(F.array(*lines)))
    key = F.concat("mode", F.when(F.col("likely_scan"), "+scan").otherwise(""), F.when(F.col("form"), "+form").otherwise(""))
    modes = rows.filter(ok).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("docs"), F.count_if("compliant").alias("value"))
    return totals.filter((F.col("section") == "total") | (F.col("docs") > 0)).unionByName(
        modes.select(F.lit("mode").alias("section"), "key", "docs", "value"))


def clause_frequency(rules: DataFrame) -> DataFrame:
    """Failed clauses of the corpus by documents (failed rules) and checks."""
    clause = F.concat_ws("-", "clause", F.col("test_number").cast("string"))
    return rules.filter(F.col("status") == "failed").groupBy(clause.alias("clause")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("failed_checks").alias("checks"), F.min(left(F.col("description"), 90)).alias("description"))


def slowest(rows: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` slowest files; a limit over a sort is a partial top-n per task."""
    return rows.filter(F.col("error").isNull()).orderBy(F.col("seconds").desc(), "doc_id").limit(n).select("doc_id", "file", "seconds")


def explanation(note: tuple[str, str]) -> str:
    """What a failed clause means for a reader, from its title and advice."""
    return f"The file breaks the rule \"{note[0]}\", so assistive technology may miss or misread that content. {note[1]}"


def explain_rules(rules: DataFrame) -> DataFrame:
    """Plain title, explanation and advice for failed rules: by clause and test, by clause, or generic."""
    def entry(note: tuple[str, str]) -> Column:
        return F.struct(F.lit(note[0]).alias("title"), F.lit(explanation(note)).alias("explanation"), F.lit(note[1]).alias("hint"))

    entries = [v for k, note in lx.CLAUSE_NOTES.items() for v in (F.lit(k), entry(note))]
    notes = F.create_map(*entries)
    note = F.coalesce(F.try_element_at(notes, F.concat_ws("-", "clause", F.col("test_number").cast("string"))),
                      F.try_element_at(notes, F.col("clause")),
                      entry(lx.CLAUSE_FALLBACK))
    return rules.filter(F.col("status") == "failed").withColumn("_n", note).select(
        "doc_id", "rule_id", "line_no", "clause", "test_number", F.col("_n.title").alias("plain_title"), F.col("_n.explanation").alias("plain_explanation"), F.col("_n.hint").alias("plain_hint"))


def verdict_counts(items: DataFrame) -> DataFrame:
    names = ["looks_good", "needs_human", "likely_problem"]
    return items.groupBy("doc_id").agg(*[F.count_if(F.col("verdict") == n).alias(n) for n in names])


# --- reports --------------------------------------------------------------------

def _nine_digits(number: Column) -> Column:
    """%09d; the formatter is only asked for what padding alone would get wrong."""
    return F.when(number.between(0, 999_999_999), F.lpad(number.cast("string"), 9, "0")).otherwise(F.format_string("%09d", number))


def _report_rows(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, section, k1, k2 (what orders a section) and the escaped line of everything that is reported."""
    failures = rules.filter(F.col("status") == "failed").select(
        "doc_id", F.lit("rule_failures").alias("section"), F.struct("clause", "test_number", "line_no", "rule_id").alias("k1"),
        F.lit(None).cast("string").alias("k2"), F.concat_ws(" | ", "clause", left(F.col("description"), 120)).alias("line"))
    found = rows.filter(F.col("check") != "rule_failures").select(
        "doc_id", F.col("check").alias("section"), F.lit(None).cast("struct<clause:string,test_number:int,line_no:int,rule_id:bigint>").alias("k1"),
        F.concat_ws("\x1f", _nine_digits(F.coalesce("page", F.lit(0))), F.coalesce("type", F.lit("")), F.coalesce("text", F.lit("")),
                    F.coalesce("detail", F.lit(""))).alias("k2"),
        F.concat_ws(" | ", F.coalesce(F.col("page").cast("string"), F.lit("")), F.coalesce("type", F.lit("")), left(F.coalesce("text", F.lit("")), 60)).alias("line"))
    return failures.unionByName(found).withColumn("line", escape_markup(F.col("line")))


def report_sections(rows: DataFrame, rules: DataFrame, shown_lines: int | None = None) -> DataFrame:
    """Report sections per document: the count, and the escaped lines in order, as one text.

    ``shown_lines`` limits what is printed per section (None prints all); the count is always
    that of all findings. With a limit, a rank filter cuts each task's output before lines meet. For sections of any
    length see ``report_lines``.
    """
    both = _report_rows(rows, rules)
    line = F.struct("k1", "k2", "line")
    if shown_lines is None:
        # one pass: what is printed is also what is counted
        sections = both.groupBy("doc_id", "section").agg(F.collect_list(line).alias("_lines")).select(
            "doc_id", "section", F.size("_lines").cast("long").alias("n"), F.array_sort("_lines").alias("_lines"))
        return sections.select("doc_id", "section", "n", _joined(F.col("_lines")).alias("body"))
    counts = both.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))
    shown = first_n(both, ["doc_id", "section"], ["k1", "k2"], shown_lines)
    body = shown.groupBy("doc_id", "section").agg(_joined(F.array_sort(F.collect_list(line))).alias("body"))
    return counts.join(body, ["doc_id", "section"]).select("doc_id", "section", "n", "body")


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda s: s["line"]), "\n")


def report_lines(rows: DataFrame, rules: DataFrame, docs: DataFrame) -> DataFrame:
    """Whole reports of the documents of ``docs``, a row per line: headline counts and verdict (section ""), then every section's
    heading and lines. ``part`` 0 to 3 orders the headline, 1 and 2 heading and lines; k1 and k2 order lines.
    """
    known, _ = known_ids(docs)
    # written once: counts, ranges and lines are read from there, not from the checks
    lines = stored(_report_rows(rows, rules).join(known, "doc_id", "left_semi"), "report-lines")
    per_section = lines.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))
    failed = F.col("section") == "rule_failures"
    totals = known.join(per_section.groupBy("doc_id").agg(
        F.sum(F.when(~failed, F.col("n"))).alias("findings"), F.sum(F.when(failed, F.col("n"))).alias("rules"), F.count_if(~failed).alias("checks")), "doc_id", "left")
    n, r, c = (F.coalesce(name, F.lit(0)) for name in ("findings", "rules", "checks"))
    verdict = F.when(n + r == 0, "pass").when(r == 0, "needs work").otherwise("fail")
    head = totals.select("doc_id", F.lit("").alias("section"), F.posexplode(F.array(
        F.concat(F.lit("Findings: "), n), F.concat(F.lit("Checks with findings: "), c), F.concat(F.lit("Failed rules: "), r),
        F.concat(F.lit("Verdict: "), verdict))).alias("part", "line"))
    heading = per_section.select("doc_id", "section", F.lit(1).alias("part"), F.concat_ws(": ", "section", "n").alias("line"))
    return lines.withColumn("part", F.lit(2)).unionByName(head.unionByName(heading), allowMissingColumns=True)


def write_report_lines(lines: DataFrame, path: str) -> None:
    """Lines as JSON text, in order over the files and in each: sorted by range, so a section of any length is many tasks' work
    and no report is put together in one value."""
    order = ["doc_id", "section", "part", "k1", "k2", "line"]
    sort = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    sort.select(F.to_json(F.struct(F.monotonically_increasing_id().alias("place"), "doc_id", "section", "line")).alias("value")).write.mode("overwrite").text(path)


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, section, number (from 0 in its section) and line of a written report.

    What a task has written of a section stands together, so a line's number is its place after the first of them, and after the
    section's lines of earlier tasks; nothing is sorted again.
    """
    rows = spark.read.schema("place long, doc_id long, section string, line string").json(path).select(
        "doc_id", "section", "line", F.shiftright("place", 33).alias("_task"), F.col("place").bitwiseAND((1 << 33) - 1).alias("_at"))
    earlier = Window.partitionBy("doc_id", "section").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("doc_id", "section", "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).select(
        F.col("doc_id").alias("_doc"), F.col("section").alias("_of"), F.col("_task").alias("_by"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("section") == F.col("_of")) & (F.col("_task") == F.col("_by"))
    return rows.join(pieces, same).select("doc_id", "section", (F.col("_at") + F.col("_shift")).alias("number"), "line")


def pass_fail_table(record: DataFrame, runs: DataFrame, docs: DataFrame) -> DataFrame:
    """Label / value / pass rows of a document, unpivoted from its record."""
    labels = {
        "contrast": "Contrast issues remaining", "nontext_contrast": "Non-text contrast issues (WCAG 1.4.11)", "alt": "Images with alt text issues (WCAG 1.1.1)",
        "color_only": "Color-only pattern warnings (WCAG 1.4.1)", "headings": "Heading structure issues (WCAG 1.3.1 / 2.4.6)",
        "sensory": "Sensory-only reference warnings (WCAG 1.3.3)", "label_name": "Label in Name issues (WCAG 2.5.3)",
        "link_text": "Non-descriptive link text (WCAG 2.4.4)", "link_quality": "Link quality issues", "table_structure": "Table structure issues (WCAG 1.3.1)",
        "language": "Language tagging issues (WCAG 3.1.1 / 3.1.2)", "target_size": "Target size issues (WCAG 2.5.8)",
        "font": "Font issues (embedding / ToUnicode)", "reflow": "Reflow / text-spacing issues (WCAG 1.4.10/1.4.12)",
        "metadata": "Metadata issues (WCAG 4.1 / PDF/UA)", "ocg": "Optional content layer issues (PDF/UA 7.11)",
        "watermark": "Watermark or background candidates", "abbreviation": "Unexpanded abbreviations (WCAG 3.1.4)",
        "reading_level": "Reading level warnings (WCAG 3.1.5)", "xfa": "XFA findings", "security": "Security restrictions (PDF/UA 7.16)",
        "coverage": "Pages without structure", "annotation": "Annotations without description (PDF/UA 7.18)",
    }
    known = ~F.coalesce("validation_failed", F.lit(True))
    comp = F.coalesce("compliant", F.lit(False))
    rows = docs.select("doc_id", "title", "lang", "has_xfa", F.col("marked"), F.col("display_title")).join(record, "doc_id", "left").join(
        runs.select("doc_id", "compliant", "validation_failed", "failed_rules"), "doc_id", "left")

    def line(label: str, value: Column, ok: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"), ok.alias("pass"))

    lang = F.when(blank(F.col("lang")), F.lit("Not set")).otherwise(F.col("lang"))
    rules = F.coalesce("failed_rules", F.lit(0))
    lines = [
        line("Document title", F.coalesce("title", F.lit("")), F.lit(True)), line("Document language", lang, lang != "Not set"),
        line("Automated verification ran to completion", F.when(known, "Yes").otherwise("No"), known),
        line("Validator compliant", F.when(known, F.when(comp, "Yes").otherwise("No")).otherwise("Unknown"), comp & known),
        line("MarkInfo /Marked", F.when(F.col("marked"), "Set").otherwise("Not set"), F.col("marked")),
        line("ViewerPreferences /DisplayDocTitle", F.when(F.col("display_title"), "Set").otherwise("Not set"), F.col("display_title")),
        line("XFA form detected (inaccessible)", F.when(F.col("has_xfa"), "Yes").otherwise("No"), ~F.col("has_xfa")),
        line("Validator failed rules", rules, rules == 0)]
    lines += [line(text, F.coalesce(c, F.lit(0)), F.coalesce(c, F.lit(0)) == 0) for c, text in labels.items()]
    return rows.select("doc_id", F.inline(F.array(*lines)))
