"""Hand values for the rules: colours, boxes, captions, formulas, layout JSON, tables."""

import json

import pytest
from pyspark.sql import functions as F

from tagloom.functions import color as c
from tagloom.functions import geometry as g
from tagloom.functions.text import strip
from tagloom.operators import contrast, document, headings, layout, prose, tables
from tagloom.sources import layout_json, text, validator


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def rgb(v):
    return F.lit(float(v)), F.lit(float(v)), F.lit(float(v))


# --- colours ---

def test_contrast_end_points(spark):
    row = one(spark, c.contrast_ratio(F.lit(0xFFFFFF), F.lit(0xFFFFFF)), c.contrast_ratio(F.lit(0), F.lit(0xFFFFFF)))
    assert row[0] == pytest.approx(1.0) and row[1] == pytest.approx(21.0)


def test_quantize_snaps_to_the_grid(spark):
    row = one(spark, c.quantize(F.lit(0.5)), c.quantize(F.lit(0.0)), c.quantize(F.lit(1.0)))
    assert tuple(row) == (round(0.5 * 255) / 255, 0.0, 1.0)


@pytest.mark.parametrize("grey", [0.6, 0.55, 0.5, 0.47])
def test_darkened_grey_passes_on_the_grid(spark, grey):
    fixed = c.darken_exact(*rgb(grey))
    assert one(spark, c.contrast_ratio(fixed, F.lit(0xFFFFFF)))[0] >= 4.5


def test_darken_leaves_black_alone_and_honours_the_large_text_limit(spark):
    assert one(spark, c.darken_exact(*rgb(0.0)))[0] == 0
    large = c.darken_exact(*rgb(0.45), required=3.0)
    assert one(spark, c.contrast_ratio(large, F.lit(0xFFFFFF)))[0] >= 3.0


def test_linear_darkening_is_the_first_step_that_passes(spark):
    def lum(x):
        return x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4
    for grey, bg in ((0.7, 1.0), (0.5, 0.9), (0.9, 0.2), (0.2, 0.3), (0.55, 0.5)):
        want = None
        for step in range(201):
            q = round(grey * (1.0 - step * 0.005) * 255) / 255
            hi, lo = max(lum(q), lum(bg)), min(lum(q), lum(bg))
            if (hi + 0.05) / (lo + 0.05) >= 4.5:
                want = round(q * 255)
                break
        frame = spark.createDataFrame([(grey, lum(bg))], "v double, bg double")
        got = c.darken_linear(frame, *[F.col("v")] * 3, F.col("bg")).first()["_fixed"] & 255
        assert got == (want or 0)


def test_background_pick(spark):
    pick = contrast.background_pick(F.array(*[F.lit(v) for v in (0x000005, 0xFFFFFF, 0x808080, 0x000000)]), F.lit(0), F.lit(0))
    none = contrast.background_pick(F.array(F.lit(1), F.lit(2)), F.lit(2), F.lit(0))
    light = contrast.background_pick(F.array(F.lit(0x101010), F.lit(0xF0F0F0)), F.lit(0), F.lit(None).cast("int"))
    assert tuple(one(spark, pick, none, light)) == (0xFFFFFF, 2, 0xF0F0F0)


# --- boxes ---

@pytest.mark.parametrize("a,b,want", [
    ((0, 0, 100, 100), (0, 0, 100, 100), 1.0), ((0, 0, 50, 50), (60, 60, 100, 100), 0.0), ((0, 0, 100, 100), (50, 0, 150, 100), 0.5),
    ((25, 25, 75, 75), (0, 0, 100, 100), 1.0), ((0, 0, 50, 50), (50, 0, 100, 50), 0.0)])
def test_cover(spark, a, b, want):
    names = [p + s for p in ("", "b_") for s in ("x0", "y0", "x1", "y1")]
    df = spark.createDataFrame([tuple(float(v) for v in (*a, *b))], names)
    assert df.select(g.cover("", "b_")).first()[0] == pytest.approx(want)


NODE = ("doc_id long, node_id string, parent_id string, depth int, ord long, tag string, page int, x0 double, y0 double, x1 double, y1 double, "
        "text string, alt string, decorative boolean, artifact boolean, font_size double, language string")


def nodes(spark, *rows):
    """(ord, tag, page, box, text) rows of document 1."""
    return spark.createDataFrame([
        (1, f"n{o}", None, 0, o, tag, page, *(map(float, box) if box else [None] * 4), txt, None, False, False, None, None)
        for o, tag, page, box, txt in rows], NODE)


HIDDEN = "doc_id long, page int, span long, color int, size double, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize("tag,page,region,kept", [
    ("P", 1, (0, 0, 100, 20), 0), ("P", 1, (0, 18, 100, 20), 1), ("Table", 1, (0, 0, 100, 20), 1), ("P", 2, (0, 0, 100, 20), 1)])
def test_invisible_text(spark, tag, page, region, kept):
    spans = spark.createDataFrame([(1, 1, 1, 0xFFFFFF, 12.0, *map(float, region))], HIDDEN)
    assert layout.drop_invisible(nodes(spark, (0, tag, page, (0, 0, 100, 20), "hi")), spans).count() == kept


# --- captions ---

@pytest.mark.parametrize("text_", ["Figure 1: results", "Fig. 2 — comparison", "Table 3: summary", "Chart 4 shows", "Exhibit 1: overview"])
def test_caption_spellings(spark, text_):
    df = nodes(spark, (0, "Figure", 1, (50, 500, 300, 650), ""), (1, "P", 1, (50, 462, 300, 478), text_))
    assert layout.link_captions(df).count() == 1


def test_caption_page_distance_and_wording_guards(spark):
    fig = (0, "Figure", 1, (50, 500, 300, 650), "")
    assert layout.link_captions(nodes(spark, fig, (1, "P", 2, (50, 462, 300, 478), "Figure 1: x"))).count() == 0
    assert layout.link_captions(nodes(spark, fig, (1, "P", 1, (50, 100, 300, 120), "Figure 1: x"))).count() == 0
    assert layout.link_captions(nodes(spark, fig, (1, "P", 1, (50, 480, 300, 498), "Some unrelated text"))).count() == 0


def test_caption_moves_under_its_figure(spark):
    df = nodes(spark, (0, "P", 1, (0, 700, 9, 710), "Body"), (1, "Figure", 1, (50, 500, 300, 650), ""), (2, "P", 1, (50, 480, 300, 498), "Figure 1: r"))
    out = {r.node_id: r for r in layout.adopt_captions(df, layout.link_captions(df)).collect()}
    assert out["n2"].parent_id == "n1" and out["n2"].tag == "Caption" and out["n0"].parent_id is None


# --- formulas ---

@pytest.mark.parametrize("text_,want", [
    (r"\frac{a}{b}", True), (r"\sum_{i=1}^{n} x_i", True), (r"\int_0^1 f(x) dx", True), ("x ≤ y ≥ z ≠ 0", True),
    ("∑ a_i + ∫ f(x) dx", True), ("(1)", True), ("(2.3)", True), ("[1.4]", True), ("This is a normal sentence.", False), ("Introduction", False), ("", False)])
def test_formula_predicate(spark, text_, want):
    assert one(spark, prose.is_formula(strip(F.lit(text_))))[0] is want


def test_formula_gets_alt(spark):
    row = prose.tag_formulas(nodes(spark, (0, "P", 1, None, r"\sigma = \sqrt{\frac{1}{n}}"))).first()
    assert row.tag == "Formula" and row.alt.startswith("Mathematical expression: ")


# --- layout JSON ---

def flat(spark, doc):
    return layout_json.flatten(spark.createDataFrame([(1, json.dumps(doc))], "doc_id long, json string")).orderBy("ord").collect()


@pytest.mark.parametrize("element,tag", [
    ({"type": "heading", "heading level": 2}, "H2"), ({"type": "heading", "heading level": 9}, "H6"), ({"type": "heading", "heading level": 0}, "H1"),
    ({"type": "heading", "heading level": "x"}, "H1"), ({"type": "paragraph", "pdfua_tag": "P"}, "P"), ({"type": "image", "pdfua_tag": "Figure"}, "Figure"),
    ({"type": "somethingweird"}, "P"), ({"type": "image"}, "Figure")])
def test_tag_resolution(spark, element, tag):
    assert flat(spark, {"kids": [element]})[0].tag == tag


def test_table_children_are_counted_in_pre_order(spark):
    def cell(col, txt):
        return {"type": "table cell", "pdfua_tag": "TD", "row number": 1, "column number": col, "kids": [{"type": "paragraph", "content": txt}]}
    rows = flat(spark, {"kids": [{"type": "table", "pdfua_tag": "Table", "rows": [{"row number": 1, "cells": [cell(1, "a"), cell(2, "b")]}]}]})
    assert [r.tag for r in rows] == ["Table", "TR", "TD", "P", "TD", "P"]
    assert [r.depth for r in rows] == [0, 1, 2, 3, 2, 3] and rows[4].parent_id == rows[1].node_id
    assert rows[2].row_span == 1 and rows[2].header is False


def test_figure_defaults_and_suggested_title(spark):
    fig = flat(spark, {"kids": [{"type": "image", "pdfua_tag": "Figure"}]})[0]
    assert fig.alt is None and fig.decorative is False
    doc = {"kids": [{"type": "heading", "level": "Doctitle", "heading level": 1, "content": "My Title"}, {"type": "paragraph", "content": "Body"}]}
    df = spark.createDataFrame([(1, json.dumps(doc))], "doc_id long, json string")
    assert layout_json.suggested_titles(df, layout_json.flatten(df)).first().suggested_title == "My Title"


def test_bad_layouts_are_set_aside(spark):
    df = spark.createDataFrame([(1, '{"kids": []}'), (2, '{"kids": [')], "doc_id long, json string")
    good, bad = layout_json.split_rejects(df)
    assert [r.doc_id for r in good.collect()] == [1] and [r.doc_id for r in bad.collect()] == [2]


def test_layout_files_and_size_limit(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"kids": [{"type": "paragraph", "content": "x"}]}')
    assert layout_json.flatten(layout_json.read_layouts(spark, str(tmp_path))).count() == 1
    assert [r.accepted for r in text.list_files(spark, str(tmp_path), limit=10).collect()] == [False]


def test_validator_report_without_result_is_unknown(spark):
    row = validator.validations(spark.createDataFrame([(1, "<report><jobs><job/></jobs></report>")], "doc_id long, xml string")).first()
    assert row.validation_error is not None


def test_validator_namespaces_and_all_contexts(spark):
    checks = "<check status='failed'><context>c</context></check>" * 8
    xml = ("<r:report xmlns:r='u'><r:jobs><r:job><r:validationResult flavour='PDFUA_1' isCompliant='false'><r:details failedRules='1'>"
           f"<r:rule clause='7.1' testNumber='3' status='failed' failedChecks='8'><r:description>d</r:description>{checks.replace('<check', '<r:check').replace('</check', '</r:check').replace('<context', '<r:context').replace('</context', '</r:context')}"
           "</r:rule></r:details></r:validationResult></r:job></r:jobs></r:report>")
    row = validator.failed_rules(spark.createDataFrame([(1, xml)], "doc_id long, xml string")).first()
    assert row.contexts == "|".join("c" * 8) and row.clause == "7.1" and row.failed_checks == 8


# --- headings, routing, security, layers ---

@pytest.mark.parametrize("tags,types", [(["H1", "H2", "H3", "H2"], []), (["H1", "H3"], ["skipped_level"]), (["H2", "H3"], ["missing_h1"]), (["H", "H2"], [])])
def test_heading_issues(spark, tags, types):
    df = nodes(spark, *[(i, t, 1, None, t) for i, t in enumerate(tags)])
    assert [r.type for r in headings.heading_issues(headings.heading_rows(df)).collect()] == types


def test_routing_of_stub_and_real_trees(spark):
    docs = spark.createDataFrame([(1, True, True), (2, True, True), (3, False, False)], "doc_id long, has_struct boolean, marked boolean")
    rows = [(d, f"n{i}") for d, n in ((1, 6), (2, 1), (3, 9)) for i in range(n)]
    out = {r.doc_id: r for r in document.tag_routing(docs, spark.createDataFrame(rows, "doc_id long, node_id string")).collect()}
    assert [(out[d].route, out[d].elements) for d in (1, 2, 3)] == [("repair", 6), ("rebuild", 1), ("rebuild", 0)]


def test_security_levels(spark):
    docs = spark.createDataFrame([(1, False, False, False), (2, True, True, False), (3, True, False, True), (4, True, True, True)],
                                 "doc_id long, encrypted boolean, allow_access boolean, allow_extract boolean")
    assert [r.severity for r in document.security(docs).orderBy("doc_id").collect()] == ["ok", "warning", "error", "ok"]


def test_unnamed_layer_is_only_reported_as_unnamed(spark):
    df = spark.createDataFrame([(1, 1, " ", True, "OFF")], "doc_id long, layer_id long, name string, off_default boolean, print_state string")
    assert [r.type for r in document.layers(df).collect()] == ["ocg_no_name"]


# --- tables ---

CELL = "doc_id long, table_id long, row int, col int, cell_id long, row_span int, col_span int, tag string, text string, scope string, headers string"


def grid(spark, rows):
    """rows of tags or (tag, col_span, row_span)."""
    out = []
    for r, row in enumerate(rows, 1):
        for i, cell in enumerate(row, 1):
            tag, cs, rs = cell if isinstance(cell, tuple) else (cell, 1, 1)
            out.append((1, 1, r, i, r * 100 + i, rs, cs, tag, "x", None, None))
    return spark.createDataFrame(out, CELL)


@pytest.mark.parametrize("rows,after", [
    ([["TH"] * 3, ["TH", "TH", "TD", "TD"], ["TH", "TD", "TD"]], [4, 4, 4]), ([["TH", "TH"], ["TD", "TD"], ["TD", "TD"]], [2, 2, 2]),
    ([[("TH", 3, 1)], ["TD"] * 3], [1, 3]), ([[("TH", 1, 2), "TH"], ["TD"], ["TD", "TD"]], [2, 1, 2])])
def test_rows_padded_to_table_width(spark, rows, after):
    out = tables.normalize_tables(grid(spark, rows)).orderBy("row").collect()
    assert [r.n_cells + r.padding for r in out] == after


def test_row_scope_goes_to_leading_cells_of_body_rows(spark):
    out = tables.normalize_tables(grid(spark, [["TH", "TH"], ["TH", "TD"]])).orderBy("row").collect()
    assert [(r.scoped, r.row_scopes) for r in out] == [(2, 0), (1, 1)]


def test_corner_gets_both_scopes(spark):
    out = tables.assign_scope(grid(spark, [["TH", "TH"], ["TH", "TD"]])).orderBy("row", "col").collect()
    assert [r.scope for r in out] == ["Both", "Column", "Row"]


def test_half_of_a_quotient_rounds_to_even(spark):
    """494 words in 39 sentences with 741 syllables: 4.94 + 17.7 - 15.59 is 7.05, in doubles a little more."""
    from tagloom.functions.numbers import half_even

    row = spark.range(1).select(F.col("id") + 494, F.col("id") + 39, F.col("id") + 741).toDF("w", "s", "y")
    grade = 0.39 * (F.col("w") / F.col("s")) + 11.8 * (F.col("y") / F.col("w")) - 15.59
    assert row.select(half_even(grade, 1)).first()[0] == 7.0
    values = spark.createDataFrame([(0.25,), (0.35,), (-2.5,), (3.14159,), (None,)], "v double")
    assert [r[0] for r in values.select(half_even("v", 1)).collect()] == [0.2, 0.4, -2.5, 3.1, None]


def test_link_rules_judge_a_text_once(spark):
    """The filter on the verdict stays above the verdict: the plan holds each pattern once."""
    from tagloom.operators import interactive

    texts = ["Click  here. ", "here", "Read more about it", "details", "info.", "WWW.example.org", "https://x.org/a", "ok", "12", "", "A real title", "this article"]
    links = spark.createDataFrame([(1, 1, i, "https://e.org", t, None) for i, t in enumerate(texts)],
                                  "doc_id long, page int, link_id long, uri string, text string, contents string")
    found = interactive.link_text(links)
    assert {r.link_id: r.reason for r in found.collect()} == {
        0: "generic", 1: "generic", 3: "generic", 4: "generic", 5: "bare_domain", 6: "bare_url", 8: "numeric_or_punctuation", 9: "bare_url", 11: "generic"}
    quality = interactive.link_quality(links)
    assert {r.link_id: r.type for r in quality.collect()} == {1: "generic", 2: "generic", 3: "generic", 4: "generic", 5: "url", 6: "url", 7: "short", 8: "short"}
    for df, once in ((found, "bare_domain"), (quality, "short")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count(f"THEN {once}") == 1


def test_languages_of_ties_and_scripts(spark):
    from tagloom.functions import language

    rows = ["un un un un", "the der the der", "xxxx yyyy zzzz", "здравствуй мир", "the мир and so on", "short"]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select(language.detect_language(F.col("t")), language.script_mismatch(F.col("t"), F.lit("en")))
    assert [tuple(r) for r in df.collect()] == [("fr", None), ("en", None), (None, None), ("ru", "Cyrillic"), ("en", "Cyrillic"), (None, None)]
