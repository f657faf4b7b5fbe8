"""Colour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.dialect import oracle, view
from tagloom.functions.numbers import half_even
from tagloom.operators import contrast as op


def chan(c: str, shift: int) -> str:
    return f"((({c}) >> {shift}) & 255)"


def lin(v: str) -> str:
    return f"(CASE WHEN {v} <= 0.04045e0 THEN {v} / 12.92e0 ELSE pow(({v} + 0.055e0) / 1.055e0, 2.4e0) END)"


def lum3(r: str, g: str, b: str) -> str:
    return f"(0.2126e0 * {lin(r)} + 0.7152e0 * {lin(g)} + 0.0722e0 * {lin(b)})"


def lum(c: str) -> str:
    return lum3(*[f"({chan(c, s)} / 255e0)" for s in (16, 8, 0)])


def ratio(a: str, b: str) -> str:
    return f"((greatest({a}, {b}) + 0.05e0) / (least({a}, {b}) + 0.05e0))"


def hexs(c: str) -> str:
    return f"('#' || lower(lpad(to_hex({c}), 6, '0')))"


def dist(a: str, b: str) -> str:
    return "(" + " + ".join(f"abs({chan(a, s)} - {chan(b, s)})" for s in (16, 8, 0)) + ")"


def q8(v: str) -> str:
    return f"(round_even({v} * 255e0, 0) / 255e0)"


CONTRAST_SQL = f"""
WITH s AS (SELECT *, trim(text) AS t, CASE WHEN size >= 18 OR (size >= 14 AND flags & 16 <> 0) THEN 3e0 ELSE 4.5e0 END AS req,
           {lum("color")} AS l1, {lum("bg")} AS l2 FROM fx_spans),
 f AS (SELECT *, {ratio("l1", "l2")} AS ra FROM s WHERE length(t) >= 2)
SELECT doc_id, page, block, line, span, substr(t, 1, 80) AS text, {hexs("color")} AS fg, {hexs("bg")} AS bg,
  round_even(ra, 2) AS ratio, req AS required FROM f WHERE ra < req"""

NONTEXT_SQL = f"""
WITH cov AS (SELECT p.doc_id, p.page, p.width, p.height, least(coalesce(a.area, 0e0) / (p.width * p.height), 1e0) AS cover
   FROM fx_page_sizes p LEFT JOIN (SELECT doc_id, page, sum(w * h) AS area FROM fx_images GROUP BY 1, 2) a USING (doc_id, page)),
 ui AS (SELECT doc_id, page, 0 AS kind, annot_id AS item, 'ui_component' AS type, subtype AS component, stroke AS fg,
   coalesce(bg, 16777215) AS bg FROM fx_annots
   WHERE subtype IN ('Widget', 'FreeText', 'Square', 'Circle') AND stroke IS NOT NULL),
 g AS (SELECT p.doc_id, p.page, 1 AS kind, path_id AS item, 'graphic' AS type, 'line/path w=' || printf('%.1f', p.width) || 'pt' AS component,
   color AS fg, coalesce(bg, 16777215) AS bg FROM fx_paths p JOIN cov c ON p.doc_id = c.doc_id AND p.page = c.page
   WHERE c.cover <= 0.6 AND color IS NOT NULL AND p.width > 0 AND p.width <= 3 AND greatest(w, h) >= 10
   AND NOT (w >= c.width * 0.7 AND h < 5) AND NOT (h >= c.height * 0.7 AND w < 5)
   AND NOT (closed AND items <= 5 AND least(w, h) > 5)
   AND NOT ({chan("color", 16)} >= 230 AND {chan("color", 8)} >= 230 AND {chan("color", 0)} >= 230)),
 u AS (SELECT *, {lum("fg")} AS l1, {lum("bg")} AS l2 FROM (SELECT * FROM ui UNION ALL SELECT * FROM g)),
 r AS (SELECT *, {ratio("l1", "l2")} AS ra FROM u)
SELECT doc_id, page, type, component, item, {hexs("fg")} AS fg, {hexs("bg")} AS bg, round_even(ra, 2) AS ratio, 3e0 AS required
FROM r WHERE ra < 3"""

RGB_SQL = """rgb AS (SELECT *, CASE space WHEN 'rgb' THEN a WHEN 'gray' THEN a WHEN 'cmyk' THEN (1 - a) * (1 - d) ELSE 0e0 END AS r,
   CASE space WHEN 'rgb' THEN b WHEN 'gray' THEN a WHEN 'cmyk' THEN (1 - b) * (1 - d) ELSE 0e0 END AS g,
   CASE space WHEN 'rgb' THEN c WHEN 'gray' THEN a WHEN 'cmyk' THEN (1 - c) * (1 - d) ELSE 0e0 END AS bl,
   space IN ('rgb', 'gray', 'cmyk') AS known FROM fx_fills)"""


def _pack(r, g, b):
    return f"CAST(CAST(round_even({r} * 255e0, 0) AS INT) * 65536 + CAST(round_even({g} * 255e0, 0) AS INT) * 256 + CAST(round_even({b} * 255e0, 0) AS INT) AS INT)"


DARKEN_EXACT_SQL = f"""
WITH RECURSIVE {RGB_SQL},
 q AS (SELECT DISTINCT r, g, bl, 1.05e0 / ({lum3(q8("r"), q8("g"), q8("bl"))} + 0.05e0) AS now FROM rgb WHERE known),
 bis AS (SELECT r, g, bl, 0 AS step, 0e0 AS lo, 1e0 AS hi FROM q WHERE now < 4.5
   UNION ALL SELECT r, g, bl, step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
   FROM (SELECT *, 1.05e0 / ({lum3(q8("r * mid"), q8("g * mid"), q8("bl * mid"))} + 0.05e0) >= 4.5 AS ok
         FROM (SELECT *, (lo + hi) / 2e0 AS mid FROM bis WHERE step < 24))),
 stp AS (SELECT r, g, bl, k, greatest(0e0, {q8("r * lo")} - k / 255e0) AS r2, greatest(0e0, {q8("g * lo")} - k / 255e0) AS g2,
   greatest(0e0, {q8("bl * lo")} - k / 255e0) AS b2 FROM bis, range(0, 9) t(k) WHERE step = 24),
 hit AS (SELECT r, g, bl, coalesce(min(k) FILTER (WHERE 1.05e0 / ({lum3("r2", "g2", "b2")} + 0.05e0) >= 4.5), 8) AS k FROM stp GROUP BY 1, 2, 3),
 fin AS (SELECT h.r, h.g, h.bl, {_pack("r2", "g2", "b2")} AS fixed FROM hit h JOIN stp s ON h.r = s.r AND h.g = s.g AND h.bl = s.bl AND h.k = s.k)
SELECT doc_id, page, fill_id, {hexs(_pack("rgb.r", "rgb.g", "rgb.bl"))} AS rgb, NOT known OR coalesce(q.now < 4.5, false) AS needs_fix,
  CASE WHEN NOT known THEN '#000000' WHEN q.now < 4.5 THEN {hexs("fin.fixed")} END AS fixed
FROM rgb LEFT JOIN q ON known AND rgb.r = q.r AND rgb.g = q.g AND rgb.bl = q.bl
LEFT JOIN fin ON known AND rgb.r = fin.r AND rgb.g = fin.g AND rgb.bl = fin.bl"""


def _linear_sql(source: str, required: str) -> str:
    """Darkening by 0.005 steps for distinct (fg, bg) packed pairs of ``source``."""
    r, g, b = [f"({chan('fg', s)} / 255e0)" for s in (16, 8, 0)]
    q = [q8(f"{v} * (1e0 - i * 0.005e0)") for v in (r, g, b)]
    return f"""pairs AS (SELECT DISTINCT fg, bg FROM {source}),
 tried AS (SELECT fg, bg, i, {_pack(*[f"{v} * (1e0 - i * 0.005e0)" for v in (r, g, b)])} AS cand,
   {ratio(lum3(*q), lum("bg"))} AS ra FROM pairs, range(0, 201) t(i)),
 best AS (SELECT fg, bg, min(i) AS i FROM tried WHERE ra >= {required} GROUP BY 1, 2),
 fix AS (SELECT p.fg, p.bg, b.i, t.cand FROM pairs p LEFT JOIN best b ON p.fg = b.fg AND p.bg = b.bg
   LEFT JOIN tried t ON t.fg = b.fg AND t.bg = b.bg AND t.i = b.i)"""


DARKEN_LINEAR_SQL = f"""
WITH src AS ({CONTRAST_SQL.replace("doc_id, page, block, line, span, substr(t, 1, 80) AS text, " + hexs("color") + " AS fg, " + hexs("bg") + " AS bg,", "doc_id, page, block, line, span, color AS fg, bg,")}),
 {_linear_sql("src", "4.5")}
SELECT doc_id, page, block, line, span, {hexs("src.fg")} AS fg, {hexs("src.bg")} AS bg, {hexs("coalesce(fix.cand, 0)")} AS fixed
FROM src JOIN fix ON src.fg = fix.fg AND src.bg = fix.bg"""

DARKEN_GRAPHIC_SQL = f"""
WITH src AS ({NONTEXT_SQL.replace("item, " + hexs("fg") + " AS fg, " + hexs("bg") + " AS bg,", "item, fg, bg,")}),
 gr AS (SELECT * FROM src WHERE type = 'graphic'),
 {_linear_sql("gr", "3.0")}
SELECT doc_id, page, item, {hexs("gr.fg")} AS fg, {hexs("gr.bg")} AS bg,
  CASE WHEN fix.i > 0 AND 1e0 - fix.i * 0.005e0 >= 0.45 THEN {hexs("fix.cand")} END AS fixed
FROM gr JOIN fix ON gr.fg = fix.fg AND gr.bg = fix.bg"""


def background_pick(spark, sf):
    s = view(spark, sf, "samples")
    pts = F.array("s0", "s1", "s2", "s3")
    return s.select("doc_id", "page", "span", op.background_pick(pts, F.col("s3"), F.col("fg")).alias("bg"))


_CAND = " UNION ALL ".join(f"SELECT doc_id, page, span, fg, s3, {i} AS i, s{i} AS s FROM fx_samples" for i in range(4))
PICK_SQL = f"""
WITH c AS ({_CAND}),
 k AS (SELECT *, CASE WHEN fg IS NULL THEN {dist("s", "0")} ELSE {dist("s", "fg")} END AS score FROM c),
 b AS (SELECT doc_id, page, span, s, row_number() OVER (PARTITION BY doc_id, page, span ORDER BY score DESC, i) AS rn
   FROM k WHERE fg IS NULL OR score >= 40)
SELECT x.doc_id, x.page, x.span, CASE WHEN b.s IS NULL THEN x.s3 ELSE b.s END AS bg FROM fx_samples x
LEFT JOIN b ON b.rn = 1 AND x.doc_id = b.doc_id AND x.page = b.page AND x.span = b.span"""

QUERIES = {
    "contrast_failures": lambda s, p: op.contrast_failures(view(s, p, "spans")),
    "contrast_darken_linear": lambda s, p: op.contrast_repairs(op.contrast_failures(view(s, p, "spans"))),
    "contrast_darken_exact": lambda s, p: op.fill_repairs(view(s, p, "fills")),
    "nontext_contrast": lambda s, p: op.nontext_contrast(
        view(s, p, "annots"), view(s, p, "paths"), view(s, p, "page_sizes"), view(s, p, "images")),
    "graphic_darken": lambda s, p: op.graphic_repairs(op.nontext_contrast(
        view(s, p, "annots"), view(s, p, "paths"), view(s, p, "page_sizes"), view(s, p, "images"))),
    "background_pick": background_pick,
    "background_fills": lambda s, p: op.background_fills(view(s, p, "fills")),
    "page_image_cover": lambda s, p: op.page_image_cover(view(s, p, "images"), view(s, p, "page_sizes")).withColumn(
        "cover", half_even("cover", 6)),
}
ORACLES = {
    "contrast_failures": oracle("spans", CONTRAST_SQL),
    "contrast_darken_linear": oracle("spans", DARKEN_LINEAR_SQL),
    "contrast_darken_exact": oracle("fills", DARKEN_EXACT_SQL),
    "nontext_contrast": oracle("annots paths page_sizes images", NONTEXT_SQL),
    "graphic_darken": oracle("annots paths page_sizes images", DARKEN_GRAPHIC_SQL),
    "background_pick": oracle("samples", PICK_SQL),
    "background_fills": oracle("fills", f"""WITH {RGB_SQL}, m AS (SELECT *, abs(w) * abs(h) AS area, {lum3("r", "g", "bl")} AS lum,
   greatest(abs(r - (r + g + bl) / 3e0), abs(g - (r + g + bl) / 3e0), abs(bl - (r + g + bl) / 3e0)) AS chroma FROM rgb WHERE known)
SELECT doc_id, page, fill_id, area, round_even(lum, 4) AS lum, round_even(chroma, 4) AS chroma FROM m
WHERE area >= 400 AND lum > 0.05 AND lum < 0.95 AND chroma > 0.04"""),
    "page_image_cover": oracle("images page_sizes", """SELECT p.doc_id, p.page,
   round_even(least(coalesce(a.area, 0e0) / (p.width * p.height), 1e0), 6) AS cover FROM fx_page_sizes p
   LEFT JOIN (SELECT doc_id, page, sum(w * h) AS area FROM fx_images GROUP BY 1, 2) a ON a.doc_id = p.doc_id AND a.page = p.page"""),
}
