"""Repairs and comparisons: overlays, reorders, corrections, catalog repairs, round trip."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom import lexicon as lx
from tagloom.functions.text import blank, left, lookup, match_key, strip
from tagloom.operators import headings, scan
from tagloom.operators.contrast import first_n
from tagloom.operators.layout import duplicate_ids, figure_numbers
from tagloom.operators.tables import assign_scope
from tagloom.session import cut_lineage, stored


# --- comparing runs -------------------------------------------------------------

def best_of(repaired: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """A rebuild replaces a failed repair when it fails fewer checks.

    ``repaired`` has doc_id, mode, compliant, validation_failed, failed_checks; ``rebuilt`` has
    doc_id, failed_checks. A document that was not rebuilt keeps its repair.
    """
    mode = F.coalesce("mode", F.lit("rebuild"))
    again = rebuilt.select("doc_id", F.col("failed_checks").alias("_again"))
    wins = F.coalesce(~F.col("compliant") & (mode == "repair") & ~F.col("validation_failed") & (F.col("_again") < F.col("failed_checks")), F.lit(False))
    return repaired.join(again, "doc_id", "left").select(
        "doc_id", F.when(wins, "rebuild").otherwise(mode).alias("mode"), wins.alias("rebuild_used"),
        F.when(wins, F.col("_again")).otherwise(F.col("failed_checks")).alias("failed_checks"))


def regression_guard(before: DataFrame, after: DataFrame) -> DataFrame:
    """The input is handed back when the output fails more checks than it did.

    Both are validations (doc_id, failed_checks); without one of the input nothing is compared.
    """
    was = before.select("doc_id", F.col("failed_checks").alias("_was"))
    worse = F.coalesce(F.col("failed_checks") > F.col("_was"), F.lit(False))
    return after.join(was, "doc_id", "left").select(
        "doc_id", worse.alias("triggered"), F.when(worse, F.col("_was")).alias("input_failed"),
        F.when(worse, F.col("failed_checks")).alias("rejected_failed"),
        F.when(worse, F.col("_was")).otherwise(F.col("failed_checks")).alias("failed_checks"))


def merge_records(runs: DataFrame, fonts: DataFrame) -> DataFrame:
    """Record after a second fix pass: a note can declare conformance, embedding clears font errors."""
    errors = fonts.filter(F.col("severity") == "error").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    said = F.coalesce(F.lower("note").contains("compliant"), F.lit(False))
    return runs.join(errors, "doc_id", "left").select(
        "doc_id", (F.col("compliant") | said).alias("compliant"),
        F.when(F.col("fonts_embedded"), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("font_errors"))


# --- overlays -------------------------------------------------------------------

def patch(rows: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Overlay the non-null values of ``patches`` on the matching rows."""
    columns = [c for c in patches.columns if c not in keys]
    renamed = patches.withColumnsRenamed({c: f"_p_{c}" for c in columns})
    out = rows.join(renamed, keys, "left")
    return out.select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def answers_as_patch(answers: DataFrame) -> DataFrame:
    """Review answers: decorative clears the text, a text sets it, an empty answer changes nothing."""
    value = strip(F.coalesce("value", F.lit("")))
    used = answers.filter(F.col("decorative") | (value != ""))
    return used.select("doc_id", "node_id", F.when(F.col("decorative"), F.lit("")).otherwise(value).alias("alt"), "decorative")


def patch_metadata(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """Set the supplied fields only and list what was set."""
    fields = {"title": "Title", "author": "Author", "subject": "Subject", "lang": "Lang"}
    given = patches.select("doc_id", *[F.nullif(c, F.lit("")).alias("_" + c) for c in fields])
    names = F.array_compact(F.array(*[F.when(F.col("_" + c).isNotNull(), F.lit(n)) for c, n in fields.items()],
                                    F.lit("ViewerPreferences.DisplayDocTitle")))
    return docs.join(given, "doc_id").select(
        "doc_id", *[F.coalesce("_" + c, c).alias(c) for c in fields], F.array_join(names, ",").alias("patched"))


# --- reading order --------------------------------------------------------------

def reading_order(nodes: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Top-level elements with position id, type label, preview and child count."""
    top = scan.with_chunk(nodes.filter(F.col("parent_id").isNull()), "ord", chunk_rows)
    top = scan.rank_in_order(top.select("doc_id", "node_id", "ord", "tag", "alt", "text", "_chunk"), ["doc_id"], ["ord"], "n")
    kids = nodes.filter(F.col("parent_id").isNotNull()).groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("children"))
    shown = F.when(F.coalesce("alt", F.lit("")) != "", F.col("alt")).otherwise(strip(F.coalesce("text", F.lit(""))))
    return top.join(kids, ["doc_id", "node_id"], "left").select(
        "doc_id", F.concat(F.lit("e"), F.col("n") - 1).alias("id"), "node_id",
        F.coalesce(lookup(lx.ORDER_LABELS, F.col("tag")), F.lit("Other")).alias("type"), "tag",
        left(shown, 80).alias("preview"), F.coalesce("children", F.lit(0)).alias("children"))


def reorder(nodes: DataFrame, requests: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Requested elements first, the rest as they were, non-element slots untouched.

    ``nodes`` carries is_element; ``requests`` (doc_id, node_id, pos >= 0). The k-th
    element of the new order takes the k-th element slot.
    """
    elements = nodes.filter("is_element").select("doc_id", "node_id", "ord")
    slots = scan.rank_in_order(scan.with_chunk(elements, "ord", chunk_rows), ["doc_id"], ["ord"], "slot").drop("_chunk")
    asked = elements.join(requests, ["doc_id", "node_id"], "left")
    asked = asked.withColumns({"_g": F.when(F.col("pos").isNull(), 1).otherwise(0), "_p": F.coalesce("pos", "ord")})
    # requested chunks sort before the others: negative numbers
    chunk = F.floor(F.col("_p") / chunk_rows)
    asked = asked.withColumn("_chunk", F.when(F.col("_g") == 0, chunk - F.lit(1 << 40)).otherwise(chunk))
    ranked = scan.rank_in_order(asked, ["doc_id"], ["_g", "_p", "ord"], "slot").select("doc_id", "node_id", "slot", F.col("ord").alias("old_ord"))
    placed = ranked.join(slots.select("doc_id", "slot", F.col("ord").alias("new_ord")), ["doc_id", "slot"])
    return placed.select("doc_id", "node_id", "old_ord", "new_ord", (F.col("old_ord") != F.col("new_ord")).alias("moved"))


def reorder_pages(nodes: DataFrame, requests: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """On pages with a request, requested nodes first, omitted ones after, all at the
    place of the page's first node. ``requests`` is (doc_id, page, node_id, pos)."""
    pages = requests.select("doc_id", "page").distinct()
    anchors = nodes.join(pages, ["doc_id", "page"], "left_semi").groupBy("doc_id", "page").agg(F.min("ord").alias("_anchor"))
    rows = nodes.select("doc_id", "page", "node_id", "ord").join(anchors, ["doc_id", "page"], "left").join(
        requests.select("doc_id", "node_id", "pos"), ["doc_id", "node_id"], "left")
    rows = rows.withColumns({
        "_a": F.coalesce("_anchor", "ord"), "_late": F.col("pos").isNull().cast("int"), "_p": F.coalesce("pos", "ord")})
    rows = rows.withColumn("_chunk", F.floor(F.col("_a") / chunk_rows))
    return scan.rank_in_order(rows, ["doc_id"], ["_a", "_late", "_p", "ord"], "rank").select("doc_id", "node_id", "ord", "rank")


# --- corrections ----------------------------------------------------------------

def _elements(nodes: DataFrame) -> DataFrame:
    """What corrections look at of every node, with its normalised text; written once, for as many steps as read it."""
    return stored(nodes.select("doc_id", "node_id", "ord", "tag", "alt", match_key(F.coalesce("text", F.lit(""))).alias("key")), "fix-elements")


def apply_fixes(nodes: DataFrame, fixes: DataFrame) -> DataFrame:
    """Outcome of each correction: applied, or skipped with the reason.

    A retag needs exactly one node with the same normalised text, else exactly one where
    one text is a prefix of the other. Equal texts of a document are one row, and prefixes are
    looked up as whole strings of the lengths that can match, so every joined pair is a match.
    Later retags of a node see the earlier ones. Nodes and corrections are read and normalised once.
    """
    return _outcomes(_elements(nodes), fixes).drop("action")


def _outcomes(elements: DataFrame, fixes: DataFrame) -> DataFrame:
    """``apply_fixes`` from the written nodes, with the action."""
    keys = ["doc_id", "fix_id", "action"]
    action = F.col("action")
    asked = stored(fixes.select(
        *keys, "new_tag", F.when(action == "retag", match_key(F.coalesce("target_text", F.lit("")))).alias("target"),
        F.when(action == "set_alt", F.coalesce("figure_number", F.lit(0))).cast("long").alias("figure_no"),
        F.when(action == "set_alt", strip(F.coalesce("new_alt", F.lit("")))).when(
            action == "set_title", strip(F.coalesce("new_title", F.lit("")))).alias("value")), "fix-requests")
    retags = asked.filter(action == "retag").select(*keys, "new_tag", "target")
    valid = F.col("new_tag").isin(lx.ALLOWED_RETAGS) & (F.length("target") >= 3)
    wanted = retags.filter(valid)
    texts = elements.filter(F.length("key") >= 3).groupBy("doc_id", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("node_id", "tag")).alias("e"))
    texts = stored(texts, "fix-texts")

    def one(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.groupBy(*keys).agg(F.sum("n").alias("n_" + name), F.min("e").alias(name))

    matched = stored(wanted.join(texts.withColumnRenamed("key", "target"), ["doc_id", "target"], "left"), "fix-matches")
    exact = matched.filter("n IS NOT NULL").select(*keys, "new_tag", "n", "e")
    open_ = matched.filter("n IS NULL").select(*keys, "new_tag", "target")
    lengths = texts.select("doc_id", F.length("key").alias("_size")).distinct()
    shorter = open_.join(lengths, "doc_id").filter(F.col("_size") <= F.length("target")).select(
        *keys, F.substr("target", F.lit(1), F.col("_size")).alias("key")).join(texts, ["doc_id", "key"])
    sizes = open_.select("doc_id", F.length("target").alias("_size")).distinct()
    starts = texts.join(sizes, "doc_id").filter(F.length("key") > F.col("_size")).select(
        "doc_id", F.substr("key", F.lit(1), F.col("_size")).alias("target"), "n", "e")
    longer = open_.join(starts, ["doc_id", "target"])
    prefix = one(shorter.select(*keys, "n", "e").unionByName(longer.select(*keys, "n", "e")), "prefix")
    near = open_.join(prefix, keys, "left").select(*keys, "new_tag", F.coalesce("n_prefix", F.lit(0)).alias("n"), F.col("prefix").alias("e"))
    found = stored(exact.unionByName(near), "fix-found")
    w = Window.partitionBy("doc_id", "node_id").orderBy("fix_id")
    single = found.filter(F.col("n") == 1).select(*keys, "new_tag", F.col("e.node_id").alias("node_id"), F.col("e.tag").alias("tag"))
    single = single.withColumn("before", F.coalesce(F.lag("new_tag").over(w), F.col("tag")))
    retagged = single.select(*keys, "node_id", F.when(F.col("before") == F.col("new_tag"), F.concat(
        F.lit("already tagged "), "new_tag")).alias("why"), F.col("new_tag").alias("value"))
    none = F.lit(None).cast("string")
    unmatched = found.filter(F.col("n") != 1).select(*keys, none.alias("node_id"), F.concat(
        F.col("n").cast("string"), F.lit(" elements matched, need exactly 1")).alias("why"), none.alias("value"))
    invalid = retags.filter(~valid).select(*keys, none.alias("node_id"), F.lit("invalid retag parameters").alias("why"), none.alias("value"))

    alts = asked.filter(action == "set_alt").select(*keys, "figure_no", "value")
    figures = figure_numbers(elements).select("doc_id", "figure_no", "node_id")
    ok = F.col("node_id").isNotNull() & (F.col("value") != "")
    altered = alts.join(figures, ["doc_id", "figure_no"], "left").select(
        *keys, F.when(ok, F.col("node_id")).alias("node_id"), F.when(~ok, F.lit("figure not found or empty alt")).alias("why"),
        F.when(ok, F.col("value")).alias("value"))
    titled = asked.filter(action == "set_title").select(
        *keys, none.alias("node_id"), F.when(F.col("value") == "", F.lit("empty title")).alias("why"), F.nullif("value", F.lit("")).alias("value"))
    unknown = asked.filter(~action.isin("retag", "set_alt", "set_title")).select(
        *keys, none.alias("node_id"), F.concat(F.lit("unknown action "), "action").alias("why"), none.alias("value"))
    out = retagged.unionByName(unmatched).unionByName(invalid).unionByName(altered).unionByName(titled).unionByName(unknown)
    return out.withColumn("applied", F.col("why").isNull())


def corrected(nodes: DataFrame, fixes: DataFrame, chunk_rows: int = scan.CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The nodes after all corrections, and the log of what was done to them.

    A node keeps its last applied tag and alternative text. Retags may open gaps between heading levels, so the headings of
    documents with an applied retag, and of no others, are repaired after that; each such document has one more line in
    the log (action heading_levels, no fix_id, the number of repaired headings as value).
    """
    elements = _elements(nodes)
    log = stored(_outcomes(elements, fixes).select("doc_id", "fix_id", "action", "node_id", "applied", "why", "value"), "fix-log")
    done = log.filter("applied AND node_id IS NOT NULL")

    def last(action: str) -> Column:
        return F.max_by(F.when(F.col("action") == action, F.col("value")), F.when(F.col("action") == action, F.col("fix_id")))

    changes = stored(done.groupBy("doc_id", "node_id").agg(last("retag").alias("_tag"), last("set_alt").alias("_alt")), "fix-changes")
    touched = done.filter("action = 'retag'").select("doc_id").distinct()
    tags = elements.select("doc_id", "node_id", "ord", "tag").join(changes.select("doc_id", "node_id", "_tag"), ["doc_id", "node_id"], "left").select(
        "doc_id", "ord", F.coalesce("_tag", "tag").alias("tag"))
    # written before its levels are repaired, which reads it for the rows and for the summaries
    heads = stored(tags.filter(F.col("tag").rlike("^H[1-6]$")).join(touched, "doc_id", "left_semi").select(
        "doc_id", "ord", F.substring("tag", 2, 1).cast("int").alias("level")), "fix-heads")
    levels = stored(headings.repair_levels(heads, chunk_rows).filter("new_level <> level").select("doc_id", "ord", "new_level"), "fix-levels")
    out = nodes.join(changes, ["doc_id", "node_id"], "left").join(levels, ["doc_id", "ord"], "left").withColumns({
        "tag": F.coalesce(F.concat(F.lit("H"), F.col("new_level")), "_tag", "tag"), "alt": F.coalesce("_alt", "alt")}).select(*nodes.columns)
    repaired = levels.groupBy("doc_id").agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        "doc_id", F.lit("heading_levels").alias("action"), F.lit(True).alias("applied"), "value")
    return out, log.unionByName(repaired, allowMissingColumns=True)


# --- catalog and clause repairs --------------------------------------------------

def failed_clauses(rules: DataFrame) -> DataFrame:
    """Flags per document from its failed rules, combined map-side."""
    key = F.concat_ws("-", "clause", F.col("test_number").cast("string"))
    exact = {"f_7_1_3": "7.1-3", "f_7_1_5": "7.1-5", "f_7_2_1": "7.2-1", "f_7_3_3": "7.3-3", "f_7_1_2": "7.1-2"}
    family = {"f_7_1": "7.1", "f_7_2": "7.2", "f_7_3": "7.3", "f_7_4": "7.4", "f_7_5": "7.5", "f_7_18": "7.18"}
    return rules.filter(F.col("status") == "failed").groupBy("doc_id").agg(
        *[F.bool_or(key == v).alias(k) for k, v in exact.items()],
        *[F.bool_or(F.col("clause").startswith(v)).alias(k) for k, v in family.items()])


def _log(df: DataFrame, *entries: tuple[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("repair"), c.cast("long").alias("n")) for n, c in entries])
    return df.select("doc_id", F.inline(rows)).filter(F.col("n") > 0)


def annotated_pages(annots: DataFrame) -> DataFrame:
    return annots.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("annot_pages"))


def auto_repairs(rules: DataFrame, docs: DataFrame, nodes: DataFrame, annots: DataFrame) -> DataFrame:
    """Repair log of the exact-clause rules; tab order whenever pages have annotations."""
    figures = nodes.filter((F.col("tag") == "Figure") & F.col("alt").isNotNull() & blank(F.col("alt"))).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("empty_alts"))
    facts = docs.join(failed_clauses(rules), "doc_id").join(figures, "doc_id", "left").join(annotated_pages(annots), "doc_id", "left")
    return _log(
        facts, ("marked", (F.col("f_7_1_3") & ~F.col("marked")).cast("int")),
        ("display_title", (F.col("f_7_1_5") & ~F.col("display_title")).cast("int")),
        ("lang", (F.col("f_7_2_1") & blank(F.col("lang"))).cast("int")),
        ("figure_alt", (F.col("f_7_3_3") & F.col("empty_alts").isNotNull()).cast("int")),
        ("tab_order", F.coalesce("annot_pages", F.lit(0))))


def clause_repairs(rules: DataFrame, docs: DataFrame, nodes: DataFrame, cells: DataFrame, annots: DataFrame,
                   ids: DataFrame) -> DataFrame:
    """Repair log of the clause-family rules. ``ids`` is (doc_id, node_id, elem_id, ord)."""
    alts = nodes.filter(F.col("tag").isin("Figure", "Formula") & blank(F.col("alt"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("alts"))
    scopes = cells.filter((F.col("tag") == "TH") & F.col("scope").isNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("scopes"))
    contents = annots.filter(F.col("contents").isNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("contents"))
    repeated = duplicate_ids(ids, "elem_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("dups"))
    facts = docs.join(failed_clauses(rules), "doc_id")
    for part in (alts, scopes, contents, repeated, annotated_pages(annots)):
        facts = facts.join(part, "doc_id", "left")

    def gated(flag: Column, n: str) -> Column:
        return F.when(flag, F.coalesce(n, F.lit(0))).otherwise(0)

    return _log(
        facts, ("tab_order", F.coalesce("annot_pages", F.lit(0))),
        ("marked", (F.col("f_7_1") & ~F.col("marked")).cast("int")),
        ("display_title", (F.col("f_7_1") & ~F.col("display_title")).cast("int")),
        ("lang", ((F.col("f_7_2") | F.col("f_7_1_2")) & blank(F.col("lang"))).cast("int")),
        ("figure_alt", gated(F.col("f_7_3"), "alts")), ("th_scope", gated(F.col("f_7_4") | F.col("f_7_5"), "scopes")),
        ("annotation_contents", gated(F.col("f_7_18"), "contents")), ("duplicate_ids", F.coalesce("dups", F.lit(0))))


def fix_tally(log: DataFrame) -> DataFrame:
    """Fixes per step and document, with a total row per document."""
    steps = log.select("doc_id", F.explode(F.array("repair", F.lit("total"))).alias("step"), "n")
    return steps.groupBy("doc_id", "step").agg(F.sum("n").alias("fixes"))


# --- repaired tables ---------------------------------------------------------------

def repaired_docs(docs: DataFrame, rules: DataFrame, lang: str = "en") -> DataFrame:
    """Documents with the catalog entries set that their failed clause families ask for."""
    flags = failed_clauses(rules).select("doc_id", F.col("f_7_1").alias("_root"), (F.col("f_7_2") | F.col("f_7_1_2")).alias("_speech"))
    root, speech = F.coalesce("_root", F.lit(False)), F.coalesce("_speech", F.lit(False))
    return docs.join(flags, "doc_id", "left").withColumns({
        "marked": F.col("marked") | root, "display_title": F.col("display_title") | root,
        "lang": F.when(speech & blank(F.col("lang")), F.lit(lang)).otherwise(F.col("lang"))}).select(*docs.columns)


def repaired_nodes(nodes: DataFrame, rules: DataFrame, alt: str = "Image") -> DataFrame:
    """Nodes with an alternative on every figure and formula of documents that failed 7.3."""
    flags = failed_clauses(rules).filter("f_7_3").select("doc_id", F.lit(True).alias("_asked"))
    bare = F.col("_asked") & F.col("tag").isin("Figure", "Formula") & blank(F.col("alt"))
    return nodes.join(flags, "doc_id", "left").withColumn("alt", F.when(bare, F.lit(alt)).otherwise(F.col("alt"))).select(*nodes.columns)


def repaired_cells(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells with the positional scope on headers that lack one, in documents that failed 7.4 or 7.5."""
    flags = failed_clauses(rules).filter(F.col("f_7_4") | F.col("f_7_5")).select("doc_id")
    keys = ["doc_id", "table_id", "row", "col", "cell_id"]
    scopes = assign_scope(cells.join(flags, "doc_id", "left_semi"), only_missing=True).select(*keys, F.col("scope").alias("_scope")).distinct()
    return cells.join(scopes, keys, "left").withColumn("scope", F.coalesce("_scope", "scope")).select(*cells.columns)


def repaired_annots(annots: DataFrame, rules: DataFrame) -> DataFrame:
    """Annotations with their address (or a blank) as contents where those were missing and 7.18 failed."""
    flags = failed_clauses(rules).filter("f_7_18").select("doc_id", F.lit(True).alias("_asked"))
    missing = F.col("_asked") & F.col("contents").isNull()
    return annots.join(flags, "doc_id", "left").withColumn(
        "contents", F.when(missing, F.coalesce("uri", F.lit(" "))).otherwise(F.col("contents"))).select(*annots.columns)


#: name of a table -> the repair that returns it repaired, from the table and the failed rules.
REPAIRS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "docs": repaired_docs, "nodes": repaired_nodes, "cells": repaired_cells, "annots": repaired_annots,
}


def evaluate_catalog(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Failed rules of the catalog clauses, as a validator would report them."""
    figures = nodes.filter((F.col("tag") == "Figure") & blank(F.col("alt"))).select("doc_id").distinct().withColumn("_bare", F.lit(True))
    failed = {("7.1", 1): ~F.col("has_struct"), ("7.1", 3): ~F.col("marked"), ("7.1", 5): ~F.col("display_title"),
              ("7.2", 1): blank(F.col("lang")), ("7.3", 3): F.coalesce("_bare", F.lit(False))}
    rows = F.array(*[F.struct(F.lit(c).alias("clause"), F.lit(t).alias("test_number"), is_failed.alias("failed")) for (c, t), is_failed in failed.items()])
    return docs.join(figures, "doc_id", "left").select("doc_id", F.inline(rows)).filter("failed").select(
        "doc_id", "clause", "test_number", F.lit("failed").alias("status"))


def _exact_repairs(docs: DataFrame, nodes: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first pass only trusts exact clauses: an empty alternative is filled, a missing one is not."""
    flags = failed_clauses(rules).select("doc_id", "f_7_1_3", "f_7_1_5", "f_7_2_1", F.col("f_7_3_3").alias("_alts"))

    def asked(name: str) -> Column:
        return F.coalesce(name, F.lit(False))

    new_docs = docs.join(flags, "doc_id", "left").withColumns({
        "marked": F.col("marked") | asked("f_7_1_3"), "display_title": F.col("display_title") | asked("f_7_1_5"),
        "lang": F.when(asked("f_7_2_1") & blank(F.col("lang")), F.lit("en")).otherwise(F.col("lang"))}).select(*docs.columns)
    empty = asked("_alts") & (F.col("tag") == "Figure") & F.col("alt").isNotNull() & blank(F.col("alt"))
    new_nodes = nodes.join(flags.select("doc_id", "_alts"), "doc_id", "left").withColumn(
        "alt", F.when(empty, F.lit("Figure")).otherwise(F.col("alt"))).select(*nodes.columns)
    return new_docs, new_nodes


def _changes(docs: DataFrame, new_docs: DataFrame, nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """Number of values a pass changed, per document."""
    values = ["marked", "display_title", "lang"]
    after = new_docs.select("doc_id", *[F.col(v).alias(f"_{v}") for v in values])
    of_docs = docs.join(after, "doc_id").select("doc_id", sum((~F.col(v).eqNullSafe(F.col(f"_{v}"))).cast("int") for v in values).alias("n"))
    of_nodes = nodes.select("doc_id", "ord", "alt").join(new_nodes.select("doc_id", "ord", F.col("alt").alias("_alt")), ["doc_id", "ord"]).filter(
        ~F.col("alt").eqNullSafe(F.col("_alt"))).select("doc_id", F.lit(1).alias("n"))
    return of_docs.unionByName(of_nodes).groupBy("doc_id").agg(F.sum("n").alias("n"))


def fix_until_stable(docs: DataFrame, nodes: DataFrame, rounds: int = 3) -> DataFrame:
    """Evaluate, repair, evaluate again until a document passes, nothing changes, or ``rounds`` are over.

    The first round repairs by exact clause, later ones by clause family; ``open`` tells the
    documents that still fail. Only open documents go on, and what a round leaves is written to
    the shared checkpoint folder, so the plan does not grow and a lost executor costs one round.
    """
    names = ["doc_id", "marked", "display_title", "lang", "has_struct"]
    docs = cut_lineage(docs.select(*names))
    nodes = cut_lineage(nodes.filter(F.col("tag").isin("Figure", "Formula")).select("doc_id", "ord", "tag", "alt"))
    rules = cut_lineage(evaluate_catalog(docs, nodes))
    spent = docs.select("doc_id", F.lit(0).cast("long").alias("fixes"))
    finished = None
    for number in range(rounds + 1):
        failing = rules.select("doc_id").distinct()
        done = spent.join(failing, "doc_id", "left_anti").select(
            "doc_id", F.lit(True).alias("compliant"), F.lit(number).alias("rounds"), "fixes", F.lit(False).alias("open"))
        finished = done if finished is None else finished.unionByName(done)
        docs, nodes, spent = (t.join(failing, "doc_id", "left_semi") for t in (docs, nodes, spent))
        if number == rounds or rules.isEmpty():
            break
        if number:
            new_docs, new_nodes = repaired_docs(docs, rules), repaired_nodes(nodes, rules)
        else:
            new_docs, new_nodes = _exact_repairs(docs, nodes, rules)
        changes = _changes(docs, new_docs, nodes, new_nodes)
        spent = cut_lineage(spent.join(changes, "doc_id", "left").select(
            "doc_id", (F.col("fixes") + F.coalesce("n", F.lit(0))).alias("fixes"), (F.coalesce("n", F.lit(0)) == 0).alias("_idle")))
        if number:
            stuck = spent.filter("_idle").select("doc_id", F.lit(False).alias("compliant"), F.lit(number + 1).alias("rounds"), "fixes", F.lit(True).alias("open"))
            finished = finished.unionByName(stuck)
            going = spent.filter("NOT _idle").select("doc_id")
            new_docs, new_nodes = (t.join(going, "doc_id", "left_semi") for t in (new_docs, new_nodes))
            spent = spent.filter("NOT _idle")
        spent = spent.drop("_idle")
        docs, nodes = cut_lineage(new_docs), cut_lineage(new_nodes)
        rules = cut_lineage(evaluate_catalog(docs, nodes))
    return finished.unionByName(spent.select("doc_id", F.lit(False).alias("compliant"), F.lit(rounds).alias("rounds"), "fixes", F.lit(True).alias("open")))


# --- digest and round trip -------------------------------------------------------

def digests(docs: DataFrame, nodes: DataFrame, elements: int = 150, alts: int = 40) -> DataFrame:
    """Compact summary of a document: its first top-level elements and figure texts."""
    def joined(df: DataFrame, text: Column, name: str) -> DataFrame:
        return df.groupBy("doc_id").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda s: s["t"]), "\n").alias(name))
    shown = F.when(F.coalesce("alt", F.lit("")) != "", F.col("alt")).otherwise(strip(F.coalesce("text", F.lit(""))))
    kind = F.coalesce(lookup(lx.ORDER_LABELS, F.col("tag")), F.lit("Other"))
    top = first_n(nodes.filter(F.col("parent_id").isNull()), ["doc_id"], ["ord"], elements)
    figures = first_n(nodes.filter(F.col("tag") == "Figure"), ["doc_id"], ["ord"], alts)
    alt = F.when(F.coalesce("alt", F.lit("")) == "", F.lit("(NO ALT)")).otherwise(F.col("alt"))
    return docs.select("doc_id", F.nullif("title", F.lit("")).alias("title"), F.nullif("lang", F.lit("")).alias("lang")).join(
        joined(top, F.concat(kind, F.lit(": "), left(shown, 120)), "elements"), "doc_id", "left").join(
        joined(figures, alt, "figure_alts"), "doc_id", "left")


def round_trip_checks(docs: DataFrame, intended: DataFrame, written: DataFrame) -> DataFrame:
    """One row per document and check RT-1..RT-9: did the output keep what was intended?"""
    heads = F.count_if(F.col("tag").isin(lx.HEADING_TAGS))
    want = intended.groupBy("doc_id").agg(heads.alias("want_h"))
    got = written.groupBy("doc_id").agg(heads.alias("got_h"), F.count_if((F.col("tag") == "Figure") & blank(F.col("alt"))).alias("bare"))
    d = docs.join(want, "doc_id", "left").join(got, "doc_id", "left")
    lang, meant = F.lower(strip(F.coalesce("lang", F.lit("")))), F.lower(strip(F.coalesce("manifest_lang", F.lit(""))))
    title = strip(F.coalesce("title", F.lit("")))
    want_h, got_h = F.coalesce("want_h", F.lit(0)), F.coalesce("got_h", F.lit(0))
    tree = F.col("has_struct")
    tests = [
        ("RT-1", "error", lang != "", F.lit(True)), ("RT-2", "error", F.col("marked"), F.lit(True)),
        ("RT-3", "warning", F.col("display_title"), F.lit(True)), ("RT-4", "error", F.col("has_ua_id"), F.lit(True)),
        ("RT-5", "warning", (title != "") & (title != "Untitled Document"), F.lit(True)), ("RT-6", "error", tree, F.lit(True)),
        ("RT-7", "error", F.coalesce("bare", F.lit(0)) == 0, tree),
        ("RT-8", "warning", (want_h == 0) | (got_h >= want_h * 0.8), tree),
        ("RT-9", "warning", (meant == "") | (lang == "") | lang.startswith(left(meant, 2)), tree)]
    rows = F.array(*[F.when(applies, F.struct(F.lit(n).alias("check"), F.lit(sev).alias("severity"), ok.alias("passed")))
                     for n, sev, ok, applies in tests])
    return d.select("doc_id", F.inline(F.array_compact(rows)))


def round_trip_summary(checks: DataFrame) -> DataFrame:
    """Passed, failed and the capped score penalty per document."""
    penalty = F.sum(F.when(F.col("passed"), 0).when(F.col("severity") == "error", 10).otherwise(3))
    return checks.groupBy("doc_id").agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("errors"),
        F.least(penalty, F.lit(40)).alias("penalty"))
