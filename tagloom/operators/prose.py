"""Checks on running text: abbreviations, reading level, sensory wording, formulas, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom import lexicon as lx
from tagloom.functions import language as lang
from tagloom.functions.numbers import half_even
from tagloom.functions.rows import with_once
from tagloom.functions.text import blank, left, matches, pattern, strip
from tagloom.operators.contrast import first_n


def _once(value: Column) -> Column:
    """A value that is computed once a row: filters on a generated column stay above it, where those on a projected one repeat its expression."""
    return F.explode_outer(F.array(value))


def abbreviations(texts: DataFrame, min_count: int = 2) -> DataFrame:
    """Acronyms and dotted abbreviations per document with their counts."""
    acronyms = F.transform(
        F.filter(F.regexp_extract_all("text", F.lit(pattern(lx.ACRONYM)), 1), lambda t: ~t.isin(lx.ABBREVIATION_STOP)),
        lambda t: F.struct(t.alias("abbreviation"), F.lit("acronym").alias("type")))
    dotted = F.transform(
        F.filter(F.regexp_extract_all("text", F.lit(pattern(lx.DOTTED)), 1), lambda t: (F.length(t) >= 3) & t.contains(".")),
        lambda t: F.struct(F.lower(t).alias("abbreviation"), F.lit("dotted").alias("type")))
    # most rows hold none: skip the regex work unless a capital pair or an inner dot is there
    cheap = F.col("text").rlike(r"[A-Z][A-Z0-9]|[A-Za-z]\.[A-Za-z]")
    return (
        with_once(texts.select("doc_id", F.col("text").alias("_text")), text=F.col("_text")).filter(cheap).select("doc_id", F.inline(F.concat(acronyms, dotted)))
        .groupBy("doc_id", "abbreviation", "type").agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") >= min_count)
    )


def top_abbreviations(counted: DataFrame) -> DataFrame:
    """All abbreviations with their rank by frequency in the document, ties by spelling."""
    order = Window.partitionBy("doc_id").orderBy(F.col("count").desc(), "abbreviation", "type")
    return counted.withColumn("rank", F.row_number().over(order))


def reading_level(texts: DataFrame) -> DataFrame:
    """Grade, ease and band of each document's whole text."""
    words = F.filter(F.split("text", lang.WORD_BREAK), lambda w: w.rlike("^[a-zA-Z]+$"))
    sentences = F.filter(F.split("text", "[.!?]+"), lambda s: ~blank(s))
    base = with_once(texts.select("doc_id", "text"), w=words, sentences=F.size(sentences)).drop("text")
    # one string <w1><w2>...: a final e is silent, each vowel group is a syllable, and a
    # word without vowels still counts as one
    marked = F.replace(F.lower(F.concat(F.lit("<"), F.array_join("w", "><"), F.lit(">"))), F.lit("e>"), F.lit(">"))
    base = with_once(base, words=F.size("w"), m=marked).drop("w")
    base = with_once(base, syllables=F.regexp_count("m", F.lit("[aeiouy]+")) + F.regexp_count("m", F.lit("<[^aeiouy>]*>"))).drop("m")
    wps, spw = F.col("words") / F.col("sentences"), F.col("syllables") / F.col("words")
    enough = (F.col("words") >= lx.READING_MIN_WORDS) & (F.col("sentences") >= lx.READING_MIN_SENTENCES)
    grade = F.greatest(F.lit(0.0), half_even(0.39 * wps + 11.8 * spw - 15.59, 1))
    ease = F.greatest(F.lit(0.0), F.least(F.lit(100.0), half_even(206.835 - 1.015 * wps - 84.6 * spw, 1)))
    out = base.select(
        "doc_id", "words", "sentences", F.when(enough, grade).alias("grade_level"), F.when(enough, ease).alias("ease"),
        F.when(enough, half_even(wps, 1)).alias("words_per_sentence"),
        F.when(enough, half_even(spw, 2)).alias("syllables_per_word"))
    g = F.col("grade_level")
    return out.withColumn("severity", F.when(g <= 6, "good").when(g <= 8, "ok").when(g <= 12, "warning").when(g > 12, "concern"))


def sensory(nodes: DataFrame) -> DataFrame:
    """Instructions that lean on a sense alone; one row per (document, page, phrase)."""
    def written(src: int, name: str) -> DataFrame:
        return with_once(nodes.select("doc_id", "page", "ord", F.lit(src).alias("src"), F.col(name).alias("_text")), text=F.col("_text")).drop("_text")

    texts = written(0, "alt").unionByName(written(1, "text")).filter(F.length("text") >= lx.SENSORY_MIN)
    found = F.array(*[
        F.struct(F.lit(i).alias("k"), F.lit(name).alias("type"),
                 strip(F.regexp_extract("text", pattern(p, True), 0)).alias("match"))
        for i, (name, p) in enumerate(lx.SENSORY_PATTERNS)])
    hits = texts.select("*", F.inline(F.filter(found, lambda h: h["match"] != "")))
    hits = hits.withColumn("_key", F.lower(F.col("match")))
    return first_n(hits, ["doc_id", "page", "_key"], ["ord", "src", "k"], 1).select(
        "doc_id", "page", "ord", "type", left(F.col("text"), 120).alias("text"), left(F.col("match"), 80).alias("match"))


def is_formula(text: Column) -> Column:
    """Commands, two symbols, an equation number or short inline mathematics; a pattern is only tried on a text that has what it starts with."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^\p{L}{3,}$"))
    short_math = (F.length(text) <= 80) & matches(text, lx.INLINE_MATH) & (F.size(words) < 3)
    latex = text.contains("\\") & matches(text, lx.LATEX, True)
    symbols = (F.octet_length(text) > F.length(text)) & (F.regexp_count(text, F.lit(lx.MATH_SYMBOLS)) >= 2)
    number = (text.contains("(") | text.contains("[")) & matches(text, lx.EQUATION_NUMBER)
    return (text != "") & (latex | symbols | number | short_math)


def formula_alt(text: Column) -> Column:
    return F.concat(F.lit("Mathematical expression: "),
                    F.when(F.length(text) <= 80, text).otherwise(F.concat(left(text, 77), F.lit("…"))))


def tag_formulas(nodes: DataFrame) -> DataFrame:
    """Formula-like text nodes retagged, with generated alt text where none is set."""
    t = strip(F.coalesce("text", F.lit("")))
    hit = F.col("tag").isin(lx.FORMULA_TAGS) & is_formula(t)
    alt = F.when(hit & (F.coalesce("alt", F.lit("")) == ""), formula_alt(t)).otherwise(F.col("alt"))
    return nodes.withColumns({"alt": alt, "tag": F.when(hit, F.lit("Formula")).otherwise(F.col("tag"))})


def language_issues(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents without a language, and untagged passages in another one."""
    untagged = with_once(
        nodes.filter(F.col("language").isNull()).select("doc_id", "page", "ord", F.col("tag").alias("_tag"), F.col("text").alias("_text")),
        tag=F.col("_tag"), text=strip(F.col("_text"))).drop("_tag", "_text").filter(
        F.col("tag").isin(lx.LANGUAGE_CHECK_TAGS) & (F.length("text") >= lx.LANGUAGE_MIN))
    joined = untagged.join(docs.select("doc_id", "lang"), "doc_id")
    other = lang.detect_language(F.col("text"))
    detected = with_once(with_once(joined, script=lang.script_mismatch(F.col("text"), F.col("lang"))),
                         other=F.when(F.col("script").isNull() & F.col("lang").isNotNull(), other))
    differs = F.col("other").isNotNull() & ~F.lower("lang").startswith(F.col("other"))
    found = detected.filter(F.col("script").isNotNull() | differs).withColumn("_key", F.lower(F.col("text")))
    changes = first_n(found, ["doc_id", "page", "_key"], ["ord"], 1).select(
        "doc_id", F.lit("suspected_language_change").alias("type"), "page", "ord", "tag",
        left(F.col("text"), 100).alias("text"), F.coalesce("script", "other").alias("detected"))
    missing = docs.filter(F.col("lang").isNull()).select(
        "doc_id", F.lit("missing_doc_lang").alias("type"), F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("tag"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("detected"))
    return changes.unionByName(missing)


def node_languages(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Longer text nodes whose language differs from the document's."""
    t = strip(F.coalesce("text", F.lit("")))
    rows = nodes.filter(F.col("tag").isin(lx.NODE_LANGUAGE_TAGS)).select("doc_id", "node_id", "ord", t.alias("text")).filter(
        F.length("text") >= lx.NODE_LANGUAGE_MIN)
    base = docs.select("doc_id", lang.primary_subtag(F.coalesce("lang", F.lit("en"))).alias("base"))
    return (
        rows.select("doc_id", "node_id", "ord", _once(lang.detect_language(F.col("text"))).alias("language"))
        .join(base, "doc_id").filter(F.col("language") != F.col("base"))
        .select("doc_id", "node_id", "ord", "language")
    )


def document_language(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Declared language, or the one detected on all text of the document, or English.

    Detection counts characters and stop words, so the counts of the nodes are added up and no
    text is put together.
    """
    missing = docs.filter(blank(F.col("lang"))).select("doc_id")
    parts = nodes.select("doc_id", strip(F.coalesce("text", F.lit(""))).alias("text")).filter(F.col("text") != "")
    counts = lang.evidence(F.col("text"))
    summed = parts.join(missing, "doc_id", "left_semi").select("doc_id", *[c.alias(n) for n, c in counts.items()]).groupBy("doc_id").agg(
        *[F.sum(n).alias(n) for n in counts], F.count(F.lit(1)).alias("_parts"))
    # the parts of a text are one space apart
    guessed = summed.select("doc_id", lang.from_evidence(F.col("length") + F.col("_parts") - 1).alias("guess"))
    unset = blank(F.col("lang"))
    return docs.select("doc_id", "lang").join(guessed, "doc_id", "left").select(
        "doc_id", F.when(unset, F.coalesce("guess", F.lit("en"))).otherwise(F.col("lang")).alias("lang"), unset.alias("was_set"))


def language_repairs(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Language to set on text nodes whose content differs from the document's language."""
    base = document_language(nodes, docs).select("doc_id", lang.primary_subtag(F.col("lang")).alias("base"))
    rows = (
        nodes.filter(F.col("tag").isin(lx.LANGUAGE_REPAIR_TAGS) & blank(F.col("language")))
        .select("doc_id", "node_id", "ord", _once(lang.detect_language(F.col("text"))).alias("language"))
        .filter(F.col("language").isNotNull())
    )
    return rows.join(base, "doc_id").filter(F.col("language") != F.col("base")).select(
        "doc_id", "node_id", "ord", "language")
