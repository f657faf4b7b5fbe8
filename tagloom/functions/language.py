"""Language and script expressions on a text column; no shuffle, no join."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagloom import lexicon as lx
from tagloom.functions.text import strip

WORD_BREAK = r"[^\p{L}\p{N}_]+"


def _beyond_latin(text: Column) -> Column:
    """Whether any character may belong to one of the scripts of the lexicon: Greek, the first of them, starts at U+0370."""
    return text.rlike("[\u0370-\uffff]")


def script_language(text: Column) -> Column:
    """First script, in list order, with more characters than max(3, a quarter of the text)."""
    limit = F.greatest(F.lit(3.0), F.length(text) * 0.25)
    return F.when(_beyond_latin(text), F.coalesce(*[
        F.when(F.regexp_count(text, F.lit(rng)) > limit, F.lit(lang)) for lang, rng in lx.SCRIPT_LANGS]))


def profile_language(text: Column) -> Column:
    """Language with the most stop words; null when none occurs. Earlier languages win ties."""
    every = sorted({w for vocabulary in lx.STOP_WORDS.values() for w in vocabulary})
    stops = F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w.isin(*every))

    def hits(found: Column, vocabulary: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(*vocabulary)))

    def best(found: Column) -> Column:
        return F.array_max(F.array(*[F.struct(hits(found, vocabulary).alias("n"), F.lit(-i).alias("rank"), F.lit(lang).alias("lang"))
                                     for i, (lang, vocabulary) in enumerate(lx.STOP_WORDS.items())]))

    # a text is split once: only the stop words in it are looked at language by language
    return F.get(F.transform(F.filter(F.array(stops), lambda found: F.size(found) > 0), lambda found: best(found)["lang"]), F.lit(0))


def detect_language(text: Column) -> Column:
    """Script first, stop-word profile second; null under 8 characters."""
    t = strip(text)
    return F.when(F.length(t) >= 8, F.coalesce(script_language(t), profile_language(t)))


def evidence(text: Column) -> dict[str, Column]:
    """What detection counts on a text, by name: its length, characters per script, stop words per
    language. The counts of parts may be added up."""
    words = F.split(F.lower(text), WORD_BREAK)

    def hits(vocabulary: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*vocabulary)))

    return {"length": F.length(text),
            **{f"script_{i}": F.regexp_count(text, F.lit(rng)) for i, (_, rng) in enumerate(lx.SCRIPT_LANGS)},
            **{f"words_{i}": hits(vocabulary) for i, vocabulary in enumerate(lx.STOP_WORDS.values())}}


def from_evidence(length: Column) -> Column:
    """``detect_language`` from the columns of ``evidence`` and the whole length."""
    script = F.coalesce(*[F.when(F.col(f"script_{i}") > F.greatest(F.lit(3.0), length * 0.25), F.lit(name))
                          for i, (name, _) in enumerate(lx.SCRIPT_LANGS)])
    best = F.array_max(F.array(*[F.struct(F.col(f"words_{i}").alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("lang"))
                                 for i, name in enumerate(lx.STOP_WORDS)]))
    return F.when(length >= 8, F.coalesce(script, F.when(best["n"] > 0, best["lang"])))


def primary_subtag(lang: Column) -> Column:
    return F.split(F.replace(F.lower(strip(lang)), F.lit("_"), F.lit("-")), "-")[0]


def script_mismatch(text: Column, doc_lang: Column) -> Column:
    """First non-Latin script present that the document language does not already expect."""
    declared = F.lower(F.coalesce(doc_lang, F.lit("")))
    arms = []
    for name, rng, expected in lx.SCRIPT_NAMES:
        hit = text.rlike(rng)
        for lang in expected:
            hit = hit & ~declared.startswith(lang)
        arms.append(F.when(hit, F.lit(name)))
    return F.when(_beyond_latin(text), F.coalesce(*arms))
