"""Quality rules from tokeniser fertility.

Public vocabularies are used as measuring instruments: how many characters a token covers,
what share of tokens falls back to single bytes, and how evenly the tokens are used. What is
usual differs by language and by length, so the limits are bands around the median of the
documents of the same language (or script, where no language is declared) and similar length,
taken over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tagloom.llm.common import binaries, map_batches, stored
from tagloom.llm.packing import ByteTokenizer, Vocabulary

SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 8

#: First and last code point of the scripts told apart when no language is declared.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)],
    "greek": [(0x370, 0x3FF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0xAC00, 0xD7AF)],
}

_MEASURE = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("n_tokens", pa.int64()), ("script", pa.string()),
    ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("entropy", pa.float64()),
]
_STRUCT = "struct<" + ",".join(
    f"{n}:{ {pa.int64(): 'bigint', pa.string(): 'string', pa.float64(): 'double'}[t] }" for n, t in _MEASURE) + ">"


@dataclass(frozen=True)
class Bands:
    """How far from the usual a document may lie.

    A limit is the median plus or minus ``spread`` scaled median absolute deviations, and never
    nearer than ``least`` (for characters per token relative, and wider for short texts by
    ``short`` over the root of the tokens). A band needs ``documents`` documents, however large the corpus is. Characters per token and byte share differ by
    language: without a band for the length, the language's band over all lengths is used, and
    without that the text is not judged by them. Entropy differs by length: without a band of the
    language, that of all languages for the length is used.
    """

    spread: float = 6.0
    chars_least: float = 0.06
    chars_short: float = 2.0
    entropy_least: float = 0.08
    byte_least: float = 0.10
    documents: int = 30


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW_WORDS) -> int:
    """Words inside windows of ``window`` words that the text holds at least twice, exactly.

    Windows are renamed to small numbers level by level (pairs, fours, ...), so two windows
    have the same number only if they are the same words.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key, base, width = ids.astype(np.int64), distinct, 1
    while width < window:
        grow = 1
        while grow * 2 * width <= window and base ** (2 * grow) < 2 ** 62:
            grow *= 2
        joined = key[:len(key) - width * (grow - 1)].copy()
        for i in range(1, grow):
            joined *= base
            joined += key[i * width:i * width + len(joined)]
        width *= grow
        if width < window:
            names, key = np.unique(joined, return_inverse=True)
            base = len(names)
        else:
            key = joined
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, words in repeated windows."""
    words = text.split()
    if not words:
        return 0, 0, sum(text.count(c) for c in SYMBOLS), 0, 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    lines = Counter(line for line in text.split(b"\n") if line and not line.isspace()) if b"\n" in text else {}
    return (len(words), len(b"".join(words).decode()), sum(text.count(c) for c in SYMBOLS),
            sum(lines.values()) - len(lines), repeated_words(ids, len(names)))


def script_of(text: bytes) -> str:
    """The script with the most letters, the first listed on ties; "other" without any."""
    points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    counts = {name: sum(int(((points >= a) & (points <= b)).sum()) for a, b in spans) for name, spans in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def measure(docs: DataFrame, vocabulary: Vocabulary, pieces: str, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs`` plus ``__m``, the measures of the whole text.

    ``vocabulary`` gives characters per token and entropy (in parts of the entropy of as many
    different tokens), ``pieces``, a vocabulary file with byte fallback, the byte share.
    """
    loaded: dict = {}

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not loaded:
            import sentencepiece
            loaded["pieces"] = sentencepiece.SentencePieceProcessor(model_file=pieces)
            loaded["byte"] = np.array([loaded["pieces"].is_byte(i) for i in range(loaded["pieces"].get_piece_size())])
        tokenizer, processor, is_byte = ByteTokenizer.shared(vocabulary), loaded["pieces"], loaded["byte"]
        out = []
        for text, lang in zip(binaries(batch, text_col), batch.column(lang_col).to_pylist()):
            text = text or b""
            base = base_counts(text)
            script = None if lang else script_of(text)
            if not base[0]:
                out.append((*base, 0, script, None, None, None))
                continue
            ids = np.array(tokenizer.ids(text))
            share = np.unique(ids, return_counts=True)[1] / len(ids)
            entropy = -float((share * np.log2(share)).sum()) / math.log2(len(ids)) if len(ids) > 1 else 1.0
            with_bytes = np.array(processor.encode(text.decode(), num_threads=1), np.int64)
            byte_share = float(is_byte[with_bytes].mean()) if len(with_bytes) else 0.0
            out.append((*base, len(ids), script, len(text.decode()) / len(ids), byte_share, entropy))
        columns = list(zip(*out)) or [()] * len(_MEASURE)
        measures = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _MEASURE)], names=[n for n, _ in _MEASURE])
        yield pa.RecordBatch.from_arrays([*batch.columns, measures], [*batch.schema.names, "__m"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, rows, f"{fields}, __m {_STRUCT}")


def _keyed(measured: DataFrame, lang_col: str) -> DataFrame:
    """Only what the bands need: group, length class and the measures as whole steps."""
    m = F.col("__m")
    return measured.filter(m["n_tokens"] > 0).select(
        _group(lang_col), _length_class(),
        F.round(F.log(m["chars_per_token"]) * 400).cast("int").alias("chars"),
        F.round(m["entropy"] * 400).cast("int").alias("entropy"),
        F.round(m["byte_share"] * 400).cast("int").alias("bytes"))


def _group(lang_col: str):
    declared = F.when(F.length(F.col(lang_col)) > 0, F.col(lang_col))
    return F.coalesce(declared, F.concat(F.lit("script:"), F.col("__m")["script"])).alias("_group")


def _length_class():
    return F.floor(F.log2(F.col("__m")["n_tokens"].cast("double")) * 2).cast("int").alias("_class")


def _median(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Median of whole steps that come with their counts: the first step at which half is reached."""
    upto = Window.partitionBy(*keys).orderBy("step")
    return (steps.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(Window.partitionBy(*keys))})
            .filter(F.col("_upto") * 2 >= F.col("_all")).groupBy(*keys)
            .agg(F.min("step").alias("median"), F.first("_all").alias("documents")))


def bands(measured: DataFrame, limits: Bands = Bands(), lang_col: str = "lang") -> DataFrame:
    """Median and spread of each measure per group and length class.

    Group "*" is all languages, class -1 all lengths.

    Counted per step of 1/400, so the result does not depend on the order of the rows and what
    is shuffled are counts.
    """
    counts = _keyed(measured, lang_col).groupBy("_group", "_class", "chars", "entropy", "bytes").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "fertility-counts")
    both = (counts.unionByName(counts.withColumn("_class", F.lit(-1)))
            .unionByName(counts.withColumn("_group", F.lit("*"))))
    keys = ["_group", "_class", "measure"]
    steps = (both.select("_group", "_class", "n", F.explode(F.create_map(
        F.lit("chars"), F.col("chars"), F.lit("entropy"), F.col("entropy"), F.lit("bytes"), F.col("bytes"))).alias("measure", "step"))
        .groupBy(*keys, "step").agg(F.sum("n").alias("n")))
    middle = _median(steps, keys)
    off = (steps.join(middle.select(*keys, "median"), keys)
           .groupBy(*keys, F.abs(F.col("step") - F.col("median")).alias("step")).agg(F.sum("n").alias("n")))
    spread = _median(off, keys).select(*keys, F.col("median").alias("spread"))
    out = (middle.join(spread, keys).filter(F.col("documents") >= limits.documents)
           .groupBy("_group", "_class").pivot("measure", ["chars", "entropy", "bytes"])
           .agg(F.first(F.col("median") / 400.0).alias("mid"), F.first(1.4826 * (F.col("spread") + 0.5) / 400.0).alias("mad")))
    return out.withColumnsRenamed({"_group": "_band_group", "_class": "_band_class"})


def judge(docs: DataFrame, vocabulary: Vocabulary, pieces: str, limits: Bands = Bands(), lang_col: str = "lang",
          text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``carry``) with ``__m`` extended by base_failed, reason and kept; every row is returned.

    Base rules reject texts under ``min_words`` words or with too many words in repeated
    windows (so empty and null texts go). Of the rest, a text is rejected when a measure leaves
    its band; where there is no band (see ``Bands``) it is kept. The bands are stored and
    joined by key, so they are broadcast by size. Texts are measured once and stored with what is
    carried.
    """
    carry = docs.columns if carry is None else carry
    measured = measure(docs, vocabulary, pieces, lang_col, text_col)
    measured = stored(measured.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, lang_col])], "__m"), "fertility")
    table = stored(bands(measured, limits, lang_col), "fertility-bands")
    values = F.struct(*[F.col(c) for c in table.columns[2:]])
    own = table.select(F.col("_band_group").alias("__og"), F.col("_band_class").alias("__oc"), values.alias("__own"))
    any_length = table.filter("_band_class = -1").select(F.col("_band_group").alias("__ag"), values.alias("__any"))
    pooled = F.broadcast(table.filter("_band_group = '*'").select(F.col("_band_class").alias("__pc"), values.alias("__all")))
    m = F.col("__m")
    joined = (measured.withColumns({"__g": _group(lang_col), "__c": _length_class()})
              .join(own, (F.col("__g") == F.col("__og")) & (F.col("__c") == F.col("__oc")), "left")
              .join(any_length, F.col("__g") == F.col("__ag"), "left")
              .join(pooled, F.col("__c") == F.col("__pc"), "left"))
    band = F.coalesce(F.col("__own"), F.col("__any"))
    even = F.coalesce(F.col("__own"), F.col("__all"))
    wide = F.greatest(F.lit(limits.chars_least) + limits.chars_short / F.sqrt(m["n_tokens"].cast("double")), limits.spread * band["chars_mad"])
    base_failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
    reason = F.when(base_failed, "base").when(
        F.abs(F.log(m["chars_per_token"]) - band["chars_mid"]) > wide, "characters per token").when(
        m["entropy"] < even["entropy_mid"] - F.greatest(F.lit(limits.entropy_least), limits.spread * even["entropy_mad"]), "token entropy").when(
        m["byte_share"] > band["bytes_mid"] + F.greatest(F.lit(limits.byte_least), limits.spread * band["bytes_mad"]), "byte fallback")
    verdict = F.struct(*[m[n].alias(n) for n, _ in _MEASURE], base_failed.alias("base_failed"), reason.alias("reason"), reason.isNull().alias("kept"))
    return joined.select(*[F.col(f"`{c}`") for c in carry], verdict.alias("__m"))
