"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence about a record meet in one posterior: the likelihood of its text under
character-trigram models, the language its markup declares, the suffix of its address, and a
prior of its host. How far a declaration or a suffix can be trusted is itself estimated from the
corpus, by counting them against what the texts say; hosts are smoothed towards their domain and
domains towards the corpus. All of these are grouped aggregations over all records.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.common import map_batches, stored, trigram_buckets


@dataclass(frozen=True)
class Fusion:
    """Every labelled language has a model, however few its texts.

    ``bits`` sizes the trigram table. ``common`` is the part of every model that is the same for all, the distribution over
    all languages: a trigram that a language has not shown counts alike for large and small ones. ``text_weight`` discounts that neighbouring trigrams share
    characters. ``strength`` is how many records a host or domain needs to outweigh what it is
    smoothed towards, ``smoothing`` the count added to every outcome.
    """

    bits: int = 14
    common: float = 0.1
    text_weight: float = 1 / 3
    strength: float = 10.0
    smoothing: float = 0.5


def trigram_counts(texts: DataFrame, bits: int) -> DataFrame:
    """lang, bucket, n over all labelled texts (columns text, lang); summed in each task first."""

    def rows(sums: dict) -> Iterator[pa.RecordBatch]:
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if lang not in sums:
                    if len(sums) >= 64:
                        yield from rows(sums)
                        sums.clear()
                    sums[lang] = np.zeros(1 << bits, np.int64)
                sums[lang] += np.bincount(trigram_buckets(text, bits), minlength=1 << bits)
        yield from rows(sums)

    return (texts.select("text", "lang").dropna().mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def text_models(texts: DataFrame, fusion: Fusion) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of every bucket under each; 2 ** bits numbers per language, whatever the texts."""
    found = trigram_counts(texts, fusion.bits).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((len(langs), 1 << fusion.bits))
    if not langs:
        return langs, counts
    counts[np.searchsorted(langs, found["lang"].to_pylist()), found["bucket"].to_numpy()] += found["n"].to_numpy()
    every = counts.sum(axis=0) + fusion.smoothing
    return langs, np.log((1 - fusion.common) * counts / counts.sum(axis=1, keepdims=True) + fusion.common * every / every.sum())


def _scored(records: DataFrame, langs: list[str], model: np.ndarray, fusion: Fusion) -> DataFrame:
    """Replace ``text`` by ``ll``, its log likelihoods, and ``best``, the likeliest language (null without trigrams)."""
    sent = records.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T.astype(np.float32)))
    at = records.columns.index("text")

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lls, bests = [], []
        for text in batch.column("text").to_pylist():
            buckets = trigram_buckets(text, fusion.bits) if text and not text.isspace() else ()
            if not len(buckets):
                lls.append([0.0] * len(langs))
                bests.append(None)
                continue
            at_once = [sent.value[buckets[i:i + 65536]].sum(axis=0, dtype=np.float64) for i in range(0, len(buckets), 65536)]
            ll = fusion.text_weight * np.sum(at_once, axis=0)
            lls.append((ll - ll.max()).tolist())
            bests.append(int(ll.argmax()))
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(lls, pa.list_(pa.float64())), pa.array(bests, pa.int32())], [*names, "ll", "best"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name != "text")
    return map_batches(records, rows, f"{fields}, ll array<double>, best int")


def _trust(scored: DataFrame, column: str, n: int, fusion: Fusion) -> DataFrame:
    """Log probability of every value of ``column`` under each language, as ``<column>_ll``.

    Values come from the corpus, so the table is joined by key. A value never seen, or a null, says nothing.
    """
    per = (scored.filter(F.col(column).isNotNull() & F.col("best").isNotNull()).groupBy(column)
           .agg(F.array(*[F.count_if(F.col("best") == i) for i in range(n)]).alias("c")))
    totals = per.agg(*[F.coalesce(F.sum(F.col("c")[i]), F.lit(0)).alias(f"t{i}") for i in range(n)], F.count(F.lit(1)).alias("values")).first()
    s = fusion.smoothing
    logs = [F.log((F.col("c")[i] + s) / (totals[f"t{i}"] + s * (totals["values"] + 1))) for i in range(n)]
    return per.select(F.col(column).alias(f"_{column}"), F.array(*logs).alias(f"{column}_ll"))


def identify(records: DataFrame, labelled: DataFrame, fusion: Fusion = Fusion()) -> DataFrame:
    """Language of every record.

    ``records`` has text, declared, suffix, host and domain (each may be null) and any keys, which
    are returned with text_lang, lang, posterior and the evidence used. ``labelled`` (text, lang)
    trains the text models. Without labelled texts, or for a record without any evidence, lang is
    "und" with posterior 0. The host prior leaves the record's own vote out. Keys may have any names; those named like
    a result (text_lang, lang, posterior) are left out.
    """
    langs, model = text_models(labelled, fusion)
    n = len(langs)
    given = ("text", "declared", "suffix", "host", "domain")
    named = {c: f"__key{i}" for i, c in enumerate(c for c in records.columns if c not in (*given, "text_lang", "lang", "posterior"))}
    records = records.select(*[F.col(f"`{c}`").alias(k) for c, k in named.items()], *given)
    keys = [F.col(k).alias(c) for c, k in named.items()]
    if not n:
        return records.select(*keys, "declared", "suffix", "host", F.lit(None).cast("string").alias("text_lang"),
                              F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"))
    scored = stored(_scored(records, langs, model, fusion), "language-scores")
    votes = [F.count_if(F.col("best") == i) for i in range(n)]
    total = scored.agg(F.array(*votes).alias("c")).first()["c"]
    floor = fusion.smoothing
    prior = [(c + floor) / (sum(total) + floor * n) for c in total]
    # counts are stored, so that a join on a hot host is broadcast by size or split
    domains = stored(scored.filter("domain IS NOT NULL").groupBy("domain").agg(F.array(*votes).alias("_domain_votes"))
                     .withColumnRenamed("domain", "_domain"), "domain-votes")
    hosts = stored(scored.filter("host IS NOT NULL").groupBy("host").agg(F.array(*votes).alias("_host_votes"))
                   .withColumnRenamed("host", "_host"), "host-votes")
    joined = scored
    for column in ("declared", "suffix"):
        joined = joined.join(stored(_trust(scored, column, n, fusion), f"{column}-trust"), F.col(column) == F.col(f"_{column}"), "left")
    joined = joined.join(domains, F.col("domain") == F.col("_domain"), "left").join(hosts, F.col("host") == F.col("_host"), "left")

    def without_own(votes_col: str, i: int) -> Column:
        own = F.when(F.col("best") == i, F.lit(1)).otherwise(F.lit(0))
        return F.coalesce(F.col(votes_col)[i] - own, F.lit(0))

    def total_of(votes_col: str) -> Column:
        return sum((without_own(votes_col, i) for i in range(1, n)), without_own(votes_col, 0))

    k = fusion.strength
    joined = joined.withColumns({"_domain_total": total_of("_domain_votes"), "_host_total": total_of("_host_votes")})
    domain_total, host_total = F.col("_domain_total"), F.col("_host_total")
    logs = []
    for i in range(n):
        domain_prior = (without_own("_domain_votes", i) + k * prior[i]) / (domain_total + k)
        host_prior = (without_own("_host_votes", i) + k * domain_prior) / (host_total + k)
        logs.append(F.col("ll")[i] + F.log(host_prior)
                    + F.coalesce(F.col("declared_ll")[i], F.lit(0.0)) + F.coalesce(F.col("suffix_ll")[i], F.lit(0.0)))
    fused = joined.withColumn("_logs", F.array(*logs)).withColumn("_top", F.array_max("_logs"))
    known = F.col("best").isNotNull() | F.col("declared").isNotNull() | F.col("suffix").isNotNull() | F.col("host").isNotNull()
    names = F.array(*map(F.lit, langs))
    place = F.array_position("_logs", F.col("_top")).cast("int")
    weight = F.aggregate("_logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_top")))
    told = fused.select(*named.values(), "declared", "suffix", "host",
                        F.when(F.col("best").isNotNull(), F.element_at(names, F.col("best") + 1)).alias("text_lang"),
                        F.when(known, F.element_at(names, place)).otherwise(F.lit("und")).alias("lang"),
                        F.when(known, F.round(1 / weight, 6)).otherwise(F.lit(0.0)).alias("posterior"))
    # names of the caller come back last, where no expression can take them for its own
    return told.select(*keys, "declared", "suffix", "host", "text_lang", "lang", "posterior")


_NOT_TEXT = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"


def page_records(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Evidence columns of web pages: the text between tags, the base code of <html lang>, the
    country suffix of the host or else a two-letter first folder, host, and domain (last two labels)."""
    address = F.regexp_extract(F.col(url), "^[^:/?#]*://([^/?#]*)([^?#]*)", 1)
    host = F.lower(F.regexp_replace(address, "^[^@]*@|:[0-9]*$", ""))
    folder = F.regexp_extract(F.col(url), "^[^:/?#]*://[^/?#]*/([A-Za-z]{2})(?:/|[?#]|$)", 1)
    country = F.regexp_extract(host, r"\.([a-z]{2})$", 1)

    def filled(column: Column) -> Column:
        return F.when(column != "", column)

    return pages.select(
        "*", F.regexp_replace(F.col(html), _NOT_TEXT, " ").alias("text"),
        F.lower(filled(F.regexp_extract(F.col(html), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))).alias("declared"),
        F.coalesce(filled(country), F.lower(filled(folder))).alias("suffix"), filled(host).alias("host"),
        filled(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"))
