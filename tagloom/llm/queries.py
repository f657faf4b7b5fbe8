"""Registered queries of the training-data operators, each with its production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.llm import conversation_repair, fertility, filter_audit, imatch, jaccard_join, language_id, line_chunks, mixing, packing, shards, simhash, url_bloom, weak_labels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def byte_vocabulary() -> packing.Vocabulary:
    import public_tokenizers as public
    return packing.Vocabulary(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_vocabulary(), packing.Capacity(2048))


def piece_vocabulary() -> str:
    import public_tokenizers as public
    return public.path("piece_bpe_32k.model")


def op7_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = fertility.judge(docs, byte_vocabulary(), piece_vocabulary(), carry=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason",
             "chars_per_token", "byte_share", "entropy"]
    return judged.select("doc_id", *[F.col("__m")[n].alias(n) for n in names])


def op10_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"), shingle=3, seed=42, radius=3)


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_chunks.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "__m.*", "text")


def op6_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), budget_percent=150, max_epochs=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edited(table(spark, sf_dir, "documents"))


def op3_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (declared: lang, host: source) and pages (markup, address, host) in one corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pages = language_id.page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    none = F.lit(None).cast("string")
    own = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.lower(F.substring("lang", 1, 2)).alias("declared"),
                      none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))
    web = pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "declared", "suffix", "host", "domain")
    return language_id.identify(own.unionByName(web), docs.select("text", "lang"))


def op4_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(table(spark, sf_dir, "documents"))


def op5_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = shards.balanced(table(spark, sf_dir, "documents"), 16)
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


#: The host rules, and the host labels whose pages make up the list of URLs.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
LISTED_LABELS = ["casino-win", "cheap-pills", "spam-farm", "ads-track", "free-bets", "adult-x"]


def op9_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    on_listed_host = F.arrays_overlap(F.split(url_bloom.host_of(F.col("url")), "[.]"), F.array(*map(F.lit, LISTED_LABELS)))
    listing = pages.filter(on_listed_host).select(url_bloom.canonical(F.col("url")).alias("url"))
    return url_bloom.judge(pages, URL_RULES, listing)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(conversations), conversations)[1]


def op13_token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_imatch": op2_imatch,
    "op3_evidence_fusion": op3_evidence_fusion,
    "op4_weak_labels": op4_weak_labels,
    "op5_prefix_shards": op5_prefix_shards,
    "op6_water_filling": op6_water_filling,
    "op7_tokeniser_fertility": op7_tokeniser_fertility,
    "op8_line_chunks": op8_line_chunks,
    "op9_blocked_bloom": op9_blocked_bloom,
    "op10_covering_simhash": op10_covering_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_combination_join": op13_token_combination_join,
}
_WORDS = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    # The level by trial: for every number of clamped sources the share of the rest, of which the
    # right one is the first that is feasible.
    "op11_filter_audit": filter_audit.ORACLE,
    "op6_water_filling": f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
  w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
  o AS (SELECT *, 2 * size AS cap, row_number() OVER (ORDER BY CAST(2 * size AS DOUBLE) / weight, source NULLS FIRST) AS r FROM w),
  t AS (SELECT a.r, (SELECT CAST(sum(size) AS BIGINT) * 150 / 100.0 FROM o) - coalesce(CAST(sum(b.cap) FILTER (b.r < a.r) AS BIGINT), 0) AS rest,
      CAST(sum(b.weight) FILTER (b.r >= a.r) AS BIGINT) AS weights FROM o a, o b GROUP BY a.r),
  l AS (SELECT min(o.r) AS r FROM o JOIN t USING (r) WHERE weight * rest / weights <= cap),
  g AS (SELECT source, size AS source_size, CASE WHEN o.r < l.r OR l.r IS NULL THEN CAST(cap AS DOUBLE)
      ELSE least(weight * rest / weights, CAST(cap AS DOUBLE)) END AS target FROM o, l LEFT JOIN t ON t.r = l.r),
  p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
      CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size / 2.0 AS middle
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, source, CAST(whole + CASE WHEN middle < target - whole * source_size THEN 1 ELSE 0 END AS INTEGER) AS repeats,
  CAST(size * (whole + CASE WHEN middle < target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p""",
    "op9_blocked_bloom": rf"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  h AS (SELECT page_id, url, rest, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(rest, ''), '^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '{url_bloom.TRACKING}'))) AS params FROM u),
  c AS (SELECT *, CASE WHEN url IS NOT NULL THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical FROM h),
  l AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), {LISTED_LABELS})),
  r AS (SELECT page_id, host, path, canonical IN (SELECT canonical FROM l WHERE canonical IS NOT NULL) AND canonical IS NOT NULL AS listed,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, coalesce(listed, false) AS listed, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
  WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict FROM r""",
}
