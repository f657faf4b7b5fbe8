"""URL filters: host rules, and a list of canonical URLs behind a blocked Bloom filter.

DataFrame functions only. The filter is a table of 512-bit blocks (eight 64-bit words); a URL
sets one bit in each word of its block. Pages whose bits are all set are possible hits, and only
those meet the list itself in a hash join, which removes the false positives.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.common import stored

WORDS = 8
BLOCK_BITS = 64 * WORDS
#: A filter up to this size is broadcast; a larger one is joined by block.
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change the page.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def _rest(url: Column) -> Column:
    """What follows the first "://"; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www/m and default port, path without index page and closing slashes, and the
    query without tracking parameters, sorted. Scheme and fragment go; null stays null."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^(www|m)\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/index\\.html?$", "/"), "/+$", "")
    query = F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest (verdict, "host/path") rule that fits the host or a parent of it and starts the path."""
    arms = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        cut = rule.index("/")
        name, start = rule[:cut], rule[cut:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        arms.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*arms)


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    spread = F.xxhash64(key, F.lit(1))
    return block, [F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter's blocks (__bloom, __w0 .. __w7) of the distinct values of ``key``."""
    block, bits = _bits(F.col(key), blocks)
    one = F.lit(1).cast("long")
    words = {f"__w{i}": F.call_function("shiftleft", one, bit) for i, bit in enumerate(bits)}
    return keys.select(block.alias("__bloom"), *[w.alias(n) for n, w in words.items()]).groupBy("__bloom").agg(
        *[F.bit_or(n).alias(n) for n in words])


def listed(pages: DataFrame, key: str, listing: DataFrame, bits_per_key: int = 16) -> DataFrame:
    """``pages`` with ``_listed``: whether ``key`` is in ``listing`` (one column ``url``, canonical).

    Null keys are not listed; repeats in the list do not matter; an empty list lists nothing.
    """
    urls = stored(listing.select("url").dropna().distinct(), "url-list")
    count = urls.count()
    blocks = max(1, math.ceil(count * bits_per_key / BLOCK_BITS))
    filled = bloom(urls, "url", blocks)
    if blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        filled = F.broadcast(filled)
    block, bits = _bits(F.col(key), blocks)
    probed = pages.withColumn("__block", block).join(filled, F.col("__block") == F.col("__bloom"), "left")
    hit = F.lit(True)
    for i, bit in enumerate(bits):
        hit = hit & (F.call_function("shiftright", F.col(f"__w{i}"), bit).bitwiseAND(F.lit(1).cast("long")) == 1)
    probed = probed.withColumn("__possible", F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).select(
        *[F.col(f"`{c}`") for c in pages.columns], "__possible")
    exact = probed.filter("__possible").join(urls.select(F.col("url").alias("__url")), F.col(key) == F.col("__url"), "left")
    names = [F.col(f"`{c}`") for c in pages.columns]
    return exact.select(*names, F.col("__url").isNotNull().alias("_listed")).unionAll(
        probed.filter("NOT __possible").select(*names, F.lit(False).alias("_listed")))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], listing: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every page.

    The longest fitting rule decides; without one a page is blocked if its canonical URL is
    listed. A null URL or one without "://" has an empty host and path, fits no rule and, when
    null, is not listed.
    """
    url = F.col(url_col)
    pages = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("_canonical"))
    ruled = listed(pages, "_canonical", listing).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                        F.coalesce(F.col("_rule.verdict"), F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                        F.col("_listed").alias("listed"))
