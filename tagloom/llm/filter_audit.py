"""Filter interaction audit: what every filter removes in every order of the filters.

A document is the set (mask) of filters it fails. In the orders that begin with a given prefix of
filters it is removed at the same step, and those orders are neighbours in lexicographic order: a
prefix of length s covers (L - s)! ranks from its Lehmer rank on. So each mask adds its counts at
the first rank of such an interval, takes them off after the last, and prefix sums over the L!
ranks give the totals of all orders from a table of counts per mask.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tagloom.llm.common import WORD_PATTERN

COUNTS = ("n", "good", "toxic")


def lehmer_rank(prefix: Sequence[int], size: int) -> int:
    """Rank of the first permutation of range(size), in lexicographic order, that begins with ``prefix``."""
    rank, left = 0, list(range(size))
    for place, item in enumerate(prefix):
        at = left.index(item)
        rank += at * factorial(size - 1 - place)
        del left[at]
    return rank


def intervals(size: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(mask, step, first rank, rank after the last, removed here) wherever a document with that mask fails
    the filter of that step; where it isn't removed here, an earlier filter of the order has removed it."""
    for step in range(1, size + 1):
        width = factorial(size - step)
        for prefix in permutations(range(size), step):
            rank = lehmer_rank(prefix, size)
            earlier = sum(1 << item for item in prefix[:-1])
            for mask in range(1, 1 << size):
                if mask >> prefix[-1] & 1:
                    yield mask, step, rank, rank + width, not mask & earlier


def _events(spark: SparkSession, size: int) -> DataFrame:
    """The ends of all intervals; their number depends on the number of filters only."""
    rows = []
    for mask, step, start, stop, here in intervals(size):
        rows += [(mask, step, start, 1, here), (mask, step, stop, -1, here)]
    return spark.createDataFrame(rows, "mask int, step int, rank int, sign int, here boolean")


def mask_of(fails: Mapping[str, Column]) -> Column:
    """Bit i is set if the i-th filter fails; a null condition does not fail."""
    bits = [F.when(condition, 1 << i).otherwise(0) for i, condition in enumerate(fails.values())]
    return sum(bits[1:], bits[0])


def audit(masks: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from ``masks`` (part, mask, n, good, toxic).

    ``letters`` names the filters in bit order and must be sorted. Parts without any failure get their rows too;
    an empty table gives none. Counts of equal (part, mask) are added up.
    """
    size, spark = len(letters), masks.sparkSession
    ranks = factorial(size)
    parts = masks.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == 1 << i, F.col("n"))), F.lit(0)) for i in range(size)]).alias("only"))
    signed = [(F.col(c) * F.col("sign")) for c in COUNTS]
    changes = masks.join(F.broadcast(_events(spark, size)), "mask").filter(F.col("rank") < ranks).groupBy("part", "step", "rank").agg(
        *[F.sum(F.when(F.col("here"), value)).alias(c) for c, value in zip(COUNTS, signed)],
        F.sum(F.when(~F.col("here"), signed[0])).alias("later"))
    grid = parts.select("part", "total", "only", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    values = [*COUNTS, "later"]
    swept = grid.join(changes, ["part", "step", "rank"], "left").select(
        "part", "total", "only", "rank", "step", *[F.sum(F.coalesce(c, F.lit(0))).over(along).alias(c) for c in values])
    orders = F.array(*[F.lit("".join(order)) for order in permutations(letters)])
    named = swept.withColumn("filter_order", F.element_at(orders, F.col("rank") + 1)).withColumn(
        "letter", F.expr("substring(filter_order, step, 1)"))
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return named.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("n").over(so_far)).alias("kept"),
        F.col("n").alias("removed"), F.col("later").alias("redundant"),
        F.expr(f"element_at(only, instr('{letters}', letter))").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"))


def text_failures(text: Column) -> dict[str, Column]:
    """Filters on one text: A few words, B few distinct words, C many capitals A-Z, D a symbol."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents counted by the filters they fail, A to D and E, a copy of an earlier text.

    Null text and null part count as empty. E fails if an equal text has a smaller doc_id; rows without an id never fail it and
    are nobody's earlier copy. Several labels of one id count as one: good or toxic if any of them says so. Repeated rows count
    each. Copies are counted per text before they meet, so a text that a third of the rows hold is one row per task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text")
    ).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask_of(text_failures(F.col("text"))).alias("mask"))
    counted = rows.groupBy("digest", "part", "mask", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    says = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = counted.filter("doc_id IS NOT NULL").join(says, "doc_id", "left").select(
        "digest", "part", "mask", "doc_id", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    nobody = counted.filter("doc_id IS NULL").select("digest", "part", "mask", "doc_id", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    # doc_id is unique per text and part here, so the least struct carries the counts of the first document
    texts = known.unionByName(nobody).groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *COUNTS))).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    earliest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    split = texts.withColumn("is_first", F.coalesce(F.col("first.doc_id") == earliest, F.lit(False)))
    stays = [F.when(F.col("is_first"), F.col(f"first.{c}")).otherwise(0) + (F.col("nameless") if c == "n" else F.lit(0)) for c in COUNTS]
    pieces = F.array(
        F.struct(F.col("mask").alias("mask"), *[s.alias(c) for s, c in zip(stays, COUNTS)]),
        F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(c) - s).alias(c) for s, c in zip(stays, COUNTS)]))
    return split.select("part", F.explode(pieces).alias("p")).select("part", "p.*").filter("n > 0").groupBy("part", "mask").agg(
        *[F.sum(c).alias(c) for c in COUNTS])


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failure_masks(docs, labels), "ABCDE")


#: The same by trying every order on every mask.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') AS w,
    doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copied FROM documents),
  l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
  f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(CASE WHEN len(w) < 100 THEN 'A' END,
      CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END, CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 'C' END,
      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN copied THEN 'E' END) AS fails FROM d LEFT JOIN l USING (doc_id)),
  m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
  i AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) AS r(step)),
  t AS (SELECT s.*, part, n, good, toxic, contains(fails, letter) AS bad, len(translate(before, fails, '')) < len(before) AS gone, fails = letter AS alone FROM m, s),
  u AS (SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS BIGINT) AS kept,
      CAST(coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (bad AND gone), 0) AS BIGINT) AS redundant,
      CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (bad AND NOT gone), 0) AS BIGINT) AS good_lost,
      CAST(coalesce(sum(toxic) FILTER (bad AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM t GROUP BY part, filter_order, step, letter)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM u"""
