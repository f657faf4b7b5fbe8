"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source is asked for its share of the budget by weight. A source that would have to be
repeated more often than allowed is clamped there and what it cannot give is shared out again
by weight among the others, until none is above its limit. Taking the sources in the order in
which they reach their limit (limit / weight) makes that one pass of running sums: a source is
clamped if, with all before it clamped, its share of the rest still exceeds its limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.llm.common import WORD_PATTERN, stored

#: Documents are ordered within their source by a seeded hash; its first hex digits split a
#: source into this many chunks, so that no task orders a whole source.
CHUNK_DIGITS = 3


def word_count(text: Column) -> Column:
    """Runs of non-space characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sources: DataFrame, budget_percent: int = 150, max_epochs: int = 2) -> DataFrame:
    """Target size per source. ``sources`` has source, size and weight (whole numbers), one row each.

    The budget is ``budget_percent`` of all sizes. A source without size or weight gets 0; if
    the limits leave part of the budget, all sources with a weight are at their limit.
    """
    cap = F.col("size") * max_epochs
    order = Window.orderBy(F.try_divide(F.col("cap"), F.col("weight")), "source")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    live = sources.withColumn("cap", F.when(F.col("weight") > 0, cap).otherwise(F.lit(0)).cast("long"))
    summed = live.withColumns({
        "_budget": F.sum("size").over(everything) * budget_percent / F.lit(100.0),
        "_capped": F.coalesce(F.sum("cap").over(upto), F.lit(0)),
        "_weights": F.sum(F.greatest("weight", F.lit(0))).over(onward),
    }).withColumn("_left", F.col("_budget") - F.col("_capped"))
    fits = F.try_divide(F.col("weight") * F.col("_left"), F.col("_weights")) <= F.col("cap")
    # the first source that is not clamped fixes the level for it and all after it
    level = summed.withColumns({
        "_open": F.coalesce((F.col("weight") > 0) & fits, F.lit(False)),
    }).withColumns({
        "_level_left": F.first(F.when(F.col("_open"), F.col("_left")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_level_weights": F.first(F.when(F.col("_open"), F.col("_weights")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    share = F.try_divide(F.col("weight") * F.col("_level_left"), F.col("_level_weights"))
    return level.select("source", "size", "weight", F.when(F.coalesce(F.col("weight"), F.lit(0)) <= 0, F.lit(0.0))
                        .otherwise(F.coalesce(F.least(share, F.col("cap").cast("double")), F.col("cap").cast("double"))).alias("target"))


def cycled_weights(sizes: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Weights for (source, size): the cycle in the order of the source names by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.pmod(place, F.lit(len(cycle))) + 1).cast("int"))
    return sizes.withColumn("weight", pick.cast("long"))


def mix(docs: DataFrame, weigh=cycled_weights, budget_percent: int = 150, max_epochs: int = 2, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, repeats, taken.

    One row per row of ``docs``. ``weigh`` adds a weight to (source, size). A source is taken
    whole as often as its target allows, and once more for the documents that come first in an
    order by a seeded hash, up to the one that brings it nearest to the target. The same seed
    takes the same documents whatever the partitions. Null texts have size 0, null sources are a
    source of their own, rows repeating an id count and are taken one by one.
    """
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                              word_count(F.col(text_col)).alias("size")), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    plan = stored(targets(weigh(sizes), budget_percent, max_epochs), "mix-targets").select(
        F.col("source").alias("_source"), F.col("size").alias("source_size"), "target")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = rows.withColumn("_key", key).withColumn("_chunk", F.substring("_key", 1, CHUNK_DIGITS))
    inner = Window.partitionBy("source", "_chunk").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("source", "_chunk").agg(F.sum("size").alias("_size")).select(
        F.col("source").alias("_s"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    placed = (keyed.withColumn("_upto", F.sum("size").over(inner))
              .join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
              .join(plan, F.col("source").eqNullSafe(F.col("_source"))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    middle = F.col("_start") + F.col("_upto") - F.col("size") / 2
    repeats = (whole + F.when(middle < rest, F.lit(1)).otherwise(F.lit(0))).cast("int")
    return placed.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"),
                         (repeats * F.col("size")).cast("long").alias("taken"))


def repeated_documents(docs: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its id is taken, all columns kept.

    Rows without an id, or repeating one, are taken as often as the first of their id.
    """
    taken = mix(docs, id_col=id_col, **parameters).groupBy("doc_id").agg(F.max("repeats").alias("__repeats")).filter("__repeats > 0")
    taken = taken.withColumnRenamed("doc_id", "__id")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return (docs.join(taken, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")))
            .select(*names, F.explode(F.sequence(F.lit(1), F.col("__repeats"))).alias("__copy")).select(*names))
