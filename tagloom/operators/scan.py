"""Ordered rules without one task per document.

A plain window keyed by document puts a whole document into one task. Here each
document is cut into chunks along its order column, the window runs per
(document, chunk), and only one summary row per chunk goes through a second,
document-wide window whose result is joined back. The result is exact for any
chunk size; the chunk size only bounds how many rows a task sees.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tagloom.session import cut_lineage

CHUNK_ROWS = 65_536

WindowFn = Callable[[WindowSpec], Column]


def with_chunk(df: DataFrame, ord_col: str = "ord", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_chunk``; needs ``ord_col`` to be a pre-order rank (at most one row per value)."""
    return df.withColumn("_chunk", F.floor(F.col(ord_col) / F.lit(chunk_rows)).cast("long"))


def ranked(df: DataFrame, order: Sequence[str], name: str = "_rank") -> DataFrame:
    """0-based rank of every row in the whole table, in ``order``.

    The table is sorted by range once and written, so that counts per partition and rows come from the same
    partitions; their running totals, one number per partition, are what a row's place inside its own is added to. No order value has
    to be rare or frequent: ranges are cut by count, rows that share a value may fall to several tasks.
    """
    sort = [F.col(c) for c in order]
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumns({
        "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = cut_lineage(placed)
    before_it = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before_it), F.lit(0)).alias("_start"))
    # one row per partition
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def with_count_chunk(df: DataFrame, order: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_chunk``: so many rows each in ``order`` (keys first), however often a value of the order column repeats."""
    return ranked(df, order).withColumn("_chunk", F.floor(F.col("_rank") / F.lit(chunk_rows)).cast("long")).drop("_rank")


def chunk_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    local: Sequence[Mapping[str, WindowFn]],
    totals: Mapping[str, Column],
    carry: Sequence[Mapping[str, WindowFn]],
    totals_of_local: bool = False,
) -> DataFrame:
    """Two-level scan over ``df`` (which carries ``_chunk``).

    ``local``   steps of columns computed per (keys, chunk) in ``order``; a later step
                may use the columns of an earlier one (same partitioning, no new shuffle).
    ``totals``  one aggregate per chunk, map-side combined. Over the input columns, or
                over the local columns too when ``totals_of_local``.
    ``carry``   steps over the chunk summaries; each sees the earlier steps and a window
                of the chunks strictly before the current one. Names starting with
                ``_t`` stay internal.

    The input is evaluated twice (rows and summaries), so chain as few scans as possible.
    """
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    out = df
    for step in local:
        out = out.withColumns({name: fn(inner) for name, fn in step.items()})

    summary = (out if totals_of_local else df).groupBy(*keys, "_chunk").agg(*[c.alias(n) for n, c in totals.items()])
    outer = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    names: list[str] = []
    for step in carry:
        summary = summary.withColumns({name: fn(outer) for name, fn in step.items()})
        names += [n for n in step if not n.startswith("_t")]
    summary = summary.select(*keys, "_chunk", *names)
    return out.join(summary, [*keys, "_chunk"], "left")


def running(order_window: WindowSpec) -> WindowSpec:
    return order_window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(order_window: WindowSpec) -> WindowSpec:
    return order_window.rowsBetween(Window.unboundedPreceding, -1)


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
    starts: Callable[[Column, Column], Column], name: str,
) -> DataFrame:
    """Cut an ordered sequence where ``starts(value, previous value)`` holds.

    ``name`` becomes the order columns of the island's first row, as a struct. Whether a
    chunk's own first row starts an island is decided from the summaries.
    """
    at = F.struct(*order)
    df = df.withColumns({"_v": value, "_at": at})
    out = chunk_scan(
        df, keys, order,
        local=[{"_before": lambda w: F.lag("_v").over(w)},
               {"_own": lambda w: F.max(F.when(F.col("_before").isNotNull() & starts(F.col("_v"), F.col("_before")), F.col("_at"))).over(running(w))}],
        totals={"_tail": F.max_by("_v", "_at"), "_head": F.min_by("_v", "_at"), "_first": F.min("_at"), "_inner": F.max("_own")},
        carry=[{"_t_prev": lambda w: F.last("_tail").over(w)},
               {"_opened": lambda w: F.when(F.col("_t_prev").isNull() | starts(F.col("_head"), F.col("_t_prev")), F.col("_first"))},
               {"_t_open": lambda w: F.coalesce("_inner", "_opened")},
               {"_prior": lambda w: F.last("_t_open", ignorenulls=True).over(w)}],
        totals_of_local=True,
    )
    return out.withColumn(name, F.coalesce("_own", "_opened", "_prior")).drop("_v", "_at", "_before", "_own", "_opened", "_prior")


def rank_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """1-based rank over a whole document, computed chunk by chunk."""
    out = chunk_scan(
        df, keys, order,
        local=[{"_rank": lambda w: F.row_number().over(w)}],
        totals={"_n": F.count(F.lit(1))},
        carry=[{"_before": lambda w: F.sum("_n").over(w)}],
    )
    return out.withColumn(name, (F.col("_rank") + F.coalesce("_before", F.lit(0))).cast("long")).drop(
        "_rank", "_before")


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``lag(value)`` over a whole document. ``value`` must not be null."""
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).getField("v")
    out = chunk_scan(
        df, keys, order,
        local=[{"_lag": lambda w: F.lag(value).over(w)}],
        totals={"_last": last},
        carry=[{"_prev_last": lambda w: F.last("_last", ignorenulls=True).over(w)}],
    )
    return out.withColumn(name, F.coalesce("_lag", "_prev_last")).drop("_lag", "_prev_last")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Inclusive running sum over a whole document."""
    df = df.withColumn("_v", value)
    out = chunk_scan(
        df, keys, order,
        local=[{"_s": lambda w: F.sum("_v").over(running(w))}],
        totals={"_n": F.sum("_v")},
        carry=[{"_before": lambda w: F.sum("_n").over(w)}],
    )
    return out.withColumn(name, F.coalesce("_s", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop(
        "_v", "_s", "_before")
