"""Contiguous shards of equal bytes, from a global prefix sum over partition totals.

DataFrame functions only. Rows are ordered by id over all partitions; the bytes before a row
are those of the partitions before its own plus those before it in its partition. The line of
bytes is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.llm.common import stored


def row_size(text: Column) -> Column:
    """Bytes of a text plus one for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def prefixed(rows: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """Add ``_row`` (0-based place) and ``_bytes`` (sum of sizes before it) in the global order.

    The ranges are written once, so each row keeps its partition while totals are taken.
    """
    ranges = stored(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
                    .withColumn("_part", F.spark_partition_id()), "shard-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_b")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b"))
    inner = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ranges.withColumns({"_place": F.row_number().over(inner) - 1, "_upto": F.sum(size).over(upto) - F.col(size)})
            .join(totals, "_part")
            .withColumns({"_row": (F.col("_n") + F.col("_place")).cast("long"), "_bytes": (F.col("_b") + F.col("_upto")).cast("long")})
            .drop("_part", "_place", "_upto", "_n", "_b"))


def balanced(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    A row belongs to the shard in whose share of all bytes its middle byte lies, so a shard's
    bytes differ from an equal share by less than one row at either end; one row larger than a
    share leaves the shards it spans empty. Rows are ordered by id (null first), then by
    checksum and size; equal rows are interchangeable. Null texts have size 1 and checksum 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_size(F.col(text_col)).alias("size"),
                       F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = prefixed(rows, ["doc_id", "text_crc32", "size"])
    total = F.lit(rows_total(placed))
    # twice the middle, in whole numbers: floor((2 * before + size) * shards / (2 * total))
    twice = (2 * F.col("_bytes") + F.col("size")).cast("decimal(38,0)") * shards
    shard = F.least(F.floor(twice / (2 * total)), F.lit(shards - 1)).cast("int")
    cut = stored(placed.withColumn("shard", shard), "shards")
    starts = cut.groupBy("shard").agg(F.min("_row").alias("_start"))
    return cut.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_start")).cast("long").alias("slot"))


def rows_total(placed: DataFrame) -> int:
    return placed.agg(F.max(F.col("_bytes") + F.col("size")).alias("t")).first()["t"] or 1
