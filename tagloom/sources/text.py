"""Plain text and intake limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.functions.text import strip

MAX_BYTES = 100 * 1024 * 1024


def text_nodes(documents: DataFrame) -> DataFrame:
    """One paragraph per non-empty line; ``ord`` is the line's position."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), F.lit("P").alias("tag"), strip(F.col("line")).alias("text")).filter(
        F.col("text") != "")


def turn_nodes(conversations: DataFrame) -> DataFrame:
    """Conversation turns as nodes, tagged by role."""
    return conversations.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.concat(F.lit("n"), "turn").alias("node_id"),
        F.when(F.col("role") == "user", "H2").otherwise("P").alias("tag"), "text")


def size_guard(inputs: DataFrame, size_col: str = "length", limit: int = MAX_BYTES) -> DataFrame:
    """Inputs above the byte limit are marked, not read."""
    return inputs.withColumn("accepted", F.col(size_col) <= limit)


def list_files(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> DataFrame:
    """Files with their sizes; content is never read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return size_guard(files, "length", limit)
