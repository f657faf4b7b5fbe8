"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.session import stored  # noqa: F401

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
#: On UTF-8 bytes this is exactly what ``bytes.split()`` cuts.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that need one batch at a time and nothing between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rows(batch)

    return df.mapInArrow(run, schema)


def binaries(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, null as None."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, whatever else the table carries."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def code_points(text: Column) -> Column:
    return F.coalesce(F.char_length(text), F.lit(0)).cast("long")


def trigram_buckets(text: str, bits: int) -> np.ndarray:
    """Hashed character trigrams of a lower-cased text with a space at either end, in order."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    mixed = (points[:-2] << np.uint64(42)) ^ (points[1:-1] << np.uint64(21)) ^ points[2:]
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
