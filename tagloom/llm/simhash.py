"""Near-duplicates by SimHash, with a candidate search that misses nothing.

Fingerprints within a Hamming radius are found by covering locality-sensitive hashing: bit i
of the fingerprint is given a vector over GF(2), and for every non-zero vector v a table keeps
the bits whose vector has an odd product with v. Up to ``radius`` differing bits span fewer
dimensions than there are, so some v is orthogonal to all of them, and in that table the two
fingerprints agree: every pair within the radius shares a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.common import binaries, id_text, map_batches, stored

BITS = 64
#: A bucket with more fingerprints than this is cut finer, if it has more than FREE_BITS free bits ...
BUCKET = 1 << 16
#: ... since one with no more of them cannot hold over 2 ** FREE_BITS different fingerprints.
FREE_BITS = 16
_HASHES_AT_ONCE = 1 << 16


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of lower-cased (A-Z) text over its word shingles, repeats included; 0 without a word."""
    import xxhash
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[at:at + _HASHES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text; null counts as no words."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.array([simhash(t or b"", shingle, seed) for t in binaries(batch, "text")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(id_text(docs), rows, "doc_id long, fp long")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


@lru_cache(maxsize=None)
def covering_masks(radius: int, taken: int = 0) -> tuple[int, ...]:
    """Masks such that any ``radius`` free bits (those not in ``taken``) are left out by one of them.

    Each mask also has all bits of ``taken``.
    """
    vectors = 2 ** (radius + 1) - 1
    free = [i for i in range(BITS) if not taken >> i & 1]
    return tuple(taken | sum(1 << bit for j, bit in enumerate(free) if ((1 + j % vectors) & v).bit_count() % 2)
                 for v in range(1, vectors + 1))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def spanning_links(fps: np.ndarray, radius: int) -> tuple[list, list]:
    """Enough links to connect what a bucket connects: a forest, not all pairs."""
    a: list = []
    b: list = []
    left = fps
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                a.extend([x] * len(found))
                b.extend(found)
                todo.extend(found)
                left = left[~near]
    return a, b


def _bucket_links(radius: int, bucket: int):
    """Task body over rows (mask, key, fp) sorted by mask and key: links, and finer rows of full buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.uint64)
        over = None  # the bucket that is being handed on, row by row

        def refined(part: np.ndarray) -> pa.RecordBatch:
            rows = np.concatenate([np.stack([np.full(part.shape[1], m, np.uint64), part[2] & np.uint64(m), part[2]])
                                   for m in covering_masks(radius, int(part[0, 0]))], axis=1)
            return emit(np.ones(rows.shape[1], np.int32), *rows)

        def emit(kind, x, y, z) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), *(pa.array(np.asarray(c, np.uint64).view(np.int64)) for c in (x, y, z))],
                ["kind", "x", "y", "z"])

        def links(part: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, (part[:2, 1:] != part[:2, :-1]).any(axis=0)])
            stops = np.r_[starts[1:], part.shape[1]]
            pairs = starts[stops - starts == 2]
            pairs = pairs[np.bitwise_count(part[2, pairs] ^ part[2, pairs + 1]) <= radius]
            a, b = list(part[2, pairs]), list(part[2, pairs + 1])
            for at in np.flatnonzero(stops - starts > 2):
                x, y = spanning_links(part[2, starts[at]:stops[at]], radius)
                a += x
                b += y
            a, b = np.array(a, np.uint64), np.array(b, np.uint64)
            return emit(np.zeros(len(a), np.int32), np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.uint64))

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("mask", "key", "fp")])
            if over is not None:
                same = (rows[:2] == over[:, None]).all(axis=0)
                if same.any():
                    yield refined(rows[:, same])
                rows = rows[:, ~same]
                if not rows.shape[1]:
                    continue
                over = None
            held = np.concatenate([held, rows], axis=1)
            if not held.shape[1]:
                continue
            last = held.shape[1] - int(np.argmin((held[:2] == held[:2, -1:]).all(axis=0)[::-1])) if (
                held[:2] != held[:2, -1:]).any() else 0
            if last:
                yield links(held[:, :last])
                held = held[:, last:]
            if held.shape[1] > bucket and BITS - int(held[0, 0]).bit_count() > FREE_BITS:
                over = held[:2, 0].copy()
                yield refined(held)
                held = held[:, :0]
        if held.shape[1]:
            yield links(held)

    return run


def links(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a forest per bucket, between different fingerprints ``fp`` within ``radius`` bits.

    Buckets over ``bucket`` fingerprints go round again with masks over the bits they leave
    free; no fingerprint is dropped and no bucket is held beyond that size.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    rows = fps.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
    out = None
    while True:
        found = stored(rows.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(
            _bucket_links(radius, bucket), "kind int, x long, y long, z long"), "simhash-links")
        edges = found.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"))
        out = edges if out is None else out.unionByName(edges)
        rows = found.filter("kind = 1").select(F.col("x").alias("mask"), F.col("y").alias("key"), F.col("z").alias("fp")).distinct()
        if rows.isEmpty():
            return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable (``root``) of every ``node`` in edges (a, b).

    Alternating large and small stars: edges are re-hung onto the smallest neighbour until the
    edge set stays the same, a number of rounds that grows with the logarithm of the longest path.
    """
    edges = stored(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.filter("b > a").join(least, "a").select(F.col("_m").alias("a"), "b").filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("_m"))
        small = down.join(lowest, "u").select("u", "v", "_m")
        edges = stored(small.select(F.col("_m").alias("a"), F.col("v").alias("b")).unionByName(
            small.select(F.col("_m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct(), "edges")
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (row["n"], row["h"]):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = (row["n"], row["h"])


def groups(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links.

    One row per row of ``docs``. Texts without words have fingerprint zero and link like any
    other; copies share a fingerprint and are joined by it alone, so a group of copies of any
    size is one row in the search. Rows without an id never name a component.
    """
    prints = stored(fingerprints(docs, shingle, seed), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    roots = components(links(classes.select("fp"), radius, bucket))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(labels, "fp", "left").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest doc_id of each group, once.

    All columns are kept. Rows without an id cannot be named by a group and all stay.
    """
    kept = stored(groups(docs, **parameters), "near-duplicates")
    heads = kept.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return named.unionAll(docs.filter("doc_id IS NULL"))
