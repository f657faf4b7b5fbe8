"""Line dedup by content-defined chunks of lines.

A long line is a chunk of its own; between long lines, a rolling hash over the hashes of the last
lines decides where a chunk ends. Nothing but the lines at hand counts, so a passage is cut the same
way wherever it stands. Chunks of one long or several short lines that the corpus holds more than
once are removed everywhere but at their first place, after the bytes were compared with the chunk
that stays. What stays of a repeated passage are short lines at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.common import binaries, map_batches, stored

_WORD = (1 << 64) - 1


@dataclass(frozen=True)
class Cuts:
    """A line of ``long_bytes`` bytes is a chunk and counts as ``min_lines`` lines. Among other lines a chunk
    ends after one where the rolling hash of the last ``window`` lines divides by ``divisor`` and that of the
    line before does not. Chunks of ``min_lines`` lines with words can be removed."""

    window: int = 2
    divisor: int = 2
    min_lines: int = 2
    long_bytes: int = 50


def _turned(value: int, by: int) -> int:
    by %= 64
    return (value << by | value >> 64 - by) & _WORD if by else value


def chunks(text: bytes, cuts: Cuts) -> list[tuple[int, int, int]]:
    """(first line, line after the last, lines with words) of the chunks that make up a text."""
    import xxhash
    lines = text.split(b"\n")
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    out, start, full, roll, before = [], 0, 0, 0, False
    for i, line in enumerate(lines):
        roll = _turned(roll, 1) ^ hashes[i]
        if i >= cuts.window:
            roll ^= _turned(hashes[i - cuts.window], cuts.window)
        # the high bits decide: they mix all of the window
        divides = (roll >> 32) % cuts.divisor == 0
        if len(line.strip()) >= cuts.long_bytes:
            if start < i:
                out.append((start, i, full))
            out.append((i, i + 1, cuts.min_lines))
            start, full = i + 1, 0
        else:
            full += bool(line and not line.isspace())
            if divides and not before:
                out.append((start, i + 1, full))
                start, full = i + 1, 0
        before = divides
    if start < len(lines):
        out.append((start, len(lines), full))
    return out


def _cut(text: bytes, cuts: Cuts) -> Iterator[tuple[int, int, bytes, int]]:
    """(chunk number, its hash, its bytes, its lines) of the chunks that can be removed."""
    import xxhash
    lines = text.split(b"\n")
    for number, (start, stop, full) in enumerate(chunks(text, cuts)):
        if full >= cuts.min_lines:
            body = b"\n".join(lines[start:stop])
            digest = xxhash.xxh64_intdigest(body)
            yield number, digest - (1 << 64) if digest >> 63 else digest, body, stop - start


def chunk_table(docs: DataFrame, cuts: Cuts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk, h of every chunk that can be removed; rows without an id or a text have none."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, numbers, digests = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), binaries(batch, "text")):
            for number, digest, _, _ in _cut(text, cuts):
                ids.append(doc_id)
                numbers.append(number)
                digests.append(digest)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(digests, pa.int64())], ["doc_id", "chunk", "h"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropna()
    return map_batches(texts, rows, "doc_id long, chunk int, h long")


def repeated(docs: DataFrame, cuts: Cuts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``gone``, the (chunk, h) to be removed from it.

    Candidates share a hash with an earlier chunk (by doc_id, then place); they go if their
    bytes equal those of the first one. A candidate that only shares the hash stays.
    """
    table = stored(chunk_table(docs, cuts, id_col, text_col), "line-chunks")
    # stored, so that both sides of the joins below are dealt out for them and a hot chunk can be split
    first = stored(table.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "chunk")).alias("first"))
                   .filter("n > 1").select("h", "first"), "repeated-hashes")
    wanted = (table.join(first, "h")
              .select(F.col("doc_id").alias("__doc"), F.struct("chunk", "h", (F.struct("doc_id", "chunk") == F.col("first")).alias("head")).alias("c"))
              .groupBy("__doc").agg(F.collect_list("c").alias("__wanted")))

    def bodies(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for doc_id, text, asked in zip(batch.column("__doc").to_pylist(), binaries(batch, "text"), batch.column("__wanted").to_pylist()):
            heads = {(c["chunk"], c["h"]): c["head"] for c in asked}
            out += [(doc_id, n, h, heads[n, h], body) for n, h, body, _ in _cut(text, cuts) if (n, h) in heads]
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()))],
            ["doc_id", "chunk", "h", "head", "body"])

    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("text")).dropna()
    found = stored(map_batches(texts.join(wanted, F.col("_doc") == F.col("__doc")).select("__doc", "text", "__wanted"), bodies,
                               "doc_id long, chunk int, h long, head boolean, body binary"), "repeated-chunks")
    heads = stored(found.filter("head").groupBy("h").agg(F.first("body").alias("_kept")), "kept-chunks")
    gone = found.filter("NOT head").join(heads, "h").filter(F.col("body") == F.col("_kept"))
    return gone.select("doc_id", F.struct("chunk", "h").alias("c")).groupBy("doc_id").agg(F.collect_set("c").alias("gone"))


def dedup_lines(docs: DataFrame, cuts: Cuts = Cuts(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks taken out of the text, plus ``__m`` (lines, removed lines, removed chunks).

    Every row stays: a text may become empty, a null text stays null. Rows that repeat a doc_id with the same text are one document and change
    alike; rows without an id are left as they are and do not count.
    """
    gone = repeated(docs, cuts, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("gone").alias("__gone"))
    joined = docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("__id"), "left").drop("__id")
    names = docs.columns
    at = names.index(text_col)

    def rebuilt(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, measures = [], []
        for text, asked in zip(binaries(batch, text_col), batch.column("__gone").to_pylist()):
            if not text:
                texts.append(text)
                measures.append((0, 0, 0))
                continue
            total = text.count(b"\n") + 1
            if not asked:
                texts.append(text)
                measures.append((total, 0, 0))
                continue
            drop = {(c["chunk"], c["h"]) for c in asked}
            drop = {n: size for n, h, _, size in _cut(text, cuts) if (n, h) in drop}
            lines = text.split(b"\n")
            texts.append(b"\n".join(line for n, (a, b, _) in enumerate(chunks(text, cuts)) if n not in drop for line in lines[a:b]))
            measures.append((total, sum(drop.values()), len(drop)))
        columns = batch.columns[:-1]
        columns[at] = pa.array(texts, pa.binary()).cast(pa.string()).cast(batch.schema.field(at).type)
        kinds = ["n_lines", "removed_lines", "removed_chunks"]
        columns.append(pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*measures) if measures else [()] * 3)], names=kinds))
        yield pa.RecordBatch.from_arrays(columns, [*names, "__m"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(joined.select(*[F.col(f"`{c}`") for c in names], "__gone"), rebuilt,
                       f"{fields}, __m struct<n_lines:bigint,removed_lines:bigint,removed_chunks:bigint>")
