"""Vector best-fit packing of tokenised documents into training sequences.

Every piece of a document asks for three things at once: tokens, one document slot and
attention cost (the square of its length). All three follow from the length, so the whole
corpus is described by how many pieces there are of each length: at most ``max_tokens``
numbers, whatever the number of documents. The best-fit plan is made on those numbers and
says, per length, which range of pieces goes to which range of sequences at which offset.
Pieces find their place by their rank within their length, which is computed in chunks.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tagloom.llm.common import binaries, id_text, map_batches, stored

#: Sequences, read from the vocabulary file alone, that the encoder treats as one id.
SPECIAL = b"<|endoftext|>"
#: Ranks are counted per (length, chunk); one chunk is what a single task may have to sort.
RANK_CHUNKS = 1024

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_LOADED: dict = {}


@dataclass(frozen=True)
class Vocabulary:
    """Files of one byte-level BPE vocabulary: as a tokenizers file and as ranks with their split pattern."""

    tokenizer: str
    ranks: str
    pattern: str


@dataclass(frozen=True)
class Capacity:
    """What one sequence can hold. ``None`` stands for the most that ``tokens`` allows."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> tuple[int, int, int]:
        return (self.tokens, self.tokens if self.documents is None else self.documents,
                self.tokens ** 2 if self.attention is None else self.attention)


class ByteTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, those of the vocabulary's tokenizers file.

    The ranks give the same ids several times faster; texts that spell a special id, which the
    ranks do not know, go to the tokenizers file itself.
    """

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken
        from tokenizers import Tokenizer
        with open(vocabulary.ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._ranks = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
        self._tokenizer = Tokenizer.from_file(vocabulary.tokenizer)

    @classmethod
    def shared(cls, vocabulary: Vocabulary) -> ByteTokenizer:
        """One per worker process."""
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = cls(vocabulary)
        return _LOADED[vocabulary]

    def ids(self, text: bytes) -> list[int]:
        if SPECIAL in text:
            return self._tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return self._ranks.encode_ordinary(text.decode())

    def encode(self, text: bytes) -> bytes:
        return array("I", self.ids(text)).tobytes()


def token_pieces(docs: DataFrame, vocabulary: Vocabulary, max_tokens: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids and then ``end_id``, cut only when longer than ``max_tokens``.

    The first piece of a cut document takes the remainder, so all others are full. A null text
    counts as empty and gives one piece with ``end_id`` alone. ``with_ids`` adds the ids.
    """
    end = array("I", [end_id]).tobytes()

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer.shared(vocabulary)
        rows: list[tuple] = []
        ids: list = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), binaries(batch, "text")):
            data = tokenizer.encode(text or b"") + end
            total = len(data) // 4
            at, to = 0, total % max_tokens or min(total, max_tokens)
            piece = 0
            while at < total:
                part = data[4 * at:4 * to]
                rows.append((doc_id, piece, at, to - at, zlib.crc32(part)))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                at, to, piece = to, to + max_tokens, piece + 1
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)

    return map_batches(id_text(docs), cut, _PIECE + (", ids array<int>" if with_ids else ""))


def best_fit_plan(counts: dict[int, int], capacity: Capacity, weights: tuple[float, float, float] = (1.0, 0.05, 0.25),
                  rule: str = "norm") -> np.ndarray:
    """Best-fit, longest pieces first, on the number of pieces per length.

    ``rule`` chooses the open sequence for a piece among those with room in all three
    dimensions, on vectors divided by the capacities: ``norm`` takes the smallest weighted
    norm of what would be left, ``dot`` the smallest weighted dot product of the piece with
    what is left now (the fullest along what the piece needs). Ties go to fewer tokens left,
    then to the oldest.

    Sequences in the same state are one class, so a step moves a whole range of pieces.
    Returns rows (length, first rank, pieces, first sequence, offset): pieces with the ranks
    ``first rank + i`` go to the sequences ``first sequence + i`` at ``offset``.
    """
    caps = np.array(capacity.vector(), float)
    weight = np.array(weights, float)
    tokens = capacity.tokens
    free: dict[tuple[int, int, int], list[list[int]]] = {}
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        item = (length, 1, length * length)
        if any(i > c for i, c in zip(item, capacity.vector())):
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of an empty sequence")
        left, rank = counts[length], 0
        need = np.array(item, float)
        states = [s for s in free if s[0] >= item[0] and s[1] >= item[1] and s[2] >= item[2]]
        if states:
            residual = np.array(states, float)
            if rule == "norm":
                score = (weight * ((residual - need) / caps) ** 2).sum(axis=1)
            elif rule == "dot":
                score = (weight * (need / caps) * (residual / caps)).sum(axis=1)
            else:
                raise ValueError(f"unknown rule {rule}")
            # Filling a sequence only makes it fit better, so the order of the classes stays.
            states = [states[i] for i in np.lexsort((-residual[:, 1], residual[:, 0], score))]
        for state in states:
            if not left:
                break
            left, rank = _fill(free, free.pop(state), state, item, left, rank, tokens, out)
        if left:
            per = min(c // i for c, i in zip(capacity.vector(), item))
            bins = -(-left // per)
            left, rank = _fill(free, [[opened, bins]], capacity.vector(), item, left, rank, tokens, out)
            opened += bins
    return np.array(out, np.int64).reshape(-1, 5)


def _fill(free, ranges, state, item, left, rank, tokens, out):
    """Put pieces of one length into the sequences of one class; what is not filled stays in ``free``."""
    per = min(r // i for r, i in zip(state, item))
    offset = tokens - state[0]
    for first, size in ranges:
        full = min(size, left // per)
        for k in range(per if full else 0):
            out.append((item[0], rank, full, first, offset + k * item[0]))
            rank += full
        left -= full * per
        if full:
            _keep(free, tuple(s - per * i for s, i in zip(state, item)), first, full)
        used = full
        if left and used < size:  # the last pieces of this length, fewer than a sequence takes
            for k in range(left):
                out.append((item[0], rank, 1, first + used, offset + k * item[0]))
                rank += 1
            _keep(free, tuple(s - left * i for s, i in zip(state, item)), first + used, 1)
            left, used = 0, used + 1
        if used < size:
            _keep(free, state, first + used, size - used)
    return left, rank


def _keep(free, state, first, size):
    if min(state) > 0:
        free.setdefault(state, []).append([first, size])


def ranked(pieces: DataFrame, chunks: int = RANK_CHUNKS) -> DataFrame:
    """Add ``_rank``: 0, 1, ... within each length, without one task per length."""
    keys = ["length", "_chunk"]
    pieces = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)).cast("int"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys).orderBy("doc_id", "piece", "ids_crc32")
    return (pieces.withColumn("_row", F.row_number().over(inner) - 1).join(starts, keys)
            .withColumn("_rank", (F.col("_start") + F.col("_row")).cast("long")).drop("_chunk", "_row", "_start"))


def pack(docs: DataFrame, vocabulary: Vocabulary, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 0.05, 0.25),
         rule: str = "norm", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack every document into sequences under ``capacity``.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).
    Null texts are empty ones, repeated rows are packed as often as they occur, an empty table
    gives no rows, other columns of ``docs`` are not looked at. Pieces are stored once; the
    plan brought to the driver has one number per length.
    """
    pieces = stored(token_pieces(docs, vocabulary, capacity.tokens, end_id, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(counts, capacity, weights, rule)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    length, rank, _, sequence, offset = plan.T.copy()
    keys = length << 44 | rank

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (lengths.to_numpy() << 44) | ranks.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + ranks.to_numpy() - rank[at], "offset": offset[at]})

    names = pieces.columns
    return ranked(pieces).withColumn("_place", place("length", "_rank")).select(
        *[c for c in names if c != "ids"], "_place.sequence_id", "_place.offset", *(["ids"] if with_ids else []))
