"""I-Match fingerprints over randomised lexicons.

Terms within a band of document frequency make up the lexicon. A document is described by the
lexicon terms it holds: for each of many random subsets of the lexicon, its terms in the subset
are sorted and hashed. Subsets come in several sizes, because a hash only survives an edit if it
covers few of a document's terms, and documents have from one to many thousand terms.
"""

from __future__ import annotations

import hashlib
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.common import binaries, id_text, map_batches

_STRIP = string.punctuation + "«»„“”‘’…–—¡¿"
_PENDING_TERMS = 300_000


@dataclass(frozen=True)
class Lexicon:
    """Terms in at least ``low`` and at most ``high`` of the documents (idf between -log high and
    -log low). Their number is at most the mean number of distinct terms of a document over
    ``low``, whatever the number of documents, so the lexicon can be sent to every task.

    A text with fewer than ``few`` lexicon terms is described by all its terms.
    """

    low: float = 0.001
    high: float = 0.2
    few: int = 4


@dataclass(frozen=True)
class Subsets:
    """``count`` subsets at each of ``scales`` sizes: a quarter of the lexicon, a sixteenth, ..."""

    count: int = 24
    scales: int = 6
    digits: int = 3

    def of(self, term: str) -> list[int]:
        """Numbers of the subsets that hold a term."""
        import xxhash
        data, out = term.encode(), []
        for scale in range(self.scales):
            parts = 4 ** (scale + 1)
            taken = min(parts, self.count) if parts != 16 else 12
            for group in range(self.count // taken):
                part = xxhash.xxh64_intdigest(data, 1000 * scale + group) % parts
                if part < taken:
                    out.append(scale * self.count + group * taken + part)
        return out


def terms(text: str) -> set[str]:
    """Distinct lower-case words without surrounding punctuation."""
    out = {w.strip(_STRIP) for w in set(text.lower().split())}
    out.discard("")
    return out


def parted(text: str, keep: int) -> tuple[set[str], str]:
    """The terms of the words that end within the first ``keep`` code points, and what of the next word is among them."""
    head = text[:keep]
    if not head or head[-1].isspace():
        return terms(head), ""
    words = head.rsplit(None, 1)
    return (terms(words[0]), words[1]) if len(words) == 2 else (set(), words[0])


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, df over all documents; counted within each task before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    seen.update(terms(text))
                if len(seen) > _PENDING_TERMS:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term string, n long")
            .groupBy("term").agg(F.sum("n").alias("df")))


def lexicon(docs: DataFrame, band: Lexicon = Lexicon(), text_col: str = "text") -> DataFrame:
    """The terms of the band, by document frequencies over all of ``docs``."""
    total = docs.count()
    return document_frequencies(docs, text_col).filter(F.col("df").between(band.low * total, band.high * total)).select("term")


class Printer:
    """Fingerprints of texts under one lexicon; one text is remembered at a time."""

    def __init__(self, chosen: Iterable[str], band: Lexicon, subsets: Subsets):
        self._chosen = {t: None for t in chosen}
        self._band, self._subsets = band, subsets

    def _places(self, term: str) -> list[int]:
        places = self._chosen.get(term)
        if places is None:
            places = self._subsets.of(term)
            if term in self._chosen:
                self._chosen[term] = places
        return places

    def print(self, text: str) -> str:
        """``digits`` hex digits per subset, dashes for a subset of which the text has no term."""
        return "".join(self.hashes(terms(text)))

    def hashes(self, every: set[str]) -> list[str]:
        """The parts of a fingerprint, from the terms of a text."""
        import xxhash
        own = self._chosen.keys() & every
        if len(own) < self._band.few:
            own = every
        held: dict[int, list[str]] = {}
        for term in sorted(own):
            for place in self._places(term):
                held.setdefault(place, []).append(term)
        subsets = self._subsets
        empty = "-" * subsets.digits
        return [xxhash.xxh64_hexdigest(" ".join(held[i]).encode())[:subsets.digits] if i in held else empty
                for i in range(subsets.count * subsets.scales)]

    def likeness(self, one: list[str], other: list[str]) -> float:
        """Share of equal hashes among the subsets that either text has terms in, 0 to 1.

        Sizes at which most subsets are used hold too many terms each to survive an edit, so only
        those used by at most three quarters count; the smallest size always does. Equal
        fingerprints have 1, without any used subset in common it is 0.
        """
        if one == other:
            return 1.0
        subsets = self._subsets
        empty = "-" * subsets.digits
        same = used = 0
        for scale in range(subsets.scales):
            part = slice(scale * subsets.count, (scale + 1) * subsets.count)
            a, b = one[part], other[part]
            either = sum(x != empty or y != empty for x, y in zip(a, b))
            if 4 * either <= 3 * subsets.count or scale == subsets.scales - 1:
                used += either
                same += sum(x == y != empty for x, y in zip(a, b))
        return same / used if used else 0.0


def fingerprints(docs: DataFrame, band: Lexicon = Lexicon(), subsets: Subsets = Subsets(), chosen: DataFrame | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every whole text; null counts as empty."""
    docs = id_text(docs, id_col, text_col)
    known = _sent(docs, band, chosen)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        printer = Printer(known.value, band, subsets)
        prints = [printer.print(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return map_batches(docs, rows, "doc_id long, fingerprint string")


def _sent(docs: DataFrame, band: Lexicon, chosen: DataFrame | None):
    found = lexicon(docs, band) if chosen is None else chosen
    return docs.sparkSession.sparkContext.broadcast([r[0] for r in found.select("term").collect()])


def beside_next(docs: DataFrame, ranges_per_partition: int = 16) -> DataFrame:
    """Rows (_range, _guest, doc_id, packed) for going through the documents in id order, task by task.

    Ids are cut into ranges; each range also gets a copy of the first row of the next one (of the
    first range, for the last) as a guest, so every row finds its successor in its own partition
    and texts are shuffled once, packed with Zstandard. What the driver sees is one id per range.
    """
    spark = docs.sparkSession
    parts = ranges_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(least))
    keys = docs.select(key.alias("k"))
    cuts = keys.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts).alias("c")).first()["c"] or []
    edges = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right"))

    heads = {r["r"]: r["k"] for r in keys.groupBy(range_of("k").alias("r")).agg(F.min("k").alias("k")).collect()}
    order = sorted(heads)
    first = np.array([heads[r] for r in order], np.int64)
    previous = np.array(order[-1:] + order[:-1], np.int64)

    def placed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard
        pack = zstandard.ZstdCompressor(level=1).compress
        ids = batch.column("doc_id")
        found = ids.fill_null(least).to_numpy(zero_copy_only=False)
        at = np.searchsorted(first, found, side="right") - 1
        guests = np.flatnonzero(found == first[at])
        rows = np.concatenate([np.arange(len(found)), guests])
        texts = [t or b"" for t in binaries(batch, "text")]
        packed = pa.array([pack(t) for t in texts], pa.binary())
        ties = pa.array([xxhash.xxh64_intdigest(t) >> 1 for t in texts], pa.int64())
        ranges = np.concatenate([np.array(order, np.int64)[at], previous[at[guests]]])
        is_guest = np.repeat(np.array([0, 1], np.int32), [len(found), len(guests)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ranges), pa.array(is_guest), ids.take(pa.array(rows)), ties.take(pa.array(rows)), packed.take(pa.array(rows))],
            ["_range", "_guest", "doc_id", "_tie", "packed"])

    if not order:
        return map_batches(docs, lambda _: iter(()), "_range long, _guest int, doc_id long, _tie long, packed binary")
    spread = map_batches(docs, placed, "_range long, _guest int, doc_id long, _tie long, packed binary")
    return (spread.repartition(max(1, parts // ranges_per_partition), "_range")
            .sortWithinPartitions("_range", "_guest", F.col("doc_id").asc_nulls_first(), "_tie"))


def compare_edited(docs: DataFrame, band: Lexicon = Lexicon(), subsets: Subsets = Subsets(), share: int = 4,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside an edited one and beside the next document.

    The edited text has its last 1/``share`` of code points replaced by as many from the start of
    the next document by id (after the last: the first; all of it if it is shorter). Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one
    row per row of ``docs``. Null texts are empty, rows without an id come first, rows repeating
    an id follow each other, a single document is its own successor.
    """
    docs = id_text(docs, id_col, text_col)
    known = _sent(docs, band, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        printer = Printer(known.value, band, subsets)
        held = None  # what is known of the row whose successor is awaited
        for batch in batches:
            out = []
            for where, guest, doc_id, packed in zip(*(batch.column(c).to_pylist() for c in ("_range", "_guest", "doc_id", "packed"))):
                if guest and (held is None or held[0] != where):
                    continue  # only the first guest is a successor
                text = unpack(packed).decode()
                # the words that the edit leaves alone are taken apart once, for both texts
                keep = len(text) - len(text) // share
                stays, begun = parted(text, keep)
                own = printer.hashes(stays | terms(begun + text[keep:]))
                if held is not None and held[0] == where:
                    _, before, start, known_terms, rest, mark = held
                    cut = len(start) // share
                    edited = start[:len(start) - cut] + text[:cut]
                    other = printer.hashes(known_terms | terms(rest + text[:cut])) if edited != start else mark
                    out.append((before, len(start), hashlib.sha256(edited.encode()).hexdigest(), "".join(mark), "".join(other),
                                printer.likeness(mark, other), printer.likeness(mark, own)))
                held = None if guest else (where, doc_id, text, stays, begun, own)
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [
                "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return beside_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                             "edited_fingerprint string, near_edited double, near_next double")
