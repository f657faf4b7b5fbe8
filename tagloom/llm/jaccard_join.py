"""N-gram Jaccard join by prefixes with token combinations.

The tokens of a document are its distinct shingles. All documents sort their tokens alike: rare ones
first, then class by class of rising document frequency. If a pair is similar, only so many tokens of
either side can be missing on the other side, so a prefix that keeps a signature whichever of its tokens
are missing shares one with the partner's prefix. A rare token is a signature by itself. Tokens of a
frequent class are one only k together: the prefix is extended by k - 1 tokens per group of the class,
which makes lists of frequent tokens short where single tokens would bring everything together.
Candidates are verified by the exact size of the intersection.

Three steps, each a shuffle of Spark's: packs of documents send their sorted tokens to ranges of the token
space, which count document frequencies; tokens that two documents hold (no others can be shared) go back to
their pack, where documents with too many tokens of their own drop out and the others get signatures;
signatures meet in buckets. A bucket is first joined as a star around its most typical document, so that a group of
near copies costs one pair per copy; pairs that are still in different components after that are verified unless
256 parity bits of either set rule them out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from tagloom.llm.common import binaries, id_text, map_batches, stored
from tagloom.llm.simhash import components

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHARED = 0xFFFF
#: Words whose hash a task remembers.
_REMEMBERED = 1 << 17


@dataclass(frozen=True)
class Join:
    """Pairs with 100 * intersection >= ``percent`` * union of the sets of ``shingle``-word shingles.

    ``classes``: (document frequency up to which, tokens to a signature), the last without a bound. ``pack`` tokens are
    sorted at once; ``stars`` is the number of rounds that join buckets around one of their outliers before all pairs between
    components are verified. None of these changes a result.
    """

    shingle: int = 5
    percent: int = 80
    classes: tuple[tuple[int | None, int], ...] = ((16, 1), (1024, 2), (None, 3))
    pack: int = 1 << 20
    stars: int = 1

    def missing(self, n: int, smaller: bool) -> int:
        """Tokens of a set of ``n`` that a similar set may lack: any such set, or one at least as large."""
        need = -(-2 * self.percent * n // (100 + self.percent)) if smaller else -(-self.percent * n // 100)
        return n - need


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def token_set(text: bytes, shingle: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit tokens of lower-cased (A-Z) text: one per shingle, one in all for fewer words, none without a word."""
    import xxhash
    parts = text.lower().split()
    if len(parts) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), len(parts))] if parts else [], np.uint64)
    hashes = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    stop = len(parts) - shingle + 1
    tokens = hashes[:stop]
    for i in range(1, shingle):
        tokens = (tokens ^ tokens >> np.uint64(31)) * _MIX + hashes[i:stop + i]
    return np.unique((tokens ^ tokens >> np.uint64(29)) * _MIX)


def _packed(values: np.ndarray) -> bytes:
    """Ascending values as differences, byte plane by byte plane: the upper planes are zeros, which compress away."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel().cumsum(dtype=np.uint64)


_PARITY = ["parity0", "parity1", "parity2", "parity3"]
_FACTS = ["n", "own", *_PARITY]
_SENT = [("at", pa.int32()), ("batch", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())]
_SIGNED = [("n", pa.int32()), ("key", pa.binary()), ("shared", pa.binary()), ("small", pa.list_(pa.int64())), ("large", pa.list_(pa.int64())),
           *((p, pa.int64()) for p in _PARITY)]


def _sent(id_type: pa.DataType) -> pa.Schema:
    header = pa.struct([("ids", pa.list_(id_type)), ("classes", pa.list_(pa.int32())), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())),
                        ("tokens", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary())])
    return pa.schema([*_SENT, ("header", header)])


def _send(join: Join, bits: int, schema: pa.Schema):
    """Task body: packs of documents to ranges of tokens, with one header per pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        words = _Words()
        task, number = TaskContext.get().partitionId(), 0
        ids: list = []
        classes: list = []
        known: dict[bytes, int] = {}
        sets: list[np.ndarray] = []
        sizes: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            batch = task << 32 | number
            tokens = np.concatenate([s for s in sets if len(s) > 3] or [np.zeros(0, np.uint64)])
            docs = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) if len(s) > 3 else 0 for s in sets])
            order = np.argsort(tokens)
            tokens, docs = tokens[order], docs[order]
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[first, len(tokens)]).astype(np.uint32)
            many = counts > 1
            inside = np.repeat(many, counts)
            header = {"ids": ids[:], "classes": classes[:], "keys": list(known), "sizes": sizes[:], "tokens": _packed(tokens[first[many]]),
                      "counts": counts[many].tobytes(), "docs": docs[inside].tobytes()}
            rows = [(batch % (1 << bits), batch, None, None, None, header)]
            sent, to = tokens[first], np.where(many, np.uint16(_SHARED), docs[first]) if len(first) else docs
            ranges = (sent >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sent), np.int64)
            cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(sent) else []
            for a, b in zip(cuts, np.r_[cuts[1:], len(sent)].astype(np.int64)):
                rows.append((int(ranges[a]), batch, _packed(sent[a:b]), to[a:b].astype(np.uint16).tobytes(), counts[a:b][many[a:b]].tobytes(), None))
            for kept in (ids, classes, sets, sizes):
                kept.clear()
            known.clear()
            number, held = number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binaries(batch, "text")):
                tokens = token_set(text or b"", join.shingle, words)
                key = xxhash.xxh3_128_digest(tokens.tobytes())
                ids.append(doc_id)
                classes.append(known.setdefault(key, len(known)))
                if len(known) > len(sets):
                    sets.append(tokens)
                    sizes.append(len(tokens))
                    held += len(tokens)
                if held >= join.pack or len(sets) >= _SHARED - 1 or len(ids) >= 4 * _SHARED:
                    yield flush()
        if ids:
            yield flush()

    return run


def _count(table: pa.Table) -> pa.Table:
    """One range: tokens that more than one document holds go back to their packs, with their document frequency."""
    headers = table.filter(pc.is_valid(table.column("header"))).select(["batch", "tokens", "docs", "counts", "header"])
    rows = table.filter(pc.is_null(table.column("header")))
    out = []
    if len(rows):
        tokens = [_unpacked(t) for t in rows.column("tokens").to_pylist()]
        docs = [np.frombuffer(d, np.uint16) for d in rows.column("docs").to_pylist()]
        times = []
        for to, counts in zip(docs, rows.column("counts").to_pylist()):
            times.append(np.ones(len(to), np.uint32))
            times[-1][to == _SHARED] = np.frombuffer(counts, np.uint32)
        every = np.concatenate(tokens)
        order = np.argsort(every)
        first = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
        sums = np.add.reduceat(np.concatenate(times)[order], first)
        frequency = np.empty(len(every), np.uint32)
        frequency[order] = np.repeat(sums, np.diff(np.r_[first, len(every)]))
        at = 0
        for batch, own, to in zip(rows.column("batch").to_pylist(), tokens, docs):
            here = frequency[at:at + len(own)]
            at += len(own)
            if (keep := here > 1).any():
                out.append((batch, _packed(own[keep]), to[keep].tobytes(), np.minimum(here[keep], _SHARED).astype(np.uint16).tobytes(), None))
    schema = headers.schema
    columns = list(zip(*out)) or [()] * 5
    return pa.concat_tables([headers, pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)])


@lru_cache(maxsize=None)
def _levels(percent: int) -> tuple[int, ...]:
    """Size levels such that a similar set is at the same or a neighbouring level: each bound is out of reach of the last."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return tuple(out)


def _combined(parts: np.ndarray, salt: int) -> np.ndarray:
    value = np.full(parts.shape[1], salt, np.uint64)
    for row in parts:
        value = (value ^ value >> np.uint64(31)) * _MIX + row
    return (value ^ value >> np.uint64(29)) * _MIX


def signatures(n: int, own: int, tokens: np.ndarray, frequency: np.ndarray, spare: int, level: int, join: Join, groups: int) -> list[int]:
    """Signatures of the shortest prefix that keeps one whichever ``spare`` of its tokens are missing.

    ``own`` tokens nobody else has stand first and need no signature; ``tokens`` are the others.
    """
    left = spare + 1 - own
    if left <= 0:
        return []
    bounds = np.array([bound for bound, _ in join.classes[:-1]], np.int64)
    kinds = np.searchsorted(bounds, frequency, side="left")
    order = np.lexsort((tokens, frequency, kinds))
    out: list[int] = []
    for kind, (_, k) in enumerate(join.classes):
        mine = tokens[order[kinds[order] == kind]]
        if k == 1:
            taken = mine[:left]
            left -= len(taken)
            out += taken.tolist()
        else:
            into = ((mine * _MIX) >> np.uint64(20)) % np.uint64(groups)
            members: dict[int, list] = {}
            for token, group in zip(mine, into.tolist()):
                held = members.setdefault(group, [])
                held.append(token)
                left -= len(held) >= k
                if not left:
                    break
            sets = [c for held in members.values() for c in combinations(sorted(held), k)]
            if sets:
                out += _combined(np.array(sets, np.uint64).T, level * len(join.classes) + kind + 1).tolist()
        if not left:
            return out
    raise AssertionError("every set has enough tokens for a prefix")


def _sign(join: Join, schema: pa.Schema):
    """One pack: its rows, and for documents that may have a partner the shared tokens and the signatures."""
    levels = _levels(join.percent)

    def run(table: pa.Table) -> pa.Table:
        header = next(h for h in table.column("header").to_pylist() if h is not None)
        rows = table.filter(pc.is_null(table.column("header")))
        tokens, docs, frequency = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint16)]
        for column, into, read in (("tokens", tokens, _unpacked), ("docs", docs, lambda b: np.frombuffer(b, np.uint16)), ("counts", frequency, lambda b: np.frombuffer(b, np.uint16))):
            into += [read(v) for v in rows.column(column).to_pylist()]
        tokens, docs, frequency = map(np.concatenate, (tokens, docs, frequency))
        local = _unpacked(header["tokens"])
        marked = docs == _SHARED
        place = np.argsort(tokens[marked])
        of = frequency[marked][place][np.searchsorted(tokens[marked][place], local)] if len(local) else np.zeros(0, np.uint16)
        times = np.frombuffer(header["counts"], np.uint32)
        tokens = np.r_[tokens[~marked], np.repeat(local, times)]
        docs = np.r_[docs[~marked], np.frombuffer(header["docs"], np.uint16)]
        frequency = np.r_[frequency[~marked], np.repeat(of, times)].astype(np.int64)
        order = np.lexsort((tokens, docs))
        tokens, docs, frequency = tokens[order], docs[order], frequency[order]
        starts = np.searchsorted(docs, np.arange(len(header["keys"]) + 1))
        out, done = [], set()
        for doc_id, kind in zip(header["ids"], header["classes"]):
            n, key = header["sizes"][kind], header["keys"][kind]
            a, b = starts[kind], starts[kind + 1]
            small = large = shared = None
            parity = [None] * 4
            if n > 3 and b - a >= n - join.missing(n, False) and kind not in done:
                level = int(np.searchsorted(levels, n, side="right"))
                facts = n, n - (b - a), tokens[a:b], frequency[a:b]
                at = lambda spare, l: signatures(*facts, spare, l, join, max(1, levels[l - 1] // 6))
                small = at(join.missing(n, True), level)
                large = at(join.missing(n, False), level) + (at(join.missing(n, False), level - 1) if level > 1 else [])
                small, large = (np.unique(np.array(s, np.uint64)).view(np.int64).tolist() for s in (small, large))
                shared = tokens[a:b].tobytes()
                odd = np.bincount((tokens[a:b] >> np.uint64(7)).astype(np.uint8), minlength=256) & 1
                parity = np.packbits(odd.astype(bool)).view(np.int64).tolist()
            done.add(kind)
            out.append((doc_id, n, key if n else None, shared, small, large, *parity))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def sketch(texts: DataFrame, join: Join = Join()) -> DataFrame:
    """From (doc_id, text), one row per row: n and key of the set, and, where a partner is possible, its shared tokens, their parity
    bits and the signatures as smaller and as larger side. Ids may be of any type."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 6 // join.pack)
    id_type = to_arrow_type(texts.schema["doc_id"].dataType)
    sent, signed = _sent(id_type), pa.schema([("doc_id", id_type), *_SIGNED])
    rows = texts.select("doc_id", "text").mapInArrow(_send(join, ranges.bit_length(), sent), from_arrow_schema(sent))
    back = rows.groupBy("at").applyInArrow(_count, from_arrow_schema(pa.schema([f for f in sent if f.name != "at"])))
    return back.groupBy("batch").applyInArrow(_sign(join, signed), from_arrow_schema(signed))


def _views(sets: pa.Array) -> Iterator[np.ndarray]:
    """The sets of a binary column where they lie: a batch of pairs holds two sets a row, and a copy of it would be as large again."""
    sets = sets.cast(pa.binary())
    _, ends, data = sets.buffers()
    ends = np.frombuffer(ends, np.int32)[sets.offset:sets.offset + len(sets) + 1].tolist()
    for a, b in zip(ends, ends[1:]):
        yield np.frombuffer(data, np.uint64, (b - a) // 8, a) if b > a else np.zeros(0, np.uint64)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that are similar, by the size of their intersection."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for x, y, n, m in zip(_views(batch.column("_a")), _views(batch.column("_b")), batch.column("_n").to_pylist(), batch.column("_m").to_pylist()):
            if len(x) < len(y):
                x, y = y, x
            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(y) else 0
            keep.append(100 * both >= percent * (n + m - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.join(sets.select(F.col("key").alias("b"), F.col("shared").alias("_b"), F.col("n").alias("_m")), "b")
            .join(sets.select(F.col("key").alias("a"), F.col("shared").alias("_a"), F.col("n").alias("_n")), "a"))
    return map_batches(both.select("a", "b", "_a", "_b", "_n", "_m"), rows, "a binary, b binary")


def _buckets(rows: DataFrame) -> DataFrame:
    """sig, small, large and the facts of the sets (_FACTS) of the signatures that could join two sets."""
    rows = rows.withColumn("own", (F.col("n") - F.octet_length("shared") / 8).cast("int"))
    postings = stored(rows.select("key", F.explode("small").alias("sig"), F.lit(True).alias("small")).unionByName(
        rows.select("key", F.explode("large").alias("sig"), F.lit(False).alias("small"))).groupBy("sig", "key").agg(
        F.max("small").alias("small"), F.max(~F.col("small")).alias("large")), "join-postings")
    used = stored(postings.groupBy("sig").agg(F.count(F.lit(1)).alias("_n"), F.max("small").alias("_s"), F.max("large").alias("_l"))
                  .filter("_n > 1 AND _s AND _l").select("sig"), "join-signatures")
    facts = rows.select("key", *_FACTS).dropDuplicates(["key"])
    return stored(postings.join(used, "sig", "left_semi").join(facts, "key").withColumn("comp", F.col("key")), "join-buckets")


def _rooted(live: DataFrame, found: DataFrame) -> DataFrame:
    roots = stored(components(found), "join-roots").select(F.col("node").alias("key"), F.col("root").alias("comp"))
    return stored(live.drop("comp").join(roots, "key", "left").withColumn("comp", F.coalesce("comp", "key")), "join-buckets")


def _outside(live: DataFrame) -> DataFrame:
    """The rows of buckets with several components that are not of the largest one there."""
    most = live.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("_c")).groupBy("sig").agg(
        F.max_by("comp", F.struct("_c", "comp")).alias("_most"), F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("sig", "_most")
    return live.join(most, "sig").filter(F.col("comp") != F.col("_most")).drop("_most")


def links(rows: DataFrame, join: Join = Join()) -> DataFrame:
    """Similar pairs (a, b) of set keys that connect whatever all similar pairs connect, from a stored ``sketch``.

    A pair is verified unless sizes, own tokens or parity bits rule it out. Every bucket is joined around its most typical
    member, the one with fewest tokens of its own; then around one of those that are still outside its largest component;
    then all pairs between components are tried.
    """
    signed = rows.filter("shared IS NOT NULL")
    sets = stored(signed.select("key", "n", "shared").dropDuplicates(["key"]), "join-sets")
    live = _buckets(signed)
    names = ["key", "comp", "small", "large", *_FACTS]
    # own tokens differ for sure, and of the others at least as many as parity bits
    apart = F.col("own") + F.col("_own") + sum(F.bit_count(F.col(p).bitwiseXOR(F.col("_" + p))) for p in _PARITY)
    fits = ((F.col("comp") != F.col("_comp")) & (100 * F.least("n", "_n") >= join.percent * F.greatest("n", "_n"))
            & ((100 + join.percent) * apart <= (100 - join.percent) * (F.col("n") + F.col("_n"))))
    sides = (F.col("small") & F.col("_large") & (F.col("n") <= F.col("_n"))) | (F.col("_small") & F.col("large") & (F.col("_n") <= F.col("n")))

    def tried(pairs: DataFrame) -> DataFrame:
        edges = pairs.select(F.least("key", "_key").alias("a"), F.greatest("key", "_key").alias("b")).distinct()
        return stored(_verified(stored(edges, "join-pairs"), sets, join.percent), "join-links")

    def around(members: DataFrame, order) -> DataFrame:
        return stored(members.groupBy("sig").agg(F.min_by(F.struct(*names), order).alias("_c")).select(
            "sig", *[F.col("_c")[c].alias("_" + c) for c in names]), "join-centres")

    found = tried(live.join(around(live, F.struct("own", F.xxhash64("key"))), "sig").filter(fits))
    live = _rooted(live, found)
    for star in range(join.stars):
        similar = tried(live.join(around(_outside(live), F.xxhash64("key", F.lit(star))), "sig").filter(fits))
        if similar.isEmpty():
            break
        found = found.unionByName(similar)
        live = _rooted(live, found)
    rest = stored(_outside(live).select("sig", *[F.col(c).alias("_" + c) for c in names]), "join-rest")
    last = tried(live.join(rest, "sig").filter(fits & sides))
    return found.unionByName(last)


def groups(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable over links, one row per row of ``docs``.

    Lower case folds A-Z only; null and wordless texts have no shingle, link with nothing and stand for themselves. Equal sets
    are one node, however many rows hold them. Rows without an id link like others but never name a component (it is null if all
    of its rows lack one); rows that repeat an id with other texts are documents of their own. Other columns are ignored.
    """
    rows = stored(sketch(id_text(docs), join), "join-sketch")
    classes = stored(rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first")), "join-classes")
    roots = components(links(rows, join))
    rooted = classes.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.select("key", "root").join(named, "root").select("key", "component_id")
    return rows.select("doc_id", "n", "key").join(labels, "key", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
