"""Conversation structure repair: the cheapest edits that make the roles legal, told by the least audit.

Legal roles are nothing, or an optional system message and then user and assistant in turn. A cost pass from the last
message to the first gives every node (message, state of the grammar) what is still to pay; arcs that lie on a cheapest way
are optimal. From a node each letter leads to one node only, so the first letters of the least audit from it are known for
lengths 1, 2, 4, ...: a node's rank among the nodes by the first 2L letters follows from its rank by L letters and the rank,
by L letters, of the node that its L-step pointer leads to. The pointers double with the ranks and
give the least way from the start, twice as far in every round.

Spark orders all messages by range, so that a long conversation is spread over tasks; faults are columns. Only codes of one byte
and an order number per message meet in one task, conversation by conversation, and the audit, which is one value anyway, has as many letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.common import stored

#: What the characters of an edit do to a message and around it: u and a insert, K keeps, U and A set the role, D deletes.
_LETTER = {"u": "I", "a": "I", "K": "K", "U": "R", "A": "R", "D": "D"}
_KEEP, _REROLE, _DELETE, _INSERT, _CUT_OFF = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. A user or assistant message is next to which state:
_NEXT = np.array([2, 2, 3, 2])
_FAR = 1 << 40
_BLOCK = 1 << 14
_SPACE = " \t\n\x0b\x0c\r"


# ---- one conversation, as one code per message: initial (0 s, 1 u, 2 a, 3 other) + 4 * fault (0 none, 1 blank, 2 duplicate, 3 truncated)

def _settled(base: list[int]) -> list[int]:
    """Costs to go at one place, from those that begin with a message, when messages may be inserted first."""
    user = min(base[2], base[3] + _INSERT)
    return [min(base[0], user + _INSERT), min(base[1], user + _INSERT), user, min(base[3], base[2] + _INSERT)]


def _before(code: int, after: list[int]) -> list[int]:
    """Costs to go in front of a message, given those behind it."""
    initial, fault = code & 3, code >> 2
    base = [c + _DELETE for c in after]
    if fault in (0, 3):
        extra = _CUT_OFF if fault else 0
        turned = after[3], after[2]  # the role that is next: assistant after user, user otherwise
        for state in range(4):
            base[state] = min(base[state], (turned[0] if state == 2 else turned[1]) + _REROLE + extra)
        if initial == 0:
            base[0] = min(base[0], after[1] + _KEEP + extra)
        elif initial == 1:
            for state in (0, 1, 3):
                base[state] = min(base[state], after[2] + _KEEP + extra)
        elif initial == 2:
            base[2] = min(base[2], after[3] + _KEEP + extra)
    return _settled(base)


_END = _settled([0, _FAR, _FAR, 0])


def _least(codes: np.ndarray, costs: np.ndarray, state: int) -> tuple[str, int]:
    """The least way through a block of messages from ``state`` in front of it: its edits, and the state behind it.

    ``costs`` are the costs to go in front of each message and behind the last.
    """
    m = len(codes)
    here = np.arange(4 * m)
    at, of = here // 4, here % 4
    initial, fault = codes[at] & 3, codes[at] >> 2
    extra, free = np.where(fault == 3, _CUT_OFF, 0), (fault == 0) | (fault == 3)
    fits = free & (((initial == 0) & (of == 0)) | ((initial == 1) & (of != 2)) | ((initial == 2) & (of == 2)))
    kept = np.where(initial == 0, 1, _NEXT[of])
    flat = costs.ravel()
    arcs = [  # in the order of their letters
        (4 * (at + 1) + of, np.full(4 * m, _DELETE), np.ones(4 * m, bool)),
        (4 * at + _NEXT[of], np.full(4 * m, _INSERT), np.ones(4 * m, bool)),
        (4 * (at + 1) + kept, _KEEP + extra, fits),
        (4 * (at + 1) + _NEXT[of], _REROLE + extra, free)]
    # one node per letter: the letter's code is the rank by one letter, the rank by 2L follows from those by L
    nodes = np.arange(4 * (m + 1))  # the last four are the end of the block
    optimal = [(to, may & (flat[to] + cost == flat[:4 * m])) for to, cost, may in arcs]
    rank, step = np.zeros(4 * (m + 1), np.int64), nodes.copy()
    for number, (to, best) in reversed(list(enumerate(optimal, 1))):
        rank[:4 * m][best], step[:4 * m][best] = number, to[best]
    while (step < 4 * m).any():
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[step], return_inverse=True)[1]
        step = step[step]
    # of a node's optimal arcs the one with the least (letter, rank of where it leads)
    letter, step, least = np.zeros(4 * (m + 1), np.int64), nodes.copy(), np.full(4 * m, np.iinfo(np.int64).max)
    for number, (to, best) in enumerate(optimal, 1):
        key = number * (int(rank.max()) + 1) + rank[to]
        best = best & (key < least)
        letter[:4 * m][best], step[:4 * m][best], least[best] = number, to[best], key[best]
    way = np.array([state])
    while way[-1] < 4 * m:
        way = np.concatenate([way, step[way]])
        step = step[step]
    way = way[:np.argmax(way >= 4 * m) + 1]
    roles = np.where(_NEXT[way[:-1] % 4] == 2, 0, 1)
    return "".join("D" if n == 1 else "ua"[r] if n == 2 else "K" if n == 3 else "UA"[r] for n, r in zip(letter[way[:-1]], roles)), int(way[-1] % 4)


def solve(codes: bytes | np.ndarray) -> tuple[list[str], int]:
    """One edit per message (the last also holds what is inserted behind it) and the cost of all."""
    codes = np.frombuffer(codes, np.uint8) if isinstance(codes, bytes) else codes
    if not len(codes):
        return [], 0
    starts = range(0, len(codes), _BLOCK)
    after, behind = _END, []
    for a in reversed(starts):
        behind.append(after)
        for code in codes[a:a + _BLOCK][::-1].tolist():
            after = _before(code, after)
    total, state, edits = after[0], 0, ""
    for a, last in zip(starts, reversed(behind)):
        block = codes[a:a + _BLOCK]
        costs = [last]
        for code in block[::-1].tolist():
            costs.append(_before(code, costs[-1]))
        part, state = _least(block.astype(np.int64), np.array(costs[::-1]), state)
        edits += part
    out, pending = [], ""
    for ch in edits:
        pending += ch
        if ch in "KUAD":
            out.append(pending)
            pending = ""
    out[-1] += {0: "", 1: "ua", 2: "a", 3: ""}[state]
    return out, total


def audit_of(edits: list[str]) -> str:
    return "".join(map(_LETTER.__getitem__, "".join(edits)))


def illegal_pairs(codes: np.ndarray) -> int:
    a, b = codes[:-1] & 3, codes[1:] & 3
    return int((~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))).sum())


# ---- tables

def ordered(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) in order: ``place`` rises with conv_id, turn (none first), role and digest of the text;
    ``fault`` is blank, duplicate or truncated, the first that holds, else null. Null role and text count as one space.

    Equal messages are counted before they are told apart, so a message that fills a conversation is one row per task there.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    firsts = same.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first")).select(
        F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    met = same.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")))
    single = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    said = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = (F.when(said == "", "blank").when((F.col("copy") > 1) | ~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate")
             .when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated"))
    sort = ["conv_id", "turn", "role", "digest", "copy"]
    lined = single.select("conv_id", "turn", "role", "text", "digest", "copy", fault.alias("fault")).repartitionByRange(*sort).sortWithinPartitions(*sort)
    return lined.select("conv_id", F.monotonically_increasing_id().alias("place"), "turn", "role", "text", "fault")


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("fault") == "blank", 4).when(F.col("fault") == "duplicate", 8).when(F.col("fault") == "truncated", 12).otherwise(0)
    return (kind + fault).cast("tinyint")


def _per_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Runs of equal conv_id in a sorted stream of batches."""
    held: list[pa.RecordBatch] = []
    key: object = None
    for batch in batches:
        ids = batch.column("conv_id")
        names = ids.to_pylist()
        start = 0
        for i in range(1, len(names) + 1):
            if i < len(names) and names[i] == names[start]:
                continue
            if held and names[start] != key:
                yield key, held
                held = []
            key = names[start]
            held.append(batch.slice(start, i - start))
            start = i
    if held:
        yield key, held


def edits(lined: DataFrame) -> DataFrame:
    """conv_id, place, edit per message, and one row per conversation with a null place and its audit, cost and illegal pairs."""
    kind = lined.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "place", "edit", "audit", "cost", "illegal"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        out: list = []
        key_type = None

        def made() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, t) for c, t in zip(columns[1:], types))], names)

        for key, parts in _per_conversation(batches):
            key_type = parts[0].column("conv_id").type
            codes = np.concatenate([p.column("code").to_numpy() for p in parts]).astype(np.uint8)
            changes, cost = solve(codes)
            out.append((key, None, None, audit_of(changes), cost, illegal_pairs(codes)))
            done = 0
            for part in parts:
                out += [(key, place, edit, None, None, None) for place, edit in zip(part.column("place").to_pylist(), changes[done:])]
                done += part.num_rows
                if len(out) > 10_000:
                    yield made()
        if out:
            yield made()

    compact = lined.select("conv_id", "place", _code().alias("code")).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return compact.mapInArrow(run, f"conv_id {kind}, place long, edit string, audit string, cost long, illegal long")


def repaired(lined: DataFrame, changes: DataFrame) -> DataFrame:
    """conv_id, place, part, role, text of the repaired conversations; inserted messages have empty text."""
    per = changes.filter("place IS NOT NULL").select(F.col("place").alias("_p"), "edit")
    pieces = lined.join(per, F.col("place") == F.col("_p")).select(
        "conv_id", "place", "role", "text", F.posexplode(F.filter(F.split("edit", ""), lambda c: (c != "D") & (c != ""))).alias("part", "_do"))
    does = F.col("_do")
    return pieces.select("conv_id", "place", "part", F.when(does.isin("u", "U"), "user").when(does.isin("a", "A"), "assistant").otherwise(F.col("role")).alias("role"),
                         F.when(does.isin("u", "a"), "").otherwise(F.col("text")).alias("text"))


def digests(messages: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of its lines ``role:text``, joined by newlines. A hash is taken in order, so a conversation streams
    through one task; nothing of it is held."""
    kind = messages.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, ids, out, key_type = None, None, [], [], None
        for batch in batches:
            key_type = batch.column("conv_id").type
            for name, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").cast(pa.binary()).to_pylist()):
                if state is None or name != key:
                    if state is not None:
                        ids.append(key)
                        out.append(state.hexdigest())
                    key, state = name, hashlib.sha256(line)
                else:
                    state.update(b"\n")
                    state.update(line)
        if state is not None:
            ids.append(key)
            out.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, key_type), pa.array(out)], ["conv_id", "repaired_sha256"])

    lines = messages.select("conv_id", "place", "part", F.concat_ws(":", "role", "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part").select("conv_id", "line").mapInArrow(
        run, f"conv_id {kind}, repaired_sha256 string")


def repair(messages: DataFrame, conversations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The repaired messages, and per conversation gaps, faults, illegal pairs, cost, audit and digest.

    Messages without a conv_id are one conversation without a name. A role that begins with none of s, u, a (an empty one too) can't be kept.
    ``conversations`` may name (conv_id) some without messages; they get zeros, an empty audit and the digest of nothing. Other columns are ignored.
    """
    lined = stored(ordered(messages), "messages")
    changes = stored(edits(lined), "edits")
    mended = repaired(lined, changes)
    faults = [F.coalesce(F.sum(F.when(F.col("fault") == f, 1)), F.lit(0)).cast("long").alias(f) for f in ("blank", "duplicate", "truncated")]
    facts = lined.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"), *faults)
    pieces = [facts, changes.filter("place IS NULL").select("conv_id", "illegal", "cost", "audit"), digests(mended)]
    if conversations is not None:
        pieces.append(conversations.select("conv_id").distinct())
    every = pieces[0]
    for piece in pieces[1:]:
        every = every.unionByName(piece, allowMissingColumns=True)
    zero = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return mended, every.groupBy("conv_id").agg(*[F.coalesce(F.max(n), zero.get(n, F.lit(0).cast("long"))).alias(n) for n in names])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32 of ``conv_id:turn``, null as one space: 0 drops the row, 1 empties its
    text, 2 takes its stops out, 3 repeats it, 4 makes it the user's."""
    name, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = (F.crc32(F.concat(name, F.lit(":"), turn).cast("binary")) % 20).alias("_kind")
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind).filter("_kind <> 0")
    changed = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                          F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), "_kind")
    return changed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "_copy")
