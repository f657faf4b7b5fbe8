"""Conversation repair: single conversations against all edits, tables against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tagloom.llm import conversation_repair as repair
from tests.llm.data import prose

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), *[T.StructField(n, T.StringType()) for n in ("place", "part", "fault", "copy", "edit", "audit", "_kind")]])
_ROLES = ["s", "u", "a"]


def best(codes):
    """(cost, audit, edits) by keeping the least of every (messages read, roles so far ended with), letter by letter."""
    def step(state, role):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, role))

    def inserted(front):
        for _ in range(3):
            for state, (cost, audit, edits) in list(front.items()):
                for role in "ua":
                    if (to := step(state, role)) is not None:
                        new = cost + 2, audit + "I", edits + role
                        front[to] = min(front.get(to, new), new)
        return front

    front = inserted({"": (0, "", "")})
    for code in codes:
        initial, fault = code & 3, code >> 2
        new: dict = {}
        for state, (cost, audit, edits) in front.items():
            ways = [(state, 3, "D", "D")]
            if fault in (0, 3):
                extra = int(fault == 3)
                if initial < 3 and (to := step(state, _ROLES[initial])) is not None:
                    ways.append((to, extra, "K", "K"))
                ways += [(to, 2 + extra, "R", r.upper()) for r in "ua" if (to := step(state, r)) is not None]
            for to, more, letter, edit in ways:
                entry = cost + more, audit + letter, edits + edit
                new[to] = min(new.get(to, entry), entry)
        front = inserted(new)
    return min(front[s] for s in ("", "a") if s in front)


@pytest.mark.parametrize("block", [1, 3, 1 << 14])
def test_cheapest_and_least_of_all_edits(block, monkeypatch):
    monkeypatch.setattr(repair, "_BLOCK", block)
    rng = random.Random(block)
    for n in [*range(0, 9)] * 60 + [60, 300]:
        codes = np.array([rng.choice([0, 1, 1, 2, 2, 3]) + 4 * rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)], np.uint8)
        edits, cost = repair.solve(codes)
        assert (cost, repair.audit_of(edits), "".join(edits)) == best(codes.tolist()), codes
        assert len(edits) == n


def test_audits_that_share_long_beginnings():
    for codes in ([1] * 9, [2] * 9, [3] * 40, [0, 0, 0, 1], [1, 1, 2, 2] * 20, [2, 1] * 33, [13] * 12, [0], [1], [2], [5, 9]):
        edits, cost = repair.solve(np.array(codes, np.uint8))
        assert (cost, repair.audit_of(edits)) == best(codes)[:2]


def by_loops(table):
    space = lambda v: " " if v is None else str(v)
    per: dict = {}
    for conv, turn, role, text in (r[:4] for r in table):
        rows = per.setdefault(conv, [])
        kind, role, text = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
        if kind:
            row = turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [row] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in per.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, codes, faults = set(), [], []
        for _, role, text in rows:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0
            seen.add((role, text))
            faults.append(fault)
            codes.append(({"s": 0, "u": 1, "a": 2}.get(role[:1], 3)) + 4 * fault)
        cost, audit, edits = best(codes)
        lines, left = [], list(rows)
        for ch in edits:
            if ch in "ua":
                lines.append({"u": "user:", "a": "assistant:"}[ch])
            else:
                _, role, text = left.pop(0)
                if ch != "D":
                    lines.append({"K": role, "U": "user", "A": "assistant"}[ch] + ":" + text)
        turns = [r[0] for r in rows if r[0] is not None]
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(i) for i in (1, 2, 3)), pairs, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table():
    rng = random.Random(4)
    out = []
    for conv in [*range(40), None]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice([prose(turn, 6) + ".", prose(conv or 0, 5), "Yes!", "", None, " \n", "end. \n\t", "é\xa0", "…", "a.b", "?"])
            out.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"]), text))
    for turn in range(700):  # one long conversation, much of it the same
        out.append((77, turn, ["user", "assistant"][turn % 2], "Same." if turn % 3 else prose(turn, 4) + "."))
    out += [out[0], out[5], (78, 5, "user", "x " * 50_000 + "."), (79, 2**40, "user", "a."), (79, -5, "assistant", "b.")]
    return [(*r, *["clash"] * 7) for r in out]


def result(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mended, summary = repair.repair(repair.damaged(frame), frame)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return mended, {r.conv_id: tuple(r[n] for n in names) for r in summary.collect()}


def test_tables_by_loops(spark):
    rows = table()
    mended, got = result(spark, rows)
    assert got == by_loops(rows)
    shapes: dict = {}
    for r in mended.orderBy("conv_id", "place", "part").collect():
        shapes[r.conv_id] = shapes.get(r.conv_id, "") + r.role[:1]
    assert all(re.fullmatch("(s?(ua)+)?", s) for s in shapes.values())


def test_empty_table(spark):
    assert result(spark, [])[1] == {}


def test_conversation_that_loses_all_messages(spark):
    rows = [(c, 0, "user", "Hi.", *["x"] * 7) for c in range(200)]
    lost = {c for c, *_ in rows if zlib.crc32(f"{c}:0".encode()) % 20 == 0}
    got = result(spark, rows)[1]
    assert len(got) == 200 and lost and all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in lost)
