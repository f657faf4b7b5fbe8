"""Packing: ids against the tokenizer itself, a legal plan under every constraint, few sequences."""

import random
import struct
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from tagloom.llm import packing
from tests.llm.data import TEXTS, VOCABULARY, empty, odd, rows


def unpacked(plan):
    """sequence -> [(offset, length)] of a plan, and the ranks it places per length."""
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, rank, count, first, offset in plan.tolist():
        for i in range(count):
            bins[first + i].append((offset, length))
            ranks[length].append(rank + i)
    return bins, ranks


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [packing.Capacity(100), packing.Capacity(100, 3), packing.Capacity(100, None, 10100), packing.Capacity(100, 4, 11000)])
def test_plan_keeps_every_constraint(rule, capacity):
    rng = random.Random(5)
    for _ in range(30):
        counts = {rng.randint(1, 100): rng.randint(0, 40) for _ in range(rng.randint(1, 25))}
        bins, ranks = unpacked(packing.best_fit_plan(counts, capacity, rule=rule))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items() if n}
        tokens, documents, attention = capacity.vector()
        for pieces in bins.values():
            pieces.sort()
            assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
            assert sum(n for _, n in pieces) <= tokens and len(pieces) <= documents and sum(n * n for _, n in pieces) <= attention


def test_plan_equals_best_fit_piece_by_piece():
    """With tokens only, the classes give as many sequences as placing the pieces one by one."""
    rng = random.Random(9)
    for _ in range(40):
        counts = {rng.randint(1, 60): rng.randint(1, 9) for _ in range(12)}
        left = []
        for n in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
            fits = [i for i, r in enumerate(left) if r >= n]
            if fits:
                left[min(fits, key=lambda i: left[i])] -= n
            else:
                left.append(60 - n)
        bins, _ = unpacked(packing.best_fit_plan(counts, packing.Capacity(60), weights=(1, 0, 0)))
        assert len(bins) == len(left)


def test_plan_of_many_pieces_is_short_and_tight():
    counts = {n: 10 ** 9 // n for n in range(1, 2049)}
    plan = packing.best_fit_plan(counts, packing.Capacity(2048))
    least = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert len(plan) < 200_000 and (plan[:, 3] + plan[:, 2]).max() <= least * 1.001


def test_piece_that_fits_nowhere():
    with pytest.raises(ValueError):
        packing.best_fit_plan({10: 1}, packing.Capacity(100, 3, 99))


def test_pack_odd_rows(spark):
    tokenizer = Tokenizer.from_file(VOCABULARY.tokenizer)
    got = packing.pack(odd(spark), VOCABULARY, packing.Capacity(64), with_ids=True).collect()
    want = []
    for doc_id, text, *_ in rows():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first if len(ids) > 64 else len(ids), len(ids) + 1, 64)]
        cuts = cuts if cuts[-1] == len(ids) else cuts + [len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc_id, piece, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])), tuple(ids[a:b])))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 3


def test_pack_nothing(spark):
    assert packing.pack(empty(spark), VOCABULARY).count() == 0


def test_ranks_do_not_need_one_task(spark):
    pieces = spark.range(1000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "7L AS length", "id AS ids_crc32")
    for chunks in (1, 3, 500):
        assert sorted(r._rank for r in packing.ranked(pieces, chunks).collect()) == list(range(1000))


def test_empty_texts_are_one_token():
    assert TEXTS[2] is None and TEXTS[3] == ""
