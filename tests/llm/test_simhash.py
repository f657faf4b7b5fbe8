"""SimHash: fingerprints by loops, covering masks, components against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import simhash
from tests.llm.data import TEXTS, empty, odd, prose, rows


def by_loops(text):
    import re
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_loops():
    for text in TEXTS + ["ÀB Cd", "A b", "one"]:
        assert simhash.simhash((text or "").encode()) == by_loops(text)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_every_close_pair_shares_a_table(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not mask & bits for mask in masks)
        taken = masks[rng.randrange(len(masks))]
        if not bits & taken:
            assert any(not mask & bits for mask in simhash.covering_masks(radius, taken))
    assert all(28 <= mask.bit_count() <= 36 for mask in simhash.covering_masks(3))


def brute(fps, radius=3):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= radius:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("bucket", [2, 40, 1 << 16])
def test_links_connect_what_all_pairs_connect(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "FREE_BITS", 4 if bucket < 1000 else 16)
    rng = random.Random(bucket)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:40]:
        for _ in range(8):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 4))) for _ in range(300)}
    signed = {simhash._signed(f): f for f in fps}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    pairs = [(signed[r.a], signed[r.b]) for r in simhash.links(frame, 3, bucket).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in pairs)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {f: find(f) for f in fps} == brute(fps)
    assert len(pairs) <= 15 * len(fps)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 2001), (2001, 2002), (2000, 2002)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 50)} | {2001: 2000, 2002: 2000}
    assert got == want


def test_odd_rows(spark):
    got = simhash.groups(odd(spark)).collect()
    own = [(r[0], by_loops(r[1])) for r in rows()]
    root = brute([f for _, f in own])
    first = {}
    for doc_id, f in own:
        if doc_id is not None:
            first[root[f]] = min(first.get(root[f], doc_id), doc_id)
    want = [(i, format(f, "016x"), first.get(root[f])) for i, f in own]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.groups(empty(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    kept = simhash.one_per_group(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 1 and len(ids) == len(set(ids)) and 0 in ids and 1 not in ids
    assert simhash.one_per_group(empty(spark)).count() == 0


def test_copies_are_one_row_in_the_search(spark):
    docs = spark.createDataFrame([(i, prose(1, 50) if i % 3 else prose(i, 50)) for i in range(300)], "doc_id long, text string")
    got = simhash.groups(docs)
    assert got.filter("component_id = 1").count() >= 200
    assert simhash.fingerprints(docs).groupBy("fp").agg(F.count("*")).count() <= 101


def test_forest_is_small():
    fps = np.arange(200, dtype=np.uint64)
    a, b = simhash.spanning_links(fps, 3)
    assert len(a) == 199
