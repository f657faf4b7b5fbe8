"""Jaccard join: components against all pairs, signatures against every way to lose tokens."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from tagloom.llm import jaccard_join
from tagloom.llm.jaccard_join import Join
from tests.llm.data import TEXTS, empty, odd, prose, rows


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def brute(table):
    """(doc_id, size, component) of every row by comparing all pairs of sets."""
    sets = [shingles(r[1]) for r in table]
    parent = {s: s for s in sets if s}

    def find(x):
        while parent[x] is not x:
            x = parent[x]
        return x

    for a, b in combinations(list(parent), 2):
        both = len(a & b)
        if 100 * both >= 80 * (len(a) + len(b) - both):
            parent[find(a)] = find(b)
    first = {}
    for r, s in zip(table, sets):
        if s and r[0] is not None:
            first[find(s)] = min(first.get(find(s), r[0]), r[0])
    return sorted(((r[0], len(s), first.get(find(s)) if s else r[0]) for r, s in zip(table, sets)), key=str)


def result(frame, join=Join()):
    return sorted(map(tuple, jaccard_join.groups(frame, join).collect()), key=str)


def changed(rng, text, share):
    words = text.split()
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = f"new{rng.randrange(10 ** 9)}"
    return " ".join(words)


def corpus(seed=5):
    """Near copies of many degrees, templates just below the threshold, mixtures of common passages, hot groups."""
    rng = random.Random(seed)
    texts = [prose(i, 30 + i % 90) for i in range(60)]
    for i in range(120):
        texts.append(changed(rng, texts[i % 60], rng.choice([0, .005, .01, .02, .03, .04])))
    template = prose(700, 80)
    texts += [template + " " + " ".join(f"own{i}x{j}" for j in range(rng.randint(5, 18))) for i in range(60)]
    texts += [changed(rng, template, .006) for _ in range(80)]
    passages = [prose(800 + i, 25) for i in range(6)]
    texts += [" ".join(rng.sample(passages, rng.randint(3, 6))) for _ in range(80)]
    texts += [" ".join(prose(900, 40).split()[:n]) for n in range(1, 40)]
    texts += [t.upper() for t in texts[:5]] + [None, "", " \n "]
    return list(enumerate(texts))


@pytest.mark.parametrize("join", [Join(), Join(classes=((2, 1), (6, 2), (None, 3)), pack=500, stars=1)], ids=str)
def test_components_by_all_pairs(spark, join):
    table = corpus()
    assert result(spark.createDataFrame(table, "doc_id long, text string").repartition(5), join) == brute(table)


def test_odd_rows(spark):
    assert result(odd(spark)) == brute(rows())
    assert result(odd(spark, TEXTS + [prose(7, 100), "x y", "X y", "word"])) == brute(rows(TEXTS + [prose(7, 100), "x y", "X y", "word"]))
    assert result(empty(spark)) == []


def every_signature(tokens, frequency, join, groups, level):
    """All signatures any prefix of these tokens could have, class by class and group by group."""
    out, low = set(), 0
    for kind, (high, k) in enumerate(join.classes):
        mine = [int(t) for t, f in zip(tokens, frequency) if f > low and (high is None or f <= high)]
        low = high
        if k == 1:
            out |= set(mine)
        else:
            into = {t: (t * int(jaccard_join._MIX) % 2 ** 64 >> 20) % groups for t in mine}
            for c in combinations(sorted(mine), k):
                if len({into[t] for t in c}) == 1:
                    out |= set(jaccard_join._combined(np.array([c], np.uint64).T, level * len(join.classes) + kind + 1).tolist())
    return out


def test_a_prefix_keeps_a_signature_whatever_is_missing():
    rng = random.Random(3)
    join = Join(classes=((2, 1), (5, 2), (None, 3)))
    for n in range(4, 15):
        for _ in range(8):
            tokens = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
            frequency = np.array([rng.choice([2, 2, 3, 4, 9, 9]) for _ in tokens])
            for smaller in (True, False):
                spare = join.missing(n, smaller)
                own = set(jaccard_join.signatures(n, 0, tokens, frequency, spare, 3, join, max(1, n // 6)))
                for gone in combinations(range(n), spare):
                    left = np.delete(np.arange(n), gone)
                    assert own & every_signature(tokens[left], frequency[left], join, max(1, n // 6), 3)


def test_packing_of_sorted_tokens():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64))
    assert (jaccard_join._unpacked(jaccard_join._packed(values)) == values).all()


def test_a_group_of_copies_costs_one_pair_per_copy(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(i, changed(rng, prose(1, 120), .004) if i % 3 else prose(i, 60)) for i in range(900)]
    made = []
    monkeypatch.setattr(jaccard_join, "stored", lambda df, what, keep=jaccard_join.stored: (made.append((what, d := keep(df, what))), d)[1])
    assert result(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)
    assert sum(d.count() for what, d in made if what == "join-pairs") <= 20 * 600


def test_sets_are_read_where_they_lie():
    import numpy as np
    import pyarrow as pa

    sets = [np.array([3, 5, 1 << 63], np.uint64), np.zeros(0, np.uint64), np.array([7], np.uint64)]
    column = pa.array([s.tobytes() for s in sets], pa.binary())
    for part, want in ((column, sets), (column.slice(1), sets[1:])):
        got = list(jaccard_join._views(part))
        assert [g.tolist() for g in got] == [w.tolist() for w in want]
        assert all(g.base is not None for g in got if len(g))
