"""Filter audit: every order tried on every document, by loops."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import types as T

from tagloom.llm import filter_audit
from tests.llm.data import SCHEMA, TEXTS, empty, odd, prose, rows

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()),
                       T.StructField("mask", T.StringType())])
EXTRA = ["CAPITALS AND # " * 10, prose(20, 150), prose(20, 150), "UPPER CASE ONLY " * 40, prose(21, 99), " ".join(f"w{i}" for i in range(120)),
         " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i}$" for i in range(120)), "A" * 11 + "b" * 89, "A" * 10 + "b" * 90]


def labels():
    return [(i, i % 2, int(i % 3 == 0), "clash") for i in range(12)] + [(2, 1, None, "x"), (None, 1, 1, None), (5, None, None, None), (2, 1, 1, "x")]


def by_loops(docs, marks):
    seen, out = {}, Counter()
    for r in docs:
        if r[0] is not None:
            seen[r[1] or ""] = min(seen.get(r[1] or "", r[0]), r[0])
    good = {i for i, q, _, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in marks if t == 1 and i is not None}
    keys = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    for r in docs:
        text, part = r[1] or "", r[2] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = "".join(x for x, failed in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            bool(re.search("[#$%&*|]", text)), r[0] is not None and r[0] > seen[text])) if failed)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, x in enumerate(order, 1):
                at = part, order, step
                here = x in bad and not gone
                for key, value in zip(keys, (not gone and not here, here, x in bad and gone, bad == x, here and r[0] in good, here and r[0] in toxic)):
                    out[at, key] += value
                out[part, x] += here
                gone = gone or here
    parts = {r[2] or "" for r in docs}
    return {(p, o, s): (*(out[(p, o, s), k] for k in keys), out[p, o[s - 1]]) for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6)}


def test_orders_by_loops_on_odd_tables(spark):
    table = rows(TEXTS + EXTRA)
    got = filter_audit.audit_documents(odd(spark, TEXTS + EXTRA), spark.createDataFrame(labels(), LABELS)).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == by_loops(table, labels())


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_documents(empty(spark), none).count() == 0
    assert filter_audit.audit_documents(odd(spark), none).filter("good_lost + toxic_lost > 0").count() == 0


def test_ranks_are_lexicographic():
    for size in (1, 3, 5):
        for rank, order in enumerate(permutations(range(size))):
            assert filter_audit.lehmer_rank(order, size) == rank
            for step in range(1, size):
                first = filter_audit.lehmer_rank(order[:step], size)
                assert first <= rank < first + len(list(permutations(range(size - step))))


def test_one_text_in_a_third_of_the_rows(spark):
    docs = spark.createDataFrame([(i, "copy" if i % 3 == 0 else prose(i, 20), "en", "s", 0, *["x"] * (len(SCHEMA) - 5)) for i in range(600)], SCHEMA)
    got = filter_audit.audit_documents(docs, spark.createDataFrame([(3, 1, 0, ""), (0, 1, 1, "")], LABELS)).filter("filter_order = 'EABCD' AND step = 1").collect()
    assert [(r.removed, r.good_lost, r.toxic_lost) for r in got] == [(199, 1, 0)]
