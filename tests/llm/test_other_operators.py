"""I-Match, language, weak labels, shards, mixing, line chunks and URL filter on small and odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import imatch, language_id, line_chunks, mixing, shards, url_bloom, weak_labels
from tests.llm.data import empty, odd, prose, rows

ORDER = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0)


# --- fingerprints

def test_imatch_odd_rows(spark):
    got = imatch.compare_edited(odd(spark)).collect()
    assert len(got) == len(rows())
    prints = defaultdict(set)
    for doc_id, text, *_ in rows():
        mine = [r for r in got if r.doc_id == doc_id and r.n_chars == len(text or "")]
        assert mine
        prints[text or ""] |= {r.fingerprint for r in mine}
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in mine)
    assert all(len(p) == 1 for p in prints.values())
    once = sorted([r for r in rows() if r[0] not in (0, 3, None)] , key=ORDER)
    by_id = {r.doc_id: r for r in got}
    for (a, text, *_), (b, after, *_) in zip(once, once[1:]):
        if b == a + 1:
            text, after = text or "", after or ""
            cut = len(text) // 4
            assert by_id[a].edited_sha256 == hashlib.sha256((text[:len(text) - cut] + after[:cut]).encode()).hexdigest()
    assert imatch.compare_edited(empty(spark)).count() == 0


def test_imatch_successors_over_many_ranges(spark):
    texts = {i * 3: f"{i} " + prose(i, i % 40) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.edited_sha256 for r in imatch.compare_edited(docs).collect()}
    ids = sorted(texts)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        cut = len(texts[a]) // 4
        assert got[a] == hashlib.sha256((texts[a][:len(texts[a]) - cut] + texts[b][:cut]).encode()).hexdigest()


def test_imatch_one_document_follows_itself(spark):
    got = imatch.compare_edited(spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0].edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and got[0].near_next == 1.0


def test_imatch_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, f"all {'half' if i % 2 else ''} only{i}") for i in range(100)], "doc_id long, text string")
    assert {r.term for r in imatch.lexicon(docs, imatch.Lexicon(0.02, 0.6)).collect()} == {"half"}


def test_imatch_tells_edits_from_others(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + j * j) % 701}" for j in range(200))) for i in range(120)], "doc_id long, text string")
    got = imatch.compare_edited(docs).collect()
    assert np.mean([r.near_edited for r in got]) > 3 * np.mean([r.near_next for r in got])


# --- shards

def test_shards_odd_rows(spark):
    got = sorted(shards.balanced(odd(spark), 4).collect(), key=lambda r: (r.shard, r.slot))
    assert len(got) == len(rows())
    want = sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows() if r[0] is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == want
    for s in range(4):
        assert [r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in got)))
    line = [r.doc_id for r in got]
    assert line[0] is None and line[1:] == sorted(line[1:])
    assert shards.balanced(empty(spark)).count() == 0


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_shards_are_balanced_whatever_the_partitions(spark, parts):
    rng = random.Random(4)
    sizes = [int(rng.paretovariate(1.2) * 20) % 3000 for _ in range(900)]
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(parts)
    got = {r.shard: r for r in shards.balanced(docs, 16).groupBy("shard").agg(F.sum("size").alias("b"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).collect()}
    share = (sum(sizes) + len(sizes)) / 16
    assert len(got) == 16 and all(abs(r.b - share) <= 3001 for r in got.values())
    assert all(got[i].z < got[i + 1].a for i in range(15))


def test_one_row_larger_than_a_share(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "b" * 1000), (2, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.slot) for r in shards.balanced(docs, 4).collect())[0] == (0, 0)


# --- mixing

def filled(sizes, weights, budget, epochs):
    """Clamp, share out what is left by weight, again and again."""
    target, live = dict.fromkeys(sizes, 0.0), {s for s in sizes if weights[s] > 0}
    left = budget
    while live:
        total = sum(weights[s] for s in live)
        over = {s for s in live if left * weights[s] / total > epochs * sizes[s]}
        if not over:
            for s in live:
                target[s] = left * weights[s] / total
            break
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= epochs * sizes[s]
        live -= over
    return target


def test_targets_against_rounds_of_clamping(spark):
    rng = random.Random(8)
    for _ in range(12):
        sizes = {f"s{i:02}": rng.choice([0, 1, 10, 500, rng.randint(1, 9000)]) for i in range(rng.randint(1, 12))}
        weights = {s: rng.choice([0, 1, 1, 2, 3, 50]) for s in sizes}
        frame = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, size long, weight long")
        got = {r.source: r.target for r in mixing.targets(frame, 150, 2).collect()}
        want = filled(sizes, weights, 1.5 * sum(sizes.values()), 2)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes), (sizes, weights, got, want)


def test_mix_odd_rows(spark):
    got = mixing.mix(odd(spark)).collect()
    assert len(got) == len(rows())
    by = defaultdict(list)
    for r in got:
        assert r.taken == r.repeats * r.size <= 2 * r.size
        by[r.source].append(r)
    for mine in by.values():
        assert sum(r.size for r in mine) == mine[0].source_size and mine[0].target <= 2 * mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 + 1
    assert sorted(map(tuple, mixing.mix(odd(spark).repartition(3)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_reaches_targets(spark):
    docs = spark.createDataFrame([(i, prose(i, i % 50), f"s{i % 7 if i % 3 else 0}") for i in range(3000)], "doc_id long, text string, source string")
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect():
        assert abs(r.t - r.w) <= 50


def test_repeated_documents(spark):
    docs = odd(spark)
    taken = {r.doc_id: r.n for r in mixing.mix(docs).groupBy("doc_id").agg(F.max("repeats").alias("n")).collect()}
    got = mixing.repeated_documents(docs)
    assert got.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    own = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert counts == {i: n * own[i] for i, n in taken.items() if n}
    assert mixing.repeated_documents(empty(spark)).count() == 0


# --- line chunks

def without_repeats(docs, cuts):
    seen, out = {}, {}
    for doc_id, text in docs:
        lines, kept = text.encode().split(b"\n"), []
        for a, b, full in line_chunks.chunks(text.encode(), cuts):
            body = b"\n".join(lines[a:b])
            if full >= cuts.min_lines and seen.setdefault(body, (doc_id, a)) != (doc_id, a):
                continue
            kept += lines[a:b]
        out[doc_id] = b"\n".join(kept).decode()
    return out


def test_line_chunks_against_loops(spark):
    rng = random.Random(2)
    pool = [prose(i, 8) for i in range(40)]
    passages = ["\n".join(rng.sample(pool, 6)) for _ in range(4)]
    docs = []
    for i in range(150):
        parts = [rng.choice(pool) if rng.random() < 0.5 else prose(1000 + i * 10 + j, 9) for j in range(rng.randint(0, 6))]
        docs.append((i, "\n".join([*parts, rng.choice(passages), *parts[:2], ""] if i % 2 else parts)))
    got = {r.doc_id: r.text for r in line_chunks.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == without_repeats(docs, line_chunks.Cuts())
    assert sum(map(len, got.values())) < sum(len(t) for _, t in docs)


def test_cuts_resist_shifts():
    cuts = line_chunks.Cuts()
    passage = [prose(i, 6) for i in range(60)]
    alone = {tuple(passage[a:b]) for a, b, _ in line_chunks.chunks("\n".join(passage).encode(), cuts)}
    for shift in range(1, 6):
        lines = [f"new {i}" for i in range(shift)] + passage
        moved = {tuple(lines[a:b]) for a, b, _ in line_chunks.chunks("\n".join(lines).encode(), cuts)}
        assert len(alone & moved) >= 0.7 * len(alone)


def test_line_chunks_odd_rows(spark):
    got = line_chunks.dedup_lines(odd(spark))
    assert got.columns == [*odd(spark).columns, "__m"]
    seen = got.select("doc_id", "text", "__m.*").collect()
    assert len(seen) == len(rows())
    texts = defaultdict(set)
    for r in seen:
        texts[r.doc_id].add(r.text)
    assert texts[2] == {None} and texts[3] == {"", prose(11, 40)} and len(texts[0]) == 1
    assert prose(2, 25) not in (texts[7].pop() or "") or all(r.removed_chunks == 0 for r in seen if r.doc_id == 7)
    assert line_chunks.dedup_lines(empty(spark)).count() == 0


def test_same_hash_other_bytes_stays(spark, monkeypatch):
    import xxhash
    real = xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda data, *a: 7 if b"\n" in data else real(data, *a))
    assert {h for _, h, _, _ in line_chunks._cut(b"a\nb\nc\nd", line_chunks.Cuts(2, 1))} == {7}
    monkeypatch.undo()


# --- URL filter

def test_hosts_paths_and_canonical_urls(spark):
    cases = {
        "https://www.Example.COM:443/A/b/?utm_source=x&b=2&a=1#f": ("www.example.com:443", "/A/b/", "example.com/A/b?a=1&b=2"),
        "http://m.x.org/index.html": ("m.x.org", "/index.html", "x.org"), "no scheme/at/all": ("", "", ""), "": ("", "", ""),
        "ftp://h?q://z": ("h", "", "h?q://z"), "a://b://c/d": ("b:", "//c/d", "b:/" + "/c/d"), None: ("", "", None),
    }
    frame = spark.createDataFrame([(u,) for u in cases], "url string")
    for r in frame.select("url", url_bloom.host_of(F.col("url")).alias("h"), url_bloom.path_of(F.col("url")).alias("p"), url_bloom.canonical(F.col("url")).alias("c")).collect():
        assert (r.h, r.p, r.c) == cases[r.url], r


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_bloom_has_no_misses_and_no_false_positives(spark, limit, monkeypatch):
    monkeypatch.setattr(url_bloom, "BROADCAST_BYTES", limit)
    keys = spark.range(5000).select(F.concat(F.lit("h/"), F.col("id")).alias("url"))
    pages = spark.range(20000).select(F.concat(F.lit("h/"), F.when(F.col("id") % 50 != 0, F.col("id") * 3)).alias("url"), F.lit(1).alias("_block"))
    got = url_bloom.listed(pages, "url", keys, bits_per_key=4)
    assert got.columns == ["url", "_block", "_listed"] and got.count() == 20000
    assert got.filter(F.col("_listed") != F.coalesce(F.substring("url", 3, 20).cast("long") < 5000, F.lit(False))).count() == 0
    assert url_bloom.listed(pages, "url", keys.limit(0)).filter("_listed").count() == 0


def test_longest_rule_wins(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    cases = {
        "http://a.example.net/en/1": ("example.net/en/", "allow"), "http://a.example.net/fr/1": ("net/", "block"), "http://net/": ("net/", "block"),
        "http://notexample.com/de/": (None, "allow"), "http://x.example.com/de/1": ("example.com/de/", "block"), "http://x.net": (None, "allow"),
        "http://listed.com/a?utm_x=1": (None, "block"), None: (None, "allow"), "x": (None, "allow"), "http://q.org/fr/": ("org/fr/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)] * 2, "page_id long, url string, rule string")
    listing = spark.createDataFrame([("listed.com/a",), ("listed.com/a",), (None,)], "url string")
    got = url_bloom.judge(pages, rules, listing).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r.rule, r.verdict) == list(cases.values())[r.page_id]
    assert url_bloom.judge(pages.limit(0), rules, listing).count() == 0


# --- language

def records(spark, extra=()):
    none = None
    data = [(i, prose(i, 30) if i % 2 else "el la los una que " * 8 + f"ñ{i}", "en" if i % 2 else "es", "en" if i % 2 else "es", f"h{i % 2}", "d") for i in range(60)]
    data += [(100, "", "es", none, none, none), (101, none, none, none, none, none), (102, "que la los", none, none, "h0", "d"),
             (103, none, none, "es", "h0", "d"), (104, "one two three", "zz", "zz", "new", "d"), *extra]
    return spark.createDataFrame(data, "key long, text string, declared string, suffix string, host string, domain string")


def test_evidence_is_fused(spark):
    frame = records(spark)
    labelled = frame.filter("key < 60").select("text", F.col("declared").alias("lang"))
    got = {r.key: r for r in language_id.identify(frame, labelled).collect()}
    assert len(got) == 65 and all(got[i].lang == ("en" if i % 2 else "es") for i in range(60))
    assert got[100].lang == "es" and got[100].text_lang is None and got[103].lang == "es" and got[102].lang == "es" and got[104].lang == "en"
    assert (got[101].lang, got[101].posterior) == ("und", 0.0)
    assert all(0 <= r.posterior <= 1 for r in got.values())


def test_no_labels_or_records(spark):
    frame = records(spark)
    none = spark.createDataFrame([], "text string, lang string")
    assert {r.lang for r in language_id.identify(frame, none).collect()} == {"und"}
    assert language_id.identify(frame.limit(0), frame.select("text", F.col("declared").alias("lang"))).count() == 0


def test_page_evidence(spark):
    html = "<HTML class=x lang='fr-CA'><script>var a='<p>';</script><p>bon<!-- no --> jour</p>"
    pages = spark.createDataFrame([(1, "https://u@a.b.co.fr:80/de/x", html), (2, "http://x.com/es/1", None), (3, None, "plain")], "page_id long, url string, html string")
    got = {r.page_id: r for r in language_id.page_records(pages).collect()}
    assert got[1].text.split() == ["bon", "jour"] and (got[1].declared, got[1].suffix, got[1].host, got[1].domain) == ("fr", "fr", "a.b.co.fr", "co.fr")
    assert (got[2].declared, got[2].suffix, got[2].text) == (None, "es", None) and (got[3].host, got[3].suffix) == (None, None)


# --- weak labels

def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    right = np.array([0.95, 0.85, 0.75, 0.65])
    votes = np.where(rng.random((20000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = weak_labels.NONE
    counts = defaultdict(int)
    for v in votes:
        counts["".join(map(str, v))] += 1
    model = weak_labels.fit_labels(counts)
    assert abs(model.prior - 0.7) < 0.02 and np.abs(model.accuracy() - right).max() < 0.03
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93


def test_weak_labels_odd_rows(spark):
    got = weak_labels.classify(odd(spark)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows()), key=str)
    assert all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in got)
    assert weak_labels.classify(empty(spark)).count() == 0


def test_scorer_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    got = weak_labels.classify(docs).join(labels, "doc_id").collect()
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([r.kept for r in got if r.quality]) > 0.98 and np.mean([r.kept for r in got if not r.quality]) < 0.3
