"""Evidence fusion: small languages, clashing columns, odd tables, and the posterior by loops."""

import math

import numpy as np
import pytest

from tagloom.llm import language_id
from tagloom.llm.common import trigram_buckets

FIELDS = ["text", "declared", "suffix", "host", "domain"]
ENGLISH = "the weather of the north was cold and the people of the town went home with the children when the evening came"
CROATIAN = "vrijeme je bilo hladno i ljudi su otišli kući kada je došla večer jer su djeca željela spavati što prije"


def texts():
    en = [" ".join(ENGLISH.split()[i % 9:] + ENGLISH.split()[:i % 7]) for i in range(400)]
    hr = [" ".join(CROATIAN.split()[i:] + CROATIAN.split()[:i]) for i in range(3)]
    return [(t, "en") for t in en] + [(t, "hr") for t in hr]


def test_a_language_of_three_texts_is_returned(spark):
    rows = [(i, t, lang, lang, f"{lang}.example", "example") for i, (t, lang) in enumerate(texts())]
    records = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string, domain string")
    got = {r.doc_id: r.lang for r in language_id.identify(records, spark.createDataFrame(texts(), "text string, lang string")).collect()}
    assert {i for i, lang in got.items() if lang == "hr"} == {400, 401, 402}
    alone = records.selectExpr("doc_id", "text", *[f"CAST(NULL AS STRING) AS {c}" for c in FIELDS[1:]])
    got = {r.doc_id: r.lang for r in language_id.identify(alone, spark.createDataFrame(texts(), "text string, lang string")).collect()}
    assert {i for i, lang in got.items() if lang == "hr"} == {400, 401, 402}


def by_loops(rows, labelled, fusion=language_id.Fusion()):
    """Posterior of every record in plain Python; rows are (text, declared, suffix, host, domain)."""
    size = 1 << fusion.bits
    counts: dict = {}
    for text, lang in labelled:
        if text is not None and lang is not None:
            counts.setdefault(lang, np.zeros(size))
            for b in trigram_buckets(text, fusion.bits):
                counts[lang][b] += 1
    langs = sorted(x for x in counts if counts[x].sum())
    every = sum(counts[x] for x in langs) + fusion.smoothing
    model = {x: (1 - fusion.common) * counts[x] / counts[x].sum() + fusion.common * every / every.sum() for x in langs}
    lls, best = [], []
    for text, *_ in rows:
        buckets = trigram_buckets(text, fusion.bits) if text and not text.isspace() else []
        ll = [fusion.text_weight * sum(math.log(model[x][b]) for b in buckets) for x in langs]
        lls.append([v - max(ll) for v in ll])
        best.append(int(np.argmax(ll)) if len(buckets) else None)
    s, n = fusion.smoothing, len(langs)
    votes = [best.count(i) for i in range(n)]
    prior = [(v + s) / (sum(votes) + s * n) for v in votes]

    def tally(at):
        out: dict = {}
        for r, b in zip(rows, best):
            if r[at] is not None:
                out.setdefault(r[at], [0] * n)
                if b is not None:
                    out[r[at]][b] += 1
        return out

    trust = {}
    for at in (1, 2):
        seen = {v: c for v, c in tally(at).items() if sum(c)}
        totals = [sum(c[i] for c in seen.values()) for i in range(n)]
        trust[at] = {v: [math.log((c[i] + s) / (totals[i] + s * (len(seen) + 1))) for i in range(n)] for v, c in seen.items()}
    hosts, domains = tally(3), tally(4)
    out = []
    for r, b, ll in zip(rows, best, lls):
        mine = [int(i == b) for i in range(n)]
        d = [c - m for c, m in zip(domains[r[4]], mine)] if r[4] is not None else [0] * n
        h = [c - m for c, m in zip(hosts[r[3]], mine)] if r[3] is not None else [0] * n
        logs = []
        for i in range(n):
            p = (d[i] + fusion.strength * prior[i]) / (sum(d) + fusion.strength)
            p = (h[i] + fusion.strength * p) / (sum(h) + fusion.strength)
            logs.append(ll[i] + math.log(p) + trust[1].get(r[1], [0] * n)[i] + trust[2].get(r[2], [0] * n)[i])
        if b is None and r[1] is None and r[2] is None and r[3] is None:
            out.append(("und", 0.0))
        else:
            top = max(logs)
            out.append((langs[logs.index(top)], 1 / sum(math.exp(v - top) for v in logs)))
    return out


def odd_rows():
    rows = [(t, [lang, None, "en"][i % 3], ["hr", None][i % 2], [f"h{i % 4}", None][i % 5 == 0], "d") for i, (t, lang) in enumerate(texts()[380:])]
    return rows + [(None, None, None, None, None), ("", "hr", None, None, None), ("  \n", None, None, None, "d"), ("a", None, None, "h1", None),
                   ("x" * 100_000, None, "xx", None, None), rows[0], rows[0], (None, "zz", "zz", "zz", "zz")]


def test_posterior_by_loops_with_clashing_columns(spark):
    extra = ["best", "ll", "_logs", "_top", "_domain", "_host_votes", "declared_ll", "__key0", "lang"]
    rows = odd_rows()
    labelled = texts()[370:] + [(None, "en"), ("abc", None), ("zdravo svijete", "")]
    schema = "doc_id long, " + ", ".join(f"{c} string" for c in [*extra, *FIELDS])
    frame = spark.createDataFrame([(i, *["clash"] * len(extra), *r) for i, r in enumerate(rows)], schema).repartition(3)
    out = language_id.identify(frame, spark.createDataFrame(labelled, "text string, lang string"))
    assert out.columns == ["doc_id", *extra[:-1], "declared", "suffix", "host", "text_lang", "lang", "posterior"]
    got = {r.doc_id: r for r in out.collect()}
    for i, (lang, posterior) in enumerate(by_loops(rows, labelled)):
        assert got[i].posterior == pytest.approx(posterior, abs=1e-3)
        assert got[i].lang == lang or posterior < 0.51


def test_empty_and_unlabelled(spark):
    schema = "best long, " + ", ".join(f"{c} string" for c in FIELDS)
    labels = spark.createDataFrame(texts()[398:], "text string, lang string")
    assert language_id.identify(spark.createDataFrame([], schema), labels).count() == 0
    none = language_id.identify(spark.createDataFrame([(1, ENGLISH, None, None, None, None)], schema), labels.limit(0)).collect()
    assert [(r.lang, r.posterior) for r in none] == [("und", 0.0)]
