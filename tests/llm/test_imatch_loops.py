"""I-Match by loops: lexicon, subsets, both fingerprints and both likenesses of every row."""

import random

import xxhash

from tagloom.llm import imatch
from tests.llm.data import prose


def words_of(text):
    return {w for w in (w.strip(imatch._STRIP) for w in text.lower().split()) if w}


def fingerprint(text, chosen, few=4):
    own = words_of(text) & chosen
    own = own if len(own) >= few else words_of(text)
    out = []
    for scale in range(6):
        parts = 4 ** (scale + 1)
        taken = 12 if parts == 16 else min(parts, 24)
        for place in range(24):
            group, part = divmod(place, taken)
            held = sorted(t for t in own if xxhash.xxh64_intdigest(t.encode(), 1000 * scale + group) % parts == part)
            out.append(xxhash.xxh64_hexdigest(" ".join(held).encode())[:3] if held else "---")
    return out


def likeness(a, b):
    if a == b:
        return 1.0
    same = used = 0
    for scale in range(6):
        x, y = a[24 * scale:24 * scale + 24], b[24 * scale:24 * scale + 24]
        either = sum(p != "---" or q != "---" for p, q in zip(x, y))
        if 4 * either <= 72 or scale == 5:
            used += either
            same += sum(p == q != "---" for p, q in zip(x, y))
    return same / used if used else 0.0


def test_every_row_by_loops(spark):
    rng = random.Random(2)
    texts = [prose(i, 5 + i * 3) for i in range(60)] + ["", "word", " lead", "trail ", "ΟΔΟΣ ΟΔΟΣ.", "a b c,d \x1c x", "x" * 5000, "é" * 40 + " é", "...", "A! b? (c)"]
    texts += ["".join(rng.choice("ab ,.\n\tÉσΣ") for _ in range(rng.randrange(60))) for _ in range(60)]
    band = imatch.Lexicon(low=0.02, high=0.5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    df = {}
    for t in texts:
        for w in words_of(t):
            df[w] = df.get(w, 0) + 1
    chosen = {w for w, n in df.items() if band.low * len(texts) <= n <= band.high * len(texts)}
    got = {r.doc_id: r for r in imatch.compare_edited(docs, band).collect()}
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        own, other, following = (fingerprint(t, chosen) for t in (text, edited, after))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == ("".join(own), "".join(other)), text
        assert (got[i].near_edited, got[i].near_next) == (likeness(own, other), likeness(own, following))
