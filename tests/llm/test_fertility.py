"""Quality rules: base counts by loops, bands that keep the usual and drop the odd."""

import random
import re

from pyspark.sql import functions as F

from tagloom.llm import fertility
from tests.llm.data import PIECES, TEXTS, VOCABULARY, empty, odd, prose, rows


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    again = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    hit = {i + j for i, w in enumerate(windows) if w in again for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_base_counts_against_loops():
    rng = random.Random(3)
    texts = [t for t in TEXTS] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["\n".join(prose(rng.randint(0, 3), 9) for _ in range(6)) for _ in range(50)]
    for text in texts:
        assert fertility.base_counts((text or "").encode()) == counted(text), text


def test_odd_rows(spark):
    got = fertility.judge(odd(spark), VOCABULARY, PIECES)
    assert got.columns == [*odd(spark).columns, "__m"]
    seen = got.select("doc_id", "text", "__m.*").collect()
    assert len(seen) == len(rows())
    for r in seen:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.reason is None) and not (r.base_failed and r.kept)
    assert fertility.judge(empty(spark), VOCABULARY, PIECES).count() == 0


def test_bands_by_language(spark):
    usual = [(i, prose(i, 150), "xx") for i in range(60)] + [(100 + i, prose(i, 150).upper(), "yy") for i in range(60)]
    strange = [(900, " ".join(f"q{i}zx{i * 7}jk" for i in range(150)), "xx"), (901, "one two " * 2 + " ".join("ab cd ef".split() * 2), "xx")]
    docs = spark.createDataFrame(usual + strange, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in fertility.judge(docs, VOCABULARY, PIECES).select("doc_id", "__m.kept", "__m.reason").collect()}
    assert all(got[i].kept for i, *_ in usual)
    assert got[900].reason == "characters per token" and got[901].reason == "base"


def test_script_stands_in_for_language(spark):
    docs = spark.createDataFrame([(1, "кот и пёс " * 30, None), (2, "cat and dog", None), (3, "123", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.s for r in fertility.measure(docs, VOCABULARY, PIECES).select("doc_id", F.col("__m.script").alias("s")).collect()}
    assert got == {1: "cyrillic", 2: "latin", 3: "other"}
