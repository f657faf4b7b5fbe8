"""The pipeline: each stage against plain Python on a small corpus, then the whole."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tagloom.llm import fertility, line_chunks, packing, simhash
from tagloom.llm.queries import byte_vocabulary
from tests.llm.data import empty, odd, prose
from tests.llm.test_other_operators import filled, without_repeats
from tests.llm.test_simhash import brute

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    shared = "\n".join(prose(900 + i, 12) for i in range(6))
    texts = {}
    for i in range(140):
        texts[i] = prose(i, 60) + "\n" + prose(i + 500, 25) + ("\n" + shared if i % 10 == 0 else "")
    for i in range(140, 150):
        texts[i] = texts[i - 140]
    texts[150], texts[151], texts[152] = "too short", "same words again and again " * 20, ""
    return [(i, t, "en", f"s{i % 4}", len(t)) for i, t in texts.items()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]


def test_quality_rules_drop_what_base_rules_reject(spark, docs):
    out = STAGES["quality_rules"](spark, docs, "")
    assert out.columns == COLUMNS
    assert set(rows(out)) == {i for i, t, *_ in corpus() if fertility.base_counts(t.encode())[0] >= 20 and i != 151}


def test_line_dedup_by_loops(spark, docs):
    out = STAGES["line_dedup"](spark, docs, "")
    assert out.columns == COLUMNS
    want = without_repeats([(i, t) for i, t, *_ in corpus()], line_chunks.Cuts())
    assert {i: (r.text, r.n_chars) for i, r in rows(out).items()} == {i: (t, len(t)) for i, t in want.items()}


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    out = STAGES["simhash_near_dedup"](spark, docs, "")
    assert out.columns == COLUMNS
    fps = {i: simhash.simhash(t.encode()) for i, t, *_ in corpus()}
    root = brute(fps.values())
    first = {}
    for i in sorted(fps):
        first.setdefault(root[fps[i]], i)
    assert set(rows(out)) == set(first.values())


def test_mix_takes_sources_to_their_targets(spark, docs):
    out = STAGES["mix_sources"](spark, docs, "")
    assert out.columns == COLUMNS
    size = {i: len(t.split()) for i, t, *_ in corpus()}
    per = defaultdict(int)
    for i, n in size.items():
        per[f"s{i % 4}"] += n
    want = filled(per, dict(zip(sorted(per), (3, 1, 2, 3))), 1.5 * sum(per.values()), 2)
    got = Counter(r.doc_id for r in out.collect())
    for s in per:
        taken = sum(n * size[i] for i, n in got.items() if f"s{i % 4}" == s)
        assert abs(taken - want[s]) <= max(size.values())
    assert max(got.values()) <= 2


def test_run_is_the_stages_one_after_another(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, "").collect(), step.schema)
    tokenizer = packing.ByteTokenizer(byte_vocabulary())
    copies = Counter(r.doc_id for r in step.collect())
    assert len(got) == sum(copies.values())
    lengths = {r.doc_id: len(tokenizer.ids(r.text.encode())) + 1 for r in step.collect()}
    assert all(r.length == lengths[r.doc_id] for r in got) and Counter(r.doc_id for r in got) == copies
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, name):
    assert STAGES[name](spark, empty(spark), "").count() == 0
    out = STAGES[name](spark, odd(spark), "")
    assert out.count() > 0
    if name != "best_fit_packing":
        assert out.columns == odd(spark).columns
