"""The scorer's sample is bounded and spread, whatever the ids."""

import pytest

from tagloom.llm import weak_labels
from tests.llm.data import prose


@pytest.mark.parametrize("same", [None, 7])
def test_sample_is_exact_under_repeated_ids(spark, monkeypatch, same):
    seen = []
    real = weak_labels.fit_scorer
    monkeypatch.setattr(weak_labels, "fit_scorer", lambda rows, training: seen.append(len(rows)) or real(rows, training))
    data = [(same if i % 3 == 0 else 1000 + i, prose(i, 30)) for i in range(900)] + [(same, "one row again")] * 300
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    assert weak_labels.classify(docs, weak_labels.Training(sample=60)).count() == 1200
    assert seen == [60]
    picked = weak_labels._sample(docs, 60).collect()
    ids = {text: i for i, text in data}
    assert len(picked) == 60 and 5 <= sum(ids[r.text] == same for r in picked) <= 40
