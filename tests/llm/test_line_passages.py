"""Passages of any number of long lines go, whatever stands around them."""

import pytest

from tagloom.llm import line_chunks
from tests.llm.data import prose


@pytest.mark.parametrize("lines", [1, 2, 3, 5])
def test_whole_passages_go(spark, lines):
    passage = [prose(100 + i, 60) for i in range(lines)]
    docs = [(i, "\n".join([prose(1000 + 10 * i + j, 20 + j) for j in range(i % 4)] + passage + [prose(2000 + i, 30), "end"])) for i in range(40)]
    got = {r.doc_id: r.text for r in line_chunks.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1]
    for i, text in docs[1:]:
        assert got[i].split("\n") == [line for line in text.split("\n") if line not in passage]


def test_single_short_lines_stay(spark):
    docs = [(i, f"{prose(i, 40)}\nhome\n{prose(500 + i, 40)}") for i in range(20)]
    got = {r.doc_id: r.text for r in line_chunks.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(docs)
