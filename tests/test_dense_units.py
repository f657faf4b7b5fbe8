"""Dense pages, crowded captions, deep lists, busy order values, long report sections: against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import geometry as g
from tagloom.operators import layout, scan
from tagloom.plans import audit
from tagloom.sources import layout_json

BOX = "doc_id long, page int, node_id string, ord long, x0 double, y0 double, x1 double, y1 double, decorative boolean"


def test_points_of_a_dense_page_meet_few_boxes(spark):
    side, n = 10.0, 40_000
    at = F.col("id")
    tiles = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("n"), at).alias("node_id"), at.alias("ord"),
                                  ((at % 200) * side).alias("x0"), (F.floor(at / 200) * side).cast("double").alias("y0"), F.lit(False).alias("decorative"))
    tiles = tiles.withColumns({"x1": F.col("x0") + 6, "y1": F.col("y0") + 6})
    points = tiles.select("doc_id", "page", F.col("ord").alias("span"), (F.col("x0") + 3).alias("x0"), (F.col("y0") + 3).alias("y0"))
    boxes = g.with_box_cells(g.prefixed(tiles, "n_", "doc_id", "page"), "n_", 1.0)
    assert boxes.count() <= 4 * n
    met = g.with_point_cells(points, F.col("x0"), F.col("y0")).join(boxes, ["doc_id", "page", "_cell"]).count()
    assert met <= 40 * n
    hits = layout.hit_test(points, tiles, "span")
    assert hits.count() == n and hits.filter(F.col("node_id") != F.concat(F.lit("n"), "span")).count() == 0


def test_hits_by_loops_with_boxes_of_all_sizes(spark):
    rng = random.Random(4)
    boxes = []
    for i in range(300):
        x, y, w = rng.uniform(-50, 900), rng.uniform(-50, 900), rng.choice([0, 1, 20, 31.9, 32, 33, 130, 600, 3000, 20000])
        boxes.append((1, 1 + i % 2, f"n{i}", i, x, y, x + w, y + rng.choice([0, 5, 40, 200, 20000]), i % 7 == 0))
    boxes += [(1, 1, "none", 999, None, None, None, None, False), (1, 1, "turned", 998, 50.0, 50.0, 10.0, 10.0, False)]
    points = [(1, 1 + i % 2, i, rng.uniform(-60, 950), rng.uniform(-60, 950)) for i in range(400)] + [(1, 1, 400, None, 5.0)]
    got = {r.span: r.node_id for r in layout.hit_test(
        spark.createDataFrame(points, "doc_id long, page int, span long, x0 double, y0 double"), spark.createDataFrame(boxes, BOX), "span").collect()}
    for _, page, span, x, y in points:
        around = [(abs((b[6] - b[4]) * (b[7] - b[5])), b[3], b) for b in boxes if x is not None and b[4] is not None and b[1] == page
                  and b[4] - 4 <= x <= b[6] + 4 and b[5] - 4 <= y <= b[7] + 4]
        best = min(around)[2] if around else None
        assert got[span] == (best[2] if best and not best[8] else None)


@pytest.mark.parametrize("rounds", [1, 4])
def test_captions_one_after_the_other(spark, rounds):
    rng = random.Random(rounds)
    nodes, o = [], 0
    for page in range(1, 13):
        crowd = 60 if page == 3 else rng.randint(2, 12)  # the third page holds a third of all nodes
        for _ in range(crowd):
            y = rng.uniform(0, 40 * crowd ** 0.5)
            nodes.append((1, page, o, "Figure", "", y, y + 30.0))
            y = rng.uniform(0, 40 * crowd ** 0.5)
            nodes.append((1, page, o + 1, rng.choice(["P", "Caption"]), f"Figure {o}: text", y, y + 10.0))
            o += 2
    frame = spark.createDataFrame(nodes, "doc_id long, page int, ord long, tag string, text string, y0 double, y1 double")
    pairs = layout.caption_gaps(frame).collect()
    want, taken = {}, set()
    for p in sorted(pairs, key=lambda r: (r.page, r.fig, r.gap, r.cap)):
        if p.fig not in want and p.cap not in taken:
            want[p.fig] = p.cap
            taken.add(p.cap)
    got = layout.link_captions(frame, rounds).collect()
    assert {r.fig: r.cap for r in got} == want and len(got) == len(want) > 40


def test_page_walk_and_rounds_take_the_same_captions(spark):
    rng = random.Random(5)
    nodes = []
    for o in rng.choices(range(300), k=400):  # some places in the order stand twice, heights are often equal, some edges are missing
        y = rng.choice([float(rng.randint(0, 400)), rng.uniform(0, 400), rng.choice([float("nan"), float("inf"), 7e15])])
        nodes.append((rng.choice([1, 2]), rng.choice([1, 2, None]), rng.choice([o, o, o, o, None]), rng.choice(["Figure", "P", "P"]), "Figure 1", y,
                      rng.choice([y + 10.0, y - 30.0, None])))
    frame = spark.createDataFrame(nodes, "doc_id long, page int, ord long, tag string, text string, y0 double, y1 double")
    walked, rounds, both = (layout.link_captions(frame, page_boxes=n) for n in (1000, 0, 50))
    assert walked.schema.simpleString() == rounds.schema.simpleString()
    assert sorted(walked.collect()) == sorted(rounds.collect()) == sorted(both.collect()) and walked.count() > 50


def test_a_page_is_walked_without_its_pairs(spark):
    n = 40_000  # some 130 million pairs of figure and caption within reach
    at = F.col("id")
    frame = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), at.alias("ord"),
                                  F.when(at % 2 == 0, "Figure").otherwise("P").alias("tag"), F.lit("Figure 1").alias("text"),
                                  ((at * 7919) % n * 0.01).alias("y0"), ((at * 7919) % n * 0.01 + 5).alias("y1"))
    got = layout.link_captions(frame)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == len({r.cap for r in rows}) > n * 0.4 and all(0 <= r.gap <= 40 for r in rows)


NODE = "doc_id long, node_id string, parent_id string, ord long, tag string, x0 double, text string"


@pytest.mark.parametrize("chunk", [1, 1000])
def test_lists_of_three_levels(spark, chunk):
    rows, o = [], 0

    def add(name, parent, tag, x=None, text="t"):
        nonlocal o
        rows.append((1, name, parent, o, tag, x, text))
        o += 1

    add("L1", None, "L")
    add("a", "L1", "LI", 10.0)
    add("ab", "a", "LBody")
    add("L2", "ab", "L")
    add("b", "L2", "LI", 30.0)
    add("L3", "b", "L")
    add("c", "L3", "LI", 60.0)
    add("cb", "c", "LBody")
    add("d", "L3", "P", 80.0)      # indented: under c, in its body
    add("e", "L3", "P", 60.0, "• more")  # a bullet after it
    add("f", "L2", "LI", 45.0)     # indented: under b, which has no body
    add("h", "L1", "P", 10.0)
    add("i", "L1", "LI", 25.0)     # indented: under a
    tree = layout.nested_list_tree(spark.createDataFrame(rows, NODE), chunk).collect()
    at = {r.node_id: r for r in tree}
    assert len(at) == len(tree) == len(rows) + 3
    assert {n: at[n].parent_id for n in "defi"} == {"d": "c_sublist", "e": "c_sublist", "f": "b_sublist", "i": "a_sublist"}
    assert (at["c_sublist"].parent_id, at["b_sublist"].parent_id, at["a_sublist"].parent_id) == ("cb", "b", "ab")
    assert at["d"].tag == at["e"].tag == "LI" and at["h"].tag == "P" and all(at[n + "_sublist"].tag == "L" for n in "abc")
    assert all(r.parent_id is None or r.parent_id in at for r in tree)
    assert len({r.ord for r in tree}) == len(tree) and at["c_sublist"].x0 == 80.0
    order = [r.node_id for r in sorted(tree, key=lambda r: r.ord) if not r.node_id.endswith("_sublist")]
    assert order == [r[1] for r in rows] and at["c_sublist"].ord + 1 == at["d"].ord


def test_sub_items_before_any_item_stay(spark):
    rows = [(1, "L", None, 0, "L", None, None), (1, "p", "L", 1, "P", 10.0, "x"), (1, "q", "L", 2, "P", 40.0, "x"), (1, "n", None, 3, "P", 90.0, "x")]
    tree = {r.node_id: r for r in layout.nested_list_tree(spark.createDataFrame(rows, NODE)).collect()}
    assert (tree["q"].parent_id, tree["q"].tag, len(tree)) == ("L", "LI", 4)


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_a_busy_order_value_is_split(spark, chunk):
    rng = random.Random(chunk)
    rows = [(1, 1, 0 if i < 300 else i, i, rng.choice(["BDC", "EMC", "Tj", "BMC", "re", "S"])) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, seq long, sub long, op string").repartition(5)
    sizes = [r["count"] for r in scan.with_count_chunk(frame, ["doc_id", "page", "seq", "sub"], chunk).groupBy("_chunk").count().collect()]
    assert max(sizes) <= chunk and len(sizes) == -(-900 // chunk)
    got = {r.sub for r in layout.unmarked_content(frame, chunk).collect()}
    depth, want = 0, set()
    for *_, sub, op in rows:
        depth = depth + 1 if op in ("BDC", "BMC") else max(0, depth - 1) if op == "EMC" else depth
        if not depth and op in layout.lx.PAINT_OPS:
            want.add(sub)
    assert got == want


def test_rank_of_an_empty_table_and_of_ties(spark):
    assert scan.ranked(spark.range(0), ["id"]).count() == 0
    got = [r._rank for r in scan.ranked(spark.range(100).select((F.col("id") % 3).alias("k")), ["k"]).orderBy("k", "_rank").collect()]
    assert got == list(range(100))


def test_report_lines_are_written_in_order(spark, tmp_path):
    found = spark.range(5000).select(
        (F.col("id") % 2).alias("doc_id"), F.lit("alt").alias("check"), (F.col("id") % 90).cast("int").alias("page"), F.lit("type").alias("type"),
        F.concat(F.lit("<t\n"), F.format_string("%05d", "id")).alias("text"), F.lit(None).cast("string").alias("detail"))
    rules = spark.createDataFrame([(1, "7.1", 1, 1, 5, "d", "failed"), (1, "7.1", 2, 1, 6, "d", "passed")],
                                  "doc_id long, clause string, test_number int, line_no int, rule_id long, description string, status string")
    docs = spark.createDataFrame([(0,), (1,), (2,)], "doc_id long")
    path = str(tmp_path / "report")
    audit.write_report_lines(audit.report_lines(found, rules, docs), path)
    got = audit.read_report_lines(spark, path).orderBy("doc_id", "section", "number").collect()
    per = {}
    for r in got:
        per.setdefault((r.doc_id, r.section), []).append((r.number, r.line))
    assert [line for _, line in per[2, ""]] == ["Findings: 0", "Checks with findings: 0", "Failed rules: 0", "Verdict: pass"]
    assert per[0, ""][3][1] == "Verdict: needs work" and per[1, ""][3][1] == "Verdict: fail"
    for doc in (0, 1):
        numbers, lines = zip(*per[doc, "alt"])
        assert numbers == tuple(range(2501)) and lines[0] == "alt: 2500"
        want = sorted((i % 90, i) for i in range(5000) if i % 2 == doc)
        assert list(lines[1:]) == [f"{p} | type | &lt;t\n{i:05d}" for p, i in want]


def test_layout_walk_fills_several_batches(spark, monkeypatch):
    monkeypatch.setattr(layout_json, "_BATCH_NODES", 7)
    json = '{"kids": [' + ", ".join(f'{{"type": "paragraph", "content": "{i}", "kids": [{{"type": "image"}}]}}' for i in range(50)) + "]}"
    docs = spark.createDataFrame([(i, text) for i, text in enumerate([json, None, "{", "[]", json])], "doc_id long, json string")
    got = layout_json.flatten(docs).collect()
    assert len(got) == 200 and [r.text for r in sorted(got, key=lambda r: (r.doc_id, r.ord)) if r.doc_id == 4 and r.depth == 0] == [str(i) for i in range(50)]
