"""What the audit costs: generated code that the JVM compiles, checks evaluated once, tables shuffled no more than needed."""

import re

import pytest
from pyspark.sql import functions as F

from catalog import rollup_queries
from tagloom import session
from tagloom.operators import document, headings, interactive, layout, prose
from tagloom.plans import audit
from tagloom.streaming import records

#: Longer methods are interpreted, unless the JVM is told otherwise.
COMPILED = 8000


def codegen(spark, make, capsys):
    capsys.readouterr()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        make().explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]


@pytest.mark.parametrize("check", ["contrast", "nontext_contrast", "alt", "headings", "language", "sensory", "abbreviation", "reading_level"])
def test_checks_are_compiled(spark, capsys, check):
    tables = rollup_queries.FixtureTables(spark, "/root/testdata/sf0.001")
    sizes = codegen(spark, lambda: audit.CHECKS[check](tables), capsys) + codegen(spark, lambda: audit.counted(audit.CHECKS[check](tables)), capsys)
    assert sizes and max(sizes) <= COMPILED  # before, 8,535 to 50,881


def test_once_a_row_changes_no_result(spark):
    nodes = spark.createDataFrame(
        [(1, "n0", 0, 1, "H2", "see the chart on the left side", None), (1, "n1", 1, 1, "H", None, None), (1, "n2", 2, None, "H4", "NASA NASA", "image"),
         (1, "n3", 3, 1, "Figure", None, None), (1, "n4", 4, 1, "Figure", None, " "), (1, "n5", 5, 1, "Figure", None, "IMG1234"), (1, "n6", 6, 1, "Figure", None, "A bridge")],
        "doc_id long, node_id string, ord long, page int, tag string, text string, alt string")
    assert [(r.node_id, r.level) for r in headings.heading_rows(nodes).orderBy("ord").collect()] == [("n0", 2), ("n1", 1), ("n2", 4)]
    assert [(r.node_id, r.type) for r in document.alt_quality(nodes).orderBy("node_id").collect()] == [("n3", "missing"), ("n4", "empty"), ("n5", "generic")]
    assert [(r.abbreviation, r["count"]) for r in prose.abbreviations(nodes).collect()] == [("NASA", 2)]
    assert {r.ord for r in prose.sensory(nodes).collect()} == {0}


RULES = "doc_id long, clause string, test_number int, line_no int, rule_id long, description string, status string"


def found_rows(spark, n=40):
    return spark.range(n).select(
        (F.col("id") % 2).alias("doc_id"), F.lit("alt").alias("check"), (F.col("id") % 9 - 1).cast("int").alias("page"), F.lit("type").alias("type"),
        F.format_string("%03d", n - F.col("id")).alias("text"), F.lit(None).cast("string").alias("detail"))


def test_sections_read_the_findings_once(spark):
    found, rules = found_rows(spark), spark.createDataFrame([(1, "7.1", 1, 1, 5, "d", "failed")], RULES)
    out = audit.report_sections(found, rules)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1  # before, 2: once for the count, once for the lines
    whole = {(r.doc_id, r.section): (r.n, r.body) for r in out.collect()}
    limited = {(r.doc_id, r.section): (r.n, r.body) for r in audit.report_sections(found, rules, 1000).collect()}
    assert whole == limited and whole[0, "alt"][0] == 20 and whole[1, "rule_failures"] == (1, "7.1 | d")


def test_nine_digits(spark):
    numbers = spark.createDataFrame([(n,) for n in (0, 7, 123456789, 1234567890, -5)], "n int")
    assert [r.s for r in numbers.select(audit._nine_digits(F.col("n")).alias("s")).collect()] == ["000000000", "000000007", "123456789", "1234567890", "-00000005"]


def test_report_lines_are_kept_and_numbered_without_a_sort(spark, tmp_path):
    found, rules = found_rows(spark), spark.createDataFrame([(1, "7.1", 1, 1, 5, "d", "failed")], RULES)
    lines = audit.report_lines(found, rules, spark.createDataFrame([(0,), (None,)], "doc_id long"))
    assert "Range (" not in lines._jdf.queryExecution().optimizedPlan().toString()  # before, 3 times: every reader of the lines ran the checks
    path = str(tmp_path / "report")
    audit.write_report_lines(lines, path)
    read = audit.read_report_lines(spark, path)
    assert "rangepartitioning" not in read._jdf.queryExecution().executedPlan().toString() and "Scan ExistingRDD" not in read._jdf.queryExecution().executedPlan().toString()
    rows = read.collect()
    assert sorted(r.number for r in rows if (r.doc_id, r.section) == (0, "alt")) == list(range(21))
    # a document without an id has its headline, as in the SQL; before, it was lost
    assert sorted(r.line for r in rows if r.doc_id is None) == ["Checks with findings: 0", "Failed rules: 0", "Findings: 0", "Verdict: pass"]
    assert {r.doc_id for r in rows} == {0, None}


def test_a_section_over_several_tasks_is_numbered_through(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = [(p << 33 | i, 1, "alt", f"{p}-{i}") for p, first, n in ((0, 3, 4), (1, 0, 6), (4, 0, 2)) for i in range(first, first + n)] + [(0, 1, "", "head")]
    spark.createDataFrame(rows, "place long, doc_id long, section string, line string").repartition(5).write.json(path)
    got = [r.line for r in audit.read_report_lines(spark, path).filter("section = 'alt'").orderBy("number").collect()]
    assert got == [r[3] for r in rows[:-1]]
    assert [r.number for r in audit.read_report_lines(spark, path).orderBy("section", "number").collect()] == [0, *range(12)]


@pytest.mark.parametrize("limit", [1 << 19, 1])
def test_arrivals_are_audited_without_shuffling_tables(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(session, "SENT_IDS", limit)
    docs = spark.createDataFrame([(1, True), (2, True), (3, False), (None, True)], "doc_id long, has_xfa boolean")
    seen = []
    audited = audit.finding_counts
    monkeypatch.setattr(audit, "finding_counts", lambda tables, checks: seen.append(tables["docs"]) or audited(tables, checks))
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1,), (3,), (3,), (4,)], "doc_id long").write.parquet(src)
    records.audit_arrivals(spark.readStream.schema("doc_id long").parquet(src), {"docs": docs}, sink, str(tmp_path / "state"), ["xfa"]).awaitTermination()
    assert [(r.doc_id, r.xfa, r.total) for r in records.record(spark, sink).collect()] == [(1, 1, 1)]
    assert {r.doc_id for r in spark.read.parquet(sink).collect()} == {1, 3, 4}
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    # before, a join with a checkpoint, of unknown size, so that every table of every check was shuffled
    assert "rightHint=(strategy=broadcast)" in plan if limit > 1 else "Join" not in plan


def test_swatches_of_ordinary_pages_take_one_shuffle(spark):
    fills = spark.createDataFrame([(d, p, i, 20.0 * i, 5.0, 8.0, 8.0, "rgb", i / 10, 0.1, 0.2, 0.0) for d, p in ((1, 1), (1, 2), (None, 1)) for i in range(4 if p == 1 else 2)],
                                  "doc_id long, page int, fill_id long, x double, y double, w double, h double, space string, a double, b double, c double, d double")
    out = layout.swatch_clusters(fills)
    assert {tuple(r) for r in out.collect()} == {(1, 1, 0, 4, 4), (None, 1, 0, 4, 4)}
    assert "rangepartitioning" not in out._jdf.queryExecution().toString()
    # before: a sort by range, a checkpoint, and shuffles by chunk and by colour
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in layout.swatch_clusters(fills, 3).collect() if r[0]} == {(1, 1, 0, 4, 4)}


def test_labels_meet_regions_of_every_level(spark):
    fields = spark.createDataFrame([(1, 1, 1, "a", None, "Tx", 140.0, 80.0, 220.0, 94.0), (1, 1, 2, "b", None, "Tx", 140.0, 300.0, 3000.0, 900.0), (1, 2, 3, "c", None, "Tx", 10.0, 10.0, 30.0, 20.0)],
                                   "doc_id long, page int, field_id long, T string, TU string, FT string, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(1, 1, 1, "Name of holder", 60.0, 84.0, 130.0, 92.0), (1, 1, 2, "Place of birth", 2000.0, 905.0, 2100.0, 915.0), (1, 1, 3, "far away", 5000.0, 84.0, 5100.0, 92.0),
                                   (1, 3, 4, "no field here", 10.0, 10.0, 30.0, 20.0), (1, 2, 5, "no place", None, 10.0, 30.0, 20.0)],
                                  "doc_id long, page int, span long, text string, x0 double, y0 double, x1 double, y1 double")
    out = interactive.label_in_name(fields, spans)
    assert {(r.field_id, r.visible_label) for r in out.collect()} == {(1, "Name of holder"), (2, "Place of birth")}
    assert "p_x0" in out._jdf.queryExecution().optimizedPlan().toString()  # spans meet what encloses a page's regions before they get cells


def test_written_findings_are_packed(spark, tmp_path):
    path = tmp_path / "findings"
    audit.write_findings(found_rows(spark), str(path))
    files = [f.name for f in path.rglob("*.parquet")]
    assert files and all(".zstd." in f for f in files)
    assert spark.read.parquet(str(path)).count() == 40
