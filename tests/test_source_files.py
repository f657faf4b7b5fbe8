"""Files as sources: limits before content, rejects, reports rule by rule; records over arriving documents."""

import os

import pytest
from pyspark.sql import functions as F

from tagloom.sources import intake, validator
from tagloom.streaming import records


def put(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as out:
        out.write(data)


def test_intake_sets_long_and_garbled_files_aside(spark, tmp_path):
    folder = str(tmp_path / "files")
    for name, data in (("a", b"good"), ("b", b""), ("c", b"x" * 11), ("d", b"\xff\xfe"), ("e", "häßlich".encode())):
        put(folder, name, data)
    taken, rejected = intake.intake(spark, folder, 10)
    assert {os.path.basename(r.path): r.text for r in taken.collect()} == {"a": "good", "e": "häßlich"}
    assert {os.path.basename(r.path): (r.length, r.error) for r in rejected.collect()} == {"c": (11, "too_long"), "d": (2, "invalid_utf8")}


def test_rows_become_files_and_are_read_once(spark, tmp_path):
    folder = str(tmp_path / "a folder")
    rows = spark.createDataFrame([(1, "one\ntwo"), (1, "again"), (None, "häßlich"), (3, None), (-4, "x" * 50)], "name long, text string")
    intake.write_files(rows, folder)
    assert sorted(len(os.listdir(os.path.join(folder, f))) for f in os.listdir(folder)).pop() <= 5
    judged = intake.judged_files(spark, folder, 20)
    assert sorted((os.path.basename(r.path).split("=")[1].rsplit("-", 1)[0], r.length, r.text, r.error) for r in judged.collect()) == [
        ("-4", 51, None, "too_long"), ("1", 6, "again\n", None), ("1", 8, "one\ntwo\n", None), ("3", 1, "\n", None), ("none", 10, "häßlich\n", None)]
    scans = judged._jdf.queryExecution().executedPlan().toString().count("FileScan binaryFile")
    assert scans == 2  # short files with content, long ones without; before, short files were read twice


def test_tasks_list_and_read_folders(spark, tmp_path):
    folder = str(tmp_path / "a folder")
    rows = spark.createDataFrame([(1, "one\ntwo"), (1, "again"), (None, "häßlich"), (3, None), (-4, "x" * 50)], "name long, text string")
    intake.write_files(rows, folder)
    for name, data in (("flat", b"flat"), ("empty", b""), (".hidden", b"no"), ("_SUCCESS", b"no"), ("bad", b"\xff\xfe"), ("_a=b", b"yes")):
        put(folder, name, data)
    put(os.path.join(folder, "x", "y"), "deep", b"deep")
    judged = intake.judged_paths(spark, folder, 20)
    assert "binaryFile" not in judged._jdf.queryExecution().executedPlan().toString()  # its index holds an entry per file in the driver
    got = sorted((os.path.basename(r.path), r.length, r.text, r.error) for r in judged.collect())
    assert len(got) == 9 and ("deep", 4, "deep", None) in got and ("bad", 2, None, "invalid_utf8") in got and ("_a=b", 3, "yes", None) in got
    assert sum(r[3] == "too_long" for r in got) == 1
    put(str(tmp_path / "flat"), "only one", b"text")
    one = intake.judged_paths(spark, str(tmp_path / "flat"), 20).first()
    assert one.path.startswith("file:/") and (one.length, one.text, one.error) == (4, "text", None)


def test_long_files_are_left_out_by_the_scan(spark, tmp_path):
    folder = str(tmp_path / "files")
    put(folder, "long", b"x" * 100)
    plan = intake.read_files(spark, folder, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(length,10)" in plan


RULE = '<rule specification="PDF/UA-1" clause="7.{0}" testNumber="{0}" status="{1}" passedChecks="1" failedChecks="2"><description> d{0} </description>{2}</rule>\n'


def test_a_report_is_read_rule_by_rule(spark, tmp_path):
    folder = str(tmp_path / "reports")
    body = "".join(RULE.format(i, "FAILED" if i % 2 else "passed", "<check status='failed'><context> c </context></check>" * (i % 3)) for i in range(3000))
    put(folder, "long.xml", f'<report><jobs><job><validationReport flavour="F" isCompliant="TRUE"><details passedRules="7" failedRules = \'3\'>{body}</details></validationReport></job></jobs></report>'.encode())
    put(folder, "none.xml", b"<report><jobs><job><taskException/></job></jobs></report>")
    put(folder, "odd.xml", ('<report><validationResult isCompliant="false"><details passedRules="many">' + RULE.format(1, "failed", "")
                            + '<rule clause="7.9" testNumber="x" status="failed"></rule><rule clause="7.8"><description>a & b</description></rule></details></validationResult></report>').encode())
    rules = validator.read_rules(spark, folder)
    assert rules.filter(F.col("path").endswith("long.xml")).count() == 3000
    assert sum(r._corrupt is not None for r in rules.collect()) == 1
    assert {r.test_number for r in rules.filter("clause = '7.9'").collect()} == {9, None}
    totals = {os.path.basename(r.path): (r.compliant, r.flavour, r.passed_rules, r.failed_rules, r.validation_error) for r in validator.read_totals(spark, folder).collect()}
    assert totals == {"long.xml": (True, "F", 7, 3, None), "none.xml": (None, None, 0, 0, "no validation result"), "odd.xml": (False, None, 0, 0, None)}
    failed = validator.validated_files(spark, folder)
    assert failed.filter(F.col("path").endswith("long.xml")).count() == 1500
    assert failed.filter("clause = '7.5'").first().contexts == ["c", "c"]


@pytest.mark.parametrize("checks", [["xfa", "abbreviation"]])
def test_a_document_that_arrives_again_is_audited_again(spark, tmp_path, checks):
    src, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs = spark.createDataFrame([(1, True), (2, True), (3, False)], "doc_id long, has_xfa boolean")

    def run(ids, has_xfa):
        spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.mode("append").parquet(src)
        tables = {"docs": docs.withColumn("has_xfa", F.col("has_xfa") & F.lit(has_xfa)), "nodes": nodes}
        records.audit_arrivals(spark.readStream.schema("doc_id long").parquet(src), tables, sink, state, checks).awaitTermination()
        return {r.doc_id: r.xfa for r in records.record(spark, sink).collect()}

    nodes = spark.createDataFrame([], "doc_id long, ord long, tag string, text string, language string, doc_lang string, page int")
    assert run([1, 3], True) == {1: 1}
    assert run([2], True) == {1: 1, 2: 1}  # after a restart, from the same checkpoint
    assert run([1], False) == {2: 1}       # mended since: its earlier finding no longer counts
    assert spark.read.parquet(sink).select("batch").distinct().count() == 3


def test_rules_are_cut_out_of_reports_once(spark, monkeypatch):
    from catalog import sources_queries
    plans = []
    monkeypatch.setattr(sources_queries.validator, "validated_files", lambda s, path: (_ for _ in ()).throw(StopIteration))
    writer = type(spark.range(1).write)
    monkeypatch.setattr(writer, "text", lambda self, *a, **k: plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()))
    with pytest.raises(StopIteration):
        sources_queries.QUERIES["validator_files"](spark, "/root/testdata/sf0.001")
    assert plans[0].count("regexp_extract_all") == 1  # before, three times: for the rules and for either end of the files
