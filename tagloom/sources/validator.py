"""Validator XML reports: totals per document and failed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_RULE = (
    "struct<_specification: string, _clause: string, _testNumber: int, _status: string, _passedChecks: long, "
    "_failedChecks: long, description: string, check: array<struct<_status: string, context: string>>>"
)
_RESULT = (
    "struct<_flavour: string, _isCompliant: string, details: struct<_passedRules: long, _failedRules: long, "
    f"_passedChecks: long, _failedChecks: long, rule: array<{_RULE}>>>"
)
SCHEMA = f"jobs struct<job: struct<validationReport: {_RESULT}, validationResult: {_RESULT}>>"


def _results(reports: DataFrame, xml_col: str) -> DataFrame:
    parsed = reports.select("doc_id", F.from_xml(F.col(xml_col), SCHEMA, {"ignoreNamespace": "true"}).alias("r"))
    job = F.col("r.jobs.job")
    return parsed.select("doc_id", F.coalesce(job["validationReport"], job["validationResult"]).alias("v"))


def validations(reports: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Totals; a report without a result block means conformance is unknown."""
    d = F.col("v.details")
    return _results(reports, xml_col).select(
        "doc_id", (F.lower("v._isCompliant") == "true").alias("compliant"), F.col("v._flavour").alias("flavour"),
        *[F.coalesce(d["_" + a], F.lit(0)).alias(b) for a, b in (
            ("passedRules", "passed_rules"), ("failedRules", "failed_rules"), ("passedChecks", "passed_checks"),
            ("failedChecks", "failed_checks"))],
        F.when(F.col("v").isNull(), F.lit("no validation result")).alias("validation_error"))


def failed_rules(reports: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Failed rules with all their contexts, numbered by (clause, test) in their report."""
    failed = F.filter("v.details.rule", lambda r: F.lower(r["_status"]) == "failed")
    ordered = F.array_sort(F.transform(failed, lambda r: F.struct(r["_clause"].alias("c"), r["_testNumber"].alias("t"), r.alias("r"))))
    rows = _results(reports, xml_col).select("doc_id", F.posexplode(ordered).alias("pos", "e"))
    r = F.col("e.r")
    contexts = F.filter(F.transform(r["check"], lambda k: F.trim(k["context"])), lambda x: x != "")
    return rows.select(
        "doc_id", (F.col("pos") + 1).alias("position"), r["_specification"].alias("specification"),
        F.coalesce(r["_clause"], F.lit("?")).alias("clause"), F.coalesce(r["_testNumber"], F.lit(0)).alias("test_number"),
        F.lit("failed").alias("status"), F.trim(r["description"]).alias("description"),
        r["_passedChecks"].alias("passed_checks"), r["_failedChecks"].alias("failed_checks"),
        F.coalesce(F.array_join(contexts, "|"), F.lit("")).alias("contexts"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Every rule of the report files below ``path``, a row per rule, so that a report of any length is read by many tasks.

    Columns: path, specification, clause, test_number, status, description, passed_checks, failed_checks, contexts (an array) and
    ``_corrupt``, the text of a rule that can't be read as one (its other columns are null then). A number that is none is null.
    """
    # numbers as text: the parser gives up a whole file for an attribute that is none
    rule = ("_specification string, _clause string, _testNumber string, _status string, _passedChecks string, _failedChecks string, "
            "description string, check array<struct<_status: string, context: string>>")
    rows = spark.read.format("xml").options(rowTag="rule", ignoreNamespace="true", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").schema(
        f"{rule}, _corrupt string").load(path)
    contexts = F.filter(F.transform("check", lambda k: F.trim(k["context"])), lambda x: x != "")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_specification").alias("specification"), F.col("_clause").alias("clause"),
                       F.col("_testNumber").try_cast("int").alias("test_number"), F.lower("_status").alias("status"), F.trim("description").alias("description"),
                       F.col("_passedChecks").try_cast("long").alias("passed_checks"), F.col("_failedChecks").try_cast("long").alias("failed_checks"),
                       F.coalesce(contexts, F.array().cast("array<string>")).alias("contexts"), "_corrupt")


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """compliant, flavour and the four totals of every report file; a file without a result has an error instead.

    Files are read tag by tag, as lines that end with ">", so the result's tags are found without holding a report.
    """
    tags = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("path"), "value")

    def attribute(name: str) -> Column:
        return F.nullif(F.regexp_extract("value", rf"\b{name}\s*=\s*[\"']([^\"']*)", 1), F.lit(""))

    opens = F.regexp_extract("value", r"<(?:\w+:)?(validationReport|validationResult|details)\b[^<]*$", 1)
    found = tags.withColumn("_tag", opens)
    report, details = F.col("_tag").isin("validationReport", "validationResult"), F.col("_tag") == "details"
    totals = {"passed_rules": "passedRules", "failed_rules": "failedRules", "passed_checks": "passedChecks", "failed_checks": "failedChecks"}
    rows = found.groupBy("path").agg(
        F.max(F.when(report, F.lower(attribute("isCompliant")) == "true")).alias("compliant"), F.max(F.when(report, attribute("flavour"))).alias("flavour"),
        *[F.coalesce(F.max(F.when(details, attribute(a).try_cast("long"))), F.lit(0)).alias(b) for b, a in totals.items()],
        F.bool_or(report).alias("_known"))
    return rows.select("path", "compliant", "flavour", *totals, F.when(~F.col("_known"), F.lit("no validation result")).alias("validation_error"))


def validated_files(spark: SparkSession, path: str) -> DataFrame:
    """Failed rules of report files beside the totals of their file."""
    failed = read_rules(spark, path).filter("status = 'failed'")
    return failed.join(read_totals(spark, path).withColumnsRenamed({"passed_checks": "all_passed_checks", "failed_checks": "all_failed_checks"}), "path")
