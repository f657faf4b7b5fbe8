"""Conformance records kept up to date while documents arrive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tagloom.plans import audit
from tagloom.session import known_ids

COUNTS = "doc_id long, check string, severity string, n long, batch long"


def audit_arrivals(documents: DataFrame, tables: Mapping[str, DataFrame], sink: str, checkpoint: str, checks: list[str] | None = None) -> StreamingQuery:
    """Run the registered checks on each batch of arriving documents (a stream with doc_id) and append their finding counts.

    Each batch reads only its documents' rows of the tables: their ids are sent to every task. Where they are too many for that, the whole
    tables are audited and other documents' counts put aside, since no table is shuffled for its rows to be chosen. A document that arrives again is audited again; one without findings
    leaves an empty line, so that its earlier findings no longer count. The batch id is a partition of the sink which a retried
    batch overwrites, so a failure between writing and committing leaves nothing twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        ids, few = known_ids(batch)
        arrived = {name: table.join(ids, "doc_id", "left_semi") for name, table in tables.items()} if few else tables
        counts = audit.finding_counts(arrived, checks).select("doc_id", "check", "severity", "n")
        counts = counts if few else counts.join(ids, "doc_id", "left_semi")
        rows = counts.unionByName(ids, allowMissingColumns=True)
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, sink: str) -> DataFrame:
    """(doc_id, check, severity, n) of each document's latest audit."""
    rows = spark.read.schema(COUNTS).parquet(sink)
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"]).filter("check IS NOT NULL").select("doc_id", "check", "severity", "n")


def record(spark: SparkSession, sink: str) -> DataFrame:
    """The conformance record of the documents with findings, as of the last batch."""
    return audit.conformance(latest_counts(spark, sink))
