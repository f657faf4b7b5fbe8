"""Request-log metrics, intake de-duplication and incremental audits as streams.

A log row is (ts timestamp, path string, ms double, user_id long, error boolean).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tagloom.session import shared_dir


def request_log(events: DataFrame) -> DataFrame:
    """Events as a request log; watermarks need an instant, not a local time."""
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"), F.col("value").alias("ms"),
                         "user_id", "event_id", (F.col("event_type") == "error").alias("error"))


def _metrics(log: DataFrame, window: Column, delay: str, *keys: str) -> DataFrame:
    counted = log.withWatermark("ts", delay).groupBy(window.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("requests"), (F.round(F.sum("ms"), 6) / F.count("ms")).alias("mean_ms"), F.count_if("error").alias("errors"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "requests", "mean_ms", "errors")


def tumbling(log: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Requests, mean latency and errors per path and window."""
    return _metrics(log, F.window("ts", size), delay, "path")


def sliding(log: DataFrame, size: str = "2 days", slide: str = "1 day", delay: str = "1 hour") -> DataFrame:
    return _metrics(log, F.window("ts", size, slide), delay, "path")


def sessions(log: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """One row per user and burst of requests."""
    return _metrics(log, F.session_window("ts", gap), delay, "user_id")


def deduplicated(log: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """First arrival of each key; state is dropped once the watermark passes it."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


ALERT = "doc_id long, previous long, current long"


class RiseAlert(StatefulProcessor):
    """Remembers the latest failed-check count per document and reports every rise.

    A document's rows of one micro-batch may come in several Arrow batches in any order, so they
    are ordered together; rows older than what is remembered are late and dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "ts timestamp, seq long, failed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat([batch[["ts", "seq", "failed"]] for batch in rows], ignore_index=True)
        if self.latest.exists():
            ts, seq, failed = self.latest.get()
            known = pd.DataFrame({"ts": [pd.Timestamp(ts)], "seq": [seq], "failed": [failed]}).astype(arrived.dtypes)
            newer = (arrived["ts"] > known["ts"][0]) | ((arrived["ts"] == known["ts"][0]) & (arrived["seq"] > seq))
            arrived = pd.concat([known, arrived[newer]], ignore_index=True)
        ordered = arrived.sort_values(["ts", "seq"], ignore_index=True)
        previous = ordered["failed"].shift()
        rises = ordered["failed"] > previous
        last = ordered.iloc[-1]
        self.latest.update((last["ts"].to_pydatetime(), int(last["seq"]), int(last["failed"])))
        yield pd.DataFrame({"doc_id": key[0], "previous": previous[rises].astype("int64"), "current": ordered["failed"][rises].astype("int64")})

    def close(self) -> None:
        pass


def regression_alerts(results: DataFrame) -> DataFrame:
    """Alerts over a stream of (doc_id, ts, seq, failed); needs the RocksDB state store."""
    return results.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=RiseAlert(), outputStructType=ALERT, outputMode="append", timeMode="none")


def run_available(stream: DataFrame, mode: str, checkpoint: str | None = None, sink: str | None = None) -> DataFrame:
    """Drain what is there into Parquet (append) or a last-result table (complete) and read it back."""
    spark = stream.sparkSession
    checkpoint = checkpoint or shared_dir(spark, "stream-state")
    sink = sink or shared_dir(spark, "stream-out")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", sink).start()
    else:
        # complete and update results replace the table of the batch before
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(sink)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def audit_incrementally(documents: DataFrame, audit: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Run the batch checks on each arriving batch and append findings by batch id.

    The batch id is a partition of the sink that a retried batch overwrites, so a failure
    between writing and committing leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        audit(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
