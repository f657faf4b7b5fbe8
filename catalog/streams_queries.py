"""Streaming queries (J1-J6), drained with availableNow and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.dialect import table
from tagloom.operators import prose
from tagloom.session import shared_dir
from tagloom.streaming import metrics as op


def _stream(spark, sf, name):
    """A table as a stream, whether it is one file or a folder of files.

    A stream takes one file for its base folder, unless the path is a pattern.
    """
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def _log(spark, sf):
    return op.request_log(_stream(spark, sf, "events"))


def _resent(spark, sf):
    """The log with every third row sent again, a minute late, as a re-sent request arrives."""
    log = _log(spark, sf)
    again = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return log.select("*", F.explode(again).alias("_late")).withColumn("ts", F.col("ts") + F.make_dt_interval(mins=F.col("_late"))).drop("_late")


def _audit(spark, sf):
    sink = shared_dir(spark, "findings")
    query = op.audit_incrementally(_stream(spark, sf, "documents"), lambda batch: prose.reading_level(batch).filter("severity IS NOT NULL"),
                                   sink, shared_dir(spark, "stream-state"))
    query.awaitTermination()
    return spark.read.parquet(sink).select("doc_id", "grade_level", "severity")


def _guard(spark, sf):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        results = _stream(spark, sf, "events").select(
            F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
            F.floor("value").cast("long").alias("failed"))
        return op.run_available(op.regression_alerts(results), "append")
    finally:
        spark.conf.set(provider, before)


QUERIES = {
    "stream_audit": _audit,
    "stream_tumbling": lambda s, p: op.run_available(op.tumbling(_log(s, p)), "append").withColumns(
        {"start": F.date_format("start", "yyyy-MM-dd HH:mm"), "end": F.date_format("end", "yyyy-MM-dd HH:mm")}),
    "stream_sliding": lambda s, p: op.run_available(op.sliding(_log(s, p)), "append").withColumns(
        {"start": F.date_format("start", "yyyy-MM-dd HH:mm"), "end": F.date_format("end", "yyyy-MM-dd HH:mm")}),
    "stream_sessions": lambda s, p: op.run_available(op.sessions(_log(s, p)), "append").select(
        F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "user_id", "requests", "mean_ms", "errors"),
    "stream_guard": _guard,
    "stream_dedupe": lambda s, p: op.run_available(op.deduplicated(_resent(s, p)), "append").select("event_id", "path", "ms", "user_id"),
}

_FMT = "strftime({c}, '%Y-%m-%d %H:%M')"
# append mode emits what the watermark has closed: windows that end an hour before the last row
_CLOSED = "(SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts), TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR FROM events)"
_AGG = "count(*) AS requests, round(sum(value), 6) / count(value) AS mean_ms, count(*) FILTER (WHERE event_type = 'error') AS errors"
from catalog.text_queries import ORACLES as _text  # noqa: E402

ORACLES = {
    "stream_audit": f"SELECT doc_id, grade_level, severity FROM ({_text['reading_level']}) WHERE severity IS NOT NULL",
    "stream_tumbling": f"""WITH w AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS s FROM events)
SELECT {_FMT.format(c='s')} AS start, {_FMT.format(c='s + INTERVAL 1 DAY')} AS "end", event_type AS path, {_AGG} FROM w WHERE s + INTERVAL 1 DAY <= {_CLOSED} GROUP BY s, event_type""",
    "stream_sliding": f"""WITH w AS (SELECT *, unnest([time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 DAY]) AS s FROM events)
SELECT {_FMT.format(c='s')} AS start, {_FMT.format(c='s + INTERVAL 2 DAY')} AS "end", event_type AS path, {_AGG} FROM w WHERE s + INTERVAL 2 DAY <= {_CLOSED} GROUP BY s, event_type""",
    "stream_sessions": f"""WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
 g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end_us, user_id, count(*) AS requests, round(sum(value), 6) / count(value) AS mean_ms,
  count(*) FILTER (WHERE event_type = 'error') AS errors FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {_CLOSED}""",
    "stream_guard": """WITH l AS (SELECT user_id AS doc_id, CAST(floor(value) AS BIGINT) AS current, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT doc_id, previous, current FROM l WHERE current > previous""",
    "stream_dedupe": "SELECT event_id, event_type AS path, value AS ms, user_id FROM events",
}
