"""Late rows, restarts and retried batches."""

import datetime as dt

from pyspark.sql import functions as F

from tagloom.streaming import metrics as op

T0 = dt.datetime(2024, 1, 1)
LOG = "ts timestamp, path string, ms double, user_id long, event_id long, error boolean"


def _write(spark, path, rows, schema=LOG):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _hit(hours, event_id):
    return (T0 + dt.timedelta(hours=hours), "view", 1.0, 1, event_id, False)


def _run(spark, src, tmp_path, build):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
    return op.run_available(build(stream), "append", str(tmp_path / "ck"), str(tmp_path / "out"))


def test_late_row_is_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    _write(spark, src, [_hit(0, 1), _hit(1, 2)])
    _run(spark, src, tmp_path, lambda s: op.tumbling(s, "1 hour", "1 hour"))
    _write(spark, src, [_hit(10, 3)])
    _run(spark, src, tmp_path, lambda s: op.tumbling(s, "1 hour", "1 hour"))
    _write(spark, src, [_hit(0.5, 4), _hit(30, 5)])
    out = _run(spark, src, tmp_path, lambda s: op.tumbling(s, "1 hour", "1 hour"))
    first = out.filter(F.col("start") == F.lit(T0)).collect()
    assert [r.requests for r in first] == [1]


def test_resent_document_is_taken_once_across_restarts(spark, tmp_path):
    src = str(tmp_path / "in")
    _write(spark, src, [_hit(0, 1), _hit(0, 1), _hit(0, 2)])
    _run(spark, src, tmp_path, lambda s: op.deduplicated(s, "event_id", "5 hours"))
    _write(spark, src, [_hit(1, 2), _hit(1, 3)])
    out = _run(spark, src, tmp_path, lambda s: op.deduplicated(s, "event_id", "5 hours"))
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3]


def test_alert_state_survives_a_restart(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "doc_id long, ts timestamp, seq long, failed long"
    src = str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        return op.run_available(op.regression_alerts(stream), "append", str(tmp_path / "ck"), str(tmp_path / "out"))

    try:
        _write(spark, src, [(1, T0, 1, 5), (1, T0, 2, 3), (2, T0, 1, 1)], schema)
        assert run().count() == 0
        _write(spark, src, [(1, T0, 3, 4), (2, T0, 2, 1)], schema)
        assert [tuple(r) for r in run().collect()] == [(1, 3, 4)]
    finally:
        spark.conf.set(provider, before)


def test_alerts_do_not_depend_on_arrow_batches(spark, tmp_path):
    provider, batch = "spark.sql.streaming.stateStore.providerClass", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {k: spark.conf.get(k) for k in (provider, batch)}
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(batch, "3")
    schema = "doc_id long, ts timestamp, seq long, failed long"
    src = str(tmp_path / "in")
    try:
        _write(spark, src, [(1, T0 + dt.timedelta(hours=h), h, h) for h in range(8, -1, -1)], schema)
        stream = spark.readStream.schema(schema).parquet(src)
        run = lambda: op.run_available(op.regression_alerts(stream), "append", str(tmp_path / "ck"), str(tmp_path / "out"))
        assert sorted((r.previous, r.current) for r in run().collect()) == [(i, i + 1) for i in range(8)]
        _write(spark, src, [(1, T0 + dt.timedelta(hours=2), 2, 99), (1, T0 + dt.timedelta(hours=9), 9, 8)], schema)
        assert run().count() == 8  # the late row is dropped, the new one does not rise
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_incremental_audit_appends_only_new_documents(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "doc_id long, text string"

    def audit(batch):
        return batch.select("doc_id", F.length("text").alias("n"))

    for doc in (1, 2):
        _write(spark, src, [(doc, "abc")], schema)
        op.audit_incrementally(spark.readStream.schema(schema).parquet(src), audit, sink, ck).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(sink).collect()) == [1, 2]


def test_a_table_of_several_files_streams_whole(spark, tmp_path):
    from catalog import queries, streams_queries

    text = "The quick brown fox jumps over the lazy dog and runs. " * 12
    spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["stream_audit"](spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2, 3]
    # one file under the table's name, as before
    assert streams_queries.op.run_available(streams_queries._stream(spark, "/root/testdata/sf0.001", "events").select("event_id"), "append").count() == \
        spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
