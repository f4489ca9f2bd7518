"""Streaming twins equal their batch operators (SURVEY §5 (c))."""

import os
import shutil

from pyspark.sql import functions as F

from vantage.operators import errors as eo
from vantage.operators.stats import window_stats
from vantage.sources.tables import bind_events
from vantage.streaming.ingest import error_groups_from_deltas, event_stream, run_ingest, window_stats_stream

SF = "/root/testdata/sf0.001"


def _landed(tmp_path):
    """The file source reads a directory of landed files."""
    d = tmp_path / "landing"
    d.mkdir()
    shutil.copy(os.path.join(SF, "events.parquet"), d / "part-0.parquet")
    return str(d)


def test_window_stats_stream_equals_batch(spark, tmp_path):
    src = _landed(tmp_path)
    q = (window_stats_stream(event_stream(spark, src)).writeStream.format("memory").queryName("ws_out")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT * FROM ws_out")
    ev = bind_events(spark.read.parquet(src)).withColumn("is_n1", F.lit(False))
    want = window_stats(ev, "30 seconds").select("period", "env_id", "model", "method", "call_count", "total_ms",
                                                  "max_ms", "p95_ms", "sample_sql")
    # append mode holds back windows newer than the watermark: compare the emitted ones
    assert got.count() > 0
    assert got.exceptAll(want).count() == 0


def test_ingest_is_idempotent(spark, tmp_path):
    src = _landed(tmp_path)
    out = str(tmp_path / "out")
    run_ingest(spark, src, out, str(tmp_path / "ck"))
    run_ingest(spark, src, out, str(tmp_path / "ck"))  # restart: nothing new, nothing duplicated
    merged = error_groups_from_deltas(spark, out).select("env_id", "signature", "occurrence_count")
    want = eo.group_errors(eo.error_events(bind_events(spark.read.parquet(src)))).select(
        "env_id", "signature", "occurrence_count")
    assert merged.exceptAll(want).count() == 0 and want.exceptAll(merged).count() == 0


def test_cooldown_stream_equals_batch(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    from vantage.operators.budgets import cooldown_fold
    from vantage.streaming.stateful import cooldown_stream, use_rocksdb

    rnd = random.Random(11)
    rows, t = [], datetime(2024, 1, 1)
    for i in range(200):
        t += timedelta(minutes=rnd.choice([1, 3, 7, 12]))
        rows.append((f"k{i % 3}", t, i))
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq long")
    land = str(tmp_path / "breaches")
    # two files -> two micro-batches: state must carry the last kept time across them
    df.filter("seq < 100").coalesce(1).write.parquet(land + "/a")
    df.filter("seq >= 100").coalesce(1).write.parquet(land + "/b")
    use_rocksdb(spark)
    src = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(land))
    q = (cooldown_stream(src, ["key"], "ts", "10 minutes").writeStream.format("memory").queryName("cool_out")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.seq for r in spark.sql("SELECT seq FROM cool_out").collect()}
    want = {r.seq for r in cooldown_fold(df, ["key"], "ts", "10 minutes").collect()}
    assert got == want


def test_counter_delta_stream_equals_batch(spark, tmp_path):
    import random

    from vantage.operators.windows import counter_deltas
    from vantage.streaming.stateful import counter_delta_stream, use_rocksdb

    rnd = random.Random(2)
    rows, calls = [], {}
    for poll in range(1, 41):
        for q in range(5):
            if rnd.random() < 0.15:
                continue  # query missing from this poll's top list
            c = calls.get(q, 0) + rnd.choice([0, 0, 3, 10])
            if rnd.random() < 0.05:
                c = 1  # counter reset
            calls[q] = c
            rows.append(("e", q, poll, c, float(c * 7 + poll), 50.0))
    df = spark.createDataFrame(rows, "env_id string, queryid int, poll_seq long, calls long, total_ms double, "
                                     "max_ms double")
    land = str(tmp_path / "polls")
    df.filter("poll_seq <= 20").coalesce(1).write.parquet(land + "/a")
    df.filter("poll_seq > 20").coalesce(1).write.parquet(land + "/b")
    use_rocksdb(spark)
    src = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(land))
    q = (counter_delta_stream(src, ["env_id", "queryid"]).writeStream.format("memory").queryName("delta_out")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.queryid, r.poll_seq, r.delta_calls, r.duration_ms) for r in spark.sql("SELECT * FROM delta_out").collect()}
    want = {(r.queryid, r.poll_seq, r.delta_calls, r.duration_ms)
            for r in counter_deltas(df, ["env_id", "queryid"]).collect()}
    assert got == want and len(want) > 0


def test_repeat_tracker_stream_equals_batch(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    from vantage.operators.windows import flag_repeats
    from vantage.streaming.stateful import repeat_flags_stream, use_rocksdb

    rnd = random.Random(9)
    rows, t = [], datetime(2024, 1, 1)
    for i in range(300):
        t += timedelta(seconds=rnd.choice([0, 1, 1, 2, 4]))
        rows.append((f"s{rnd.randrange(2)}", t, i))
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq long")
    land = str(tmp_path / "ev")
    df.filter("seq < 150").coalesce(1).write.parquet(land + "/a")
    df.filter("seq >= 150").coalesce(1).write.parquet(land + "/b")
    use_rocksdb(spark)
    src = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(land))
    q = (repeat_flags_stream(src, ["key"], "5 seconds", 4).writeStream.format("memory").queryName("rep_out")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.seq: r.is_n1 for r in spark.sql("SELECT seq, is_n1 FROM rep_out").collect()}
    want = {r.seq: r.is_n1 for r in flag_repeats(df, ["key"], "5 seconds", 4).collect()}
    assert got == want and any(want.values())


def test_sinks_partitioned_writes(spark, tmp_path):
    from datetime import datetime

    from vantage.streaming.ingest import write_table, write_traces

    rows = [("t1", "env0", "sig-a", "tb 1", datetime(2024, 1, 1, 10)),
            ("t1", "env0", "sig-a", "tb 2", datetime(2024, 1, 2, 11)),
            ("t2", "env2", "sig-b", "tb 3", datetime(2024, 1, 2, 12))]
    df = spark.createDataFrame(rows, "tenant_id string, env_id string, signature string, traceback string, "
                                     "period timestamp")
    traces = str(tmp_path / "traces")
    write_traces(df, traces)
    assert os.path.isdir(os.path.join(traces, "tenant_id=t1", "env_id=env0", "signature=sig-a"))
    assert any(f.endswith(".gz") for _, _, fs in os.walk(traces) for f in fs)
    assert spark.read.json(traces).count() == 3
    table = str(tmp_path / "table")
    write_table(df, table)
    write_table(df, table)  # append
    back = spark.read.parquet(table)
    assert back.count() == 6 and {r.date.isoformat() for r in back.select("date").distinct().collect()} == {
        "2024-01-01", "2024-01-02"}
