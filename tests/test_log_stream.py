"""Streaming log assembly: entries over segments and micro-batches, flush by timer."""

import os
import time

import pytest

from vantage.operators import logs as lo
from vantage.streaming import logs as sl
from vantage.streaming.stateful import rocksdb_state

HEAD = "2024-01-01 00:00:{:02d},000 12 INFO db odoo.addons.sale: message {}"
FIELDS = ["log", "pid", "level", "db", "logger", "message", "continuation"]


@pytest.fixture
def logs(spark, tmp_path):
    class Logs:
        def land(self, log, segment, *lines, end="\n"):
            folder = tmp_path / "in" / f"log={log}" / f"segment={segment}"
            os.makedirs(folder)
            (folder / "part.txt").write_bytes((end.join(lines) + end).encode())

        def run(self, idle_ms=3_600_000):
            with rocksdb_state(spark):
                sl.run_entries(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), idle_ms)
            return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*FIELDS, "segment", "line_no").collect())

    return Logs()


def batch(spark, log, lines):
    rows = [(log, i, v) for i, v in enumerate(lines, 1)]
    got = lo.assemble_entries(spark.createDataFrame(rows, "file string, line_no long, value string")).withColumnRenamed("file", "log")
    return sorted(tuple(r) for r in got.select(*FIELDS).collect())


def test_entries_over_batches_equal_the_batch_operator(spark, logs):
    a = [["lost", HEAD.format(1, 1), "c1", "", "c2", HEAD.format(2, 2), "x"], ["y"], ["z", HEAD.format(3, 3)], [HEAD.format(4, 4), "  at end"]]
    b = [[HEAD.format(1, 1), "1" * 9, "2024-01-01 no header"], ["no header here"]]
    logs.land("a", "000", *a[0])
    logs.land("b", "000", *b[0], end="\r\n")
    first = logs.run()
    assert [r[5] for r in first] == ["message 1"]  # the last entry of each log is open
    logs.land("a", "001", *a[1])
    logs.land("a", "002", *a[2])
    assert [r[5:7] for r in logs.run()] == [("message 1", "c1\n\nc2"), ("message 2", "x\ny\nz")]  # over three segments and two batches
    logs.land("a", "003", *a[3])
    logs.land("b", "001", *b[1])
    logs.land("a", "end")
    logs.land("b", "end")
    got = logs.run()
    want = batch(spark, "a", sum(a, [])) + batch(spark, "b", sum(b, []))
    assert [r[:7] for r in got] == want
    assert [r[7:] for r in got if r[0] == "a"] == [("000", 2), ("000", 6), ("002", 2), ("003", 1)]
    assert logs.run() == got  # nothing new, nothing twice


def test_idle_log_is_flushed_by_its_timer(spark, logs):
    logs.land("a", "000", HEAD.format(1, 1), "more")
    logs.land("b", "000", "never a header")
    logs.run(idle_ms=0)
    time.sleep(0.1)
    got = logs.run(idle_ms=0)
    assert [r[5:7] for r in got] == [("message 1", "more")]
    logs.land("a", "001", "behind the flush", HEAD.format(2, 2))
    logs.land("a", "end")
    assert [r[5:7] for r in logs.run()] == [("message 1", "more"), ("message 2", "")]


def test_files_of_a_log_do_not_grow_with_its_lines(spark, tmp_path):
    from pyspark.sql import functions as F

    from vantage.plans import logs as pl

    def landed(n):
        sf, path = str(tmp_path / f"sf{n}"), str(tmp_path / f"in{n}")
        k = F.col("id")
        spark.range(n).select(
            k.alias("event_id"), F.timestamp_seconds(1_704_100_000 + F.floor(k / 10)).cast("timestamp_ntz").alias("ts"), F.lit(3).cast("long").alias("user_id"),
            F.when(k % 9 == 0, "error").otherwise("click").alias("event_type"), F.lit(1.5).alias("value"),
            F.concat(F.lit('{"k": '), (k % 20).cast("string"), F.lit("}")).alias("props")).write.parquet(f"{sf}/events.parquet")
        for land in pl.land_segments(spark, sf, path):
            land()
        return sf, path, len([f for _, _, files in os.walk(path) for f in files if f.endswith(".txt")])

    sf, path, few = landed(600)
    assert few > 3  # entries cross segments
    lines = pl.log_lines(spark, sf).select("file", "value").withColumnRenamed("file", "log")
    texts = spark.read.schema("value string, log string, segment string").text(path).filter("segment <> 'end'").select("log", "value")
    assert texts.exceptAll(lines).isEmpty() and lines.exceptAll(texts).isEmpty() and not texts.isEmpty()
    assert landed(6000)[2] <= pl.SEGMENTS_A_LOG + 1 and few <= pl.SEGMENTS_A_LOG + 1
