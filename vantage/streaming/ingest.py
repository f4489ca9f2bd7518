"""Structured Streaming twins (S1, S5, S6, S8, S9, SRC4, SRC7, SNK1-SNK4).

* ``window_stats_stream``: event-time 30 s tumbling statistics with a
  watermark, append mode (S1).  Exact p95 per window uses the sorted array of
  the group's durations: a 30 s group of one (model, method) is bounded by
  time, so the array stays small.
* ``ingest_batches``: ``foreachBatch`` ingest (S5 / S6 / R20): valid rows
  are folded into the error-group state table, invalid rows go to a
  quarantine table; every output is written under ``batch=<id>`` with
  overwrite, so a retried micro-batch (lost executor, restart) replaces its
  own output instead of duplicating it.
Checkpoints and state live under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.operators import errors as eo
from vantage.session import checkpoint_dir
from vantage.sources.tables import bind_events

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """SRC1 / SRC7: a file source over landed event files (Parquet)."""
    return (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files)
            .parquet(path))


def window_stats_stream(events: DataFrame, window: str = "30 seconds", watermark: str = "1 minute",
                        p: int = 95) -> DataFrame:
    """A7 on event time; append mode emits each window once the watermark
    passes its end."""
    ev = bind_events(events).withWatermark("ts", watermark)
    g = (ev.filter((F.col("model") != "") | (F.col("method") != ""))
         .groupBy(F.window("ts", window).alias("w"), "env_id", "model", "method")
         .agg(F.count(F.lit(1)).alias("call_count"),
              F.sum(F.col("duration_ms").cast("long")).alias("total_ms"),
              F.max("duration_ms").alias("max_ms"),
              F.array_sort(F.collect_list("duration_ms")).alias("_d"),
              F.min(F.when(F.col("sql") != "", F.struct("ts", "seq", "sql"))).alias("_first")))
    n = F.col("call_count")
    idx = F.least(F.floor(n * p / 100), n - 1) + 1
    return g.select(F.col("w.start").alias("period"), "env_id", "model", "method", "call_count", "total_ms",
                    "max_ms", F.element_at("_d", idx.cast("int")).alias("p95_ms"),
                    F.coalesce(F.col("_first.sql"), F.lit("")).alias("sample_sql"))


def valid_events(df: DataFrame) -> DataFrame:
    """S6 validity: key fields present and parseable."""
    return df.withColumn("_valid", F.col("event_id").isNotNull() & F.col("ts").isNotNull()
                         & F.col("event_type").isNotNull() & F.col("user_id").isNotNull())


def ingest_batches(spark: SparkSession, out_dir: str | None = None):
    """Returns a ``foreachBatch`` function writing error-group deltas and the
    quarantine of one micro-batch, idempotently by batch id (S5 / S6)."""
    base = out_dir or os.path.join(checkpoint_dir(spark), "ingest")

    def handle(batch: DataFrame, batch_id: int) -> None:
        v = valid_events(batch)
        good = bind_events(v.filter("_valid").drop("_valid"))
        bad = v.filter(~F.col("_valid")).drop("_valid")
        groups = eo.group_errors(eo.error_events(good))
        (groups.withColumn("batch", F.lit(batch_id))
         .write.mode("overwrite").parquet(os.path.join(base, "error_group_deltas", f"batch={batch_id}")))
        (bad.withColumn("batch", F.lit(batch_id))
         .write.mode("overwrite").parquet(os.path.join(base, "quarantine", f"batch={batch_id}")))

    return handle


def run_ingest(spark: SparkSession, source: str, out_dir: str | None = None, ckpt: str | None = None):
    """Runs the ingest stream to completion over what is available (SRC7 /
    SNK1); returns the finished query."""
    ck = ckpt or os.path.join(checkpoint_dir(spark), "ingest-ckpt")
    q = (event_stream(spark, source).writeStream.foreachBatch(ingest_batches(spark, out_dir))
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def error_groups_from_deltas(spark: SparkSession, out_dir: str) -> DataFrame:
    """U1 over all written deltas: the merged error-group table."""
    d = spark.read.parquet(os.path.join(out_dir, "error_group_deltas"))
    order = F.struct("batch")
    return (d.groupBy("env_id", "signature")
            .agg(F.sum("occurrence_count").alias("occurrence_count"),
                 F.min_by("first_seen", order).alias("first_seen"), F.max_by("last_seen", order).alias("last_seen"),
                 F.max_by("message", order).alias("message"), F.min_by("error_type", order).alias("error_type"),
                 F.min_by("module", order).alias("module"), F.min_by("model", order).alias("model"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("affected_users")))).alias("affected_users")))


def write_traces(df: DataFrame, path: str) -> None:
    """SNK2: raw traces as gzip JSON partitioned by tenant / env / signature."""
    (df.write.mode("append").partitionBy("tenant_id", "env_id", "signature")
     .option("compression", "gzip").json(path))


def write_table(df: DataFrame, path: str, date_col: str = "period") -> None:
    """SNK1: append partitioned by date (retention drops whole partitions)."""
    df.withColumn("date", F.to_date(date_col)).write.mode("append").partitionBy("date").parquet(path)
