"""Streaming view of the newest log lines (SNK3, W5): the last ``n`` lines of each environment,
gone when an environment has been idle for a while.

The lines are list state with a time to live, so an environment that comes back after it
starts anew.  A micro-batch emits the whole tail of each environment that had new lines; it
replaces that environment's folder of the view, which a retried batch writes again alike.
The time of a batch stands with its rows, and reading leaves out tails past their life.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vantage.streaming.stateful import rocksdb_state

_LINE = T.StructType([T.StructField("file", T.StringType()), T.StructField("line_no", T.LongType()),
                      T.StructField("value", T.StringType())])
_VIEW = "env_id string, file string, line_no long, value string, seen_at timestamp"
TAIL, LIFE = 1000, timedelta(hours=24)


class TailProcessor(StatefulProcessor):
    """Keeps the ``n`` greatest lines of a key by (file, line_no); a line that comes again counts once."""

    def __init__(self, n: int, life: timedelta):
        self.n = n
        self.life_ms = int(life.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("tail", _LINE, ttlDurationMs=self.life_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.lines.get()] if self.lines.exists() else []
        for pdf in rows:  # a part at a time: no more than n lines and one part are held
            new = set(zip(pdf["file"], pdf["line_no"].astype("int64").tolist(), pdf["value"], strict=True))
            kept = heapq.nlargest(self.n, new.union(kept), key=lambda x: x[:2])
        kept.sort(key=lambda x: x[:2])
        self.lines.put(kept)
        out = pd.DataFrame(kept, columns=["file", "line_no", "value"])
        out.insert(0, "env_id", key[0])
        out["seen_at"] = pd.Timestamp(timerValues.getCurrentProcessingTimeInMs(), unit="ms")
        yield out

    def close(self) -> None:
        pass


def tail_stream(lines: DataFrame, n: int = TAIL, life: timedelta = LIFE) -> DataFrame:
    """(env_id, file, line_no, value, seen_at): the whole tail of each environment with new lines.
    Rows without env_id, file or line_no have no place in a tail and are left out."""
    if n < 1:
        raise ValueError("a tail has at least one line")
    return (lines.select("env_id", "file", F.col("line_no").cast("long").alias("line_no"), "value")
            .dropna(subset=["env_id", "file", "line_no"]).groupBy("env_id")
            .transformWithStateInPandas(TailProcessor(n, life), _VIEW, "Update", "ProcessingTime"))


def run_tail(lines: DataFrame, view: str, checkpoint: str, n: int = TAIL, life: timedelta = LIFE) -> None:
    """Brings the view up to date with all lines landed since the last run.

    A query with a time to live never runs dry, so it is stopped after a batch without new lines."""
    def replace(batch: DataFrame, _: int) -> None:
        (batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("env_id").parquet(view))

    with rocksdb_state(lines.sparkSession):
        query = (tail_stream(lines, n, life).writeStream.outputMode("update").foreachBatch(replace)
                 .option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start())
        while query.isActive and (query.lastProgress is None or query.lastProgress["numInputRows"] > 0):
            time.sleep(0.05)
        if query.exception() is not None:
            raise query.exception()
        query.stop()


def read_tail(spark: SparkSession, view: str, life: timedelta = LIFE, now: Column | None = None) -> DataFrame:
    """(env_id, pos, file, line_no, value): the view without idle environments, lines counted from 0."""
    since = (F.current_timestamp() if now is None else now) - F.lit(life)
    rows = spark.read.schema(_VIEW).parquet(view).filter(F.col("seen_at") > since)
    order = Window.partitionBy("env_id").orderBy("file", "line_no")  # a tail's lines at most
    return rows.select("env_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "file", "line_no", "value")
