"""Custom streaming state (S3 alert cool-down, S4 counter deltas) with
``transformWithStateInPandas``; state lives in the RocksDB state store under
the query's checkpoint, so a restarted or retried query resumes exactly.

Within a micro-batch rows of a key are processed in event order; across
micro-batches in arrival order (as the reference processes its queue)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vantage.operators.windows import interval_us

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@contextmanager
def rocksdb_state(spark):
    """RocksDB state stores inside the block; the session's setting comes back behind it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    use_rocksdb(spark)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class CooldownProcessor(StatefulProcessor):
    """S3: emit a breach unless one was emitted for the key less than
    ``cooldown_us`` earlier (suppressed ones do not extend the gap)."""

    def __init__(self, cooldown_us: int, ts_col: str):
        self.cooldown_us = cooldown_us
        self.ts_col = ts_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_kept", T.StructType([T.StructField("t", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        t = pdf[self.ts_col].astype("int64") // 1000  # ns -> us
        order = t.sort_values(kind="mergesort").index
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for i in order:
            x = int(t[i])
            if last is None or x - last >= self.cooldown_us:
                keep.append(i)
                last = x
        if last is not None:
            self.last.update((last,))
        yield pdf.loc[keep]

    def close(self) -> None:
        pass


def cooldown_stream(breaches: DataFrame, keys: list[str], ts_col: str, cooldown: str) -> DataFrame:
    """S3 on a streaming DataFrame of breaches (append output)."""
    return (breaches.groupBy(*keys)
            .transformWithStateInPandas(CooldownProcessor(interval_us(cooldown), ts_col), breaches.schema,
                                        "Append", "None"))


class CounterDeltaProcessor(StatefulProcessor):
    """Per (env, query id) keep the previous poll's counters; emit deltas
    for consecutive polls with more calls (same rules as W2)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prev = handle.getValueState("prev", T.StructType([
            T.StructField("poll_seq", T.LongType()), T.StructField("calls", T.LongType()),
            T.StructField("total_ms", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("poll_seq", kind="mergesort")
        prev = self.prev.get() if self.prev.exists() else None
        out = []
        for r in pdf.itertuples(index=False):
            if prev is not None and r.poll_seq - prev[0] == 1:
                dc = int(r.calls) - int(prev[1])
                if dc > 0:
                    dm = float(r.total_ms) - float(prev[2])
                    avg = int(dm / dc)  # towards zero
                    out.append({**r._asdict(), "delta_calls": dc, "delta_ms": dm, "avg_ms": avg,
                                "duration_ms": int(r.max_ms) if avg == 0 else avg})
            prev = (int(r.poll_seq), int(r.calls), float(r.total_ms))
        if prev is not None:
            self.prev.update(prev)
        cols = list(pdf.columns) + ["delta_calls", "delta_ms", "avg_ms", "duration_ms"]
        yield pd.DataFrame(out, columns=cols)

    def close(self) -> None:
        pass


def counter_delta_stream(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    schema = T.StructType(snapshots.schema.fields + [
        T.StructField("delta_calls", T.LongType()), T.StructField("delta_ms", T.DoubleType()),
        T.StructField("avg_ms", T.IntegerType()), T.StructField("duration_ms", T.IntegerType())])
    return snapshots.groupBy(*keys).transformWithStateInPandas(CounterDeltaProcessor(), schema, "Append", "None")




class RepeatTracker(StatefulProcessor):
    """Per key (env, SQL signature) keep the timestamps inside the window;
    an event is flagged when, after pruning older ones and adding itself, at
    least ``threshold`` remain.  Only the window's timestamps are kept."""

    def __init__(self, window_us: int, threshold: int):
        self.window_us = window_us
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", T.StructType([T.StructField("t", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        t = (pdf["ts"].astype("int64") // 1000).to_numpy()
        order = sorted(range(len(pdf)), key=lambda i: (t[i], pdf["seq"].iat[i]))
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        flags = [False] * len(pdf)
        for i in order:
            cut = t[i] - self.window_us
            recent = [x for x in recent if x >= cut]
            recent.append(int(t[i]))
            flags[i] = len(recent) >= self.threshold
        self.recent.clear()
        if recent:
            self.recent.put([(x,) for x in recent])
        out = pdf.copy()
        out["is_n1"] = flags
        yield out

    def close(self) -> None:
        pass


def repeat_flags_stream(events: DataFrame, keys: list[str], window: str, threshold: int) -> DataFrame:
    """S2 on a streaming DataFrame that has ``ts`` and ``seq``."""
    schema = T.StructType(events.schema.fields + [T.StructField("is_n1", T.BooleanType())])
    return events.groupBy(*keys).transformWithStateInPandas(
        RepeatTracker(interval_us(window), threshold), schema, "Append", "None")
