"""Streaming log assembly (S8) from a text source of rotated segments (SRC1).

A log is a folder of segments, ``log=<name>/segment=<name>/``; names of segments sort in time
order, and a segment is landed when it is complete.  Inside a segment entries are cut out by
one regular-expression split, without state and without Python.  Only what touches a segment's
edge is stateful: lines before the first header belong to the entry that the segment before
left open, and the last entry stays open.  So a log has two rows a segment in its task,
however many lines it has.

An open entry is kept in the state store (header, and a list of continuations) and comes out
when the next header of its log arrives, when a segment of one empty line ends its log, or when its log has
been idle for a while: a processing-time timer flushes it.  Lines before a log's first header are dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vantage.operators.logs import LOG_HEADER_PATTERN, MAX_LINE, parsed_header

SEGMENTS = "value string, log string, segment string"
_OPEN = T.StructType([T.StructField(c, T.StringType()) for c in ("segment", "header")] + [T.StructField("line_no", T.LongType())])
_LINES = T.StructType([T.StructField("lines", T.StringType())])
_ENTRY = "log string, segment string, line_no long, header string, continuation string"
#: Entries whose lines are summed up together.
BLOCK = 64
#: Zero-width place in front of a header line; only \n ends a line.
_BEFORE_HEADER = "(?md)(?=" + LOG_HEADER_PATTERN + ")"


def segment_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """SRC1: one row for each landed segment: its whole text, log and segment."""
    reader = spark.readStream.schema(SEGMENTS).option("wholetext", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format("text").load(path)


def _cut(lines: Column) -> Column:
    """Lines of at most ``MAX_LINE`` characters, joined again."""
    return F.array_join(F.transform(F.split(lines, "\n", -1), lambda x: F.substring(x, 1, MAX_LINE)), "\n")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbered(parts: Column) -> Column:
    """Each of ``parts`` with the number of lines before it, and of all parts (n).

    Lines are summed up by blocks, so that no part adds up all before it."""
    def total(sizes: Column) -> Column:
        return F.aggregate(sizes, F.lit(0), lambda a, x: a + x)

    def lines_in(p: Column) -> Column:
        return F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))

    def in_block(parts: Column, block: Column, i: Column, before: Column) -> Column:
        return F.transform(block, lambda _, j: F.struct(
            F.get(parts, i * BLOCK + j).alias("part"), (before + total(F.slice(block, 1, j))).alias("before"), F.size(parts).alias("n")))

    def in_blocks(parts: Column, blocks: Column) -> Column:
        return _let(F.transform(blocks, total), lambda sums: F.flatten(F.transform(
            blocks, lambda block, i: _let(total(F.slice(sums, 1, i)), lambda before: in_block(parts, block, i, before)))))

    return _let(parts, lambda parts: _let(F.transform(parts, lines_in), lambda sizes: _let(
        F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(BLOCK)), lambda b: F.slice(sizes, b + 1, BLOCK)),
        lambda blocks: in_blocks(parts, blocks))))


def pieces(segments: DataFrame) -> DataFrame:
    """(log, segment, pos, line_no, kind, header, lines): the entries of each segment; kind is ``head`` for lines
    before its first header, ``tail`` for its last entry, ``entry`` for those in between; a segment of one empty line is ``end``."""
    text = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\n\\z", "")
    each = (segments.select("log", "segment", F.posexplode(_numbered(F.split(text, _BEFORE_HEADER))).alias("pos", "p"))
            .select("log", "segment", "pos", "p.part", "p.before", "p.n"))
    part = F.regexp_replace("part", "\n\\z", "")
    is_entry = part.rlike("(?d)" + LOG_HEADER_PATTERN.rstrip("$") + "(\\n|\\z)")
    has_more = F.instr(part, "\n") > 0
    return each.select(
        "log", "segment", "pos", (F.col("before") + 1).cast("long").alias("line_no"),
        F.when((part == "") & (F.col("n") == 1), "end").when(~is_entry, "head").when(F.col("pos") == F.col("n") - 1, "tail").otherwise("entry").alias("kind"),
        F.when(is_entry, F.substring(F.substring_index(part, "\n", 1), 1, MAX_LINE)).alias("header"),
        F.when(~is_entry, _cut(part)).when(has_more, _cut(F.substr(part, F.instr(part, "\n") + 1))).alias("lines"))


class EdgeProcessor(StatefulProcessor):
    """Joins what segments leave open; ``idle_ms`` after a log's last segment its open entry comes out."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.lines = handle.getListState("lines", _LINES)

    def _stored(self) -> tuple | None:
        """(segment, header, line_no, continuations) of the open entry, if there is one."""
        if not self.open.exists():
            return None
        return (*self.open.get(), [r[0] for r in self.lines.get()] if self.lines.exists() else [])

    def _frame(self, log: str, closed: list[tuple]) -> pd.DataFrame:
        rows = [(log, segment, line_no, header, "\n".join(parts)) for segment, header, line_no, parts in closed]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _ENTRY.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # entries that begin and end in this batch never go through the state store
        closed: list[tuple] = []
        entry = self._stored()
        known = len(entry[3]) if entry else None  # continuations that the store has
        edges = pd.concat(list(rows), ignore_index=True).sort_values(["segment", "pos"])
        for r in edges.itertuples():
            if r.kind in ("tail", "end") and entry:
                closed.append(entry)
                entry, known = None, None
            if r.kind == "tail":
                entry = (r.segment, r.header, r.line_no, [])
            if r.lines is not None and entry:
                entry[3].append(r.lines)
        if known is None:
            self.open.clear()
            self.lines.clear()
        if entry:
            if known is None:
                self.open.update(entry[:3])
            for text in entry[3][known or 0:]:
                self.lines.appendValue((text,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if entry:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._frame(key[0], closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entry = self._stored()
        self.open.clear()
        self.lines.clear()
        yield self._frame(key[0], [entry] if entry else [])

    def close(self) -> None:
        pass


def entry_stream(segments: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """Log, segment and line_no (of the header), the parsed header and the continuation of every entry."""
    cut = pieces(segments)
    whole = cut.filter("kind = 'entry'").select("log", "segment", "line_no", "header", F.coalesce("lines", F.lit("")).alias("continuation"))
    edges = (cut.filter("kind <> 'entry'").groupBy("log")
             .transformWithStateInPandas(EdgeProcessor(idle_ms), _ENTRY, "Append", "ProcessingTime"))
    return whole.unionByName(edges).select("log", "segment", "line_no", *parsed_header(F.col("header")), "continuation")


def run_entries(spark: SparkSession, path: str, out: str, checkpoint: str, idle_ms: int = 60_000, tick: str = "1 second") -> None:
    """Assembles what has landed since the last run into Parquet files at ``out``, and flushes idle logs.

    Timers keep a query going, so it runs until a batch without new segments is through; what
    that leaves open stays in the checkpoint for the next run.  A first batch without segments does not
    count: it may repeat one that the last run was stopped in."""
    query = (entry_stream(segment_stream(spark, path), idle_ms).writeStream.format("parquet").outputMode("append")
             .option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=tick).start())
    idle = set()
    while query.isActive:
        last = query.lastProgress
        if last is not None and last["numInputRows"] == 0:
            idle.add(last["timestamp"])
            if len(idle) > 1 or any(p["numInputRows"] > 0 for p in query.recentProgress):
                break
        time.sleep(0.05)
    if query.exception() is not None:
        raise query.exception()
    query.stop()
