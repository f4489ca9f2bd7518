"""Server-log assembly and parsing (R1, R2, R3, C8-C11, SRC1).

Lines arrive as (file, line_no, value).  R1 numbers entries with a running
count of header lines per file (bucketed by line number, so no file is sorted
in one task) and gathers each entry's continuation lines with one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions import errors as fe
from vantage.functions.sqltext import model_from_sql, parse_query_message, sql_method
from vantage.operators.windows import running_sum_in_group

# Fixed value: header layout "date time,ms pid LEVEL db logger: message".
LOG_HEADER_PATTERN = (r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})\s+(\d+)\s+"
                      r"(DEBUG|INFO|WARNING|ERROR|CRITICAL)\s+(\S+)\s+(\S+?):\s(.*)$")
MAX_LINE = 1 << 20
LINE_BUCKET = 1 << 20  # lines per bucket for running counts


def parse_timestamp(s: Column) -> Column:
    """C9: 'yyyy-MM-dd HH:mm:ss,SSS' (fallback layouts tried in turn); NULL
    when none parses."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss,SSS")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss.SSS")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def split_logger(logger: Column) -> Column:
    """C11: strip 'odoo.addons.' then 'odoo.'; module = first segment, model = rest."""
    name = F.regexp_replace(F.regexp_replace(logger, r"^odoo\.addons\.", ""), r"^odoo\.", "")
    parts = F.split(name, r"\.", 2)
    return F.struct(F.get(parts, 0).alias("module"), F.coalesce(F.get(parts, 1), F.lit("")).alias("model"))


def parsed_header(h: Column) -> list[Column]:
    """Ts, pid, level, db, logger and message of a header line."""
    parts = [F.regexp_extract(h, LOG_HEADER_PATTERN, i) for i in range(1, 7)]
    return [parse_timestamp(parts[0]).alias("ts"), *[p.alias(n) for p, n in zip(parts[1:], ("pid", "level", "db", "logger", "message"))]]


def assemble_entries(lines: DataFrame) -> DataFrame:
    """Header lines start entries, other lines append; lines before the
    first header are dropped.  Lines are capped at 1 MB."""
    v = F.substring(F.col("value"), 1, MAX_LINE)
    d = (lines.select("file", "line_no", v.alias("value"))
         .withColumn("_h", F.col("value").rlike(LOG_HEADER_PATTERN)).withColumn("_hi", F.col("_h").cast("long")))
    # entry id = running count of header lines; bucketed by line number so a
    # large file is never sorted in one task
    d = (running_sum_in_group(d, ["file"], ["line_no"], "_hi", ts_col="line_no", bucket=LINE_BUCKET,
                              out_col="entry")
         .drop("_hi").filter(F.col("entry") > 0))
    g = (d.groupBy("file", "entry")
         .agg(F.max(F.when(F.col("_h"), F.col("value"))).alias("header"),
              F.min(F.when(F.col("_h"), F.col("line_no"))).alias("line_no"),
              F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("line_no", "value")))).alias("_cont")))
    return g.select("file", "entry", "line_no", *parsed_header(F.col("header")),
                    F.array_join(F.transform("_cont", lambda x: x["value"]), "\n").alias("continuation"))


def entries_to_errors(entries: DataFrame) -> DataFrame:
    """R2 (+F13): ERROR / CRITICAL entries -> error events with type (C12),
    traceback (C13), module / model (C11) and signature (C14-C16)."""
    e = entries.filter(F.col("level").isin("ERROR", "CRITICAL"))
    full = F.when(F.col("continuation") == "", F.col("message")) \
        .otherwise(F.concat(F.col("message"), F.lit("\n"), F.col("continuation")))
    e = e.withColumn("full", full).withColumn("error_type", fe.error_type(F.col("full")))
    e = e.withColumn("traceback", fe.extract_traceback(F.col("full"))).withColumn("_lg", split_logger(F.col("logger")))
    return e.select(
        "file", "entry", "ts",
        fe.error_signature(F.col("error_type"), F.col("full"), F.col("traceback")).alias("signature"),
        "error_type", F.col("full").alias("message"),
        F.col("_lg.module").alias("module"), F.col("_lg.model").alias("model"), "traceback")


def entries_to_queries(entries: DataFrame) -> DataFrame:
    """Query log entries -> ORM events (C10 message parse, C6 model,
    C7 method); unparseable entries are dropped."""
    q = parse_query_message(F.col("logger"), F.col("message"), F.col("continuation"))
    e = entries.withColumn("_q", q).filter(F.col("_q.ok"))
    return e.select("file", "entry", "ts", F.lit("orm").alias("category"),
                    model_from_sql(F.col("_q.sql")).alias("model"),
                    sql_method(F.col("_q.sql")).alias("method"),
                    F.col("_q.duration_ms").alias("duration_ms"), F.col("_q.sql").alias("sql"))
