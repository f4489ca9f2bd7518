"""Server-log queries.  Log files are derived from the event stream: one file
per environment and day; every event writes one header line in the server's
layout; error events add a three-line traceback, and some ORM events a
continuation line of their SQL.  R1 reassembles the entries, R2 turns error
entries into error events, R3 turns query entries into ORM events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vantage.operators import logs as lo
from vantage.operators.windows import rank_in_group
from vantage.plans.errors import WS_SQL, _normalize_sql
from vantage.plans.registry import REGISTRY, query
from vantage.session import checkpoint_dir, written
from vantage.sources.tables import EVENTS_CTE_SQL, telemetry_events
from vantage.streaming import logs as sl
from vantage.streaming.stateful import rocksdb_state


def log_lines(spark, sf_dir):
    ev = telemetry_events(spark, sf_dir)
    cat = F.col("category")
    level = F.when(F.col("is_error"), "ERROR").when(cat == "sql", "DEBUG").otherwise("INFO")
    logger = (F.when(cat == "sql", "odoo.sql_db").when(cat == "orm", "odoo.models.query")
              .otherwise(F.concat(F.lit("odoo.addons."), F.col("module"), F.lit(".models."), F.col("model"))))
    qsql = F.concat(F.lit('SELECT "id" FROM "sale_'), F.col("method"), F.lit('" WHERE id = '), F.col("k").cast("string"))
    msg = (F.when(cat == "sql", F.concat(F.lit("query: "), qsql))
           .when(cat == "orm", F.concat(F.col("duration_ms").cast("string"), F.lit("."), (F.col("k") % 10).cast("string"),
                                        F.lit("ms "), qsql))
           .when(F.col("is_error"), F.concat(F.lit("Error while processing "), F.col("method")))
           .otherwise(F.concat(F.col("method"), F.lit(" done in "), F.col("duration_ms").cast("string"), F.lit("ms"))))
    header = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), (F.col("user_id") + 1000).cast("string"),
                         level, F.concat(F.lit("db_"), F.col("env_id")), F.concat(logger, F.lit(":")), msg)
    tb = F.array(header, F.lit("Traceback (most recent call last):"),
                 F.concat(F.lit('  File "/opt/app/addons/'), F.col("module"), F.lit("/models/"), F.col("model"),
                          F.lit('.py", line '), F.col("k").cast("string"), F.lit(", in "), F.col("method")),
                 F.concat(F.lit("ValueError: Record "), F.col("user_id").cast("string"), F.lit(" not found for user"),
                          F.col("k").cast("string"), F.lit("@example.com at 10.0.0."), (F.col("k") % 255).cast("string")))
    arr = (F.when(F.col("is_error"), tb)
           .when((cat == "orm") & (F.col("k") % 7 == 0), F.array(header, F.lit("  AND active = true")))
           .otherwise(F.array(header)))
    file = F.concat(F.col("env_id"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".log"))
    x = ev.select(file.alias("file"), "ts", "seq", F.posexplode(arr).alias("sub", "value"))
    # line numbers per file: a bucketed rank (no file sorted in one task)
    n = rank_in_group(x, ["file"], ["ts", "seq", "sub"], bucket="1 hour", out_col="line_no")
    return n.select("file", "line_no", "value")


def entries(spark, sf_dir):
    return lo.assemble_entries(log_lines(spark, sf_dir))


_LINES_SQL = "WITH " + EVENTS_CTE_SQL + r""",
e2 AS (
  SELECT *, env_id || '/' || strftime(ts, '%Y-%m-%d') || '.log' AS file,
         'SELECT "id" FROM "sale_' || method || '" WHERE id = ' || CAST(k AS VARCHAR) AS qsql FROM ev),
e3 AS (
  SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' ' || CAST(user_id + 1000 AS VARCHAR) || ' ' ||
         CASE WHEN is_error THEN 'ERROR' WHEN category = 'sql' THEN 'DEBUG' ELSE 'INFO' END || ' db_' || env_id || ' ' ||
         CASE WHEN category = 'sql' THEN 'odoo.sql_db' WHEN category = 'orm' THEN 'odoo.models.query'
              ELSE 'odoo.addons.' || module || '.models.' || model END || ': ' ||
         CASE WHEN category = 'sql' THEN 'query: ' || qsql
              WHEN category = 'orm' THEN CAST(duration_ms AS VARCHAR) || '.' || CAST(k % 10 AS VARCHAR) || 'ms ' || qsql
              WHEN is_error THEN 'Error while processing ' || method
              ELSE method || ' done in ' || CAST(duration_ms AS VARCHAR) || 'ms' END AS header FROM e2),
e4 AS (
  SELECT file, ts, seq,
         CASE WHEN is_error THEN [header, 'Traceback (most recent call last):',
                                  '  File "/opt/app/addons/' || module || '/models/' || model || '.py", line '
                                    || CAST(k AS VARCHAR) || ', in ' || method,
                                  'ValueError: Record ' || CAST(user_id AS VARCHAR) || ' not found for user'
                                    || CAST(k AS VARCHAR) || '@example.com at 10.0.0.' || CAST(k % 255 AS VARCHAR)]
              WHEN category = 'orm' AND k % 7 = 0 THEN [header, '  AND active = true']
              ELSE [header] END AS arr FROM e3),
x AS (SELECT file, ts, seq, unnest(arr) AS value, unnest(range(len(arr))) AS sub FROM e4),
lines AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY ts, seq, sub) AS line_no, value FROM x),
PAT AS (SELECT '^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})\s+(\d+)\s+(DEBUG|INFO|WARNING|ERROR|CRITICAL)\s+(\S+)\s+(\S+?):\s(.*)$' AS p),
d AS (SELECT lines.*, regexp_matches(value, PAT.p) AS h FROM lines, PAT),
d2 AS (SELECT *, CAST(sum(CAST(h AS INTEGER)) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS entry
       FROM d),
g AS (SELECT file, entry, max(CASE WHEN h THEN value END) AS header, min(CASE WHEN h THEN line_no END) AS line_no,
             coalesce(string_agg(CASE WHEN NOT h THEN value END, chr(10) ORDER BY line_no), '') AS continuation
      FROM d2 WHERE entry > 0 GROUP BY 1, 2),
ent AS (SELECT file, entry, line_no,
               CAST(replace(regexp_extract(header, PAT.p, 1), ',', '.') AS TIMESTAMP) AS ts,
               regexp_extract(header, PAT.p, 2) AS pid, regexp_extract(header, PAT.p, 3) AS level,
               regexp_extract(header, PAT.p, 4) AS db, regexp_extract(header, PAT.p, 5) AS logger,
               regexp_extract(header, PAT.p, 6) AS message, continuation
        FROM g, PAT)"""


@query("log_entries", _LINES_SQL + "\nSELECT * FROM ent", ops="R1 C8 C9 S8(batch)")
def q_log_entries(spark, sf_dir):
    return entries(spark, sf_dir)


def _trim(x):
    return f"regexp_replace({x}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


_FULL = "CASE WHEN continuation = '' THEN message ELSE message || chr(10) || continuation END"
_LAST = _trim(f"string_split({_trim(_FULL)}, chr(10))[-1]")
_IDENT = f"regexp_extract({_LAST}, '^([A-Za-z0-9_.]+): ', 1)"


@query("log_errors", _LINES_SQL + f""",
er AS (SELECT *, {_FULL} AS full_msg FROM ent WHERE level IN ('ERROR', 'CRITICAL')),
er2 AS (SELECT *, CASE WHEN {_trim('full_msg')} = '' THEN 'UnknownError' WHEN {_IDENT.replace(_FULL, 'full_msg')} <> ''
                       THEN {_IDENT.replace(_FULL, 'full_msg')} ELSE {_LAST.replace(_FULL, 'full_msg')} END AS error_type,
                  CASE WHEN position('Traceback (most recent call last):' IN full_msg) > 0
                       THEN substr(full_msg, position('Traceback (most recent call last):' IN full_msg)) ELSE full_msg END
                    AS traceback,
                  regexp_replace(regexp_replace(logger, '^odoo\\.addons\\.', ''), '^odoo\\.', '') AS lg
            FROM er),
er3 AS (SELECT *, regexp_extract_all(traceback, '(?m)^\\s*File "([^"]+)", line (\\d+), in (.+)$', 1) AS files,
               regexp_extract_all(traceback, '(?m)^\\s*File "([^"]+)", line (\\d+), in (.+)$', 3) AS funcs FROM er2),
er4 AS (SELECT *, CASE WHEN len(files) > 0 AND files[-1] <> '' THEN files[-1] END AS ffile,
               CASE WHEN len(files) > 0 AND files[-1] <> '' THEN funcs[-1] END AS ffunc FROM er3)
SELECT file, entry, ts,
       substr(sha256(concat_ws(chr(0), error_type,
              CASE WHEN ffile IS NULL THEN NULL
                   WHEN position('/addons/' IN ffile) > 0 THEN regexp_extract(ffile, '^.*/addons/(.*)$', 1)
                   WHEN position('/odoo/' IN ffile) > 0 THEN regexp_extract(ffile, '^.*/odoo/(.*)$', 1)
                   ELSE string_split(ffile, '/')[-1] END,
              ffunc, __NORM__)), 1, 16) AS signature,
       error_type, full_msg AS message,
       string_split(lg, '.')[1] AS module,
       CASE WHEN position('.' IN lg) > 0 THEN substr(lg, position('.' IN lg) + 1) ELSE '' END AS model,
       traceback
FROM er4""".replace("__NORM__", _normalize_sql("full_msg")), ops="R2 F13 C11 C12 C13 C14 C16")
def q_log_errors(spark, sf_dir):
    return lo.entries_to_errors(entries(spark, sf_dir))


@query("log_queries", _LINES_SQL + """,
q AS (SELECT *, CASE WHEN logger = 'odoo.models.query' AND regexp_matches(message, '^(\\d+(?:\\.\\d+)?)ms\\s+(.+)$')
                       THEN regexp_extract(message, '^(\\d+(?:\\.\\d+)?)ms\\s+(.+)$', 2)
                     WHEN logger = 'odoo.sql_db' AND regexp_matches(message, '^query:\\s+(.+)$')
                       THEN regexp_extract(message, '^query:\\s+(.+)$', 1) END AS sql0,
             CASE WHEN logger = 'odoo.models.query'
                  THEN CAST(trunc(CAST(regexp_extract(message, '^(\\d+(?:\\.\\d+)?)ms\\s+(.+)$', 1) AS DOUBLE))
                            AS INTEGER) ELSE 0 END AS duration_ms
      FROM ent),
q2 AS (SELECT *, CASE WHEN coalesce(continuation, '') <> '' THEN sql0 || ' ' || replace(continuation, chr(10), ' ')
                      ELSE sql0 END AS sql FROM q WHERE sql0 IS NOT NULL)
SELECT file, entry, ts, 'orm' AS category,
       replace(regexp_extract(sql, '(?i)(?:FROM|INTO|UPDATE)\\s+"(\\w+)"', 1), '_', '.') AS model,
       CASE WHEN length(regexp_replace(sql, '^\\s+|\\s+$', '', 'g')) < 6 THEN 'unknown'
            WHEN starts_with(upper(regexp_replace(sql, '^\\s+|\\s+$', '', 'g')), 'SELECT') THEN 'read'
            WHEN starts_with(upper(regexp_replace(sql, '^\\s+|\\s+$', '', 'g')), 'INSERT') THEN 'create'
            WHEN starts_with(upper(regexp_replace(sql, '^\\s+|\\s+$', '', 'g')), 'UPDATE') THEN 'write'
            WHEN starts_with(upper(regexp_replace(sql, '^\\s+|\\s+$', '', 'g')), 'DELETE') THEN 'unlink'
            ELSE 'unknown' END AS method,
       coalesce(duration_ms, 0) AS duration_ms, sql
FROM q2""", ops="R3 C6 C7 C10")
def q_log_queries(spark, sf_dir):
    return lo.entries_to_queries(entries(spark, sf_dir))


# ------------------------------------------------- the same logs as a stream (S8, SRC1)
# Segments are landed in two waves, so that entries begin in one micro-batch and end in another;
# a segment of one empty line ends each log.  A log is rotated into a few segments of whole
# fifties of lines, named by the fifty that they begin with: a segment is a file, and the number of files
# must not grow with the lines of a log, nor a file with them without end.

SEGMENT_LINES = 50
SEGMENTS_A_LOG = 8
LONGEST_SEGMENT = 20_000  # lines; a multiple of SEGMENT_LINES


def land_segments(spark, sf_dir, path):
    """Two functions that land the first segment of every log, and all others."""
    numbered = written(log_lines(spark, sf_dir))  # read for the lengths and for the segments
    fifties = F.ceil(F.max("line_no") / (SEGMENTS_A_LOG * SEGMENT_LINES))
    lengths = numbered.groupBy(F.col("file").alias("log")).agg(F.least(fifties, F.lit(LONGEST_SEGMENT // SEGMENT_LINES)).alias("fifties"))
    n = F.floor((F.col("line_no") - 1) / (SEGMENT_LINES * F.col("fifties"))) * F.col("fifties")
    lines = F.sort_array(F.collect_list(F.struct("line_no", "value")))  # of one segment
    cut = (numbered.join(lengths, F.col("file").eqNullSafe(F.col("log"))).groupBy("log", n.alias("n"))
           .agg(F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias("value"))
           .select("value", "log", F.format_string("%09d", "n").alias("segment")))
    cut = written(cut)  # landed in two parts
    first = F.col("segment") == "000000000"
    ends = cut.filter(first).select(F.lit("").alias("value"), "log", F.lit("end").alias("segment"))

    def land(rows):
        rows.write.mode("append").partitionBy("log", "segment").text(path)

    return lambda: land(cut.filter(first)), lambda: land(cut.filter(~first).unionByName(ends))


@query("log_stream", REGISTRY["log_entries"].sql.replace("SELECT file, entry, line_no,", "SELECT file, line_no,"), ops="S8 SRC1 R1 C8 C9")
def q_log_stream(spark, sf_dir):
    folder = f"{checkpoint_dir(spark)}/log-stream-{uuid.uuid4().hex}"
    with rocksdb_state(spark):
        for land in land_segments(spark, sf_dir, f"{folder}/in"):
            land()
            sl.run_entries(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", idle_ms=3_600_000)
    e = spark.read.parquet(f"{folder}/out")
    line = F.col("segment").cast("long") * SEGMENT_LINES + F.col("line_no")
    return e.select(F.col("log").alias("file"), line.alias("line_no"), "ts", "pid", "level", "db", "logger", "message", "continuation")
