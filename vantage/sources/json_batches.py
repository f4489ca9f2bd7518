"""Aggregated-batch JSON (SRC4, SRC5, N6, P2).

Batches are JSON envelopes {env_id, period, duration_ms, orm_stats[], summary}
as shipped by agents (gzip files are read natively by ``spark.read.json``).
They are parsed with an explicit schema in PERMISSIVE mode: a malformed
document yields NULL and is dropped with the other invalid batches (empty
env_id), never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORM_STAT = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("call_count", T.LongType()), T.StructField("total_ms", T.LongType()),
    T.StructField("avg_ms", T.DoubleType()), T.StructField("max_ms", T.IntegerType()),
    T.StructField("p95_ms", T.IntegerType()), T.StructField("n1_detected", T.BooleanType()),
    T.StructField("sample_sql", T.StringType()),
])
SUMMARY = T.StructType([
    T.StructField("total_queries", T.LongType()), T.StructField("total_duration_ms", T.LongType()),
    T.StructField("slow_queries", T.LongType()), T.StructField("n1_patterns", T.LongType()),
    T.StructField("errors", T.LongType()),
])
BATCH = T.StructType([
    T.StructField("env_id", T.StringType()), T.StructField("period", T.TimestampType()),
    T.StructField("duration_ms", T.IntegerType()), T.StructField("orm_stats", T.ArrayType(ORM_STAT)),
    T.StructField("summary", SUMMARY),
])


def read_batches(spark, path: str) -> DataFrame:
    """SRC4: landed batch files (plain or .gz), explicit schema."""
    return spark.read.schema(BATCH).option("mode", "PERMISSIVE").json(path)


def parse_batches(json_col: Column) -> Column:
    return F.from_json(json_col, BATCH, {"mode": "PERMISSIVE"})


def valid_batches(batches: DataFrame) -> DataFrame:
    """SRC4 validity: parsed and with a non-empty env_id."""
    return batches.filter(F.coalesce(F.col("env_id"), F.lit("")) != "")


def stats_rows(batches: DataFrame) -> DataFrame:
    """Batch -> one row per ORM stat, with P2 NULL-ification on write (0 max /
    p95 and empty SQL become NULL)."""
    s = batches.select("env_id", "period", F.explode("orm_stats").alias("s"))
    return s.select("env_id", "period", "s.model", "s.method", "s.call_count", "s.total_ms", "s.avg_ms",
                    F.nullif(F.col("s.max_ms"), F.lit(0)).alias("max_ms"),
                    F.nullif(F.col("s.p95_ms"), F.lit(0)).alias("p95_ms"),
                    "s.n1_detected",
                    F.nullif(F.col("s.sample_sql"), F.lit("")).alias("sample_sql"))


def envelopes(stats: DataFrame, summary: DataFrame, window_ms: int) -> DataFrame:
    """Build batch JSON documents from window stats and summaries (the agent
    side of SRC4); one document per (env, window)."""
    st = (stats.groupBy("env_id", "period")
          .agg(F.collect_list(F.struct(*[F.col(f.name) for f in ORM_STAT.fields])).alias("orm_stats")))
    sm = summary.select("env_id", "period", F.struct(*[F.col(f.name) for f in SUMMARY.fields]).alias("summary"))
    doc = sm.join(st, ["env_id", "period"], "left").select(
        F.to_json(F.struct("env_id", "period", F.lit(window_ms).alias("duration_ms"),
                           F.coalesce("orm_stats", F.array().cast(T.ArrayType(ORM_STAT))).alias("orm_stats"),
                           "summary")).alias("json"))
    return doc


# ------------------------------------------------------------ error batches (SRC5)

ERROR_EVENT = T.StructType([
    T.StructField("signature", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("module", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("traceback", T.StringType()),
    T.StructField("context", T.StructType([T.StructField("uid", T.IntegerType())])),
])
ERROR_BATCH = T.StructType([
    T.StructField("env_id", T.StringType()), T.StructField("sent_at", T.TimestampType()),
    T.StructField("events", T.ArrayType(ERROR_EVENT)), T.StructField("spike_threshold", T.IntegerType()),
])
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def error_envelopes(err: DataFrame, window: str, spike_threshold: int) -> DataFrame:
    """Error rows (``operators.errors.error_events``) -> one JSON document per
    environment and ``window``, events in arrival order."""
    event = F.struct("seq", "signature", F.col("error_type").alias("type"), "message", "module", "model",
                     F.col("ts").alias("timestamp"), F.struct(F.col("user_id").alias("uid")).alias("context"))
    docs = (err.groupBy("env_id", F.window("ts", window)["end"].alias("sent_at"))
            .agg(F.sort_array(F.collect_list(event)).alias("events"))
            .withColumn("events", F.transform("events", lambda e: e.dropFields("seq")))
            .withColumn("spike_threshold", F.lit(spike_threshold)))
    return docs.select(F.to_json(F.struct("env_id", "sent_at", "events", "spike_threshold"), _MICROS).alias("value"))


def read_error_batches(spark, path: str) -> DataFrame:
    """SRC5: landed error batches (JSON lines, plain or .gz), explicit schema."""
    return spark.read.schema(ERROR_BATCH).options(mode="PERMISSIVE", **_MICROS).json(path)


def error_rows(batches: DataFrame) -> DataFrame:
    """Error batch -> one row per event, ``seq`` = (sent_at, position): empty module, model and
    traceback are NULL, user 0 is none.  Batches without env_id or events and events
    without signature give no rows."""
    e = valid_batches(batches).select("env_id", "sent_at", "spike_threshold", F.posexplode("events").alias("pos", "e"))

    def filled(c):
        return F.nullif(F.col(f"e.{c}"), F.lit("")).alias(c)

    return e.filter(F.coalesce(F.col("e.signature"), F.lit("")) != "").select(
        "env_id", F.struct("sent_at", "pos").alias("seq"), F.col("e.timestamp").alias("ts"), F.col("e.signature"),
        F.col("e.type").alias("error_type"), F.col("e.message"), filled("module"), filled("model"),
        filled("traceback"), F.nullif(F.col("e.context.uid"), F.lit(0)).alias("user_id"), "spike_threshold")


# ------------------------------------------------ breakdowns and envelopes

BREAKDOWN = T.StructType([
    T.StructField("sql_ms", T.LongType()), T.StructField("sql_count", T.LongType()),
    T.StructField("orm_ms", T.LongType()), T.StructField("orm_count", T.LongType()),
    T.StructField("python_ms", T.LongType()),
    T.StructField("functions", T.ArrayType(T.StructType([
        T.StructField("model", T.StringType()), T.StructField("method", T.StringType()),
        T.StructField("category", T.StringType()), T.StructField("duration_ms", T.LongType()),
        T.StructField("call_count", T.LongType()), T.StructField("pct", T.DoubleType())]))),
])
HEARTBEAT = T.StructType([T.StructField("agent_version", T.StringType()), T.StructField("status", T.StringType()),
                          T.StructField("metadata", T.StringType())])
LOG_LINES = T.StructType([T.StructField("lines", T.ArrayType(T.StringType()))])


def parse_breakdown(json_col: Column) -> Column:
    """Stored breakdown JSON -> typed struct; missing functions -> []."""
    b = F.from_json(json_col, BREAKDOWN)
    return b.withField("functions", F.coalesce(b["functions"], F.array().cast(BREAKDOWN["functions"].dataType)))


def parse_heartbeat(json_col: Column) -> Column:
    """Heartbeat envelope; missing metadata -> '{}'."""
    h = F.from_json(json_col, HEARTBEAT)
    return h.withField("metadata", F.coalesce(h["metadata"], F.lit("{}")))


def log_line_rows(envelopes: DataFrame, json_col: str = "payload") -> DataFrame:
    """Log-line envelopes -> one row per line with its position; empty or
    malformed envelopes give no rows."""
    p = F.from_json(F.col(json_col), LOG_LINES)
    return envelopes.select("*", F.posexplode(F.coalesce(p["lines"], F.array().cast("array<string>")))
                            .alias("pos", "line")).drop(json_col)
