"""Driver tables and their binding to the telemetry data model.

The driver ships TPC-H-like Parquet tables plus an ``events`` stream.  This
module reads them (column pruning and filters are left to Catalyst) and maps
``events`` onto the telemetry event record:

==============  ===================================================
event field     derived from ``events``
==============  ===================================================
seq, ts         ``event_id``, ``ts`` (NTZ read, cast to timestamp)
env_id          ``'env' || user_id % 3``
category        error->error, view->sql, click/signup->orm,
                purchase->profiler
model           ``'m' || user_id``
method          ``event_type``
module          ``'mod' || k % 4`` with ``k = props.k``
duration_ms     ``floor(value)`` as int
sql             ``'SELECT * FROM ' || event_type || ' WHERE id = ' || k``
is_error        ``event_type = 'error'``
user_id         ``user_id`` as int
==============  ===================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def category_of(event_type: Column) -> Column:
    return (F.when(event_type == "error", "error")
            .when(event_type == "view", "sql")
            .when(event_type.isin("click", "signup"), "orm")
            .when(event_type == "purchase", "profiler")
            .otherwise("python"))


def bind_events(events: DataFrame) -> DataFrame:
    """``events`` rows -> telemetry event rows (pure projection, no shuffle)."""
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    return (events
            .select(
                F.col("event_id").alias("seq"),
                F.col("ts").cast("timestamp").alias("ts"),
                F.concat(F.lit("env"), (F.col("user_id") % 3).cast("string")).alias("env_id"),
                category_of(et).alias("category"),
                F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"),
                et.alias("method"),
                F.concat(F.lit("mod"), (k % 4).cast("string")).alias("module"),
                F.floor("value").cast("int").alias("duration_ms"),
                F.concat(F.lit("SELECT * FROM "), et, F.lit(" WHERE id = "), k.cast("string")).alias("sql"),
                (et == "error").alias("is_error"),
                F.col("user_id").cast("int").alias("user_id"),
                k.alias("k"),
                F.col("value").alias("value"),
            ))


def telemetry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind_events(table(spark, sf_dir, "events"))


# DuckDB twin of ``bind_events`` for oracle SQL (a CTE named ``ev``).
EVENTS_CTE_SQL = """
ev AS (
  SELECT event_id AS seq,
         ts,
         'env' || CAST(user_id % 3 AS VARCHAR) AS env_id,
         CASE WHEN event_type = 'error' THEN 'error'
              WHEN event_type = 'view' THEN 'sql'
              WHEN event_type IN ('click', 'signup') THEN 'orm'
              WHEN event_type = 'purchase' THEN 'profiler'
              ELSE 'python' END AS category,
         'm' || CAST(user_id AS VARCHAR) AS model,
         event_type AS method,
         'mod' || CAST(k % 4 AS VARCHAR) AS module,
         CAST(floor(value) AS INTEGER) AS duration_ms,
         'SELECT * FROM ' || event_type || ' WHERE id = ' || CAST(k AS VARCHAR) AS sql,
         event_type = 'error' AS is_error,
         CAST(user_id AS INTEGER) AS user_id,
         k,
         value
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""
