"""Event-stream queries: N+1 flagging, window statistics, N+1 reports.

(2 s, 10) N+1 rule never fires on the driver's event density, so the queries
use (6 h, 10); statistics use the reference's 30 s tumbling window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.operators import n1 as n1ops
from vantage.operators import stats as st
from vantage.operators.windows import flag_n1, interval_us
from vantage.plans.registry import query
from vantage.sources.tables import EVENTS_CTE_SQL, table, telemetry_events

N1_WINDOW = "6 hours"
N1_THRESHOLD = 10
STATS_WINDOW = "30 seconds"
PATTERN_LIMIT = 50
TIMELINE_LIMIT = 100
SLOW_MS = 200


def flagged_events(spark: SparkSession, sf_dir: str, window: str = N1_WINDOW,
                   threshold: int = N1_THRESHOLD) -> DataFrame:
    return flag_n1(telemetry_events(spark, sf_dir), window, threshold)


def orm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.window_stats(flagged_events(spark, sf_dir), STATS_WINDOW)


def scored_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n1ops.score_patterns(n1ops.n1_pattern_summary(orm_stats(spark, sf_dir)))


def ranked_patterns(spark: SparkSession, sf_dir: str, limit: int = PATTERN_LIMIT) -> DataFrame:
    return n1ops.rank_patterns(scored_patterns(spark, sf_dir), limit)


# ---------------------------------------------------------------- DuckDB twins

def _n1_cte(window: str = N1_WINDOW, threshold: int = N1_THRESHOLD) -> str:
    w = interval_us(window)
    return f""",
fl AS (
  SELECT *, regexp_replace(regexp_replace(sql, '^\\s+|\\s+$', '', 'g'),
                           '(?:''[^'']*''|\\b\\d+\\b)', '?', 'g') AS signature
  FROM ev),
n1 AS (
  SELECT *, coalesce(signature, '') <> '' AND
         (row_number() OVER (PARTITION BY env_id, signature ORDER BY ts, seq)
          - count(*) OVER (PARTITION BY env_id, signature ORDER BY epoch_us(ts)
                           RANGE BETWEEN UNBOUNDED PRECEDING AND {w + 1} PRECEDING)) >= {threshold} AS is_n1
  FROM fl)"""


def _stats_cte(window: str = STATS_WINDOW) -> str:
    w = interval_us(window)
    return f""",
stats AS (
  SELECT env_id, make_timestamp(epoch_us(ts) // {w} * {w}) AS period, model, method,
         count(*) AS call_count,
         CAST(sum(duration_ms) AS BIGINT) AS total_ms,
         max(duration_ms) AS max_ms,
         list_sort(list(duration_ms))[least(95 * count(*) // 100, count(*) - 1) + 1] AS p95_ms,
         bool_or(is_n1) AS n1_detected,
         coalesce(first(sql ORDER BY ts, seq) FILTER (WHERE coalesce(sql, '') <> ''), '') AS sample_sql,
         floor((CAST(sum(duration_ms) AS BIGINT) * 200 + count(*)) / (2 * count(*))) / 100.0 AS avg_ms
  FROM n1
  WHERE coalesce(model, '') <> '' OR coalesce(method, '') <> ''
  GROUP BY 1, 2, 3, 4)"""


WITH_STATS = "WITH " + EVENTS_CTE_SQL + _n1_cte() + _stats_cte()

_SCORE_SQL = """
  CASE WHEN total_duration_ms = 0 OR occurrences = 0 THEN 0.0
       ELSE floor((total_duration_ms * occurrences
                   * (CASE WHEN peak_calls > 100 THEN 4 WHEN peak_calls > 50 THEN 3 ELSE 2 END) + 10) / 20) / 100.0
  END"""

_SUGGESTION_SQL = """
  CASE WHEN method IN ('read', 'browse') THEN printf('Use prefetch_fields or batch read: env[''%s''].browse(ids).read([fields]) instead of individual reads. Peak: %d calls in one window.', model, peak_calls)
       WHEN method = 'search_read' THEN printf('Combine search+read into a single search_read with domain filter. If looping, collect IDs first then batch-read. Peak: %d calls.', peak_calls)
       WHEN method IN ('search', 'search_count') THEN printf('Cache search results or use a single search with a broader domain. Avoid calling search inside loops. Peak: %d calls.', peak_calls)
       WHEN method = 'write' THEN printf('Batch writes: collect vals dicts and call write once on a recordset. env[''%s''].browse(ids).write(vals). Peak: %d calls.', model, peak_calls)
       WHEN method = 'create' THEN printf('Batch creates: pass a list of dicts to env[''%s''].create([vals_list]). Peak: %d calls.', model, peak_calls)
       WHEN method = 'unlink' THEN printf('Batch deletes: env[''%s''].browse(ids).unlink(). Peak: %d calls.', model, peak_calls)
       WHEN method = 'name_get' THEN printf('Override _compute_display_name or use read([''display_name'']) on the recordset. Peak: %d calls.', peak_calls)
       ELSE printf('Review %s.%s for loop-based calls. Consider batch operations or caching. Peak: %d calls in one window.', model, method, peak_calls)
  END"""

_PATTERNS_CTE = f""",
pat AS (
  SELECT env_id, model, method,
         count(*) AS occurrences,
         CAST(sum(call_count) AS BIGINT) AS total_calls,
         max(call_count) AS peak_calls,
         CAST(sum(total_ms) AS BIGINT) AS total_duration_ms,
         max(total_ms) AS peak_ms,
         min(period) AS first_seen,
         max(period) AS last_seen,
         first(sample_sql ORDER BY call_count DESC, period DESC) AS sample_sql,
         floor((CAST(sum(call_count) AS BIGINT) * 200 + greatest(count(*), 1))
               / (2 * greatest(count(*), 1))) / 100.0 AS avg_calls_per_window
  FROM stats WHERE n1_detected GROUP BY 1, 2, 3),
scored AS (
  SELECT *,
         CASE WHEN coalesce(sample_sql, '') <> ''
              THEN regexp_replace(regexp_replace(sample_sql, '^\\s+|\\s+$', '', 'g'),
                                  '(?:''[^'']*''|\\b\\d+\\b)', '?', 'g')
              ELSE '' END AS signature,
         {_SCORE_SQL} AS impact_score,
         {_SUGGESTION_SQL} AS suggestion
  FROM pat),
sev AS (
  SELECT *, CASE WHEN impact_score >= 100 THEN 'critical' WHEN impact_score >= 30 THEN 'high'
                 WHEN impact_score >= 5 THEN 'medium' ELSE 'low' END AS severity FROM scored),
ranked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY env_id ORDER BY total_duration_ms DESC, model, method) AS rank
    FROM sev) WHERE rank <= {PATTERN_LIMIT})"""


# --------------------------------------------------------------------- queries

@query("n1_flag", "WITH " + EVENTS_CTE_SQL + _n1_cte() + """
SELECT seq, env_id, signature, is_n1 FROM n1""", ops="W1 C1")
def q_n1_flag(spark, sf_dir):
    return flagged_events(spark, sf_dir).select("seq", "env_id", "signature", "is_n1")


@query("orm_window_stats", WITH_STATS + """
SELECT * FROM stats""", ops="A7 A9 A10 S1(batch)")
def q_orm_window_stats(spark, sf_dir):
    return orm_stats(spark, sf_dir)


@query("batch_summary", "WITH " + EVENTS_CTE_SQL + _n1_cte() + f"""
SELECT env_id, make_timestamp(epoch_us(ts) // {interval_us(STATS_WINDOW)} * {interval_us(STATS_WINDOW)}) AS period,
       count(*) AS total_queries, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms,
       count(*) FILTER (WHERE duration_ms > {SLOW_MS}) AS slow_queries,
       count(*) FILTER (WHERE is_n1) AS n1_patterns,
       count(*) FILTER (WHERE is_error) AS errors
FROM n1 GROUP BY 1, 2""", ops="A8")
def q_batch_summary(spark, sf_dir):
    return st.batch_summary(flagged_events(spark, sf_dir), STATS_WINDOW, slow_threshold_ms=SLOW_MS)


@query("p95_nearest_rank", """
SELECT l_suppkey,
       list_sort(list(l_quantity))[least(95 * count(*) // 100, count(*) - 1) + 1] AS p95_quantity,
       list_sort(list(l_extendedprice))[least(95 * count(*) // 100, count(*) - 1) + 1] AS p95_price
FROM lineitem GROUP BY 1""", ops="A9")
def q_p95(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    q = st.nearest_rank(li, ["l_suppkey"], "l_quantity", 95, "p95_quantity")
    p = st.nearest_rank(li, ["l_suppkey"], "l_extendedprice", 95, "p95_price")
    return q.join(p, "l_suppkey")


@query("n1_patterns", WITH_STATS + _PATTERNS_CTE + """
SELECT * FROM ranked""", ops="A1 C2 C3 C4 T1")
def q_n1_patterns(spark, sf_dir):
    return ranked_patterns(spark, sf_dir)


@query("n1_windows", WITH_STATS + """
SELECT env_id, count(DISTINCT period) AS n1_windows FROM stats WHERE n1_detected GROUP BY 1""", ops="A2")
def q_n1_windows(spark, sf_dir):
    return n1ops.n1_windows(orm_stats(spark, sf_dir))


@query("n1_timeline", WITH_STATS + f"""
SELECT env_id, period, pattern_count, total_calls, total_ms FROM (
  SELECT env_id, period, count(*) AS pattern_count, CAST(sum(call_count) AS BIGINT) AS total_calls,
         CAST(sum(total_ms) AS BIGINT) AS total_ms,
         row_number() OVER (PARTITION BY env_id ORDER BY period DESC) AS rn
  FROM stats WHERE n1_detected GROUP BY 1, 2) WHERE rn <= {TIMELINE_LIMIT}""", ops="A3")
def q_n1_timeline(spark, sf_dir):
    return n1ops.n1_timeline(orm_stats(spark, sf_dir), limit=TIMELINE_LIMIT)


@query("n1_summary", WITH_STATS + _PATTERNS_CTE + """
SELECT env_id, count(*) AS total_patterns, CAST(sum(total_duration_ms) AS BIGINT) AS total_wasted_ms,
       count(*) FILTER (WHERE severity = 'critical') AS critical_count,
       count(*) FILTER (WHERE severity = 'high') AS high_count,
       CASE WHEN max(impact_score) > 0 THEN first(model ORDER BY impact_score DESC, total_duration_ms DESC, model, method) ELSE '' END AS top_model,
       CASE WHEN max(impact_score) > 0 THEN first(method ORDER BY impact_score DESC, total_duration_ms DESC, model, method) ELSE '' END AS top_method
FROM sev GROUP BY 1""", ops="A23")
def q_n1_summary(spark, sf_dir):
    return n1ops.n1_summary(scored_patterns(spark, sf_dir))


@query("stats_rollup", WITH_STATS + """
SELECT env_id, model, method, CAST(sum(call_count) AS BIGINT) AS total_calls,
       CAST(sum(total_ms) AS BIGINT) AS total_ms, max(max_ms) AS peak_ms,
       bool_or(n1_detected) AS any_n1, count(*) AS windows
FROM stats GROUP BY 1, 2, 3""", ops="A4")
def q_stats_rollup(spark, sf_dir):
    return st.stats_rollup(orm_stats(spark, sf_dir))


@query("top_stats", WITH_STATS + """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY env_id ORDER BY total_ms DESC, period DESC, model, method) AS rank
  FROM stats) WHERE rank <= 20""", ops="T1")
def q_top_stats(spark, sf_dir):
    return st.top_k_per_key(orm_stats(spark, sf_dir), ["env_id"],
                            [F.col("total_ms").desc(), F.col("period").desc(), F.col("model"), F.col("method")], 20)


@query("batch_ingest", WITH_STATS + """
SELECT env_id, period, model, method, call_count, total_ms, avg_ms, CAST(nullif(max_ms, 0) AS DOUBLE) AS max_ms,
       CAST(nullif(p95_ms, 0) AS DOUBLE) AS p95_ms, n1_detected, nullif(sample_sql, '') AS sample_sql
FROM stats""", ops="P2")
def q_batch_ingest(spark, sf_dir):
    from vantage.sources import json_batches as jb
    ev = flagged_events(spark, sf_dir)
    docs = jb.envelopes(st.window_stats(ev, STATS_WINDOW), st.batch_summary(ev, STATS_WINDOW, slow_threshold_ms=SLOW_MS),
                        interval_us(STATS_WINDOW) // 1000)
    parsed = docs.select(jb.parse_batches(F.col("json")).alias("b")).select("b.*")
    # nullable integer columns are exposed as doubles (NULL-safe in every client)
    return (jb.stats_rows(jb.valid_batches(parsed))
            .withColumn("max_ms", F.col("max_ms").cast("double")).withColumn("p95_ms", F.col("p95_ms").cast("double")))
