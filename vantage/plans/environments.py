"""Dashboard of an environment (A24), age limits of heartbeats and alerts (U4), patterns enriched from
recordings (J8), nested waterfalls and compute chains (N3).

Bindings: every tenth event (by its ``k``) of env0 and env1 is a heartbeat, degraded if it is an error;
env2 never reported.  A recording has a compute chain if one of its events has a ``k`` divisible by
seven.  An alert is the fifth occurrence of an error, acknowledged if its number divides by three.
The agent of env1 sends no SQL, so only recordings know it.  Tenant t1 keeps error traces for
ten days, t2 without limit."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions.sqltext import normalize_sql
from vantage.operators import environments as eo
from vantage.operators import n1 as n1ops
from vantage.operators import nested
from vantage.operators import profiles as po
from vantage.operators.budgets import batches
from vantage.operators.compute import compute_edges, compute_stats
from vantage.operators.errors import group_errors, spike_alerts
from vantage.operators.tables import fold_status, parse_policy
from vantage.plans import budgets as pb
from vantage.plans import errors as pe
from vantage.plans import profiles as pp
from vantage.plans import telemetry as pt
from vantage.plans.records import environments
from vantage.plans.registry import REGISTRY, query
from vantage.session import written
from vantage.sources.tables import EVENTS_CTE_SQL, telemetry_events

NOW = "2024-01-31 00:00:00"
DAY_AGO = "2024-01-30 00:00:00"
SPIKE = 5
POLICY_JSON = {"t1": '{"error_traces_days": 10}', "t2": '{"error_traces_days": -1}'}


def heartbeats(spark, sf_dir):
    return (telemetry_events(spark, sf_dir).filter((F.col("k") % 10 == 0) & (F.col("env_id") != "env2"))
            .select("env_id", "seq", F.col("ts").alias("received_at"),
                    F.when(F.col("is_error"), "degraded").otherwise("healthy").alias("status")))


def alerts(spark, sf_dir):
    return (spike_alerts(pe._errs(spark, sf_dir), SPIKE)
            .select("env_id", "signature", "seq", F.col("ts").alias("created_at"),
                    (F.col("seq") % 3 == 0).alias("acknowledged")))


def _after(sql: str, marker: str) -> str:
    return sql[sql.index(marker) + len(marker):]


_HB_SQL = """
hb AS (SELECT env_id, seq, ts AS received_at, CASE WHEN is_error THEN 'degraded' ELSE 'healthy' END AS status
       FROM ev WHERE k % 10 = 0 AND env_id <> 'env2')"""
_ALERT_SQL = f"""
al AS (SELECT env_id, signature, seq, ts AS created_at, seq % 3 = 0 AS acknowledged
       FROM (SELECT *, row_number() OVER (PARTITION BY env_id, signature ORDER BY ts, seq) AS rn FROM err)
       WHERE rn = {SPIKE})"""
_RECENT_PATTERNS = pt._PATTERNS_CTE.replace("WHERE n1_detected", f"WHERE n1_detected AND period >= TIMESTAMP '{DAY_AGO}'")

_DASHBOARD_SQL = ("WITH RECURSIVE " + EVENTS_CTE_SQL + pt._n1_cte() + pt._stats_cte() + _RECENT_PATTERNS
                  + _after(pe._ERR_CTE, EVENTS_CTE_SQL) + pe._CHANGES_CTE + _after(pb._BASE, EVENTS_CTE_SQL)
                  + "," + _HB_SQL + "," + _ALERT_SQL + f""",
st AS (SELECT env_id, signature, last(status ORDER BY ts, seq) AS status FROM changes GROUP BY 1, 2),
e1 AS (SELECT g.env_id, count(*) AS errors_total, count(*) FILTER (WHERE coalesce(st.status, 'open') = 'open') AS errors_open
       FROM groups g LEFT JOIN st USING (env_id, signature) GROUP BY 1),
rc AS (SELECT env_id, period, bool_or(k % 7 = 0) AS has_chain FROM be GROUP BY 1, 2),
e2 AS (SELECT env_id, count(*) AS recordings_total,
              least(count(*) FILTER (WHERE has_chain), {eo.CHAIN_CAP}) AS recordings_with_chain FROM rc GROUP BY 1),
top AS (SELECT *, row_number() OVER (PARTITION BY env_id ORDER BY total_duration_ms DESC, model, method) AS cost FROM sev),
e3 AS (SELECT env_id, count(*) AS n1_patterns, count(*) FILTER (WHERE severity = 'critical') AS n1_critical
       FROM top WHERE cost <= {eo.PATTERN_CAP} GROUP BY 1),
e4 AS (SELECT env_id, count(*) FILTER (WHERE NOT acknowledged) AS alerts_unacknowledged FROM al GROUP BY 1),
e5 AS (SELECT env_id, count(*) AS budgets_total, count(*) FILTER (WHERE is_active) AS budgets_active FROM bud GROUP BY 1),
lh AS (SELECT env_id, last(status ORDER BY received_at, seq) AS status, max(received_at) AS received_at FROM hb GROUP BY 1)
SELECT v.env_id, coalesce(lh.status, 'unknown') AS agent_status, lh.received_at AS last_heartbeat_at,
       coalesce(errors_total, 0) AS errors_total, coalesce(errors_open, 0) AS errors_open,
       coalesce(recordings_total, 0) AS recordings_total, coalesce(recordings_with_chain, 0) AS recordings_with_chain,
       coalesce(n1_patterns, 0) AS n1_patterns, coalesce(n1_critical, 0) AS n1_critical,
       coalesce(alerts_unacknowledged, 0) AS alerts_unacknowledged, coalesce(budgets_total, 0) AS budgets_total,
       coalesce(budgets_active, 0) AS budgets_active
FROM (SELECT DISTINCT env_id FROM ev) v LEFT JOIN lh USING (env_id) LEFT JOIN e1 USING (env_id)
LEFT JOIN e2 USING (env_id) LEFT JOIN e3 USING (env_id) LEFT JOIN e4 USING (env_id) LEFT JOIN e5 USING (env_id)""")


@query("environment_dashboard", _DASHBOARD_SQL, ops="A24 J4 W4")
def q_environment_dashboard(spark, sf_dir):
    ev = telemetry_events(spark, sf_dir)
    status = fold_status(pe.status_changes(spark, sf_dir), ["env_id", "signature"], "status", ["ts", "seq"])
    groups = (group_errors(pe._errs(spark, sf_dir)).join(status, ["env_id", "signature"], "left")
              .select("env_id", F.coalesce("status", F.lit("open")).alias("status")))
    recordings = batches(ev, pp.REC_WINDOW).groupBy(*pp.REC).agg(F.bool_or(F.col("k") % 7 == 0).alias("has_chain"))
    patterns = n1ops.score_patterns(n1ops.n1_pattern_summary(pt.orm_stats(spark, sf_dir), DAY_AGO))
    return eo.dashboard(ev.select("env_id"), heartbeats(spark, sf_dir), groups, recordings, patterns,
                        alerts(spark, sf_dir), pb.budgets(spark, sf_dir))


@query("retention_alerts", "WITH " + _after(pe._ERR_CTE, "WITH ") + "," + _ALERT_SQL + f"""
SELECT env_id, signature, seq, created_at, acknowledged, CASE WHEN env_id = 'env2' THEN 't2' ELSE 't1' END AS tenant_id,
       CASE WHEN env_id = 'env2' THEN -1 ELSE 10 END AS error_traces_days
FROM al WHERE env_id = 'env2' OR created_at >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY""", ops="U4 N7 J4")
def q_retention_alerts(spark, sf_dir):
    envs = environments(spark, sf_dir)
    policies = (envs.select("tenant_id").distinct()
                .withColumn("p", parse_policy(F.when(F.col("tenant_id") == "t1", POLICY_JSON["t1"]).otherwise(POLICY_JSON["t2"])))
                .select("tenant_id", "p.error_traces_days"))
    return eo.retain_alerts(alerts(spark, sf_dir), envs, policies, NOW)


@query("retention_heartbeats", "WITH " + EVENTS_CTE_SQL + "," + _HB_SQL + f"""
SELECT * FROM hb WHERE received_at >= TIMESTAMP '{NOW}' - INTERVAL {eo.HEARTBEAT_DAYS} DAY""", ops="U4")
def q_retention_heartbeats(spark, sf_dir):
    return eo.retain_heartbeats(heartbeats(spark, sf_dir), NOW)


_NORMAL = "regexp_replace(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '(?:''[^'']*''|\\b\\d+\\b)', '?', 'g')"


@query("n1_enriched", pp._REC_SQL + pt._stats_cte() + """,
bare AS (SELECT * REPLACE (CASE WHEN env_id = 'env1' THEN '' ELSE sample_sql END AS sample_sql) FROM stats)"""
       + pt._PATTERNS_CTE.replace("FROM stats WHERE", "FROM bare WHERE") + ", merged AS ("
       + REGISTRY["n1_recording_merge"].sql.replace(pp._REC_SQL + ",", "WITH ", 1) + f""")
SELECT s.env_id, s.model, s.method, s.occurrences, s.total_calls, s.total_duration_ms, s.impact_score, s.severity,
       CASE WHEN s.sample_sql = '' AND m.env_id IS NOT NULL THEN m.sample_sql ELSE s.sample_sql END AS sample_sql,
       CASE WHEN m.env_id IS NOT NULL THEN {_NORMAL.format('m.sample_sql')}
            WHEN s.sample_sql <> '' THEN {_NORMAL.format('s.sample_sql')} ELSE '' END AS signature
FROM sev s LEFT JOIN merged m USING (env_id, model, method)""", ops="J8 A1 A18 C2 C3")
def q_n1_enriched(spark, sf_dir):
    stats = pt.orm_stats(spark, sf_dir)
    stats = stats.withColumn("sample_sql", F.when(F.col("env_id") == "env1", "").otherwise(F.col("sample_sql")))
    merged = REGISTRY["n1_recording_merge"].fn(spark, sf_dir)
    enrichment = merged.withColumn("signature", normalize_sql(F.col("sample_sql")))
    return (n1ops.score_patterns(n1ops.n1_pattern_summary(stats), enrichment)
            .select("env_id", "model", "method", "occurrences", "total_calls", "total_duration_ms", "impact_score",
                    "severity", "sample_sql", "signature"))


def _as_text(df, *nested_cols):
    """Nested columns as JSON text, for clients (and oracles) without nested types."""
    return df.select([F.to_json(c).alias(c) if c in nested_cols else c for c in df.columns])


_LANES_SQL = _after(REGISTRY["waterfall_lanes"].sql, pp._REC_SQL.strip() + ",")
_SUMMARY_SQL = _after(REGISTRY["waterfall_summary"].sql, pp._REC_SQL.strip())


@query("waterfall_documents", pp._REC_SQL + ",\nlane_rows AS (WITH " + _LANES_SQL + "),\nsums AS (" + _SUMMARY_SQL + f"""),
sp AS (SELECT env_id, period, pos // {nested.CHUNK} AS chunk,
              to_json(list({{'span_id': span_id, 'label': label, 'category': category, 'ms': ms, 'start_ms': start_ms,
                             'model': model, 'method': method, 'module': module, 'sql': sql, 'is_n1': is_n1,
                             'is_error': is_error, 'seq': seq}} ORDER BY pos)) AS spans FROM spans GROUP BY 1, 2, 3),
la AS (SELECT env_id, period, pos // {nested.CHUNK} AS chunk,
              to_json(list({{'category': category, 'total_ms': total_ms, 'pct': pct, 'label': label}} ORDER BY pos)) AS lanes
       FROM lane_rows GROUP BY 1, 2, 3)
SELECT env_id, period, chunk, sp.spans, la.lanes,
       CASE WHEN chunk = 0 THEN to_json({{'total_ms': total_ms, 'span_count': span_count, 'sql_ms': sql_ms,
            'sql_count': sql_count, 'orm_ms': orm_ms, 'orm_count': orm_count, 'python_ms': python_ms,
            'n1_count': n1_count, 'n1_ms': n1_ms, 'error_count': error_count, 'critical_sql': critical_sql}}) END AS summary
FROM sp LEFT JOIN la USING (env_id, period, chunk) JOIN sums USING (env_id, period)""", ops="N3 R16 A14 A15")
def q_waterfall_documents(spark, sf_dir):
    spans = written(pp.spans(spark, sf_dir))  # read by three branches
    docs = nested.waterfall_documents(spans, po.waterfall_lanes(spans, pp.REC), po.waterfall_summary(spans, pp.REC), pp.REC)
    return _as_text(docs, "spans", "lanes", "summary")


_EDGES_SQL = _after(REGISTRY["compute_edges"].sql, pp._CHAIN_SQL.strip() + ",")
_STATS_SQL = _after(REGISTRY["compute_stats"].sql, pp._CHAIN_SQL.strip() + ",")


@query("chain_documents", pp._CHAIN_SQL + ",\nedge_rows AS (WITH " + _EDGES_SQL + "),\nsums AS (WITH " + _STATS_SQL + f"""),
nd2 AS (SELECT rec, CAST(idx // {nested.CHUNK} AS BIGINT) AS chunk,
               to_json(list({{'node_id': node_id, 'model': model, 'field_name': field_name, 'method': method,
                              'duration_ms': duration_ms, 'depends_on': depends_on, 'trigger_field': trigger_field,
                              'depth': depth, 'parent_id': parent_id}} ORDER BY idx)) AS nodes FROM chain GROUP BY 1, 2),
ed AS (SELECT rec, CAST(split_part(dst, '-', 2) AS BIGINT) // {nested.CHUNK} AS chunk,
              to_json(list({{'kind': kind, 'src': src, 'dst': dst, 'trigger_field': trigger_field}}
                           ORDER BY CAST(split_part(dst, '-', 2) AS BIGINT), kind, src, dst, trigger_field)) AS edges
       FROM edge_rows GROUP BY 1, 2)
SELECT rec, chunk, nodes, edges,
       CASE WHEN chunk = 0 THEN to_json({{'total_ms': total_ms, 'node_count': node_count, 'max_depth': max_depth,
            'slowest_node': slowest_node, 'slowest_ms': slowest_ms, 'trigger_field': trigger_field,
            'bottleneck_count': bottleneck_count}}) END AS summary
FROM nd2 LEFT JOIN ed USING (rec, chunk) JOIN sums USING (rec)""", ops="N3 R17 J14 A19")
def q_chain_documents(spark, sf_dir):
    chain = po.compute_chain(pp.compute_nodes(spark, sf_dir), packed=True)
    return _as_text(nested.chain_documents(chain, compute_edges(chain), compute_stats(chain)), "nodes", "edges", "summary")
