"""Change-only snapshots (C22 / S9) and the per-environment dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import budgets as bo
from vantage.operators import errors as eo
from vantage.operators import n1 as n1ops
from vantage.operators.changes import changes_only
from vantage.operators.tables import fold_status
from vantage.plans import budgets as pb
from vantage.plans import errors as pe
from vantage.plans import telemetry as pt
from vantage.plans.registry import query
from vantage.sources.tables import EVENTS_CTE_SQL, table


@query("snapshot_changes", """
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate AS ts, o_orderstatus, o_orderpriority,
                  sha256(to_json({'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority})) AS content_hash
           FROM orders),
l AS (SELECT *, lag(content_hash) OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey) AS prev FROM s)
SELECT o_custkey, o_orderkey, ts, o_orderstatus, o_orderpriority, content_hash FROM l
WHERE prev IS NULL OR prev <> content_hash""", ops="C22 S9(batch)")
def q_snapshot_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"),
                                              "o_orderstatus", "o_orderpriority")
    return changes_only(o, ["o_custkey"], ["ts", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])


def _after(sql: str, marker: str) -> str:
    return sql[sql.index(marker) + len(marker):]


_OVERVIEW_SQL = ("WITH RECURSIVE " + EVENTS_CTE_SQL + pt._n1_cte() + pt._stats_cte() + pt._PATTERNS_CTE
                 + _after(pe._ERR_CTE, EVENTS_CTE_SQL) + pe._CHANGES_CTE
                 + _after(pb._BASE, EVENTS_CTE_SQL) + """,
envs AS (SELECT DISTINCT env_id FROM ev),
gs AS (
  SELECT g.env_id, g.signature, g.last_seen, c.last_status, c.last_ts
  FROM groups g LEFT JOIN (SELECT env_id, signature, last(status ORDER BY ts, seq) AS last_status, max(ts) AS last_ts
                           FROM changes GROUP BY 1, 2) c USING (env_id, signature)),
e_agg AS (SELECT env_id, count(*) AS errors_total,
                 count(*) FILTER (WHERE last_status IS NULL OR last_status = 'open' OR last_seen > last_ts) AS errors_open
          FROM gs GROUP BY 1),
r_agg AS (SELECT env_id, count(DISTINCT period) AS recordings,
                 count(DISTINCT CASE WHEN is_n1 THEN period END) AS recordings_with_n1
          FROM (SELECT env_id, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) AS period, is_n1
                FROM n1 WHERE category IN ('profiler', 'orm', 'sql')) GROUP BY 1),
p_agg AS (SELECT env_id, count(*) AS n1_patterns, count(*) FILTER (WHERE severity = 'critical') AS n1_critical
          FROM sev GROUP BY 1),
b_agg AS (SELECT env_id, count(*) FILTER (WHERE breach) AS budget_breaches FROM samples GROUP BY 1),
bd AS (SELECT env_id, count(*) AS budgets_total, count(*) FILTER (WHERE is_active) AS budgets_active
       FROM bud GROUP BY 1)
SELECT envs.env_id, coalesce(errors_total, 0) AS errors_total, coalesce(errors_open, 0) AS errors_open,
       coalesce(recordings, 0) AS recordings, coalesce(recordings_with_n1, 0) AS recordings_with_n1,
       coalesce(n1_patterns, 0) AS n1_patterns, coalesce(n1_critical, 0) AS n1_critical,
       coalesce(budget_breaches, 0) AS budget_breaches, coalesce(budgets_total, 0) AS budgets_total,
       coalesce(budgets_active, 0) AS budgets_active
FROM envs LEFT JOIN e_agg USING (env_id) LEFT JOIN r_agg USING (env_id) LEFT JOIN p_agg USING (env_id)
LEFT JOIN b_agg USING (env_id) LEFT JOIN bd USING (env_id)""")


@query("overview", _OVERVIEW_SQL, ops="A24 J4")
def q_overview(spark, sf_dir):
    ev = pt.flagged_events(spark, sf_dir)
    envs = ev.select("env_id").distinct()
    groups = eo.group_errors(eo.error_events(ev))
    st = fold_status(pe.status_changes(spark, sf_dir), ["env_id", "signature"], "status", ["ts", "seq"])
    gs = groups.join(st, ["env_id", "signature"], "left")
    e_agg = gs.groupBy("env_id").agg(
        F.count(F.lit(1)).alias("errors_total"),
        F.count_if(F.col("status").isNull() | (F.col("status") == "open") | (F.col("last_seen") > F.col("last_ts")))
        .alias("errors_open"))
    rec = bo.batches(ev, pb.BATCH_WINDOW)
    r_agg = (rec.groupBy("env_id", "period").agg(F.bool_or("is_n1").alias("has_n1"))
             .groupBy("env_id").agg(F.count(F.lit(1)).alias("recordings"),
                                    F.count_if("has_n1").alias("recordings_with_n1")))
    stats = pt.st.window_stats(ev, pt.STATS_WINDOW)
    scored = n1ops.score_patterns(n1ops.n1_pattern_summary(stats))
    p_agg = scored.groupBy("env_id").agg(F.count(F.lit(1)).alias("n1_patterns"),
                                         F.count_if(F.col("severity") == "critical").alias("n1_critical"))
    samples = bo.overhead_samples(bo.module_stats(bo.batches(ev, pb.BATCH_WINDOW)), pb.budgets(spark, sf_dir))
    b_agg = samples.groupBy("env_id").agg(F.count_if("breach").alias("budget_breaches"))
    bd = pb.budgets(spark, sf_dir).groupBy("env_id").agg(F.count(F.lit(1)).alias("budgets_total"),
                                                         F.count_if("is_active").alias("budgets_active"))
    out = envs
    for t in (e_agg, r_agg, p_agg, b_agg, bd):
        out = out.join(t, "env_id", "left")
    cols = ["errors_total", "errors_open", "recordings", "recordings_with_n1", "n1_patterns", "n1_critical",
            "budget_breaches", "budgets_total", "budgets_active"]
    return out.select("env_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in cols])
