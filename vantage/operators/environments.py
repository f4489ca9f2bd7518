"""Per-environment dashboard (A24) and age limits without a policy row each (U4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.operators.tables import retain_by_age

CHAIN_CAP = 1000     # fixed value: a dashboard counts at most this many recordings with a chain
PATTERN_CAP = 200    # fixed value: a dashboard looks at the costliest patterns only
HEARTBEAT_DAYS = 7   # fixed value: heartbeats are kept this long, whatever the policy


def dashboard(envs: DataFrame, heartbeats: DataFrame, groups: DataFrame, recordings: DataFrame,
              patterns: DataFrame, alerts: DataFrame, budgets: DataFrame,
              chain_cap: int = CHAIN_CAP, pattern_cap: int = PATTERN_CAP) -> DataFrame:
    """One row per row of ``envs`` (env_id), from one partial aggregate a table.

    heartbeats (env_id, status, received_at, seq): the latest one's status, 'unknown' and no time
    without any; groups (env_id, status): all and open; recordings (env_id, has_chain): all, and
    those with a chain up to ``chain_cap``; patterns (scored, of the last day): the
    ``pattern_cap`` with most time (model, method break ties) and the critical ones among them;
    alerts (env_id, acknowledged): not yet acknowledged, a NULL counts as not; budgets (env_id,
    is_active): all and active.  Counts of a table without rows for an environment are 0.
    """
    by_env = Window.partitionBy("env_id").orderBy(F.col("total_duration_ms").desc(), "model", "method")
    costly = patterns.withColumn("_rn", F.row_number().over(by_env)).filter(F.col("_rn") <= pattern_cap)
    latest = F.max_by(F.struct("status", "received_at"), F.struct("received_at", "seq"))

    def total(df: DataFrame, **counts: Column) -> DataFrame:
        return df.groupBy("env_id").agg(*[c.cast("long").alias(n) for n, c in counts.items()])

    rows = F.count(F.lit(1))
    parts = [
        total(groups, errors_total=rows, errors_open=F.count_if(F.col("status") == "open")),
        total(recordings, recordings_total=rows,
              recordings_with_chain=F.least(F.count_if(F.col("has_chain")), F.lit(chain_cap))),
        total(costly, n1_patterns=rows, n1_critical=F.count_if(F.col("severity") == "critical")),
        total(alerts, alerts_unacknowledged=F.count_if(~F.coalesce(F.col("acknowledged"), F.lit(False)))),
        total(budgets, budgets_total=rows, budgets_active=F.count_if(F.col("is_active"))),
    ]
    counts = [c for p in parts for c in p.columns if c != "env_id"]
    out = envs.select("env_id").distinct().join(heartbeats.groupBy("env_id").agg(latest.alias("_hb")), "env_id", "left")
    for p in parts:
        out = out.join(p, "env_id", "left")
    return out.select("env_id", F.coalesce("_hb.status", F.lit("unknown")).alias("agent_status"),
                      F.col("_hb.received_at").alias("last_heartbeat_at"),
                      *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts])


def retain_alerts(alerts: DataFrame, envs: DataFrame, policies: DataFrame, now) -> DataFrame:
    """U4: alerts share the age limit of error traces: joined to their environment's tenant, kept
    while ``created_at`` is not older than ``error_traces_days``; a policy <= 0 keeps all.  An alert of
    an unknown environment stays."""
    owned = alerts.join(envs.select("env_id", "tenant_id"), "env_id", "left")
    return retain_by_age(owned, policies, "tenant_id", "created_at", "error_traces_days", now)


def retain_heartbeats(heartbeats: DataFrame, now, days: int = HEARTBEAT_DAYS) -> DataFrame:
    """U4: heartbeats received in the last ``days`` days, the limit itself included: one filter that
    reaches the scan.  A heartbeat without a time stays."""
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    return heartbeats.filter(F.col("received_at").isNull() | (F.col("received_at") >= cutoff))
