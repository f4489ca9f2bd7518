"""Record-level joins and filters: valid sessions with user attributes
(J2, F8), tenant-scoped expiry through two hops (J5), alert existence by JSON
metadata containment (J18, F5), and audit capture from a request log (U9).

Bindings: a session per order (user = customer, expiring 30 days after the
order date, revoked when the order is finished); environments env0/env1 belong
to tenant t1 and env2 to t2; the request log is the event stream with an HTTP
method per event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.plans import budgets as pb
from vantage.plans.registry import query
from vantage.sources.tables import EVENTS_CTE_SQL, table, telemetry_events

NOW = "1998-06-01 00:00:00"
TENANT = "t1"
SAMPLE_CUTOFF = "2024-01-15 00:00:00"


@query("valid_sessions", f"""
SELECT o.o_orderkey AS session_id, o.o_custkey AS uid, c.c_name AS login, c.c_mktsegment AS segment,
       o.o_orderdate + INTERVAL 30 DAY AS expires_at
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_orderstatus <> 'F'
  AND (o.o_orderdate + INTERVAL 30 DAY IS NULL OR o.o_orderdate + INTERVAL 30 DAY > TIMESTAMP '{NOW}')""",
       ops="J2 F8")
def q_valid_sessions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    s = o.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("uid"),
                 (F.col("o_orderstatus") == "F").alias("revoked"),
                 (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
    valid = s.filter(~F.col("revoked") & (F.col("expires_at").isNull()
                                          | (F.col("expires_at") > F.lit(NOW).cast("timestamp"))))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("login"),
                                                    F.col("c_mktsegment").alias("segment"))
    return valid.join(users, "uid").select("session_id", "uid", "login", "segment", "expires_at")


def environments(spark, sf_dir):
    ev = telemetry_events(spark, sf_dir).select("env_id").distinct()
    return ev.select("env_id", F.when(F.col("env_id") == "env2", "t2").otherwise("t1").alias("tenant_id"))


@query("tenant_samples_expired", "WITH RECURSIVE " + EVENTS_CTE_SQL + pb._BASE.split(EVENTS_CTE_SQL, 1)[1] + f""",
envs AS (SELECT DISTINCT env_id, CASE WHEN env_id = 'env2' THEN 't2' ELSE 't1' END AS tenant_id FROM ev)
SELECT s.budget_id, s.env_id, s.period, s.overhead_pct FROM samples s
WHERE s.budget_id IN (SELECT b.budget_id FROM bud b JOIN envs e ON e.env_id = b.env_id WHERE e.tenant_id = '{TENANT}')
  AND s.period < TIMESTAMP '{SAMPLE_CUTOFF}'""", ops="J5 J4 U4")
def q_tenant_samples_expired(spark, sf_dir):
    samples = pb.samples(spark, sf_dir)
    owned = (pb.budgets(spark, sf_dir).join(environments(spark, sf_dir), "env_id")
             .filter(F.col("tenant_id") == TENANT).select("budget_id"))
    return (samples.join(owned, "budget_id", "left_semi")
            .filter(F.col("period") < F.lit(SAMPLE_CUTOFF).cast("timestamp"))
            .select("budget_id", "env_id", "period", "overhead_pct"))


_ALERTS_SQL = pb._BASE.split(EVENTS_CTE_SQL, 1)[1]


@query("breach_has_alert", "WITH RECURSIVE " + EVENTS_CTE_SQL + _ALERTS_SQL + f""",
al AS (SELECT env_id, 'budget_exceeded' AS type, period AS created_at,
              to_json({{'module': module, 'budget_id': budget_id, 'endpoint': endpoint}}) AS metadata
       FROM samples WHERE breach AND threshold_pct >= 25)
SELECT s.env_id, s.budget_id, s.module, s.period FROM samples s
WHERE s.breach AND EXISTS (
  SELECT 1 FROM al WHERE al.env_id = s.env_id AND al.type = 'budget_exceeded'
    AND json_extract_string(al.metadata, '$.module') = s.module
    AND json_extract_string(al.metadata, '$.budget_id') = s.budget_id
    AND al.created_at > s.period - INTERVAL 6 HOUR AND al.created_at <= s.period)""", ops="J18 F5 W9")
def q_breach_has_alert(spark, sf_dir):
    s = pb.samples(spark, sf_dir).filter(F.col("breach"))
    al = (s.filter(F.col("threshold_pct") >= 25)
          .select("env_id", F.lit("budget_exceeded").alias("type"), F.col("period").alias("created_at"),
                  F.to_json(F.struct("module", "budget_id", "endpoint")).alias("metadata")))
    a = al.select("env_id", "type", "created_at",
                  F.get_json_object("metadata", "$.module").alias("a_module"),
                  F.get_json_object("metadata", "$.budget_id").alias("a_budget"))
    cond = ((s.env_id == a.env_id) & (a.type == "budget_exceeded") & (a.a_module == s.module)
            & (a.a_budget == s.budget_id) & (a.created_at > s.period - F.expr("INTERVAL 6 HOURS"))
            & (a.created_at <= s.period))
    return s.join(a, cond, "left_semi").select("env_id", "budget_id", "module", "period")


@query("audit_capture", "WITH " + EVENTS_CTE_SQL + """,
r AS (SELECT seq, ts, user_id, env_id,
             CASE method WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' WHEN 'signup' THEN 'POST'
                         WHEN 'purchase' THEN 'PUT' ELSE 'DELETE' END AS http_method,
             '/api/v1/' || method || '/' || CAST(k AS VARCHAR) AS route FROM ev)
SELECT seq, ts, user_id, env_id, http_method || ' ' || route AS action,
       split_part(route, '/', 4) AS resource, split_part(route, '/', 5) AS resource_id
FROM r WHERE http_method <> 'GET'""", ops="U9 C17")
def q_audit_capture(spark, sf_dir):
    ev = telemetry_events(spark, sf_dir)
    m = F.col("method")
    hm = (F.when(m == "view", "GET").when(m.isin("click", "signup"), "POST").when(m == "purchase", "PUT")
          .otherwise("DELETE"))
    route = F.concat(F.lit("/api/v1/"), m, F.lit("/"), F.col("k").cast("string"))
    r = ev.select("seq", "ts", "user_id", "env_id", hm.alias("http_method"), route.alias("route"))
    parts = F.split("route", "/")
    return (r.filter(F.col("http_method") != "GET")
            .select("seq", "ts", "user_id", "env_id", F.concat_ws(" ", "http_method", "route").alias("action"),
                    F.get(parts, 3).alias("resource"), F.get(parts, 4).alias("resource_id")))


