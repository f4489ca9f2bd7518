"""Listings and nested records over the driver tables (T3, T5, F6, U1, U4, U6, A6, J11-J13, X2, X4) and landed error batches (SRC5).

Bindings: error groups and their status changes as in ``plans.errors``;
env0 / env1 belong to tenant t1 (errors kept 7 days), env2 to t2 (14 days); every
group seen more than once has a stored trace.  Models of J12 are nations, an
access row is a supplier's (group, rights) on model ``suppkey % 30`` and a rule a part's
brand and type on model ``size % 30``: ids from 25 on have no model.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vantage.operators import errors as eo
from vantage.operators import listings as lo
from vantage.operators import profiles as po
from vantage.operators import tables as to
from vantage.plans import budgets as pb
from vantage.plans import errors as pe
from vantage.plans import profiles as pp
from vantage.plans import records as pr
from vantage.plans import upgrade as pu
from vantage.plans.registry import REGISTRY, query
from vantage.session import checkpoint_dir
from vantage.sources import json_batches as jb
from vantage.sources.tables import table, telemetry_events

NOW = "2024-02-01 00:00:00"
STORED_UNTIL = "2024-01-16 00:00:00"
PER_PAGE = 25
VARIANTS = {"all": {}, "search": {"search": pe.SEARCH_TERM, "status": "resolved"},
            "status": {"status": "resolved", "error_type": "x"}, "type": {"error_type": "error"}}

_STATUS_CTE = pe._ERR_CTE + pe._CHANGES_CTE + """,
cur AS (SELECT env_id, signature, last(status ORDER BY ts, seq) AS status FROM changes GROUP BY 1, 2),
gs AS (SELECT g.*, coalesce(c.status, 'open') AS status FROM groups g LEFT JOIN cur c USING (env_id, signature))"""


def _groups(spark, sf_dir):
    return lo.with_status(eo.group_errors(eo.error_events(telemetry_events(spark, sf_dir))),
                          pe.status_changes(spark, sf_dir))


def _page_sql(variant: str, condition: str, order: str) -> str:
    return f"""SELECT * FROM (
  SELECT '{variant}' AS variant, env_id, signature, status, occurrence_count, last_seen, count(*) OVER w AS total,
         row_number() OVER (PARTITION BY env_id ORDER BY {order}, last_seen DESC, signature) - 1 AS row_in_page
  FROM gs WHERE {condition} WINDOW w AS (PARTITION BY env_id)) WHERE row_in_page < {PER_PAGE}"""


@query("error_list", _STATUS_CTE + "\n" + "\nUNION ALL\n".join([
    _page_sql("all", "true", "occurrence_count DESC"),
    _page_sql("search", " OR ".join(f"{c} ILIKE '%{pe.SEARCH_TERM}%'" for c in ("message", "module", "model")),
              "last_seen DESC"),
    _page_sql("status", "status = 'resolved'", "last_seen DESC"),
    _page_sql("type", "error_type = 'error'", "occurrence_count DESC")]), ops="T3 T2 U2")
def q_error_list(spark, sf_dir):
    groups = _groups(spark, sf_dir)
    pages = None
    for name, chosen in VARIANTS.items():
        p = lo.list_groups(groups, **chosen, per_page=PER_PAGE).select(
            F.lit(name).alias("variant"), "env_id", "signature", "status", "occurrence_count", "last_seen", "total",
            "row_in_page")
        pages = p if pages is None else pages.unionByName(p)
    return pages


@query("error_counts", _STATUS_CTE + """
SELECT env_id, count(*) AS total, count(*) FILTER (WHERE status = 'open') AS open,
       count(*) FILTER (WHERE status = 'resolved') AS resolved,
       count(*) FILTER (WHERE status = 'acknowledged') AS acknowledged,
       count(*) FILTER (WHERE error_type = 'error') AS typed
FROM gs GROUP BY 1""", ops="A6")
def q_error_counts(spark, sf_dir):
    s = F.col("status")
    return to.counts(_groups(spark, sf_dir), ["env_id"], {
        "open": s == "open", "resolved": s == "resolved", "acknowledged": s == "acknowledged",
        "typed": F.col("error_type") == "error"})


_REF = "CASE WHEN occurrence_count > 1 THEN 'traces/' || env_id || '/' || signature || '.json.gz' END"


@query("error_retention", _STATUS_CTE + f"""
SELECT env_id, CASE WHEN env_id = 'env2' THEN 't2' ELSE 't1' END AS tenant_id, signature, status, last_seen,
       {_REF} AS raw_trace_ref
FROM gs WHERE status <> 'open'
  AND last_seen < TIMESTAMP '{NOW}' - (CASE WHEN env_id = 'env2' THEN 14 ELSE 7 END) * INTERVAL 1 DAY""", ops="U4 U6 F2")
def q_error_retention(spark, sf_dir):
    owners = pr.environments(spark, sf_dir).withColumn("days", F.when(F.col("tenant_id") == "t2", 14).otherwise(7))
    return (lo.expired_groups(_groups(spark, sf_dir), owners, NOW)
            .select("env_id", "tenant_id", "signature", "status", "last_seen", F.expr(_REF).alias("raw_trace_ref")))


@query("error_merge", pe._ERR_CTE + "\nSELECT * FROM groups", ops="U1 X2 A21")
def q_error_merge(spark, sf_dir):
    err = eo.error_events(telemetry_events(spark, sf_dir))
    stored = F.col("ts") < F.lit(STORED_UNTIL).cast("timestamp")
    return pe._users_text(eo.merge_groups(eo.group_errors(err.filter(stored)), eo.group_errors(err.filter(~stored))))


@query("error_batches", pe._ERR_CTE + "\nSELECT * FROM groups", ops="SRC5 A21 A22")
def q_error_batches(spark, sf_dir):
    """Error batches land as JSON files, are read back and grouped."""
    landed = f"{checkpoint_dir(spark)}/error-batches-{uuid.uuid4().hex}"
    sent = jb.error_envelopes(eo.error_events(telemetry_events(spark, sf_dir)), "30 seconds", pe.SPIKE_THRESHOLD)
    sent.write.text(landed, compression="gzip")
    return pe._users_text(eo.group_errors(jb.error_rows(jb.read_error_batches(spark, landed))))


@query("budget_catalog", pb._BASE + "\nSELECT * FROM bud WHERE is_active ORDER BY env_id, module, endpoint, budget_id",
       ops="T5")
def q_budget_catalog(spark, sf_dir):
    return lo.budget_catalog(pb.budgets(spark, sf_dir)).select(
        "budget_id", "env_id", "module", "endpoint", "threshold_pct", "is_active")


@query("recording_list", pp._REC_SQL + """,
pat AS (SELECT env_id, period, count(DISTINCT (model, method)) AS n1_patterns FROM spans WHERE is_n1 GROUP BY 1, 2),
s AS (SELECT env_id, period, CAST(sum(ms) AS BIGINT) AS total_ms, count(*) FILTER (WHERE category = 'sql') AS sql_count,
             CAST(sum(CASE WHEN category = 'sql' THEN ms ELSE 0 END) AS BIGINT) AS sql_ms FROM spans GROUP BY 1, 2)
SELECT s.*, pat.n1_patterns IS NOT NULL AS has_n1 FROM s LEFT JOIN pat USING (env_id, period)""", ops="F6 A16")
def q_recording_list(spark, sf_dir):
    spans = pp.spans(spark, sf_dir)
    patterns = (po.recording_patterns(spans, pp.REC).groupBy(*pp.REC)
                .agg(F.count(F.lit(1)).alias("n1_patterns")))
    rows = (po.waterfall_summary(spans, pp.REC).select(*pp.REC, "total_ms", "sql_count", "sql_ms")
            .join(patterns, pp.REC, "left"))
    return lo.presence_flags(rows, {"has_n1": "n1_patterns"})


@query("schema_models", "WITH " + pu._IDX_SQL.lstrip() + """
SELECT env_id, model, string_agg(field, ',' ORDER BY field) AS fields, count(*) AS n_fields
FROM (SELECT DISTINCT env_id, model, field FROM idx) GROUP BY 1, 2""", ops="J11")
def q_schema_models(spark, sf_dir):
    idx = pu.schema_index(spark, sf_dir)
    nested = lo.nest(idx.select("env_id", "model").distinct(), idx, ["env_id", "model"], F.struct("field"), "fields")
    return nested.select("env_id", "model", F.array_join(F.col("fields.field"), ",").alias("fields"),
                         F.size("fields").cast("long").alias("n_fields"))


@query("model_access", """
WITH acl AS (
  SELECT model_id, string_agg(group_id || ':' || rights, ',' ORDER BY group_id, rights) AS accesses FROM (
    SELECT DISTINCT s_suppkey % 30 AS model_id, CAST(s_nationkey % 10 AS VARCHAR) AS group_id,
           CASE WHEN s_acctbal < 0 THEN 'r' ELSE 'rw' END AS rights FROM supplier) GROUP BY 1),
rules AS (
  SELECT model_id, string_agg(name || '=' || scope, ',' ORDER BY name, scope) AS rules FROM (
    SELECT DISTINCT p_size % 30 AS model_id, p_brand AS name, p_type AS scope FROM part) GROUP BY 1)
SELECT n_nationkey AS model_id, n_name AS model, coalesce(accesses, '') AS accesses, coalesce(rules, '') AS rules
FROM nation LEFT JOIN acl ON acl.model_id = n_nationkey LEFT JOIN rules ON rules.model_id = n_nationkey""", ops="J12")
def q_model_access(spark, sf_dir):
    models = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("model_id"),
                                                     F.col("n_name").alias("model"))
    acl = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") % 30).cast("int").alias("model_id"), (F.col("s_nationkey") % 10).cast("string").alias("group_id"),
        F.when(F.col("s_acctbal") < 0, "r").otherwise("rw").alias("rights"))
    rules = table(spark, sf_dir, "part").select((F.col("p_size") % 30).cast("int").alias("model_id"),
                                                F.col("p_brand").alias("name"), F.col("p_type").alias("scope"))
    nested = lo.nest(models, acl, ["model_id"], F.struct("group_id", "rights"), "accesses")
    nested = lo.nest(nested, rules, ["model_id"], F.struct("name", "scope"), "rules")
    return nested.select(
        "model_id", "model",
        F.array_join(F.transform("accesses", lambda x: F.concat_ws(":", x["group_id"], x["rights"])), ",").alias("accesses"),
        F.array_join(F.transform("rules", lambda x: F.concat_ws("=", x["name"], x["scope"])), ",").alias("rules"))


@query("ordered_distinct", """
SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words
FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS w FROM part)""", ops="X4")
def q_ordered_distinct(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")
    return p.select("p_partkey", F.array_join(lo.ordered_distinct(words), " ").alias("words"))


_FRAME_SQL = REGISTRY["profile_frame_time"].sql


@query("compute_fields", f"""
WITH fr AS ({_FRAME_SQL}),
idx AS (
  SELECT '_compute_' || CASE n_nationkey % 2 WHEN 0 THEN 'click_' ELSE 'signup_' END || CAST(n_nationkey % 3 AS VARCHAR)
           AS method_name,
         n_name AS model, 'f' || CAST(n_regionkey AS VARCHAR) AS field_name, n_name || ',' || n_name || '.total' AS depends_on,
         CASE WHEN n_nationkey % 4 > 0 THEN 'base' ELSE '' END AS module
  FROM nation WHERE n_nationkey % 5 <> 0)
SELECT profile_id, method_name, duration_ms, coalesce(model, '') AS model, coalesce(field_name, '') AS field_name,
       coalesce(depends_on, '') AS depends_on,
       CASE WHEN model IS NULL THEN split_part(source_file, '/', 2) ELSE module END AS module
FROM fr LEFT JOIN idx USING (method_name)""", ops="J13 C21 A20")
def q_compute_fields(spark, sf_dir):
    """Field metadata: a nation is a computed field; every fifth has no compute method and is skipped."""
    k = F.col("n_nationkey")
    method = F.concat(F.lit("_compute_"), F.when(k % 2 == 0, "click_").otherwise("signup_"), (k % 3).cast("string"))
    records = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("model"), F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("name"),
        F.when(k % 5 != 0, method).alias("compute"),
        F.concat(F.col("n_name"), F.lit(", "), F.col("n_name"), F.lit(".total,")).alias("depends"),
        F.when(k % 4 > 0, F.lit("base, sale")).alias("modules"))
    frames = po.frame_time(*pp.profile_rows(spark, sf_dir)).withColumn(
        "source_file", F.concat(F.lit("/srv/"), "source_file"))
    return lo.with_fields(frames, lo.field_index(records)).select(
        "profile_id", "method_name", "duration_ms", "model", "field_name",
        F.array_join("depends_on", ",").alias("depends_on"), "module")
