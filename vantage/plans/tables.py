"""Table-maintenance, listing and alert-delivery queries over orders,
customers, suppliers, lineitem and the event stream.

Bindings: a customer's orders stand for stateful rows (newest / keep-N /
paging / retention); nations are tenants with a retention policy JSON; a
supplier is an agent whose heartbeats are its line items' ship dates;
nations are notification channels of the environment ``env<nationkey % 3>``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import errors as eo
from vantage.operators import sampling as so
from vantage.operators import tables as to
from vantage.operators.windows import interval_us, keep_newest, latest_per_key, prev_in_group
from vantage.plans.errors import _errs, status_changes
from vantage.plans.registry import query
from vantage.plans.telemetry import _n1_cte, flagged_events
from vantage.sources.tables import EVENTS_CTE_SQL, table, telemetry_events

NOW = "1998-08-03 00:00:00"
KEEP_N = 3
PAGE, PER_PAGE = 2, 25
STALE_DAYS = 120
RAW_WINDOW, RAW_CAP = "1 day", 50
RATE_WINDOW, RATE_LIMIT = "1 day", 3
LOCK_WINDOW, LOCK_MAX, LOCK_FOR = "1 day", 3, "2 days"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                 "o_orderdate", "o_orderpriority")


@query("latest_per_key", """
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1""", ops="W4")
def q_latest_per_key(spark, sf_dir):
    return latest_per_key(_orders(spark, sf_dir), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("keep_n", f"""
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank
  FROM orders) WHERE rank <= {KEEP_N}""", ops="W3 U5 J6")
def q_keep_n(spark, sf_dir):
    return keep_newest(_orders(spark, sf_dir), ["o_custkey"],
                       [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], KEEP_N, rank_col="rank")


def _policies(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    d = F.when(F.col("n_nationkey") % 7 == 3, F.lit(-1)).otherwise((F.col("n_nationkey") % 4) * 400)
    js = F.concat(F.lit('{"error_traces_days": '), d.cast("string"), F.lit(', "raw_logs_days": 5}'))
    return n.select(F.col("n_nationkey").alias("tenant_id"), to.parse_policy(js).alias("p")) \
        .select("tenant_id", "p.*")


@query("retention_age", f"""
WITH pol AS (
  SELECT n_nationkey AS tenant_id,
         coalesce(nullif(CASE WHEN n_nationkey % 7 = 3 THEN -1 ELSE (n_nationkey % 4) * 400 END, 0), 7)
           AS error_traces_days
  FROM nation),
r AS (SELECT o.o_orderkey, o.o_orderdate, c.c_nationkey AS tenant_id
      FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)
SELECT r.tenant_id, r.o_orderkey, r.o_orderdate, p.error_traces_days
FROM r LEFT JOIN pol p USING (tenant_id)
WHERE p.error_traces_days IS NULL OR p.error_traces_days <= 0
   OR r.o_orderdate >= TIMESTAMP '{NOW}' - p.error_traces_days * INTERVAL 1 DAY""", ops="U4 N7 J4")
def q_retention_age(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                F.col("c_nationkey").alias("tenant_id"))
    rows = o.join(c, "o_custkey").drop("o_custkey")
    pol = _policies(spark, sf_dir).select("tenant_id", "error_traces_days")
    return to.retain_by_age(rows, pol, "tenant_id", "o_orderdate", "error_traces_days", NOW)


@query("stale_keys", f"""
SELECT s.s_suppkey, s.s_name, coalesce(h.last_seen, TIMESTAMP '1970-01-01 00:00:00') AS last_seen,
       h.last_seen IS NULL OR h.last_seen < TIMESTAMP '{NOW}' - INTERVAL {STALE_DAYS} DAY AS is_stale
FROM supplier s LEFT JOIN (SELECT l_suppkey, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1) h
  ON h.l_suppkey = s.s_suppkey""", ops="J3 W4 C24")
def q_stale_keys(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    hb = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_shipdate")
    return to.stale_agents(s, hb, "s_suppkey", "l_shipdate", NOW, STALE_DAYS)


@query("page_list", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
                  count(*) OVER (PARTITION BY o_orderstatus) AS total
           FROM orders)
SELECT o_orderstatus, o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, total,
       CAST(ceil(total / {PER_PAGE}) AS BIGINT) AS total_pages, {PAGE} AS page, {PER_PAGE} AS per_page,
       {PAGE} < CAST(ceil(total / {PER_PAGE}) AS BIGINT) AS has_next, {str(PAGE > 1).lower()} AS has_prev,
       rn - {(PAGE - 1) * PER_PAGE} - 1 AS row_in_page
FROM r WHERE rn > {(PAGE - 1) * PER_PAGE} AND rn <= {PAGE * PER_PAGE}""", ops="T2 T3 T6 T7")
def q_page_list(spark, sf_dir):
    return to.page(_orders(spark, sf_dir), ["o_orderstatus"],
                   [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], PAGE, PER_PAGE)


_CHANGES = f"""
changes AS (
  SELECT 'env' || CAST(o_custkey % 150 % 3 AS VARCHAR) AS env_id,
         'error:mod' || CAST(o_orderkey % 4 AS VARCHAR) || ':m' || CAST(o_custkey % 150 AS VARCHAR) || ':error'
           AS signature,
         make_timestamp((1704067200 + (o_orderkey * 7919) % 2592000) * 1000000) AS ts,
         o_orderkey AS seq,
         CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'acknowledged' ELSE 'open' END AS status
  FROM orders)"""


@query("status_fold", "WITH " + _CHANGES + """
SELECT env_id, signature, last(status ORDER BY ts, seq) AS status, count(*) AS changes,
       max(ts) AS last_ts, last(seq ORDER BY ts, seq) AS last_seq
FROM changes GROUP BY 1, 2""", ops="U2")
def q_status_fold(spark, sf_dir):
    return to.fold_status(status_changes(spark, sf_dir), ["env_id", "signature"], "status", ["ts", "seq"])


@query("patch_coalesce", """
WITH p AS (
  SELECT o_custkey AS c_custkey,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'PRIORITY' END AS c_mktsegment,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS c_acctbal
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM orders) WHERE rn = 1)
SELECT c.c_custkey, c.c_name, coalesce(p.c_mktsegment, c.c_mktsegment) AS c_mktsegment,
       coalesce(p.c_acctbal, c.c_acctbal) AS c_acctbal
FROM customer c LEFT JOIN p USING (c_custkey)""", ops="U3 P4 W4")
def q_patch_coalesce(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    last = latest_per_key(_orders(spark, sf_dir), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    patch = last.select(F.col("o_custkey").alias("c_custkey"),
                        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("PRIORITY")).alias("c_mktsegment"),
                        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("c_acctbal"))
    return to.patch_coalesce(base, patch, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("retry_reset", f"""
WITH ob AS (SELECT o_orderkey AS delivery_id,
                   CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'sent' END AS status,
                   o_orderkey % 5 AS attempt, o_orderdate AS created_at FROM orders)
SELECT delivery_id, attempt, created_at,
       CASE WHEN status = 'failed' AND attempt < 3 AND created_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR
            THEN 'pending' ELSE status END AS status,
       status = 'failed' AND attempt < 3 AND created_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AS was_reset
FROM ob""", ops="U7 U8")
def q_retry_reset(spark, sf_dir):
    o = _orders(spark, sf_dir)
    ob = o.select(F.col("o_orderkey").alias("delivery_id"),
                  F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "pending")
                  .otherwise("sent").alias("status"),
                  (F.col("o_orderkey") % 5).alias("attempt"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return to.retry_reset(ob, NOW)


@query("counter_delta", """
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate AS ts,
                  CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) // 30 AS BIGINT) AS poll_seq,
                  CAST(o_orderkey % 1000 AS BIGINT) AS calls, o_totalprice AS total_ms, o_totalprice / 100 AS max_ms
           FROM orders),
l AS (SELECT *, lag(poll_seq) OVER w AS pp, lag(calls) OVER w AS pc, lag(total_ms) OVER w AS pt FROM s
      WINDOW w AS (PARTITION BY o_custkey ORDER BY ts, poll_seq, o_orderkey)),
d AS (SELECT *, calls - pc AS delta_calls, total_ms - pt AS delta_ms FROM l
      WHERE pp IS NOT NULL AND poll_seq - pp = 1 AND calls - pc > 0)
SELECT o_custkey, o_orderkey, poll_seq, delta_calls, delta_ms,
       CAST(trunc(delta_ms / delta_calls) AS INTEGER) AS avg_ms,
       CASE WHEN CAST(trunc(delta_ms / delta_calls) AS INTEGER) = 0 THEN CAST(trunc(max_ms) AS INTEGER)
            ELSE CAST(trunc(delta_ms / delta_calls) AS INTEGER) END AS duration_ms
FROM d""", ops="W2 J16 S4(batch)")
def q_counter_delta(spark, sf_dir):
    o = _orders(spark, sf_dir)
    s = o.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"),
                 F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) / 30)
                 .cast("long").alias("poll_seq"),
                 (F.col("o_orderkey") % 1000).cast("long").alias("calls"),
                 F.col("o_totalprice").alias("total_ms"), (F.col("o_totalprice") / 100).alias("max_ms"))
    p = prev_in_group(s, ["o_custkey"], ["ts", "poll_seq", "o_orderkey"], ["poll_seq", "calls", "total_ms"],
                      bucket="30 days")
    d = (p.filter(F.col("prev_poll_seq").isNotNull() & (F.col("poll_seq") - F.col("prev_poll_seq") == 1))
         .withColumn("delta_calls", F.col("calls") - F.col("prev_calls"))
         .filter(F.col("delta_calls") > 0)
         .withColumn("delta_ms", F.col("total_ms") - F.col("prev_total_ms")))
    avg = (F.col("delta_ms") / F.col("delta_calls")).cast("int")  # towards zero
    return d.select("o_custkey", "o_orderkey", "poll_seq", "delta_calls", "delta_ms", avg.alias("avg_ms"),
                    F.when(avg == 0, F.col("max_ms").cast("int")).otherwise(avg).alias("duration_ms"))


_RW = interval_us(RAW_WINDOW)


@query("sampled_raw_events", "WITH " + EVENTS_CTE_SQL + _n1_cte() + f""",
cfg AS (SELECT * FROM (VALUES ('development', 'full', 1.0, 50, ''),
                              ('staging', 'sampled', 0.25, 100, 'error,slow_query,n1'),
                              ('production', 'aggregated_only', 0.05, 200, 'error,slow_query,n1'))
        t(env_type, mode, sample_rate, slow_threshold_ms, always_capture)),
e AS (SELECT *, CASE env_id WHEN 'env0' THEN 'development' WHEN 'env1' THEN 'staging' ELSE 'production' END
                  AS env_type FROM n1),
a AS (SELECT e.*, (is_error OR is_n1 OR coalesce(slow_threshold_ms > 0 AND duration_ms > slow_threshold_ms, false)
                   OR list_contains(string_split(lower(coalesce(always_capture, '')), ','), lower(category)))
                  OR CASE mode WHEN 'full' THEN true
                               WHEN 'sampled' THEN (seq * 2654435761) % 1000000 < sample_rate * 1000000
                               WHEN 'aggregated_only' THEN false ELSE true END AS allowed
      FROM e LEFT JOIN cfg USING (env_type)),
c AS (SELECT *, make_timestamp(epoch_us(ts) // {_RW} * {_RW}) AS period FROM a WHERE is_error OR allowed),
r AS (SELECT *, row_number() OVER (PARTITION BY env_id, period ORDER BY ts, seq) AS rn FROM c)
SELECT env_id, seq, period, category, duration_ms, is_n1, is_error, allowed FROM r
WHERE is_error OR rn <= {RAW_CAP}""", ops="F10 F11 W6")
def q_sampled_raw_events(spark, sf_dir):
    ev = flagged_events(spark, sf_dir).withColumn(
        "env_type", F.when(F.col("env_id") == "env0", "development").when(F.col("env_id") == "env1", "staging")
        .otherwise("production"))
    a = so.allow(ev, so.presets(spark))
    return so.cap_raw(a, RAW_WINDOW, RAW_CAP).select("env_id", "seq", "period", "category", "duration_ms",
                                                      "is_n1", "is_error", "allowed")


@query("request_rate", "WITH " + EVENTS_CTE_SQL + f""",
r AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS identifier, seq, ts,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, seq)
             - count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
                              RANGE BETWEEN UNBOUNDED PRECEDING AND {interval_us(RATE_WINDOW)} PRECEDING) - 1
               AS prior_requests
      FROM ev)
SELECT identifier, seq, ts, prior_requests, prior_requests < {RATE_LIMIT} AS allowed FROM r""", ops="U11")
def q_request_rate(spark, sf_dir):
    ev = telemetry_events(spark, sf_dir).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("identifier"), "seq", "ts")
    return to.request_rate(ev, ["identifier"], RATE_WINDOW, RATE_LIMIT)


@query("login_lockout", "WITH RECURSIVE " + EVENTS_CTE_SQL + f""",
att AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS identifier, seq, ts, method = 'signup' AS success,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS rn
        FROM ev WHERE method IN ('error', 'signup')),
f AS (
  SELECT identifier, seq, ts, success, rn, CASE WHEN success THEN 0 ELSE 1 END AS attempt,
         CASE WHEN NOT success THEN ts END AS began
  FROM att WHERE rn = 1
  UNION ALL
  SELECT a.identifier, a.seq, a.ts, a.success, a.rn,
         CASE WHEN a.success THEN 0 WHEN a.ts < f.began + INTERVAL '{LOCK_WINDOW}' THEN f.attempt + 1 ELSE 1 END,
         CASE WHEN a.success THEN NULL WHEN a.ts < f.began + INTERVAL '{LOCK_WINDOW}' THEN f.began ELSE a.ts END
  FROM f JOIN att a ON a.identifier = f.identifier AND a.rn = f.rn + 1)
SELECT identifier, seq, ts, success, CAST(attempt AS BIGINT) AS attempt, attempt >= {LOCK_MAX} AS locked,
       CASE WHEN attempt >= {LOCK_MAX} THEN ts + INTERVAL '{LOCK_FOR}' END AS locked_until
FROM f""", ops="U10")
def q_login_lockout(spark, sf_dir):
    ev = telemetry_events(spark, sf_dir).filter(F.col("method").isin("error", "signup"))
    att = ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("identifier"), "seq", "ts",
                    (F.col("method") == "signup").alias("success"))
    return to.login_lockout(att, LOCK_WINDOW, LOCK_MAX, LOCK_FOR)


# ------------------------------------------------------------ alert delivery

def channels(spark, sf_dir):
    """A channel per nation: a dimension of fixed size, so the fan-out grows with the alerts only."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return n.select(F.concat(F.lit("env"), (F.col("n_nationkey") % 3).cast("string")).alias("env_id"),
                    F.col("n_nationkey").alias("channel_id"),
                    F.when(F.col("n_regionkey") == 0, "slack")
                    .when(F.col("n_regionkey") == 1, "webhook").otherwise("email").alias("channel_type"),
                    (F.col("n_regionkey") != 4).alias("is_active"))


SPIKE = 5
_SPIKE_SQL = """
err AS (SELECT env_id, seq, ts, concat_ws(':', category, nullif(module, ''), nullif(model, ''), nullif(method, ''))
               AS signature, category AS error_type FROM ev WHERE is_error),
alerts AS (SELECT env_id, signature, seq, ts, rn AS occurrence_count,
                  printf('%s: %d occurrences of %s', error_type, rn, substr(signature, 1, 8)) AS message
           FROM (SELECT *, row_number() OVER (PARTITION BY env_id, signature ORDER BY ts, seq) AS rn FROM err)
           WHERE rn = 5),
ch AS (SELECT 'env' || CAST(n_nationkey % 3 AS VARCHAR) AS env_id, n_nationkey AS channel_id,
              CASE n_regionkey WHEN 0 THEN 'slack' WHEN 1 THEN 'webhook' ELSE 'email' END AS channel_type
       FROM nation WHERE n_regionkey <> 4)"""
PENDING_LIMIT = 100


def _alerts(spark, sf_dir):
    return eo.spike_alerts(_errs(spark, sf_dir), SPIKE).select("env_id", "signature", "seq", "ts", "message")


@query("alert_fanout", "WITH " + EVENTS_CTE_SQL + "," + _SPIKE_SQL + """
SELECT a.env_id, a.signature, a.seq, a.ts, a.message, ch.channel_id, ch.channel_type,
       'pending' AS status, 0 AS attempt
FROM alerts a JOIN ch USING (env_id)""", ops="J17 SNK5 C17")
def q_alert_fanout(spark, sf_dir):
    return to.fan_out(_alerts(spark, sf_dir), channels(spark, sf_dir), "env_id")


@query("pending_deliveries", "WITH " + EVENTS_CTE_SQL + "," + _SPIKE_SQL + f"""
SELECT a.env_id, a.signature, a.seq, a.ts, a.message, ch.channel_id, ch.channel_type
FROM alerts a JOIN ch USING (env_id) WHERE (a.seq + ch.channel_id) % 3 <> 0
ORDER BY a.ts, a.seq, ch.channel_id LIMIT {PENDING_LIMIT}""", ops="J1 T4 U8")
def q_pending_deliveries(spark, sf_dir):
    # a delivery is done already where alert and channel numbers add up to a multiple of three
    alerts, ch = _alerts(spark, sf_dir), channels(spark, sf_dir)
    sent = (F.col("seq") + F.col("channel_id")) % 3 == 0
    outbox = (to.fan_out(alerts.select("env_id", "seq", F.col("ts").alias("created_at")), ch, "env_id")
              .withColumn("status", F.when(sent, "delivered").otherwise("pending"))
              .select("seq", "channel_id", "status", "created_at"))
    return (to.pending_deliveries(outbox, ch, alerts, ["seq"], PENDING_LIMIT)
            .select("env_id", "signature", "seq", "ts", "message", "channel_id", "channel_type"))
