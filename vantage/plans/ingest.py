"""Ingest queries: the event table arrives in batches, the tables they leave behind are read back.

Groups: batches are cut by event id; behind the first one the groups of users 0 and 1 modulo 7 are
resolved and acknowledged.  Alerts: batches are cut at a midnight, and the breaches of
each come back as a stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vantage.plans.budgets import BATCH_WINDOW, COOLDOWN, budgets
from vantage.plans.errors import _ERR_CTE, _users_text
from vantage.plans.registry import REGISTRY, query
from vantage.session import checkpoint_dir
from vantage.sources.tables import table
from vantage.streaming import batch_ingest as bi
from vantage.streaming.store import Store

BATCHES = 3
MIDNIGHT = "2024-01-15 00:00:00"


def _store(spark, kind):
    return Store(spark, f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}")


@query("ingest_groups", _ERR_CTE + f""",
cut AS (SELECT max(event_id) // {BATCHES} + 1 AS width FROM events),
life AS (SELECT env_id, signature, min(seq) // any_value(width) AS first_batch, max(seq) // any_value(width) AS last_batch, any_value(CAST(substr(model, 2) AS INTEGER)) AS u
         FROM err, cut GROUP BY 1, 2)
SELECT groups.*, CASE WHEN first_batch > 0 OR last_batch > 0 OR u % 7 > 1 THEN 'open' WHEN u % 7 = 0 THEN 'resolved' ELSE 'acknowledged' END AS status,
       first_batch = 0 AND last_batch > 0 AND u % 7 < 2 AS reopened
FROM groups JOIN life USING (env_id, signature)""", ops="R20 S5 S6 U1 U2")
def q_ingest_groups(spark, sf_dir):
    events, store, rules = table(spark, sf_dir, "events"), _store(spark, "ingest"), budgets(spark, sf_dir)
    width = events.agg(F.max("event_id")).first()[0] // BATCHES + 1
    for i in range(BATCHES):
        bi.ingest(store, events.filter(F.floor(F.col("event_id") / width) == i), f"events-{i}", rules, BATCH_WINDOW)
        if i == 0:
            user = F.regexp_extract("model", r"(\d+)$", 1).cast("int") % 7
            known = store.state("error_groups", bi.GROUPS).filter(user < 2)
            bi.set_status(store, known.select("env_id", "signature", F.when(user == 0, "resolved").otherwise("acknowledged").alias("status")), "status-0")
    raised = store.appended("error_alerts", bi.ALERTS).select("env_id", "signature").distinct().withColumn("reopened", F.lit(True))
    groups = store.state("error_groups", bi.GROUPS).join(raised, ["env_id", "signature"], "left")
    return _users_text(groups.withColumn("reopened", F.coalesce("reopened", F.lit(False))))


@query("ingest_alerts", REGISTRY["budget_alerts"].sql, ops="SNK4 R19 R20 W9 C5")
def q_ingest_alerts(spark, sf_dir):
    events, rules = table(spark, sf_dir, "events"), budgets(spark, sf_dir)
    store, alerts = _store(spark, "ingest"), _store(spark, "alerts")
    early = F.col("ts") < F.lit(MIDNIGHT).cast("timestamp_ntz")
    for name, part in (("early", early), ("late", ~early | F.col("ts").isNull())):
        bi.ingest(store, events.filter(part), name, rules, BATCH_WINDOW)
        bi.alert_stream(spark, store, alerts, f"{alerts.base}/checkpoint", COOLDOWN)
    exceeded = F.get_json_object("metadata", "$.exceeded_by").cast("double")
    return alerts.appended("alerts", bi.BUDGET_ALERTS).select(
        "env_id", "budget_id", "module", F.col("period").alias("created_at"), "type", "severity", "message", exceeded.alias("exceeded_by"))
