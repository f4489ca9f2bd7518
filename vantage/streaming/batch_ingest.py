"""Whole ingest of event batches (R20): five outputs of a batch, then breaches as a second stream (SNK4).

A micro-batch of events is split into rows that can be used and quarantined ones (S6); the
good ones are folded into error groups with their status (S5), and give window
statistics, recordings, budget samples and threshold breaches.  All of it is committed at once
through ``store``.  The second stream follows the manifest, so that it sees committed
breaches only, and turns them into alerts that are ten minutes apart for each budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.operators import budgets as bo
from vantage.operators import errors as eo
from vantage.operators.profiles import waterfall_spans, waterfall_summary
from vantage.operators.stats import window_stats
from vantage.operators.windows import flag_n1
from vantage.session import written
from vantage.sources.tables import bind_events
from vantage.streaming.ingest import valid_events
from vantage.streaming.store import MANIFEST, Store

KEYS = ["env_id", "signature"]
GROUPS = ("env_id string, signature string, occurrence_count long, first_seen timestamp, last_seen timestamp, message string, "
          "error_type string, module string, model string, affected_users array<int>, status string")
ALERTS = "env_id string, signature string, occurrence_count long, type string, severity string, message string, metadata string"
SAMPLES = ("env_id string, module string, period timestamp, module_ms long, sql_ms long, sql_count long, orm_ms long, orm_count long, "
           "python_ms long, total_ms long, budget_id string, endpoint string, threshold_pct int, overhead_pct double, breach boolean")
BUDGET_ALERTS = "env_id string, budget_id string, module string, period timestamp, type string, severity string, message string, metadata string"


def fold_groups(state: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups after the batch, re-open alerts).  ``state`` has a status; a group that fires again
    is open, and one that was resolved or acknowledged raises a critical alert."""
    before = state.select(*KEYS, F.col("status").alias("_was"))
    merged = eo.merge_groups(state.drop("status"), delta)
    fired = delta.select(*KEYS, F.lit(True).alias("_fired"))
    j = merged.join(before, KEYS, "left").join(fired, KEYS, "left")
    hit = F.coalesce("_fired", F.lit(False))
    after = j.withColumn("status", F.when(hit, F.lit(eo.OPEN)).otherwise(F.coalesce("_was", F.lit(eo.OPEN))))
    alerts = after.filter(hit & F.col("_was").isin(eo.RESOLVED, eo.ACKNOWLEDGED)).select(
        *KEYS, "occurrence_count", F.lit("error_reopen").alias("type"), F.lit("critical").alias("severity"),
        F.format_string("Resolved error re-fired: %s (%d total occurrences)", F.substring("signature", 1, 40), "occurrence_count").alias("message"),
        F.to_json(F.struct("signature", "error_type", "occurrence_count", "model", "module")).alias("metadata"))
    return after.drop("_was", "_fired"), alerts


def ingest(store: Store, batch: DataFrame, name: str, budgets: DataFrame, window: str = "1 hour", before_manifest=None) -> bool:
    """One batch of raw event rows into all tables of ``store``; False if ``name`` was committed before.

    What several outputs read (the checked rows, the flagged ones, the groups of the batch, the samples) is
    computed once and written beside the store's tables, so the batch itself is read once."""
    if store.done(name):
        return False
    v = valid_events(batch).withColumn("_valid", F.col("_valid") & ~F.isnan(F.coalesce("value", F.lit(0.0)))
                                       & (F.col("props").isNull() | F.get_json_object("props", "$").isNotNull()))
    v = written(v)
    good = bind_events(v.filter("_valid").drop("_valid"))
    flagged = written(flag_n1(good).withColumn("period", F.window("ts", window).start))
    profiled = bo.batches(flagged, window)
    delta = written(eo.group_errors(eo.error_events(good)))
    state = store.touched(store.state("error_groups", GROUPS), delta, KEYS)
    groups, alerts = fold_groups(state, delta)
    samples = written(bo.overhead_samples(bo.module_stats(profiled), budgets).select(*[c.split()[0] for c in SAMPLES.split(", ")]))
    return store.commit(
        name,
        {"quarantine": v.filter(~F.col("_valid")).drop("_valid"), "error_alerts": alerts,
         "orm_stats": window_stats(flagged.drop("period"), "30 seconds"),
         "recordings": waterfall_summary(waterfall_spans(profiled, ["env_id", "period"]), ["env_id", "period"]),
         "budget_samples": samples, "breaches": samples.filter("breach")},
        {"error_groups": (groups, KEYS)}, before_manifest)


def set_status(store: Store, changes: DataFrame, name: str) -> bool:
    """U2 on the stored groups: ``changes`` (env_id, signature, status) under the batch name ``name``."""
    known = store.touched(store.state("error_groups", GROUPS), changes, KEYS)
    new = (known.join(changes.select(*KEYS, F.col("status").alias("_new")), KEYS, "left")
           .withColumn("status", F.coalesce("_new", "status")).drop("_new"))
    return store.commit(name, {}, {"error_groups": (new, KEYS)})


def ingest_stream(store: Store, events: DataFrame, budgets: DataFrame, checkpoint: str) -> None:
    """R20 over what is available of an event stream."""
    def handle(rows: DataFrame, batch_id: int) -> None:
        rows.persist()  # read once for each output
        try:
            ingest(store, rows, f"events-{batch_id}", budgets)
        finally:
            rows.unpersist()

    (events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def budget_alerts(breaches: DataFrame, past: DataFrame, cooldown: str = "10 minutes") -> DataFrame:
    """R19 + W9: alerts of new ``breaches``, none within ``cooldown`` of an alert for the same budget, ``past`` ones included."""
    keys = ["env_id", "budget_id", "module"]
    columns = [*keys, "period", "endpoint", "overhead_pct", "threshold_pct", "total_ms", "module_ms"]
    last = past.groupBy(*keys).agg(F.max("period").alias("period"))
    none = [F.lit(None).cast(breaches.schema[c].dataType).alias(c) for c in columns[4:]]
    rows = breaches.select(*columns).unionByName(last.select(*keys, "period", *none))
    kept = bo.cooldown_fold(rows, keys, "period", cooldown).filter(F.col("overhead_pct").isNotNull())
    return bo.alert_rows(kept).select(*keys[:2], "module", F.col("created_at").alias("period"), "type", "severity", "message", "metadata")


def alert_stream(spark: SparkSession, store: Store, alerts: Store, checkpoint: str, cooldown: str = "10 minutes") -> None:
    """SNK4: follows the manifest of ``store`` and appends the alerts of newly committed breaches to ``alerts``."""
    def handle(rows: DataFrame, batch_id: int) -> None:
        new = rows.filter("table = 'breaches'").select("seq", "attempt")
        files = store.files("breaches", SAMPLES).join(new, ["seq", "attempt"], "left_semi").drop("seq", "attempt", "bucket")
        alerts.commit(f"breaches-{batch_id}", {"alerts": budget_alerts(files, alerts.appended("alerts", BUDGET_ALERTS), cooldown)}, {})

    committed = spark.readStream.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{store.base}/manifest")
    (committed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
