"""Whole ingest: all tables of a batch or none, replays, status transitions, the breach stream."""

import os

import pytest
from pyspark.sql import functions as F

from vantage.operators import budgets as bo
from vantage.operators import errors as eo
from vantage.plans.budgets import budgets as budget_table
from vantage.sources.tables import bind_events
from vantage.streaming import batch_ingest as bi
from vantage.streaming.ingest import event_stream
from vantage.streaming.store import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").cache()


@pytest.fixture(scope="module")
def budgets(spark):
    return budget_table(spark, SF).withColumn("threshold_pct", F.lit(10)).cache()


def halves(events):
    mid = events.approxQuantile("event_id", [0.5], 0)[0]
    return events.filter(F.col("event_id") <= mid), events.filter(F.col("event_id") > mid)


def view(store):
    rows = lambda df: sorted(map(str, df.collect()))
    return {"groups": rows(store.state("error_groups", bi.GROUPS)), "alerts": rows(store.appended("error_alerts", bi.ALERTS)),
            "samples": rows(store.appended("budget_samples", bi.SAMPLES)), "breaches": rows(store.appended("breaches", bi.SAMPLES)),
            "stats": rows(store.appended("orm_stats", "env_id string, model string, method string, call_count long")),
            "recordings": rows(store.appended("recordings", "env_id string, total_ms long"))}


def test_replay_and_crash_change_nothing(spark, tmp_path, events, budgets):
    one, two = halves(events)
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    assert bi.ingest(store, one, "b0", budgets)
    first = view(store)
    assert all(first[k] for k in ("groups", "samples", "breaches", "stats", "recordings"))
    assert not bi.ingest(store, one, "b0", budgets) and view(store) == first  # the batch id is known

    def crash():
        raise RuntimeError("lost driver")

    with pytest.raises(RuntimeError):
        bi.ingest(store, two, "b1", budgets, before_manifest=crash)
    assert view(store) == first  # everything but the manifest was written
    assert bi.ingest(store, two, "b1", budgets)
    got = store.state("error_groups", bi.GROUPS).drop("status")
    want = eo.group_errors(eo.error_events(bind_events(events)))
    columns = [c for c in want.columns if c in got.columns]
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0 and got.count() == want.count()
    last = view(store)
    assert len(last["samples"]) > len(first["samples"]) and not bi.ingest(store, two, "b1", budgets) and view(store) == last


def test_status_transitions(spark, tmp_path, events, budgets):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    row = lambda i, user, kind="error": (i, user, kind)

    def batch(*rows):
        return spark.createDataFrame([(i, "2024-01-01 00:00:00", u, k, 1.5, '{"k": 1}') for i, u, k in rows],
                                     "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn(
            "ts", F.col("ts").cast("timestamp_ntz"))

    def status():
        return {r.model: (r.status, r.occurrence_count) for r in store.state("error_groups", bi.GROUPS).collect()}

    bi.ingest(store, batch(row(1, 1), row(2, 2), row(3, 3)), "b0", budgets)
    assert status() == {"m1": ("open", 1), "m2": ("open", 1), "m3": ("open", 1)}
    known = store.state("error_groups", bi.GROUPS)
    changes = known.filter("model <> 'm3'").select("env_id", "signature", F.when(F.col("model") == "m1", "resolved").otherwise("acknowledged").alias("status"))
    assert bi.set_status(store, changes, "status-0") and not bi.set_status(store, changes, "status-0")
    assert status() == {"m1": ("resolved", 1), "m2": ("acknowledged", 1), "m3": ("open", 1)}
    bi.ingest(store, batch(row(4, 1), row(5, 1), row(6, 3), row(7, 4)), "b1", budgets)
    assert status() == {"m1": ("open", 3), "m2": ("acknowledged", 1), "m3": ("open", 2), "m4": ("open", 1)}
    alerts = store.appended("error_alerts", bi.ALERTS).collect()
    assert [(a.type, a.severity, a.occurrence_count) for a in alerts] == [("error_reopen", "critical", 3)]
    assert alerts[0].message.startswith("Resolved error re-fired: ") and alerts[0].message.endswith("(3 total occurrences)")
    assert '"model":"m1"' in alerts[0].metadata


def test_bad_rows_are_quarantined(spark, tmp_path, budgets):
    store = Store(spark, str(tmp_path / "s"))
    rows = [(1, "2024-01-01", 1, "error", 1.0, '{"k": 1}'), (None, "2024-01-01", 1, "error", 1.0, "{}"), (3, None, 1, "error", 1.0, "{}"),
            (4, "2024-01-01", 1, "error", float("nan"), "{}"), (5, "2024-01-01", 1, "error", 1.0, "not json"), (6, "2024-01-01", 1, "error", None, None)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    bi.ingest(store, df, "b0", budgets)
    bad = store.appended("quarantine", "event_id long, props string").collect()
    assert sorted((r.event_id is None, r.event_id) for r in bad if r.event_id) == [(False, 3), (False, 4), (False, 5)] and len(bad) == 4
    assert sum(r.occurrence_count for r in store.state("error_groups", bi.GROUPS).collect()) == 2


def test_breaches_come_back_as_a_stream(spark, tmp_path, events, budgets):
    one, two = halves(events)
    for name, part in (("0", one), ("1", two)):
        part.coalesce(1).write.parquet(str(tmp_path / "land" / name))
    store, alerts = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "a"))
    source = event_stream(spark, str(tmp_path / "land" / "*"))
    bi.ingest_stream(store, source, budgets, str(tmp_path / "c1"))
    assert store.manifest().select("batch").distinct().count() == 2
    for _ in range(2):  # a second run finds nothing new
        bi.alert_stream(spark, store, alerts, str(tmp_path / "c2"))
    got = alerts.appended("alerts", bi.BUDGET_ALERTS)
    want = bo.budget_alerts(store.appended("budget_samples", bi.SAMPLES))
    assert want.count() > 0
    pairs = lambda df, t: sorted(tuple(r) for r in df.select("env_id", "budget_id", F.col(t).cast("string"), "severity", "message").collect())
    assert pairs(got, "period") == pairs(want, "created_at")
    assert got.filter("get_json_object(metadata, '$.threshold_pct') = '10'").count() == got.count()
    assert os.path.isdir(tmp_path / "a" / "alerts")


def test_a_batch_is_read_once(spark, tmp_path, events, budgets):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    some = events.limit(200)
    assert bi.ingest(Store(spark, str(tmp_path / "s"), buckets=4), some.withColumn("value", counted.asNondeterministic()("value")), "b0", budgets)
    assert read.value == some.count()
