"""Dashboard, age limits, enrichment and nested results against results written out by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vantage.operators import environments as eo
from vantage.operators import n1 as n1ops
from vantage.operators import nested
from vantage.operators.errors import spike_alerts

T = datetime(2024, 1, 10)


def _dashboard(spark, **caps):
    envs = spark.createDataFrame([("a",), ("a",), ("b",), ("idle",)], "env_id string")
    hb = spark.createDataFrame([("a", "healthy", T, 1), ("a", "degraded", T, 2), ("a", "old", T - timedelta(days=1), 3),
                                ("gone", "healthy", T, 4)], "env_id string, status string, received_at timestamp, seq long")
    groups = spark.createDataFrame([("a", "open"), ("a", "resolved"), ("b", "open"), ("b", None)], "env_id string, status string")
    rec = spark.createDataFrame([("a", True)] * 3 + [("a", False), ("b", None)], "env_id string, has_chain boolean")
    pat = spark.createDataFrame([("a", "m1", "x", 50, "critical"), ("a", "m2", "x", 90, "low"), ("a", "m0", "x", 50, "low"),
                                 ("b", "m", "x", 1, "critical")],
                                "env_id string, model string, method string, total_duration_ms long, severity string")
    alerts = spark.createDataFrame([("a", True), ("a", False), ("a", None)], "env_id string, acknowledged boolean")
    budgets = spark.createDataFrame([("b", True), ("b", False)], "env_id string, is_active boolean")
    out = eo.dashboard(envs, hb, groups, rec, pat, alerts, budgets, **caps).collect()
    assert len(out) == 3
    return {r.env_id: r for r in out}


def test_dashboard(spark):
    got = _dashboard(spark)
    assert tuple(got["a"])[1:] == ("degraded", T, 2, 1, 4, 3, 3, 1, 2, 0, 0)
    assert tuple(got["b"])[1:] == ("unknown", None, 2, 1, 1, 0, 1, 1, 0, 2, 1)
    assert tuple(got["idle"])[1:] == ("unknown", None, *[0] * 9)


def test_dashboard_caps(spark):
    """The caps cut counts only: recordings stay whole, the cheaper of two patterns goes, ties by name."""
    a = _dashboard(spark, chain_cap=2, pattern_cap=2)["a"]
    assert (a.recordings_total, a.recordings_with_chain, a.n1_patterns, a.n1_critical) == (4, 2, 2, 0)


def test_age_limits(spark):
    rows = [("a", 1, T), ("a", 2, T - timedelta(days=2)), ("a", 3, T - timedelta(days=2, microseconds=1)),
            ("keep", 4, T - timedelta(days=900)), ("lost", 5, T - timedelta(days=900)), (None, 6, T - timedelta(days=9))]
    alerts = spark.createDataFrame(rows, "env_id string, seq long, created_at timestamp")
    envs = spark.createDataFrame([("a", "t1"), ("keep", "t2")], "env_id string, tenant_id string")
    pol = spark.createDataFrame([("t1", 2), ("t2", 0)], "tenant_id string, error_traces_days int")
    assert sorted(r.seq for r in eo.retain_alerts(alerts, envs, pol, str(T)).collect()) == [1, 2, 4, 5, 6]
    hb = spark.createDataFrame([(1, T), (2, T - timedelta(days=7)), (3, T - timedelta(days=7, seconds=1)), (4, None)],
                               "seq long, received_at timestamp")
    assert sorted(r.seq for r in eo.retain_heartbeats(hb, str(T)).collect()) == [1, 2, 4]
    assert eo.retain_heartbeats(hb.limit(0), str(T)).count() == 0


def test_patterns_are_enriched_only_where_recorded(spark):
    stats = spark.createDataFrame([("e", m, "read", T, 4, 10, 5, True, s) for m, s in
                                   (("filled", ""), ("kept", "select 1"), ("bare", ""), ("alone", "select 7"))],
                                  "env_id string, model string, method string, period timestamp, call_count long, "
                                  "total_ms long, max_ms long, n1_detected boolean, sample_sql string")
    rec = spark.createDataFrame([("e", "filled", "read", "q 5", "q ?"), ("e", "kept", "read", "q 6", "q ?"),
                                 ("other", "bare", "read", "q 7", "q ?")],
                                "env_id string, model string, method string, sample_sql string, signature string")
    got = {r.model: (r.sample_sql, r.signature) for r in
           n1ops.score_patterns(n1ops.n1_pattern_summary(stats), rec).collect()}
    assert got == {"filled": ("q 5", "q ?"), "kept": ("select 1", "q ?"), "bare": ("", ""), "alone": ("select 7", "select ?")}


def test_nested_results_in_chunks(spark):
    n = 8
    spans = spark.range(n).select(F.lit("r").alias("rec"), F.col("id").alias("pos"), (F.col("id") * 10).alias("ms"),
                                  F.lit("x").alias("full_sql")).repartition(5)
    spans = spans.unionByName(spark.createDataFrame([("s", 0, 7, "x")], "rec string, pos long, ms long, full_sql string"))
    lanes = spark.createDataFrame([("r", i, f"lane{i}") for i in range(4)] + [("s", 0, "only")], "rec string, pos long, label string")
    sums = spark.createDataFrame([("r", 280), ("s", 7)], "rec string, total_ms long")
    out = {(r.rec, r.chunk): r for r in nested.waterfall_documents(spans, lanes, sums, ["rec"], size=3).collect()}
    assert sorted(out) == [("r", 0), ("r", 1), ("r", 2), ("s", 0)]
    assert [[x.ms for x in out["r", c].spans] for c in range(3)] == [[0, 10, 20], [30, 40, 50], [60, 70]]
    assert [x.label for x in out["r", 0].lanes] == ["lane0", "lane1", "lane2"]
    assert [x.label for x in out["r", 1].lanes] == ["lane3"] and out["r", 2].lanes is None
    assert out["r", 0].summary.total_ms == 280 and out["r", 1].summary is None and out["s", 0].summary.total_ms == 7
    assert not hasattr(out["r", 0].spans[0], "full_sql")


def test_nested_chain_edges_lie_with_their_end(spark):
    chain = spark.createDataFrame([("r", i, f"compute-{i}") for i in range(5)], "rec string, idx int, node_id string")
    edges = spark.createDataFrame([("r", "compute-0", "compute-4", "", "parent"), ("r", "compute-3", "compute-4", "f", "depends"),
                                   ("r", "compute-0", "compute-1", "", "parent")],
                                  "rec string, src string, dst string, trigger_field string, kind string")
    stats = spark.createDataFrame([("r", 5)], "rec string, node_count long")
    out = {r.chunk: r for r in nested.chain_documents(chain, edges, stats, size=2).collect()}
    assert [x.dst for x in out[0].edges] == ["compute-1"] and out[1].edges is None
    assert [(x.kind, x.src) for x in out[2].edges] == [("depends", "compute-3"), ("parent", "compute-0")]
    assert out[0].summary.node_count == 5 and out[2].summary is None
    assert nested.chain_documents(chain.limit(0), edges, stats).count() == 0


def test_disabled_spike_alerts_keep_their_columns(spark):
    err = spark.createDataFrame([("e", "s", 1, T, "Error")], "env_id string, signature string, seq long, ts timestamp, error_type string")
    off = spike_alerts(err, 0)
    assert off.columns == spike_alerts(err, 1).columns and off.count() == 0 and spike_alerts(err, 1).count() == 1
