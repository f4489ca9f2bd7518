from pyspark.sql import functions as F

from vantage.functions import parsing as pz
from vantage.operators.tables import parse_policy


def one(spark, expr, v):
    return spark.createDataFrame([(v,)], "a string").select(expr.alias("r")).first().r


def test_module_from_source(spark):
    assert one(spark, pz.module_from_source(F.col("a")), "/opt/odoo/addons/sale/models/x.py") == "sale"
    assert one(spark, pz.module_from_source(F.col("a")), "/srv/enterprise/helpdesk/models/t.py") == "helpdesk"
    assert one(spark, pz.module_from_source(F.col("a")), "/usr/lib/python3/x.py") == ""


def test_client_ip(spark):
    cases = {"10.0.0.1:8080": "10.0.0.1", "[::1]:443": "::1", "192.168.1.300": None, "10.0.0.1": "10.0.0.1",
             "[2001:db8::1]": "2001:db8::1", "garbage": None}
    for k, v in cases.items():
        assert one(spark, pz.client_ip(F.col("a")), k) == v, k


def test_many2one_and_flags(spark):
    assert one(spark, pz.many2one_id(F.col("a")), '[7, "Main Company"]') == 7
    assert one(spark, pz.many2one_id(F.col("a")), "false") is None
    assert one(spark, pz.many2many_ids(F.col("a")), "[0, 3, 5]") == [3, 5]
    c = one(spark, pz.sampler_config(F.col("a")), '{"sampling_mode": "sampled", "sample_rate": 0.25}')
    assert c.mode == "sampled" and c.always_capture == "error,slow_query,n1"
    assert one(spark, pz.sampler_config(F.col("a")), '{"sampling_mode": "full"}').always_capture == ""
    assert one(spark, pz.plan_policy(F.col("a")), "enterprise").raw_logs_days == 90
    assert one(spark, pz.plan_policy(F.col("a")), "unknown").error_traces_days == 7


def test_retention_policy_defaults(spark):
    p = one(spark, parse_policy(F.col("a")), '{"error_traces_days": 0, "raw_logs_days": -1}')
    assert (p.error_traces_days, p.profiler_recordings_days, p.budget_samples_days, p.schema_snapshots_keep,
            p.raw_logs_days, p.audit_log_days) == (7, 7, 30, 10, -1, 90)
    p = one(spark, parse_policy(F.col("a")), "not json")
    assert p.error_traces_days == 7 and p.audit_log_days == 90


def test_pull_since_and_stat_scan(spark):
    from vantage.sources.incremental import pull_since, stat_snapshot_scan
    df = spark.createDataFrame([(i, f"r{i}") for i in range(1, 11)], "id long, v string")
    batch, mark = pull_since(df, "id", 4, 3)
    assert [r.id for r in batch.collect()] == [5, 6, 7] and mark.first().hwm == 7
    _, empty = pull_since(df, "id", 10, 3)
    assert empty.first().hwm == 10
    stats = spark.createDataFrame([("e", "SET x = 1", 9), ("e", "begin", 8), ("e", "SELECT 1", 5), ("e", "SELECT 2", 7)],
                                  "env_id string, query string, total_ms long")
    assert [r.query for r in stat_snapshot_scan(stats, top=1).collect()] == ["SELECT 2"]


def test_breakdown_and_envelopes(spark):
    from vantage.sources import json_batches as jb
    df = spark.createDataFrame([('{"sql_ms": 200, "orm_ms": 300}',), ("oops",)], "a string")
    r = df.select(jb.parse_breakdown(F.col("a")).alias("b")).collect()
    assert r[0].b.sql_ms == 200 and r[0].b.functions == []
    hb = one(spark, jb.parse_heartbeat(F.col("a")), '{"agent_version": "1.2", "status": "online"}')
    assert hb.status == "online" and hb.metadata == "{}"
    env = spark.createDataFrame([("e1", '{"lines": ["a", "b"]}'), ("e2", "bad"), ("e3", '{"lines": []}')],
                                "env_id string, payload string")
    rows = [(x.env_id, x.pos, x.line) for x in jb.log_line_rows(env).collect()]
    assert rows == [("e1", 0, "a"), ("e1", 1, "b")]
