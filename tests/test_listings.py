"""Listings, nested records and the closed-only retention rule."""

from datetime import datetime

from pyspark.sql import functions as F

from vantage.operators import listings as lo
from vantage.sources import json_batches as jb

GROUPS = "env_id string, signature string, occurrence_count long, last_seen timestamp, error_type string, message string, " \
         "module string, model string"


def _day(n):
    return datetime(2024, 1, n)


def _groups(spark):
    return spark.createDataFrame([
        ("e", "a", 5, _day(1), "T", "boom", None, None),
        ("e", "b", 9, _day(2), "U", "calm", "Boom", None),
        ("e", "c", 5, _day(3), "T", "quiet", None, "x"),
        ("e", "d", 5, _day(3), "T", None, None, None)], GROUPS)


def _signatures(df):
    return [r.signature for r in df.orderBy("row_in_page").collect()]


def test_list_variants_and_order(spark):
    changes = spark.createDataFrame([("e", "a", _day(4), 1, "resolved"), ("e", "b", _day(4), 2, "resolved"),
                                     ("e", "b", _day(5), 3, "open")],
                                    "env_id string, signature string, ts timestamp, seq long, status string")
    g = lo.with_status(_groups(spark), changes)
    assert _signatures(lo.list_groups(g)) == ["b", "c", "d", "a"]  # count, then last seen, then signature
    assert _signatures(lo.list_groups(g, search="boom", status="open", error_type="T")) == ["b", "a"]
    assert _signatures(lo.list_groups(g, status="open", error_type="T")) == ["c", "d", "b"]
    assert _signatures(lo.list_groups(g, error_type="T")) == ["c", "d", "a"]
    assert _signatures(lo.list_groups(g, page_no=2, per_page=3)) == ["a"]


def test_only_closed_groups_expire(spark):
    g = (_groups(spark).withColumn("status", F.when(F.col("signature") == "b", "open").otherwise("resolved"))
         .unionByName(_groups(spark).withColumn("env_id", F.lit("kept")).withColumn("status", F.lit("resolved"))))
    owners = spark.createDataFrame([("e", "t1", 7), ("kept", "t2", 0)], "env_id string, tenant_id string, days int")
    gone = lo.expired_groups(g, owners, "2024-01-10 00:00:00").collect()
    # c and d were seen exactly at the cutoff; b is open; a policy of 0 days keeps all
    assert [(r.env_id, r.signature) for r in gone] == [("e", "a")]


def test_nest_keeps_empty_parents_and_drops_orphans(spark):
    parents = spark.createDataFrame([(1, "m1"), (2, "m2")], "model_id int, model string")
    children = spark.createDataFrame([(1, "b", True), (1, "a", False), (1, "a", False), (9, "z", True)],
                                     "model_id int, name string, perm boolean")
    got = {r.model_id: [tuple(x) for x in r.accesses]
           for r in lo.nest(parents, children, ["model_id"], F.struct("name", "perm"), "accesses").collect()}
    assert got == {1: [("a", False), ("b", True)], 2: []}


def test_flags_catalog_and_distinct(spark):
    df = spark.createDataFrame([(1, 3), (2, None)], "id int, n1_patterns int")
    flagged = lo.presence_flags(df, {"has_n1": "n1_patterns"})
    assert flagged.columns == ["id", "has_n1"] and [r.has_n1 for r in flagged.orderBy("id").collect()] == [True, False]
    b = spark.createDataFrame([("e", "m2", "x", "1", True), ("e", "m1", "y", "2", True), ("e", "m1", "x", "3", False)],
                              "env_id string, module string, endpoint string, budget_id string, is_active boolean")
    assert [r.budget_id for r in lo.budget_catalog(b).collect()] == ["2", "1"]
    assert [r.budget_id for r in lo.budget_catalog(b, active_only=False).collect()] == ["3", "2", "1"]
    words = spark.createDataFrame([(["b", "a", "b", "c", "a"],)], "w array<string>")
    assert words.select(lo.ordered_distinct(F.col("w")).alias("w")).first().w == ["b", "a", "c"]


def test_error_batches(spark, tmp_path):
    (tmp_path / "b.json").write_text("\n".join([
        '{"env_id":"e","sent_at":"2024-01-01T00:00:30.000000Z","spike_threshold":3,"events":['
        '{"signature":"s1","type":"T","message":"m","module":"","timestamp":"2024-01-01T00:00:01.000002Z",'
        '"context":{"uid":0}},'
        '{"signature":"s2","type":"T","message":"m","model":"x","timestamp":"2024-01-01T00:00:02.000000Z",'
        '"context":{"uid":7}},{"type":"T"}]}',
        '{"env_id":"","events":[{"signature":"s3"}]}', '{"env_id":"e","events":null}', 'not json']))
    rows = jb.error_rows(jb.read_error_batches(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r.signature, r.module, r.model, r.user_id, r.spike_threshold, r.ts.microsecond) for r in rows] == [
        ("s1", None, None, None, 3, 2), ("s2", None, "x", 7, 3, 0)]


def test_fields_of_methods(spark):
    records = spark.createDataFrame([
        ("order", "total", "_compute_total", " line , line.price,", "sale, base"), ("order", "tax", "_compute_total", None, None),
        ("", "x", "_compute_total", None, None), ("order", "plain", None, "a", "m")],
        "model string, name string, compute string, depends string, modules string")
    frames = spark.createDataFrame([("_compute_total", "/x/addons/own/a.py"), ("_compute_other", "/x/addons/own/a.py"),
                                    ("_compute_lost", None)], "method_name string, source_file string")
    got = sorted((r.method_name, r.model, r.field_name, tuple(r.depends_on), r.module)
                 for r in lo.with_fields(frames, lo.field_index(records)).collect())
    assert got == [("_compute_lost", "", "", (), ""), ("_compute_other", "", "", (), "own"),
                   ("_compute_total", "order", "tax", (), ""),
                   ("_compute_total", "order", "total", ("line", "line.price"), "sale")]
