"""Ordered folds against brute force (W9 cool-down, U10 lock-out, R17 depth)."""

import random
from datetime import datetime, timedelta

from vantage.operators import budgets as bo
from vantage.operators import profiles as po
from vantage.operators import tables as to


def test_cooldown_matches_greedy(spark):
    rnd = random.Random(3)
    rows, t = [], datetime(2024, 1, 1)
    for i in range(300):
        t += timedelta(minutes=rnd.choice([1, 2, 5, 11, 30]))
        rows.append((f"k{i % 3}", t, i))
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq long")
    got = {r.seq for r in bo.cooldown_fold(df, ["key"], "ts", "10 minutes").collect()}
    want, last = set(), {}
    for k, ts, s in sorted(rows, key=lambda r: (r[0], r[1])):
        if k not in last or ts - last[k] >= timedelta(minutes=10):
            want.add(s)
            last[k] = ts
    assert got == want


def test_login_lockout_matches_simulation(spark):
    rnd = random.Random(5)
    rows, t = [], datetime(2024, 1, 1)
    for i in range(400):
        t += timedelta(minutes=rnd.choice([1, 2, 3, 20]))
        rows.append((f"u{i % 4}", i, t, rnd.random() < 0.15))
    df = spark.createDataFrame(rows, "identifier string, seq long, ts timestamp, success boolean")
    got = {r.seq: (r.attempt, r.locked) for r in to.login_lockout(df, "15 minutes", 5, "30 minutes").collect()}
    state = {}
    for ident, s, ts, ok in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        cnt, start = state.get(ident, (0, None))
        if ok:
            state[ident] = (0, None)
            assert got[s] == (0, False)
            continue
        if start is None or ts >= start + timedelta(minutes=15):
            cnt, start = 1, ts
        else:
            cnt += 1
        state[ident] = (cnt, start)
        assert got[s] == (cnt, cnt >= 5)


def test_compute_chain_fixture(spark):
    # price_subtotal (20) -> price_total (15) -> amount_total (120)
    rows = [("r", 0, "sale.order.line", "price_subtotal", "_compute_amount", 20, [], "product_uom_qty"),
            ("r", 1, "sale.order.line", "price_total", "_compute_amount", 15, ["price_subtotal"], ""),
            ("r", 2, "sale.order.line", "amount_total", "_compute_amounts", 120, ["price_total"], "")]
    df = spark.createDataFrame(rows, "rec string, idx int, model string, field_name string, method string, "
                                     "duration_ms int, depends_on array<string>, trigger_field string")
    chain = po.compute_chain(df)
    edges = {(r.src, r.dst) for r in po.compute_edges(chain).collect()}
    assert ("compute-0", "compute-1") in edges
    s = po.compute_stats(chain).first()
    assert (s.total_ms, s.max_depth, s.slowest_node, s.slowest_ms) == (155, 2, "compute-2", 120)
    assert s.trigger_field == "product_uom_qty"
    # 5, 8, 200 ms: average 71, threshold 142, one bottleneck
    rows = [("q", i, "m", f"f{i}", "x", d, [], "") for i, d in enumerate([5, 8, 200])]
    s = po.compute_stats(po.compute_chain(spark.createDataFrame(rows, df.schema))).first()
    assert s.bottleneck_count == 1


def test_stored_waterfall_simple_and_lanes(spark):
    import json
    simple = json.dumps([{"label": "ORM", "ms": 200, "model": "a", "method": "read"},
                         {"label": "SQL", "ms": 500}, {"label": "SQL", "duration_ms": 100},
                         {"label": "Python", "ms": 200}])
    detailed = json.dumps([{"category": "orm", "duration_ms": 120, "start_ms": 0, "model": "m", "method": "x"},
                           {"category": "sql", "ms": 80, "start_ms": 10, "parent_id": "span-0"}])
    df = spark.createDataFrame([("s", simple, '[{"model": "a", "method": "read"}]'), ("d", detailed, None),
                                ("bad", "{not json", None)], "rec string, waterfall string, n1_patterns string")
    sp = po.stored_spans(df)
    s = {r.pos: r for r in sp.filter("rec = 's'").collect()}
    assert [s[i].start_ms for i in range(4)] == [0, 200, 700, 800] and s[0].is_n1
    d = {r.pos: r for r in sp.filter("rec = 'd'").collect()}
    assert (d[1].start_ms, d[1].depth, d[1].duration_ms) == (10, 1, 80)
    assert sp.filter("rec = 'bad'").count() == 0
    lanes = {r.category: r for r in po.waterfall_lanes(sp.filter("rec = 's'").withColumnRenamed("duration_ms", "ms"),
                                                        ["rec"]).collect()}
    assert (lanes["sql"].total_ms, lanes["sql"].pct, lanes["sql"].pos) == (600, 60.0, 0)


def test_greedy_chain_matches_fold_on_dense_keys(spark):
    from vantage.operators.chains import greedy_chain
    rnd = random.Random(21)
    rows, t = [], datetime(2024, 1, 1)
    for i in range(2000):
        t += timedelta(seconds=rnd.choice([5, 20, 60, 200, 700]))
        rows.append(("hot" if i % 3 else f"k{i % 7}", t, i))  # one key holds two thirds of the rows
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq long")
    got = {r.seq for r in greedy_chain(df, ["key"], "ts", "seq", "10 minutes").filter("kept").collect()}
    want = {r.seq for r in bo.cooldown_fold_local(df, ["key"], "ts", "10 minutes").collect()}
    assert got == want


def test_cooldown_with_a_hot_key(spark):
    rnd = random.Random(4)
    rows, t = [], datetime(2024, 1, 1)
    for i in range(600):
        t += timedelta(minutes=rnd.choice([1, 4, 9, 13]))
        rows.append(("hot" if i % 4 else "cold", t, i))
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq long")
    got = {r.seq for r in bo.cooldown_fold(df, ["key"], "ts", "10 minutes").collect()}
    want = {r.seq for r in bo.cooldown_fold_local(df, ["key"], "ts", "10 minutes").collect()}
    assert got == want


def test_login_lockout_distributed_equals_fold(spark):
    rnd = random.Random(8)
    rows, t = [], datetime(2024, 1, 1)
    for i in range(1500):
        t += timedelta(minutes=rnd.choice([0, 1, 2, 3, 7, 20]), seconds=rnd.choice([0, 11, 37]))
        ident = "bot" if i % 5 else f"u{i % 3}"  # one identifier holds most attempts
        rows.append((ident, i, t, rnd.random() < 0.08))
    df = spark.createDataFrame(rows, "identifier string, seq long, ts timestamp, success boolean")
    cols = ["identifier", "seq", "attempt", "locked", "locked_until"]
    got = {tuple(r) for r in to.login_lockout(df, "15 minutes", 5, "30 minutes").select(*cols).collect()}
    want = {tuple(r) for r in to.login_lockout_local(df, "15 minutes", 5, "30 minutes").select(*cols).collect()}
    assert got == want


def test_chains_with_ties_and_null_keys(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    offs = [0, 0, 30, 900, 900, 905, 1500]
    rows = [(k, t0 + dt.timedelta(seconds=s), i) for k in ("a", None) for i, s in enumerate(offs)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq long")
    got = sorted((r.key or "", r.seq) for r in bo.cooldown_fold(df, ["key"], "ts", "10 minutes").collect())
    assert got == sorted((k, s) for k in ("a", "") for s in (0, 3, 6))
    tries = spark.createDataFrame([(k, i, t, i == 4) for k, t, i in rows], "identifier string, seq long, ts timestamp, success boolean")
    one = {tuple(r) for r in to.login_lockout(tries, "15 minutes", 2, "30 minutes").collect()}
    assert one == {tuple(r) for r in to.login_lockout_local(tries.filter("identifier = 'a'"), "15 minutes", 2, "30 minutes").collect()} | {
        (None, *r[1:]) for r in one if r[0] == "a"}
