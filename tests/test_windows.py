"""Window operators against brute force on small inputs."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from vantage.operators import stats as st
from vantage.operators import windows as wo


def _events(spark, n=400, keys=3, seed=7):
    rnd = random.Random(seed)
    base = datetime(2024, 1, 1)
    rows, t = [], base
    for i in range(n):
        t = t + timedelta(seconds=rnd.choice([0, 1, 1, 2, 5, 30]))
        rows.append((i, t, f"k{rnd.randrange(keys)}"))
    return rows, spark.createDataFrame(rows, "seq long, ts timestamp, key string")


def test_flag_repeats_matches_brute_force(spark):
    rows, df = _events(spark)
    got = {r.seq: r.hit for r in wo.flag_repeats(df, ["key"], "10 seconds", 4, out_col="hit").collect()}
    for seq, ts, key in rows:
        n = sum(1 for s2, t2, k2 in rows if k2 == key and (t2, s2) <= (ts, seq) and t2 >= ts - timedelta(seconds=10))
        assert got[seq] == (n >= 4)


def test_window_count_open_left(spark):
    rows, df = _events(spark)
    got = {r.seq: r.n for r in wo.window_count(df, ["key"], "10 seconds", out_col="n", closed_left=False).collect()}
    for seq, ts, key in rows:
        n = sum(1 for s2, t2, k2 in rows if k2 == key and (t2, s2) <= (ts, seq) and t2 > ts - timedelta(seconds=10))
        assert got[seq] == n


def test_window_count_hot_key_is_spread(spark):
    """One key holds all rows, bursts share a timestamp, one row has no time: the counts are
    exact and the rows of one window lie in many slices."""
    rnd = random.Random(3)
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(milliseconds=rnd.choice([rnd.randrange(40_000), 7_000, 17_000])), "hot", f"x{i}")
            for i in range(500)]
    df = spark.createDataFrame([*rows, (500, None, "hot", "none"), (501, base, None, "nokey")],
                               "seq long, ts timestamp, key string, extra string")
    for closed in (True, False):
        got = {r.seq: (r.n, r.extra) for r in
               wo.window_count(df, ["key"], "10 seconds", out_col="n", closed_left=closed).collect()}
        assert len(got) == 502 and got[500] == (0, "none") and got[501] == (1, "nokey")
        for seq, ts, _, extra in rows:
            edge = ts - timedelta(seconds=10)
            n = sum(1 for s2, t2, _, _ in rows if (t2, s2) <= (ts, seq) and (t2 >= edge if closed else t2 > edge))
            assert got[seq] == (n, extra)
    plan = wo.window_count(df, ["key"], "10 seconds")._jdf.queryExecution().executedPlan().toString()
    by = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert by and all("_b#" in x or "_span#" in x for x in by)  # never by the key alone
    assert wo.window_count(df.limit(0), ["key"], "10 seconds").count() == 0


def test_rank_and_prev_in_group(spark):
    rows, df = _events(spark)
    w = Window.partitionBy("key").orderBy("ts", "seq")
    ref = df.withColumn("rn", F.row_number().over(w)).withColumn("p", F.lag("seq").over(w))
    want = {r.seq: (r.rn, r.p) for r in ref.collect()}
    r1 = {r.seq: r.rank for r in wo.rank_in_group(df, ["key"], ["ts", "seq"], bucket="1 minute").collect()}
    r2 = {r.seq: r.prev_seq for r in wo.prev_in_group(df, ["key"], ["ts", "seq"], ["seq"], bucket="1 minute").collect()}
    for s, (rn, p) in want.items():
        assert r1[s] == rn and r2[s] == p


def test_nearest_rank(spark):
    def p(vals, pct):
        df = spark.createDataFrame([("g", v) for v in vals], "g string, v int")
        r = st.nearest_rank(df, ["g"], "v", pct, "p").collect()
        return r[0]["p"] if r else None
    assert p([], 95) is None
    assert p([42], 95) == 42
    assert p([10, 20], 95) == 20
    assert p(list(range(1, 101)), 95) == 96
    assert p(list(range(1, 101)), 50) == 51


def test_nearest_rank_refines_ranges(spark):
    """Groups of many values are refined, few stay whole; lopsided, tied, negative and missing values."""
    rnd = random.Random(5)
    rows = [("wide", round(rnd.gauss(0, 100), 6)) for _ in range(3000)]
    rows += [("steep", float(10 ** rnd.uniform(-3, 12))) for _ in range(2000)]
    rows += [("tied", float(rnd.randrange(3))) for _ in range(500)] + [("one", 4.5), ("none", None), ("none", float("nan"))]
    rows += [(None, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, v double")
    for p in (0, 50, 95, 100):
        want = {}
        for g in ("wide", "steep", "tied", "one", None):
            vals = sorted(v for k, v in rows if k == g)
            want[g] = vals[min(p * len(vals) // 100, len(vals) - 1)]
        for leaf in (1, 20, 100_000):
            if leaf == 1 and p != 95:
                continue
            got = st.nearest_rank(df, ["g"], "v", p, "p", leaf=leaf).collect()
            assert {r.g: r.p for r in got} == want and len(got) == len(want)
    longs = spark.createDataFrame([("a", x) for x in (-2**63, -1, 0, 5, 2**63 - 1)], "g string, v long")
    assert st.nearest_rank(longs, ["g"], "v", 50, "p", leaf=1).first().p == 0


def test_window_stats_fixture(spark):
    t = datetime(2024, 1, 1, 0, 0, 1)
    rows = [(1, t, "env", "res.partner", "search_read", 10, False, "q1", "orm"),
            (2, t, "env", "res.partner", "search_read", 20, False, "", "orm"),
            (3, t, "env", "res.partner", "search_read", 50, True, "q3", "orm"),
            (4, t, "env", "product.product", "write", 5, False, "", "orm")]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, env_id string, model string, method string, "
                                     "duration_ms int, is_n1 boolean, sql string, category string")
    out = {r.model: r for r in st.window_stats(df, "30 seconds").collect()}
    assert len(out) == 2
    p = out["res.partner"]
    assert (p.call_count, p.total_ms, p.max_ms, p.avg_ms, p.n1_detected, p.sample_sql) == (3, 80, 50, 26.67, True, "q1")
    assert out["product.product"].sample_sql == ""


def test_counter_deltas(spark):
    rows = [("e", 1, 1, 100, 5000.0, 90.0), ("e", 1, 2, 110, 5500.0, 90.0), ("e", 2, 1, 100, 100.0, 3.0),
            ("e", 2, 2, 100, 100.0, 3.0)]
    df = spark.createDataFrame(rows, "env_id string, queryid int, poll_seq int, calls int, total_ms double, max_ms double")
    out = wo.counter_deltas(df, ["env_id", "queryid"]).collect()
    assert len(out) == 1 and out[0].delta_calls == 10 and out[0].avg_ms == 50
