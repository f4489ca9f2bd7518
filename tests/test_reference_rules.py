"""Rules that oracles written from the same reading could not see."""

import datetime as dt

from pyspark.sql import functions as F

from vantage.functions.scoring import impact_score
from vantage.operators import access as ac
from vantage.operators import n1 as n1ops
from vantage.operators.profiles import recording_patterns, waterfall_summary
from vantage.operators.sampling import draw
from vantage.operators.windows import counter_deltas


def test_delta_average_is_cut_towards_zero(spark):
    rows = [("q", 1, 10, 100.0, 7.9), ("q", 2, 13, 99.0, 7.9), ("q", 3, 15, 104.0, 9.0)]
    got = counter_deltas(spark.createDataFrame(rows, "k string, poll_seq int, calls long, total_ms double, max_ms double"), ["k"])
    # -1 ms over 3 calls is 0, so the largest call stands in
    assert {r.poll_seq: (r.avg_ms, r.duration_ms) for r in got.collect()} == {2: (0, 7), 3: (2, 2)}


def test_python_time_is_python_alone_and_patterns_keep_the_whole_sql(spark):
    long = "SELECT " + "x" * 300
    rows = [(1, 0, 5, "python", "m", "f", "", "", False, False), (1, 1, 7, "profiler", "m", "f", "", "", False, False),
            (1, 2, 3, "sql", "m", "f", long[:200] + "...", long, True, False)]
    spans = spark.createDataFrame(rows, "rec int, pos long, ms int, category string, model string, method string, sql string, "
                                        "full_sql string, is_n1 boolean, is_error boolean")
    assert waterfall_summary(spans, ["rec"]).first().python_ms == 5
    assert recording_patterns(spans, ["rec"]).first().sql == long


def test_peak_is_the_largest_window_total(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("e", t, "m", "f", 5, 100, 40, True, "s"), ("e", t + dt.timedelta(1), "m", "f", 5, 60, 50, True, "s")]
    stats = spark.createDataFrame(rows, "env_id string, period timestamp, model string, method string, call_count int, "
                                        "total_ms int, max_ms int, n1_detected boolean, sample_sql string")
    assert n1ops.n1_pattern_summary(stats).first().peak_ms == 100
    # recordings of another environment enrich nothing
    extra = spark.createDataFrame([("other", "m", "f", "x", "sig")], "env_id string, model string, method string, sample_sql string, signature string")
    scored = n1ops.score_patterns(n1ops.n1_pattern_summary(stats), extra)
    assert scored.count() == 1 and scored.first().signature == "s"


def test_no_overflow(spark):
    big = spark.createDataFrame([(9_000_000_000_000_000_000, 10**13, 10**6, 200)], "seq long, ms long, occ long, peak long")
    r = big.select(draw("seq").alias("d"), impact_score("ms", "occ", "peak").alias("s")).first()
    assert r.d == 9_000_000_000_000_000_000 * 2654435761 % 1_000_000 and r.s == 10**13 * 10**6 * 2 / 1000


def test_domain_rules(spark):
    frame = spark.createDataFrame([(r"a\b", 3)], "name string, n int")
    fields = {"name": ac.Val(F.col("name"), "str"), "n": ac.Val(F.col("n"), "num")}

    def holds(tree):
        return frame.select(ac.compile_domain(tree, fields, {}).alias("x")).first().x

    assert holds(("leaf", "missing", "child_of", 1)) is False
    assert holds(("leaf", "n", "not in", [ac.Ref("user.unknown"), 5])) is False
    assert holds(("leaf", "n", "not in", [5])) is True
    assert holds(("leaf", "name", "like", r"a\b")) is True and holds(("leaf", "name", "like", r"a\%")) is True
